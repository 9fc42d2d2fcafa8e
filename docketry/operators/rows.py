"""Row-set operators: duplicates, samples, splits, folds, grids. Each takes and returns DataFrames; orders are explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import key_order
from docketry.sources.staging import settle


def keep_unique(df: DataFrame, *key: str) -> DataFrame:
    """Rows whose key stands once; every row of a repeated key goes."""
    once = df.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    same = [F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}")) for k in key]
    return df.alias("__a").join(once.alias("__b"), same, "left_semi")


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an explicit order."""
    w = Window.partitionBy(*key).orderBy(*(c.desc() for c in order))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def repeated_rows(df: DataFrame) -> DataFrame:
    """Rows that stand more than once, with their number."""
    return df.groupBy(*df.columns).count().filter("count > 1")


def assert_unique(df: DataFrame) -> DataFrame:
    if not repeated_rows(df).isEmpty():
        raise ValueError("duplicate rows")
    return df


def sample_n(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """Exactly n rows in the fixed order of ``seed``; a distributed top-k, not a global sort."""
    return df.orderBy(key_order(seed, F.col(key)), F.col(key)).limit(n)


def sample_strata(df: DataFrame, stratum: str, key: str, sizes: dict[str, int] | int, seed: str, forced: list | None = None) -> DataFrame:
    """Up to so many rows of each stratum; strata without a size give none. Rows whose key is ``forced`` come first.

    The largest size is a literal limit, so each task keeps no more rows of a stratum before the shuffle.
    """
    first = [(~F.col(key).isin(forced)).cast("int")] if forced else []
    w = Window.partitionBy(stratum).orderBy(*first, key_order(seed, F.col(key)), F.col(key))
    most = sizes if isinstance(sizes, int) else max(sizes.values(), default=0)
    ranked = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    if not isinstance(sizes, int):
        ranked = ranked.filter(F.col("__r") <= F.coalesce(*(F.when(F.col(stratum) == k, F.lit(v)) for k, v in sizes.items()), F.lit(0)))
    return ranked.drop("__r")


def sample_strata_seeds(df: DataFrame, stratum: str, key: str, sizes: dict[str, int] | int, seeds: list[str]) -> DataFrame:
    """``sample_strata`` once for each seed, with the seed as a column: one scan, a row for each seed, ranked in one window."""
    seeded = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    w = Window.partitionBy("seed", stratum).orderBy(F.md5(F.concat("seed", F.lit(":"), F.col(key).cast("string"))), F.col(key))
    most = sizes if isinstance(sizes, int) else max(sizes.values(), default=0)
    ranked = seeded.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    if not isinstance(sizes, int):
        ranked = ranked.filter(F.col("__r") <= F.coalesce(*(F.when(F.col(stratum) == k, F.lit(v)) for k, v in sizes.items()), F.lit(0)))
    return ranked.drop("__r")


def complement(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_anti")


def folds(df: DataFrame, key: str, n: int = 5, seed: str = "42") -> DataFrame:
    """Fold numbers 1..n over a fixed shuffle; the first rows-mod-n folds have one row more.

    ``ntile`` over the whole set is one task; so rows are first numbered inside hash blocks of the order, and a block's
    offset, from a small table of block counts, gives the global number.
    """
    h = key_order(seed, F.col(key))
    blocked = df.withColumn("__h", h).withColumn("__b", F.substr("__h", F.lit(1), F.lit(3)))
    counts = blocked.groupBy("__b").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__o", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__t", F.sum("__c").over(Window.partitionBy(F.lit(1))))
    w = Window.partitionBy("__b").orderBy("__h", key)
    at = F.row_number().over(w) + F.col("__o") - 1
    size, extra = F.floor(F.col("__t") / n), F.col("__t") % n
    fold = F.when(at < extra * (size + 1), F.floor(at / (size + 1))).otherwise(extra + F.floor(F.try_divide(at - extra * (size + 1), size)))
    return blocked.join(F.broadcast(before), "__b").withColumn("fold", (fold + 1).cast("int")).drop("__h", "__b", "__c", "__o", "__t")


def running(df: DataFrame, by: list[str], order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with running sums by name, over the rows of the same ``by`` up to and with this one in ``order``; rows that tie in
    it follow one another in any fixed order.

    However large a group is, no task holds it: rows are dealt by ranges of (by, order) and written once, so that every later
    read sees the same parts. Each part sums its own rows; at most one group crosses from a part into the next, so the table of
    what stood before has no more rows than parts, and is broadcast.
    """
    named = df.withColumns({f"__{k}": F.coalesce(c, F.lit(0)) for k, c in sums.items()} | {"__tie": F.monotonically_increasing_id()})
    place = [*map(F.col, by), *order, F.col("__tie")]
    dealt = named.repartitionByRange(*place).sortWithinPartitions(*place).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    dealt = settle(dealt.drop("__tie"), "running")
    totals = dealt.groupBy("__p", *by).agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *by, *(F.sum(f"__{k}").over(earlier).alias(f"__b_{k}") for k in sums)).filter(F.col(f"__b_{next(iter(sums))}").isNotNull())
    own = Window.partitionBy("__p", *by).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({k: F.sum(f"__{k}").over(own) for k in sums}).alias("__l")
    same = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.{k}")) for k in ("__p", *by)]
    both = local.join(F.broadcast(before.alias("__r")), same, "left")
    kept = [F.col(f"__l.{c}") for c in df.columns if c not in sums]
    return both.select(*kept, *((F.col(f"__l.{k}") + F.coalesce(F.col(f"__b_{k}"), F.lit(0))).alias(k) for k in sums))


def number_rows(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 by key, without one task for all rows."""
    return running(df, [], [F.col(key)], **{name: F.lit(1).cast("long")})


def group_folds(df: DataFrame, group: str, n: int = 5, seed: str = "42") -> DataFrame:
    """Folds 1..n with all rows of a group in one; the folds' numbers of rows differ by no more than the largest group's.

    Groups never leave the executors. Of each size, groups are dealt in turn by their place in a fixed shuffle; what is left of
    a size (fewer than n groups) goes to the folds with the fewest rows so far, from the largest size to the smallest. That
    takes the histogram of sizes only: at most sqrt(2 rows) entries.
    """
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__c"))
    histogram = sorted(((r["__c"], r["m"]) for r in sizes.groupBy("__c").agg(F.count("*").alias("m")).collect()), reverse=True)
    loads, rest = [0] * n, []
    for c, m in histogram:
        least = sorted(range(n), key=lambda f: (loads[f], f))[: m % n]
        for f in range(n):
            loads[f] += m // n * c + (c if f in least else 0)
        rest.append((c, m - m % n, [f + 1 for f in least]))
    plan = df.sparkSession.createDataFrame(rest, "__c long, __even long, __rest array<int>")
    at = running(sizes, ["__c"], [key_order(seed, F.col("__g")), F.col("__g")], __at=F.lit(1).cast("long"))
    fold = F.when(F.col("__at") <= F.col("__even"), F.pmod(F.col("__at") - 1, F.lit(n)) + 1).otherwise(F.get("__rest", (F.col("__at") - F.col("__even") - 1).cast("int")))
    dealt = at.join(plan, "__c").select("__g", fold.cast("int").alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of parameter values, keys sorted, the last key fastest; a handful of literal rows."""
    tables = [spark.createDataFrame([(i, v) for i, v in enumerate(values[k])], f"__{k} int, {k} {'string' if isinstance(values[k][0], str) else 'boolean' if isinstance(values[k][0], bool) else 'int'}") for k in sorted(values)]
    return reduce(lambda a, b: a.crossJoin(b), tables)
