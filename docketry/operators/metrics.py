"""Scores of predictions: everything starts from small counted tables, so only one shuffle of the predictions is made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.rows import running
from docketry.sources.staging import settle


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(t, p, n)."""
    return df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Shares of each true label's row."""
    return confusion(df, truth, predicted).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("t")))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, tp, n_true, n_pred, precision, recall, f1) over the union of labels; 0 where undefined."""
    c = confusion(df, truth, predicted)
    rows = c.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("n_true"), F.lit(0).alias("n_pred")).union(
        c.select(F.col("p"), F.lit(0), F.lit(0), F.col("n"))
    )
    k = rows.groupBy("label").agg(*(F.sum(x).alias(x) for x in ("tp", "n_true", "n_pred")))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    k = k.withColumns({"precision": zero(F.col("tp"), F.col("n_pred")), "recall": zero(F.col("tp"), F.col("n_true"))})
    return k.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return per_class(df, truth, predicted).agg(*(F.avg(x).alias(x) for x in ("precision", "recall", "f1")))


def mcc(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Multi-class Matthews correlation; 0 if its denominator is."""
    d = lambda x: F.col(x).cast("double")
    s = per_class(df, truth, predicted).agg(F.sum(d("tp")).alias("c"), F.sum(d("n_true")).alias("s"), F.sum(d("n_true") * d("n_pred")).alias("tp"), F.sum(d("n_true") * d("n_true")).alias("tt"), F.sum(d("n_pred") * d("n_pred")).alias("pp"))
    below = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select(F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), F.nullif(below, F.lit(0.0))), F.lit(0.0)).alias("mcc"))


def set_prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Means of each row's set precision and recall (0 where undefined), and the harmonic mean of the means."""
    hit = F.size(F.array_intersect(truth, predicted))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    means = df.agg(F.avg(zero(hit, F.size(F.array_distinct(predicted)))).alias("precision"), F.avg(zero(hit, F.size(F.array_distinct(truth)))).alias("recall"))
    return means.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def average_precision(df: DataFrame, query: str, score: str, relevant: str, tie: str) -> DataFrame:
    """Of each query: the mean, at relevant items, of precision so far; by score descending, then ``tie``. No task holds a query's list."""
    kept = df.select(query, score, F.col(relevant).cast("long").alias("__rel"), tie)
    r = running(kept, [query], [F.col(score).desc(), F.col(tie)], __rank=F.lit(1).cast("long"), __seen=F.col("__rel"))
    return r.filter(F.col("__rel") == 1).groupBy(query).agg(F.avg(F.col("__seen") / F.col("__rank")).alias("ap"))


def binary_by_fold(df: DataFrame, fold: str, score: str, label: str) -> DataFrame:
    """Of each fold of scored pairs (``label`` 1 or 0): (fold, n, positives, ap, f1, f1_threshold, accuracy, accuracy_threshold).

    Equal scores are one step: the sweep accepts all of them or none. ``ap`` sums, over steps from the highest score, the gain in
    recall times precision. ``f1`` and ``accuracy`` are the best over steps (the first of equals), each with the threshold half
    way to the next lower score, or the score itself at the last step. A fold without positives has no ap (null) and an f1 of
    0; rows with a null score or label don't count. Steps are counted first, and their running sums come from range
    partitions: a fold may hold any number of rows.
    """
    steps = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(fold).alias("fold"), F.col(score).cast("double").alias("s")).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("p"))
    whole = steps.groupBy("fold").agg(F.sum("c").alias("n"), F.sum("p").alias("positives"))
    swept = running(steps, ["fold"], [F.col("s").desc()], taken=F.col("c"), tp=F.col("p"))
    both = swept.alias("a").join(whole.alias("b"), F.col("a.fold").eqNullSafe(F.col("b.fold"))).select("a.*", "n", "positives")
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("taken") + F.col("positives"))).otherwise(0.0)
    right = (2 * F.col("tp") - F.col("taken") + F.col("n") - F.col("positives")) / F.col("n")
    gain = F.try_divide(F.col("p") * F.col("tp"), F.col("positives") * F.col("taken"))
    first = lambda value: F.max(F.struct(value.alias("v"), F.col("s")))  # noqa: E731  the highest score of those with the best value
    best = both.groupBy("fold").agg(F.max("n").alias("n"), F.max("positives").alias("positives"), F.sum(gain).alias("ap"), first(f1).alias("f"), first(right).alias("r"))
    below = lambda c: F.max(F.when(F.col("s") < F.col(f"b.{c}.s"), F.col("s")))
    under = steps.alias("a").join(best.alias("b"), F.col("a.fold").eqNullSafe(F.col("b.fold"))).groupBy(F.col("a.fold").alias("fold")).agg(below("f").alias("fu"), below("r").alias("ru"))
    half = lambda c, u: (F.col(f"{c}.s") + F.coalesce(u, F.col(f"{c}.s"))) / 2
    out = best.alias("b").join(under.alias("u"), F.col("b.fold").eqNullSafe(F.col("u.fold")))
    return out.select("b.fold", "n", "positives", "ap", F.col("f.v").alias("f1"), half("f", F.col("fu")).alias("f1_threshold"), F.col("r.v").alias("accuracy"), half("r", F.col("ru")).alias("accuracy_threshold"))


def _inversions(y: np.ndarray, w: np.ndarray) -> int:
    """The weight of pairs i < j with y[i] > y[j]: merges of sorted halves, counted by binary search."""
    if len(y) <= 64:
        return int((np.triu(y[:, None] > y[None, :], 1) * np.outer(w, w)).sum())
    half = len(y) // 2
    order = np.argsort(y[:half], kind="stable")
    sums = np.concatenate(([0], np.cumsum(w[:half][order])))
    above = sums[-1] - sums[np.searchsorted(y[:half][order], y[half:], "right")]
    return int((above * w[half:]).sum()) + _inversions(y[:half], w[:half]) + _inversions(y[half:], w[half:])


#: Blocks an axis is cut into: the table of rows by two blocks has at most (2 BLOCKS)^2 entries and is merged on the driver.
BLOCKS = 512


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, pearson, spearman, kendall) of two columns, over rows where both are there; null where a column is constant.

    Spearman's are the mean ranks of ties, from running sums of distinct values. Kendall's is tau-b. Its discordant pairs are
    merged from blocks: values are cut into BLOCKS blocks of rows on both axes; the table of rows by (block of x, block of y)
    gives the pairs whose blocks differ on both axes; pairs that share a block are counted inside it, by merging. A value of
    more rows than a block has one for itself, in which no pair is discordant and which isn't gathered. So a task holds n /
    BLOCKS distinct pairs with their numbers, 24 bytes each.
    """
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("w"))
    n = d.agg(F.sum("w")).first()[0] or 0
    block = -(-n // BLOCKS) or 1
    start, c = F.col("start"), F.col("c")
    cells = d
    for v in ("x", "y"):
        counts = d.groupBy(v).agg(F.sum("w").alias("c"))
        upto = running(counts, [], [F.col(v)], upto=c).withColumn("start", F.col("upto") - c)
        own = 2 * F.floor(start / block) + (c > block).cast("int")
        cells = cells.join(upto.select(v, c.alias(f"c{v}"), (start + (c + 1) / 2).alias(f"r{v}"), own.alias(f"b{v}")), v)
    cells = settle(cells, "correlations")
    whole = lambda v: F.sum(F.col("w") * F.col(v))
    means = cells.agg(*((whole(v) / n).alias(f"m_{v}") for v in ("x", "y", "rx", "ry"))).first() if n else {}
    middle = lambda v: F.col(v) - F.lit(means[f"m_{v}"] if n else 0.0)
    moments = [F.sum(F.col("w") * middle(k + a) * middle(k + b)).alias(f"{k}{a}{b}") for k in ("", "r") for a, b in ("xx", "xy", "yy")]
    ties = [F.sum((F.col("w") * (F.col(f"c{v}") - 1)).cast("double")).alias(f"t{v}") for v in ("x", "y")]
    sums = cells.agg(*moments, *ties, F.sum((F.col("w") * (F.col("w") - 1)).cast("double")).alias("tb"))

    def inside(name: str, *keys: str) -> DataFrame:
        """Discordant pairs inside each block, or cell of two blocks, that holds more than one value."""

        def count(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["x", "y"])
            return pd.DataFrame({"d": [_inversions(frame["y"].to_numpy(), frame["w"].to_numpy())]})

        mixed = cells.filter(sum(F.pmod(F.col(k), F.lit(2)) for k in keys) == 0).select("x", "y", "w", *keys)
        return mixed.groupBy(*keys).applyInPandas(count, "d long").agg(F.coalesce(F.sum("d"), F.lit(0)).alias(name))

    table = cells.groupBy("bx", "by").agg(F.sum("w").alias("w")).toPandas()
    grid = np.zeros((2 * BLOCKS + 2, 2 * BLOCKS + 2), np.int64)
    grid[table["bx"], table["by"]] = table["w"]
    seen = np.cumsum(grid, axis=0) - grid  # rows in blocks of x before
    higher = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1] - seen  # of those, the ones in blocks of y above
    apart = float((grid.astype(np.float64) * higher).sum())
    every = sums.crossJoin(inside("dx", "bx")).crossJoin(inside("dy", "by")).crossJoin(inside("db", "bx", "by"))  # one row each
    discordant = F.lit(apart) + F.col("dx") + F.col("dy") - F.col("db")
    pairs = F.lit(float(n) * (n - 1) / 2)
    root = lambda a, b: F.nullif(F.sqrt(a * b), F.lit(0.0))
    tau = F.try_divide(pairs - (F.col("tx") + F.col("ty") - F.col("tb")) / 2 - 2 * discordant, root(pairs - F.col("tx") / 2, pairs - F.col("ty") / 2))
    of = lambda k: F.try_divide(F.col(f"{k}xy"), root(F.col(f"{k}xx"), F.col(f"{k}yy")))
    return every.select(F.lit(n).cast("long").alias("n"), of("").alias("pearson"), of("r").alias("spearman"), tau.alias("kendall"))


def at_k(df: DataFrame, query: str, rank: str, relevant: str, k: int) -> DataFrame:
    """recall and precision at k of each query with a relevant item."""
    hit = F.sum(F.when(F.col(rank) <= k, F.col(relevant)).otherwise(0))
    return df.groupBy(query).agg(F.try_divide(hit, F.sum(relevant)).alias("recall"), (hit / F.lit(k)).alias("precision"))
