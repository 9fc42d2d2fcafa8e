"""Exact scans of all pairs of query and item vectors, in blocks: a matrix product shows which pairs can count, and those are
computed anew as a plain loop sums them, from the first entry to the last.

Squared distances are rounded to six places, halves up. Their order: numbers, infinity, NaN, and last pairs without a distance
(a vector is null, holds a null, or the two differ in length); then ids, null last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and items of one matrix product: 4 MB of distances.
QUERIES, ITEMS = 512, 1024
#: Pairs that wait before each query's k best are picked from them.
PENDING = 100_000
#: Relevant items times queries of one group in ``average_precision``, at some 30 bytes each.
ENTRIES = 6_000_000
#: Orders of pairs whose distance is infinite, not a number, or missing.
INFINITE, NAN, NONE = 1e306, 1e307, 1e308


def whole(v: str) -> Column:
    """A vector in doubles; null if it holds a null."""
    return F.when(F.forall(v, lambda x: x.isNotNull()), F.col(v).cast("array<double>"))


class Vectors:
    """Rows of one width; ``fine`` are those whose entries are all finite, ``there`` those that have this width at all. The few of
    ``other`` widths are compared by themselves."""

    def __init__(self, lists: pa.Array, width: int | None = None):
        n = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        self.width = width if width is not None else int(np.bincount(n[n >= 0]).argmax()) if (n >= 0).any() else 0
        self.there = n == self.width
        self.rows = np.zeros((len(n), self.width))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.rows[self.there] = flat[np.repeat(self.there[n >= 0], n[n >= 0])].reshape(int(self.there.sum()), self.width)
        self.other = {int(i): np.asarray(lists[int(i)].as_py(), np.float64) for i in np.flatnonzero((n >= 0) & ~self.there)}
        self.fine = self.there & np.isfinite(self.rows).all(axis=1)
        clean = np.where(self.fine[:, None], self.rows, 0.0)
        self.squares = (clean * clean).sum(axis=1)
        one = np.ones(len(n))
        self.left = np.column_stack((-2 * clean, self.squares, one))
        self.right = np.column_stack((clean, one, self.squares))


def near(a: Vectors, rows: slice, b: Vectors, columns: slice) -> tuple[np.ndarray, float]:
    """Squared distances, infinite where one is not fine, and how far they may be off."""
    d = a.left[rows] @ b.right[columns].T
    d[~a.fine[rows]] = np.inf
    d[:, ~b.fine[columns]] = np.inf
    most = float(a.squares[rows].max(initial=0.0) + b.squares[columns].max(initial=0.0))
    return d, 4e-16 * (a.width + 8) * 2 * most


def exact(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """The order of pairs: squared distances in millionths, rounded, or INFINITE, NAN or NONE."""
    d = np.zeros(len(i))
    with np.errstate(invalid="ignore", over="ignore"):
        for x, y in zip(a.rows.T, b.rows.T, strict=True):
            off = x[i] - y[j]
            d += off * off
        same = a.there[i] & b.there[j]
        for at in np.flatnonzero(~same) if a.other and b.other else ():
            x, y = a.other.get(int(i[at])), b.other.get(int(j[at]))
            if x is not None and y is not None and len(x) == len(y):
                same[at], d[at] = True, sum((u - v) * (u - v) for u, v in zip(x, y, strict=True))
        d *= 1e6
    return np.where(same, ordered(d), NONE)


def ordered(d: np.ndarray) -> np.ndarray:
    """Millionths rounded, halves up."""
    down = np.floor(d)
    with np.errstate(invalid="ignore"):
        up = down + (d - down >= 0.5)
    return np.where(np.isnan(d), NAN, np.where(d < INFINITE, up, INFINITE))


def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of ids as an array, and which are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(column.type):
        return column.fill_null(0).to_numpy(zero_copy_only=False), null
    return np.array(["" if x is None else x for x in column.to_pylist()], object), null


class _Best:
    """The k best of each query so far: by order, then by id or group; of a group only its best."""

    def __init__(self, n: int, k: int, grouped: bool):
        self.n, self.k, self.grouped, self.kth = n, k, grouped, np.full(n, np.inf)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *found: np.ndarray) -> None:
        """Queries, orders, ids and whether those are null."""
        self.kept.append(found)
        self.size += len(found[0])

    def pick(self) -> tuple[np.ndarray, ...]:
        q, d, key, null = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        code = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        order = np.lexsort((code, null, d, q))
        if self.grouped:  # the first of each query and group, in this order
            by = order[np.lexsort((code[order], null[order], q[order]))]  # stable: a group's best comes first
            new = np.ones(len(by), bool)
            new[1:] = (q[by][1:] != q[by][:-1]) | (code[by][1:] != code[by][:-1]) | (null[by][1:] != null[by][:-1])
            first = np.zeros(len(q), bool)
            first[by[new]] = True
            order = order[first[order]]
        n = np.bincount(q[order], minlength=self.n)
        start = np.cumsum(n) - n
        order = order[np.arange(len(order)) - start[q[order]] < self.k]
        best = q[order], d[order], key[order], null[order]
        full = np.flatnonzero(n >= self.k)
        last = best[1][np.cumsum(np.minimum(n, self.k))[full] - 1]
        self.kth[full] = np.where(last < INFINITE, last, np.inf)
        self.kept, self.size = [best], len(order)
        return best


def _search(held, k: int, grouped: bool, kinds: list[pa.DataType]):
    """Each task's k best of every query."""

    def run(batches):
        names, lists, before = held.value
        own = Vectors(lists)
        blocks = [slice(a, min(a + QUERIES, len(own.rows))) for a in range(0, len(own.rows), QUERIES)]
        best = [_Best(b.stop - b.start, k, grouped) for b in blocks]
        step = 64  # few items first: they give a k-th distance to what follows
        for batch in batches:
            items = Vectors(batch.column("v"), own.width)
            key, null = keys(batch.column("key"))
            when = batch.column("ts").to_numpy()
            a = 0
            while a < len(batch):
                part = slice(a, min(a + step, len(batch)))
                for block, here in zip(blocks, best, strict=True):
                    d, off = near(own, block, items, part)
                    able = d <= np.where(own.fine[block], (here.kth + 1) / 1e6 + off, np.inf)[:, None]
                    if before is not None:
                        able &= when[None, part] < before[block, None]
                    i, j = np.divmod(np.flatnonzero(able), able.shape[1])
                    if len(i):
                        order = exact(own, i + block.start, items, j + a)
                        some = order <= here.kth[i]
                        i, j = i[some], j[some] + a
                        here.add(i, order[some], key[j], null[j])
                        if step < ITEMS or here.size > PENDING:
                            here.pick()
                a, step = part.stop, min(2 * step, ITEMS)
        for block, here in zip(blocks, best, strict=True):
            if here.kept:
                q, order, key, null = here.pick()
                d = np.where(order < INFINITE, order / 1e6, np.where(order == INFINITE, np.inf, np.nan))
                columns = [names.take(pa.array(q + block.start)), pa.array(key, kinds[1], mask=null), pa.array(d, mask=order == NONE)]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "key", "d"])

    return run


def nearest(queries: DataFrame, items: DataFrame, k: int, grouped: bool, dated: bool) -> DataFrame:
    """(q, key, d, rank) of a stated set ``queries(q, v[, ts])``, which fits a task, among ``items(key, v[, ts])``."""
    spark = items.sparkSession
    ts = [F.col("ts") if dated else F.lit(0).cast("long").alias("ts")]
    queries, items = queries.select("q", whole("v").alias("v"), *ts), items.select("key", whole("v").alias("v"), *ts)
    if dated:
        queries, items = queries.filter("ts is not null"), items.filter("ts is not null")
    kind = f"q {dict(queries.dtypes)['q']}, key {dict(items.dtypes)['key']}, d double"
    asked = queries.toArrow().combine_chunks()
    part = lambda name: asked.column(name).combine_chunks()
    before = part("ts").to_numpy() if dated else None
    kinds = [asked.schema.field("q").type, items.select("key").limit(0).toArrow().schema.field("key").type]
    if not len(asked):
        return spark.createDataFrame([], kind + ", rank int")
    held = spark.sparkContext.broadcast((part("q"), part("v"), before))
    found = items.mapInArrow(_search(held, k, grouped, kinds), kind)
    found = found.groupBy("q", "key").agg(F.min("d").alias("d")) if grouped else found
    w = Window.partitionBy("q").orderBy(F.col("d").asc_nulls_last(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Group:
    """Some queries and some of the items that are relevant to them: how many items come before each of those, by query."""

    def __init__(self, queries: Vectors, names: np.ndarray, items: Vectors, ids: np.ndarray):
        self.queries, self.names = queries, names
        self.ids = np.unique(ids)
        order_of = np.searchsorted(self.ids, ids, "right")
        self.lists = []
        for q in range(len(names)):
            d = _row(queries, q, items)
            order = np.lexsort((order_of, d))
            order = order[ids[order] != names[q]]
            d = d[order]
            run = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]).astype(np.int64)))) if len(d) else np.zeros(0, np.int64)
            self.lists.append((d, run * (len(self.ids) + 2) + order_of[order], np.zeros(len(d) + 1, np.int32), np.zeros(len(d) + 1, np.int32)))

    def count(self, items: Vectors, ids: np.ndarray, relevant: np.ndarray) -> None:
        for q, (d, runs, every, own) in enumerate(self.lists):
            if not len(d):
                continue
            x = _row(self.queries, q, items)
            at = np.searchsorted(d, x, "right")
            tied = np.flatnonzero(d[np.maximum(at - 1, 0)] == x)
            if len(tied):
                run = runs[at[tied] - 1] // (len(self.ids) + 2)
                at[tied] = np.searchsorted(runs, run * (len(self.ids) + 2) + np.searchsorted(self.ids, ids[tied], "right"), "right")
            other = ids != self.names[q]
            every += np.bincount(at[other], minlength=len(every)).astype(np.int32)
            own += np.bincount(at[other & relevant], minlength=len(own)).astype(np.int32)

    def sums(self):
        """Of each query: the sum of precisions at these items, and their number."""
        for name, (d, _, every, own) in zip(self.names, self.lists, strict=True):
            before, seen = np.cumsum(every[:-1], dtype=np.int64), np.cumsum(own[:-1], dtype=np.int64)
            yield int(name), float(((seen + 1) / (before + 1)).sum()), len(d)


def _row(queries: Vectors, q: int, items: Vectors) -> np.ndarray:
    """Orders of all ``items`` for one query: from the product, but anew where that can't tell how they round."""
    d, off = near(queries, slice(q, q + 1), items, slice(None))
    d, off = np.maximum(d[0], 0) * 1e6, off * 1e6
    fine = np.isfinite(d)
    part = np.where(fine, d, 0.0) - np.floor(np.where(fine, d, 0.0))
    unsure = np.flatnonzero(~fine | (np.abs(part - 0.5) <= off))
    out = ordered(d)
    out[unsure] = exact(queries, np.full(len(unsure), q), items, unsure)
    return out


def _precisions(batches):
    """Rows come by group: its queries (step 0), the relevant items that are its own (1), all items (2)."""
    at, queries, mine, group = None, [], [], None

    def close():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*group.sums(), strict=True), (pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["q", "s", "n"])

    def stacked(rows):
        lists = pa.concat_arrays([r.column("v") for r in rows])
        return lists, np.concatenate([r.column("id").to_numpy() for r in rows])

    for batch in batches:
        number, step = batch.column("g").to_numpy(), batch.column("step").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(number) != 0) | (np.diff(step) != 0)) + 1, [len(batch)])) if len(batch) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = batch.slice(a, b - a)
            if at != number[a]:
                if group:
                    yield close()
                at, queries, mine, group = number[a], [], [], None
            if step[a] < 2:
                (queries if step[a] == 0 else mine).append(rows)
                continue
            if not queries or not mine:
                continue
            if group is None:
                lists, names = stacked(queries)
                own = Vectors(lists)
                lists, ids = stacked(mine)
                group = _Group(own, names, Vectors(lists, own.width), ids)
            group.count(Vectors(rows.column("v"), group.queries.width), rows.column("id").to_numpy(), rows.column("rel").to_numpy(zero_copy_only=False))
    if group:
        yield close()


def average_precision(queries: DataFrame, items: DataFrame, entries: int | None = None) -> DataFrame:
    """(q, ap) of ``queries(q, v, label)``: the mean, at items of the same label, of precision so far, over ``items(id, v, label)``
    ranked by distance, then id. An item with the query's own id is no item; a query without a relevant item has no row. ids are long.

    No pair of query and item is ever a row. A group is some queries of one label with a share of the items of that label, at
    most ``entries`` pairs; all items go to each group, which counts those before each of its own.
    """
    spark = items.sparkSession
    entries = entries or ENTRIES
    sizes = items.filter("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    asked = queries.groupBy("label").agg(F.count("*").alias("m"))
    at_once = max(1, 3 * spark.sparkContext.defaultParallelism)
    m = F.sum("m").over(Window.partitionBy(F.lit(1)))
    # shares of a label's items while one query has more than ``entries`` of them; chunks of its queries for the rest
    shares = F.ceil(F.col("n") / entries)
    fit = F.least(F.floor(entries * shares / F.col("n")), F.greatest(F.ceil(m / at_once), F.lit(1)))
    plan = asked.join(sizes, "label").select("label", shares.alias("shares"), F.ceil(F.col("m") / fit).alias("chunks"))
    vector = lambda df, key: df.select(F.col(key).alias("id"), whole("v").cast("array<float>" if dict(df.dtypes)["v"] == "array<float>" else "array<double>").alias("v"), "label")
    queries, items = vector(queries, "q"), vector(items, "id")
    number = lambda chunk, share: F.xxhash64("label", chunk, share)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    of = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(count))
    groups = plan.select("label", every("chunks").alias("chunk"), "shares").select("label", "chunk", every("shares").alias("share")).select(number("chunk", "share").alias("g"), F.col("label").alias("own"))
    dealt = queries.join(F.broadcast(plan), "label").withColumn("chunk", of("chunks", 1)).withColumn("share", every("shares")).select(number("chunk", "share").alias("g"), F.lit(0).alias("step"), F.lit(True).alias("rel"), "id", "v")
    mine = items.join(F.broadcast(plan), "label").withColumn("share", of("shares", 2)).withColumn("chunk", every("chunks")).select(number("chunk", "share").alias("g"), F.lit(1).alias("step"), F.lit(True).alias("rel"), "id", "v")
    rest = items.crossJoin(F.broadcast(groups)).select("g", F.lit(2).alias("step"), F.coalesce(F.col("label") == F.col("own"), F.lit(False)).alias("rel"), "id", "v")
    rows = dealt.unionByName(mine).unionByName(rest).repartition(max(at_once, int(spark.conf.get("spark.sql.shuffle.partitions"))), "g").sortWithinPartitions("g", "step")
    sums = rows.mapInArrow(_precisions, "q long, s double, n long").groupBy("q").agg((F.sum("s") / F.sum("n")).alias("ap"))
    return sums.filter("ap is not null")
