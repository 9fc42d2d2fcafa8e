"""Exact nearest-neighbour search over cells, with or without a date before which items must lie.

Index. Up to PIVOTS centres (the square root of the number of items, or the cube root where dates cut the cells further) are
fitted on a bounded sample by a few rounds of k-means on the driver; every item belongs to its nearest centre's cell. A cell's items, in order of date (or of distance to the centre, where there are no dates), are cut into blocks;
a block keeps its number of items, the least and the greatest distance to the centre, and its least date. The table of blocks
has at most BLOCKS rows for any number of items; ``save`` and ``load`` keep the index.

Search. Items are scanned where they lie and never shuffled: a stated query set goes to the tasks, QUERIES at a time, with its
distances to the centres. No item of a block can be nearer to a query than

    max(d(q, centre) - greatest, least - d(q, centre), (d(q, centre)^2 - d(q, nearest centre)^2) / (2 d(centre, nearest centre))).

A query skips every block for which that exceeds its k-th distance so far, and every block that begins at or after its date. The
first k-th distance comes from the sample (its rows are items); each block that is searched tightens it for the blocks that
follow in the task. With groups, the k-th best group counts. What is left is ranked by Spark; results equal a full scan's.

Uniform directions in many dimensions leave little to skip, whatever the cells; ``share`` tells how many pairs were computed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators.rows import running
from docketry.sources.staging import settle

PIVOTS, SAMPLE, BLOCKS, BLOCK, QUERIES = 512, 8192, 65_536, 1024, 2048
#: Squared distances are rounded to six places before they are ranked, so what is kept reaches as far beyond the k-th.
SLACK = 2e-6
_LAST = np.iinfo(np.int64).max


@dataclass
class Cells:
    """``items(id, v, grp, ts, cell, block)`` by cell and block; ``blocks`` as numbers; centres; a sample of items."""

    items: DataFrame
    blocks: pd.DataFrame
    centres: np.ndarray
    sample: pd.DataFrame
    grouped: bool
    dated: bool


def moment(df: DataFrame, name: str) -> Column:
    """A date or time as a whole number."""
    kind = dict(df.dtypes)[name]
    return F.unix_date(name).cast("long") if kind == "date" else F.unix_micros(F.col(name).cast("timestamp")) if kind.startswith("timestamp") else F.col(name).cast("long")


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _stack(lists) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in lists]) if len(lists) else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _centres(sample: np.ndarray, n: int) -> np.ndarray:
    """k-means on the sample, from its first n distinct rows; a centre that loses its rows stays where it was."""
    at = np.unique(sample, axis=0, return_index=True)[1]
    centres = sample[np.sort(at)[:n]].copy()
    for _ in range(6):
        home = _squared(sample, centres).argmin(axis=1)
        for c in np.unique(home):
            centres[c] = sample[home == c].mean(axis=0)
    return centres


def build(items: DataFrame, group: str | None = None, ts: str | None = None) -> Cells:
    """The index over ``items(id, v[, group][, ts])``. Rows without a vector, or without a date or group where asked for, are no items."""
    kept = items.filter(F.col("v").isNotNull())
    kept = kept.filter(F.col(ts).isNotNull()) if ts else kept
    kept = kept.filter(F.col(group).isNotNull()) if group else kept
    kept = kept.select("id", F.col("v").cast("array<double>").alias("v"), (F.col(group) if group else F.col("id")).alias("grp"), (moment(items, ts) if ts else F.lit(0).cast("long")).alias("ts"))
    n = kept.count()
    few = kept.orderBy(F.xxhash64(F.lit("cells"), "id"), "id").limit(max(1, min(SAMPLE, n // 16))).toPandas() if n else kept.limit(0).toPandas()
    points = _stack(few["v"])
    centres = _centres(points, max(1, min(PIVOTS, round(n ** (1 / 3 if ts else 1 / 2))))) if n else np.zeros((1, 1))
    held = items.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            d = _squared(_rows(batch.column("v")), held.value) if len(batch) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(np.sqrt(d.min(axis=1)))], names=[*batch.schema.names, "cell", "r"])

    kinds = ", ".join(f"{name} {kind}" for name, kind in kept.dtypes)
    dealt = running(kept.mapInArrow(assign, f"{kinds}, cell int, r double"), ["cell"], [F.col("ts" if ts else "r"), F.col("id")], at=F.lit(1).cast("long"))
    size = max(BLOCK if n > 64 * BLOCK else 32, -(-2 * n // BLOCKS))
    dealt = settle(dealt.withColumn("block", F.floor((F.col("at") - 1) / size).cast("int")).drop("at").repartitionByRange("cell", "block").sortWithinPartitions("cell", "block"), "cells")
    blocks = dealt.groupBy("cell", "block").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.min("ts").alias("ts")).toPandas()  # at most BLOCKS and the centres
    return Cells(dealt, blocks.sort_values(["cell", "block"], ignore_index=True), centres, few, group is not None, ts is not None)


def save(index: Cells, folder: str) -> None:
    spark = index.items.sparkSession
    index.items.write.mode("overwrite").parquet(f"{folder}/items")
    spark.createDataFrame(index.blocks).write.mode("overwrite").parquet(f"{folder}/blocks")
    spark.createDataFrame([(i, [float(x) for x in c], index.grouped, index.dated) for i, c in enumerate(index.centres)], "i int, v array<double>, grouped boolean, dated boolean").write.mode("overwrite").parquet(f"{folder}/centres")
    spark.createDataFrame(index.sample.assign(v=[list(map(float, v)) for v in index.sample["v"]]), index.items.select(*index.sample.columns).schema).write.mode("overwrite").parquet(f"{folder}/sample")


def load(spark: SparkSession, folder: str) -> Cells:
    part = lambda name: spark.read.parquet(f"{folder}/{name}")
    rows = sorted(part("centres").collect(), key=lambda r: r["i"])
    return Cells(part("items"), part("blocks").toPandas().sort_values(["cell", "block"], ignore_index=True), np.array([r["v"] for r in rows]), part("sample").toPandas(), rows[0]["grouped"], rows[0]["dated"])


class _Asked:
    """A block of queries as tasks see it: distances to centres, k-th squared distances, dates."""

    def __init__(self, q: list, v: np.ndarray, before: np.ndarray, k: int, index: Cells):
        self.q, self.v, self.before, self.k = q, v, before, k
        d2 = _squared(v, index.centres)
        self.to_centre, near = np.sqrt(d2), d2.argmin(axis=1)
        between = np.sqrt(_squared(index.centres, index.centres))[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d2 - d2.min(axis=1, keepdims=True)) / (2 * between)
        self.plane = np.where(between > 1e-9, plane, 0.0)
        sample, when = _stack(index.sample["v"]), index.sample["ts"].to_numpy(np.int64)
        codes = pd.factorize(index.sample["grp"])[0]
        self.kth = np.full(len(q), np.inf)
        if len(sample):
            for i, row in enumerate(_squared(v, sample)):
                ok = when < before[i]
                best = np.full(codes.max() + 1, np.inf)
                np.minimum.at(best, codes[ok], row[ok])
                self.kth[i] = np.partition(best, k - 1)[k - 1] if len(best) >= k else np.inf
        self.scanned = len(sample)

    def open(self, cell: int, lo: float, hi: float, least: int, kth: np.ndarray) -> np.ndarray:
        """The queries that must search a block."""
        d = self.to_centre[:, cell]
        bound = np.maximum(np.maximum(d - hi, lo - d), self.plane[:, cell])
        return np.flatnonzero((np.maximum(bound - 1e-9, 0) ** 2 <= kth + SLACK) & (least < self.before))


def _scan(asked, blocks, k: int, grouped: bool, kinds: list[pa.DataType]):
    """Of one task's items: the candidates that can be among a query's k best, and the pairs computed."""

    def run(batches):
        own, table = asked.value, blocks.value
        kth, found, pairs, size = own.kth.copy(), [], 0, 0

        def cut_down() -> pd.DataFrame:
            whole = pd.concat(found, ignore_index=True)
            best = whole.groupby(["i", "grp"], sort=False)["d"].min() if grouped else whole.set_index(["i", "grp"])["d"]
            place = best.groupby(level=0).transform(lambda d: np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf)
            last = place.groupby(level=0).first()
            kth[last.index] = np.minimum(kth[last.index], last)
            return whole[whole["d"] <= kth[whole["i"]] + SLACK]

        for batch in batches:
            key = batch.column("cell").to_numpy().astype(np.int64) << 32 | batch.column("block").to_numpy()
            if not len(key):
                continue
            v, when = _rows(batch.column("v")), batch.column("ts").to_numpy()
            ids, groups = np.array(batch.column("id")), np.array(batch.column("grp"))
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                some = own.open(int(key[a]) >> 32, *table[int(key[a])], kth)
                if not len(some):
                    continue
                pairs += len(some) * int(b - a)
                d = _squared(own.v[some], v[a:b])
                one, row = np.nonzero((d <= kth[some][:, None] + SLACK) & (when[None, a:b] < own.before[some][:, None]))
                exact = np.zeros(len(one))
                for j in range(v.shape[1]):  # from the first entry to the last, as a scan sums them
                    off = own.v[some[one], j] - v[a + row, j]
                    exact += off * off
                found.append(pd.DataFrame({"i": some[one], "id": ids[a + row], "grp": groups[a + row], "d": exact}))
                size += len(one)
                if size > 200_000:
                    found, size = [cut_down()], 0
        rows = cut_down() if found else pd.DataFrame({"i": [], "id": [], "grp": [], "d": []})
        columns = [[own.q[int(i)] for i in rows["i"]], rows["id"].tolist(), rows["grp"].tolist(), rows["d"].tolist(), [0] * len(rows)]
        last = [own.q[0], None, None, None, pairs]
        yield pa.RecordBatch.from_arrays([pa.array([*c, x], kind) for c, x, kind in zip(columns, last, kinds, strict=True)], names=["q", "id", "grp", "d", "pairs"])

    return run


def candidates(queries: DataFrame, index: Cells, k: int) -> DataFrame:
    """(q, id, grp, d, pairs): what the scan leaves of each query, and rows with the number of pairs that tasks computed (d null).

    ``queries(q, v[, ts])`` is a stated set; one without a vector or, where items are dated, without a date finds nothing.
    """
    spark, names = index.items.sparkSession, ["q", "v"] + ["ts"] * index.dated
    when = moment(queries, "ts") if index.dated else F.lit(_LAST)
    rows = queries.select(*names).filter(" and ".join(f"{x} is not null" for x in names)).select("q", F.col("v").cast("array<double>").alias("v"), when.alias("before"))
    own = dict(index.items.dtypes)
    kind = f"q {dict(queries.dtypes)['q']}, id {own['id']}, grp {own['grp']}, d double, pairs long"
    kinds = [*queries.select("q").limit(0).toArrow().schema.types, *index.items.select("id", "grp").limit(0).toArrow().schema.types, pa.float64(), pa.int64()]
    table = {(int(r.cell) << 32 | int(r.block)): (float(r.lo), float(r.hi), int(r.ts)) for r in index.blocks.itertuples()}
    held = spark.sparkContext.broadcast(table)
    blocks = -(-rows.count() // QUERIES)
    blocks = 2 * blocks if blocks > 1 else blocks  # uneven hashes stay below the block's size
    out = spark.createDataFrame([], kind)
    for b in range(blocks):
        some = rows.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()  # a block of the stated set
        if len(some) and len(index.blocks):
            asked = _Asked(some["q"].tolist(), _stack(some["v"]), some["before"].to_numpy(np.int64), k, index)
            out = out.unionByName(index.items.select("id", "v", "grp", "ts", "cell", "block").mapInArrow(_scan(spark.sparkContext.broadcast(asked), held, k, index.grouped, kinds), kind))
    return out


def ranked(found: DataFrame, k: int, grouped: bool) -> DataFrame:
    """(q, id or grp, d, rank) of ``candidates``: by rounded squared distance, then id or group."""
    key = "grp" if grouped else "id"
    near = found.filter("d is not null").withColumn("d", F.round("d", 6))
    best = near.groupBy("q", key).agg(F.min("d").alias("d")) if grouped else near.select("q", "id", "d")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", key))).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Cells, k: int) -> DataFrame:
    """The k nearest items, or groups by their nearest item, of each query."""
    return ranked(candidates(queries, index, k), k, index.grouped)


def share(queries: DataFrame, index: Cells, k: int) -> float:
    """The part of all pairs of query and item that a search computes, with those of the sample."""
    n, m = int(index.blocks["n"].sum()), queries.count()
    done = candidates(queries, index, k).agg(F.sum("pairs")).first()[0] or 0
    return (done + m * len(index.sample)) / max(1, n * m)
