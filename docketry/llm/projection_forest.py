"""Approximate nearest neighbours by inner product: a forest of random-projection trees behind one priority queue.

Trees. Vectors get one more entry, sqrt(M^2 - |v|^2) with M the largest norm, so that the nearest by distance is the largest
inner product (a query's entry is 0). Each of TREES trees is fitted on the SAMPLE rows that come first by a hash (fewer where
they exceed SAMPLE_BYTES): a node splits its part of the sample at the median of the projection on the widest of DIRECTIONS
random directions, until leaves hold about LEAF of all rows, but at least FEWEST sample rows. Every row is indexed, in every
tree.

Search. All trees of a query share one priority queue: a subtree's priority is the sum of squared margins by which the query
lies on the other side on the way to it, so the next leaf is the likeliest of all trees. It ends when the leaves opened hold
``budget`` rows. The budget is fitted, not set: for CALIBRATE queries all rows are scanned, the leaf at which each true
neighbour would be met is looked up, and the least budget is taken that meets TARGET of them. Random data need a large share of
all rows, clustered data a small one; ``index.forest`` holds the share of all leaves' rows and the recall found.

Reranking. A tree's leaves are dealt in their order into branches of at most BRANCH_BYTES; a leaf larger than that is cut in
parts. Branch and queries (in parts of QUERIES at most) meet in one task, which scores each opened leaf and keeps the best
``k`` + 1 a query; scores are sums of products of doubles from first to last entry. Equal vectors count as one node with their
``k`` + 1 smallest ids, which lose nothing as they tie; equal queries are searched once.

A row whose vector is null, empty, zero, or holds null or non-finite entries, or whose id is null, takes no part; nor do
vectors shorter than the longest. A repeated id stands for its smallest vector. Fewer candidates than ``k``: all found. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.shared import partitions, settle, table
from docketry.llm.vectors import matrix, usable

TREES, LEAF, FEWEST, DIRECTIONS = 4, 64, 8, 8
SAMPLE, SAMPLE_BYTES = 16_384, 16 << 20
CALIBRATE, TARGET = 192, 0.95
BRANCH_BYTES, QUERIES = 24 << 20, 16_384
#: Scored pairs that a task holds before it drops all but the best of each query.
HELD = 500_000
#: Candidates kept beside the k + 1 best before scores are summed in order, as rounding may swap neighbours.
SPARE = 4


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed from the first entry to the last, so that equal vectors have equal scores."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * query[..., j]
    return out


@dataclass
class Tree:
    """Inner nodes with their unit normals, offsets and children; a negative child is leaf -1 - child. Leaves in order."""

    normals: np.ndarray
    offsets: np.ndarray
    kids: np.ndarray
    leaves: int

    @staticmethod
    def fit(sample: np.ndarray, most: int, seed: int) -> Tree:
        rng = np.random.default_rng(seed)
        normals, offsets, kids, leaves = [], [], [], 0

        def split(rows: np.ndarray) -> int:
            nonlocal leaves
            if len(rows) > most:
                w = rng.standard_normal((DIRECTIONS, sample.shape[1]))
                p = sample[rows] @ (w / np.linalg.norm(w, axis=1, keepdims=True)).T
                best = p.var(axis=0).argmax()
                p, middle = p[:, best], float(np.median(p[:, best]))
                low = p <= middle
                if 0 < low.sum() < len(rows):
                    me = len(normals)
                    normals.append(w[best] / np.linalg.norm(w[best]))
                    offsets.append(middle)
                    kids.append([0, 0])
                    kids[me] = [split(rows[low]), split(rows[~low])]
                    return me
            leaves += 1
            return -leaves

        split(np.arange(len(sample)))
        d = sample.shape[1]
        return Tree(np.array(normals).reshape(-1, d), np.array(offsets), np.array(kids, np.int64).reshape(-1, 2), leaves)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        at = np.zeros(len(x), np.int64) if len(self.offsets) else np.full(len(x), -1)
        while (inside := np.flatnonzero(at >= 0)).size:
            node = at[inside]
            right = np.einsum("ij,ij->i", x[inside], self.normals[node]) > self.offsets[node]
            at[inside] = self.kids[node, right.astype(np.int64)]
        return -1 - at


class Forest:
    def __init__(self, trees: list[Tree]):
        self.trees, self.sizes, self.budget = trees, [np.zeros(t.leaves, np.int64) for t in trees], 0.0
        self.share, self.recall = 0.0, 1.0  # of all leaves' rows, and of true neighbours, as calibrated

    def visits(self, x: np.ndarray):
        """(tree, leaf) in the order of one queue over all trees."""
        margins = [t.normals @ x - t.offsets for t in self.trees]
        queue = [(0.0, t, 0 if len(tree.offsets) else -1) for t, tree in enumerate(self.trees)]
        while queue:
            far, t, node = heapq.heappop(queue)
            kids = self.trees[t].kids
            while node >= 0:
                m = margins[t][node]
                near = int(m > 0)
                heapq.heappush(queue, (far + m * m, t, int(kids[node, 1 - near])))
                node = int(kids[node, near])
            yield t, -1 - node

    def opened(self, x: np.ndarray) -> list[tuple[int, int]]:
        """The leaves to open within the budget; at least one."""
        found, rows = [], 0
        for t, leaf in self.visits(x):
            found.append((t, leaf))
            rows += int(self.sizes[t][leaf])
            if rows >= self.budget:
                break
        return found


@dataclass
class Index:
    """``items(uid, ids, v, extra)``, distinct vectors; the forest; how leaves are dealt: branch and parts by tree and leaf."""

    items: DataFrame
    forest: Forest
    branch: list[np.ndarray]
    parts: list[np.ndarray]
    k: int


def distinct_vectors(df: DataFrame, id_column: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, v), one an id, and (uid, ids, v): each vector with its k + 1 smallest ids; uid is the smallest."""
    zero = F.exists("v", lambda x: x != 0)
    rows = usable(df, id_column, vector).filter(F.col("id").isNotNull() & zero).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    rows = settle(rows.groupBy("id").agg(F.min("v").alias("v")), "forest_rows")
    keyed = rows.withColumn("h", F.xxhash64("v"))  # compared first, vectors only where it is equal
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).filter(F.col("r") <= k + 1)
    items = first.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return rows, items.select(F.col("ids")[0].alias("uid"), "ids", "v")


def best(df: DataFrame, of: str, k: int, tie: str) -> DataFrame:
    """The k rows of each ``of`` with the highest scores; each task keeps no more before the shuffle."""
    place = F.row_number().over(Window.partitionBy(of).orderBy(F.col("score").desc(), tie))
    return df.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def scanned(items: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(q, uid, score): the k best of all rows for a few query vectors, by a scan; a query is not its own neighbour."""
    held = items.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries]), np.array([v for _, v in queries])))

    def run(batches):
        own, q = held.value
        kept = []
        for batch in batches:
            v, ids = matrix(batch.column("v"), np.float64), np.array(batch.column("uid"))
            s = q @ v.T
            s[own[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(ids))
            at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n else np.zeros((len(q), 0), np.int64)
            kept.append(pd.DataFrame({"q": np.repeat(own, n), "uid": ids[at].ravel(), "score": np.take_along_axis(s, at, axis=1).ravel()}))
        if kept:
            rows = pd.concat(kept)
            rows = rows[np.isfinite(rows["score"])].sort_values(["q", "score"], ascending=[True, False]).groupby("q").head(k)
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    hits = items.select("uid", "v").mapInArrow(run, "q long, uid long, score double")
    return best(hits, "q", k, "uid")


def build(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, target: float = TARGET) -> tuple[DataFrame, Index]:
    """The usable rows (id, v) and the index over them."""
    rows, items = distinct_vectors(df, id_column, vector, k)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    items = settle(items.withColumn("norm", norm), "forest_items")
    spread = items.agg(F.count("*").alias("n"), F.max("norm").alias("m"), F.max(F.size("v")).alias("d")).first()
    n, most, d = spread["n"], spread["m"] or 0.0, spread["d"] or 0
    items = items.withColumn("extra", F.sqrt(F.greatest(F.lit(most * most) - F.col("norm") * F.col("norm"), F.lit(0.0)))).drop("norm")
    if not n:
        return rows, Index(items, Forest([]), [], [], k)
    order = F.xxhash64(F.lit("fit"), "uid")
    sample = items.orderBy(order, "uid").limit(min(SAMPLE, max(1, SAMPLE_BYTES // (8 * d)))).select("v", "extra").toArrow().combine_chunks()  # bounded by SAMPLE and SAMPLE_BYTES
    points = np.column_stack((matrix(sample["v"].chunk(0), np.float64), sample["extra"].to_numpy()))
    leaf = max(FEWEST, LEAF * len(points) // n)
    forest = Forest([Tree.fit(points, leaf, seed) for seed in range(TREES)])
    held = items.sparkSession.sparkContext.broadcast(forest.trees)

    def count(batches):
        sizes = [np.zeros(t.leaves, np.int64) for t in held.value]
        for batch in batches:
            x = np.column_stack((matrix(batch.column("v"), np.float64), batch.column("extra").to_numpy()))
            for own, tree in zip(sizes, held.value, strict=True):
                own += np.bincount(tree.leaf(x), minlength=tree.leaves)
        for t, own in enumerate(sizes):
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t, np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["tree", "leaf", "n"])

    counted = items.select("v", "extra").mapInArrow(count, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
    for r in counted.toPandas().itertuples():  # one row a leaf: at most TREES * SAMPLE / FEWEST
        forest.sizes[r.tree][r.leaf] = r.n
    fit = items.orderBy(F.xxhash64(F.lit("calibrate"), "uid"), "uid").limit(CALIBRATE).select("uid", "v").collect()
    asked = [(r["uid"], np.array(r["v"])) for r in fit]
    hits = scanned(items, asked, k).join(items.select("uid", "v", "extra"), "uid").select("q", "v", "extra").toPandas() if asked else pd.DataFrame()  # CALIBRATE * k rows
    needs = []
    if len(hits):
        x = np.column_stack((np.array(hits["v"].tolist()), hits["extra"]))
        home = np.stack([t.leaf(x) for t in forest.trees], axis=1)
        for uid, v in asked:
            wanted = home[(hits["q"] == uid).to_numpy()]
            place, opened = [np.full(t.leaves, np.inf) for t in forest.trees], 0
            for t, at in forest.visits(np.append(v, 0.0)):
                opened += int(forest.sizes[t][at])
                place[t][at] = opened
            needs += np.min([place[t][wanted[:, t]] for t in range(TREES)], axis=0).tolist()
    # at least k + 1 rows an opened tree, so that small tables find all there is
    forest.budget = max(float(np.quantile(needs, target, method="higher")) if needs else 0.0, 4.0 * TREES * (k + 1))
    forest.share = forest.budget / (TREES * n)
    forest.recall = float(np.mean(np.array(needs) <= forest.budget)) if needs else 1.0
    room = max(1, BRANCH_BYTES // (8 * (d + 2)))
    parts = [-(-s // room) for s in forest.sizes]
    branch = []
    for s in forest.sizes:
        deal, left, now = np.zeros(len(s), np.int64), room, 0
        for i, size in enumerate(s):
            if size > left or size > room:
                now, left = now + 1, room
            deal[i] = now
            left = left - size if size <= room else 0
        branch.append(deal)
    return rows, Index(items, forest, branch, [np.maximum(p, 1) for p in parts], k)


_ITEM = "tree int, branch int, part int, leaf int, uid long, ids array<long>, v array<double>"
_VISIT = "tree int, branch int, part int, q long, v array<double>, leaves array<int>"


def _route(index: Index):
    """Each item once a tree, to the branch of its leaf."""
    held = index.items.sparkSession.sparkContext.broadcast((index.forest.trees, index.branch, index.parts))

    def run(batches):
        trees, branch, parts = held.value
        for batch in batches:
            x = np.column_stack((matrix(batch.column("v"), np.float64), batch.column("extra").to_numpy()))
            uid = np.array(batch.column("uid"))
            for t, tree in enumerate(trees):
                leaf = tree.leaf(x)
                part = (uid * 2654435761 >> 7) % parts[t][leaf]
                made = [np.full(len(x), t, np.int32), branch[t][leaf].astype(np.int32), part.astype(np.int32), leaf.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, made), batch.column("uid"), batch.column("ids"), batch.column("v")], names=["tree", "branch", "part", "leaf", "uid", "ids", "v"])

    return index.items.select("uid", "ids", "v", "extra").mapInArrow(run, _ITEM)


def _open(queries: DataFrame, index: Index) -> DataFrame:
    """For each query and branch (each part of it): the leaves to open."""
    held = queries.sparkSession.sparkContext.broadcast((index.forest, index.branch, index.parts))

    def run(batches):
        forest, branch, parts = held.value
        for batch in batches:
            x, where, rows = matrix(batch.column("v"), np.float64), [], []
            for i in range(len(x)):
                found: dict[tuple, list[int]] = {}
                for t, leaf in forest.opened(np.append(x[i], 0.0)):
                    for part in range(parts[t][leaf]):
                        found.setdefault((t, int(branch[t][leaf]), part), []).append(leaf)
                where += found.items()
                rows += [i] * len(found)
            at = pa.array(rows, pa.int64())
            key = [pa.array([w[0][j] for w in where], pa.int32()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*key, batch.column("q").take(at), batch.column("v").take(at), pa.array([w[1] for w in where], pa.list_(pa.int32()))], names=["tree", "branch", "part", "q", "v", "leaves"])

    spread = queries.select("q", "v").repartition(partitions(queries.sparkSession), "q")  # a query takes milliseconds: its rows are few, its work isn't
    return spread.mapInArrow(run, _VISIT)


def _first(qs: np.ndarray, tie: np.ndarray, ss: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each q the n entries with the highest scores, the smaller ``tie`` first, in that order."""
    order = np.lexsort((tie, -ss, qs))
    qs = qs[order]
    begin = np.flatnonzero(np.append(True, qs[1:] != qs[:-1])) if len(qs) else np.zeros(0, np.int64)
    place = np.arange(len(qs)) - np.repeat(begin, np.diff(np.append(begin, len(qs))))
    order = order[place < n]
    return qs[place < n], tie[order], ss[order]


def _meet(k: int, items: pd.DataFrame, visits: pd.DataFrame) -> pd.DataFrame:
    """The best k + 1 ids a query among the opened leaves of one branch."""
    nothing = pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if not len(items) or not len(visits):
        return nothing
    items = items.sort_values("leaf", kind="stable")
    v, leaf = np.stack(items["v"].to_numpy()), items["leaf"].to_numpy()
    names, start = np.unique(leaf, return_index=True)
    end = np.append(start[1:], len(leaf))
    q = np.stack(visits["v"].to_numpy())
    opened = visits["leaves"].to_numpy()
    who, which = np.repeat(np.arange(len(q)), [len(x) for x in opened]), np.concatenate(opened)
    by = np.argsort(which, kind="stable")
    who, which = who[by], which[by]
    cut = np.searchsorted(which, np.stack((names, names + 1)))
    keep = k + 1 + SPARE
    floor = np.full(len(q), -np.inf)  # the keep-th best score so far: what is below can't come back
    found, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def cut_down(found: list) -> tuple:
        qs, rs, ss = _first(*map(np.concatenate, zip(*found, strict=True)), keep)
        last = np.flatnonzero(np.append(qs[1:] != qs[:-1], True)) if len(qs) else np.zeros(0, np.int64)
        full = last[np.diff(last, prepend=-1) == keep]
        floor[qs[full]] = ss[full]
        return qs, rs, ss

    for i in range(len(names)):
        some = who[cut[0, i] : cut[1, i]]
        step = max(1, 2 * HELD // (end[i] - start[i]))
        for at in range(0, len(some), step):
            few = some[at : at + step]
            s = q[few] @ v[start[i] : end[i]].T
            one, row = np.nonzero(s >= floor[few][:, None])
            found.append((few[one], row + start[i], s[one, row]))
            size += len(row)
            if size > HELD:
                found, size = [cut_down(found)], 0
    qs, rs, _ = cut_down(found)
    ids = items["ids"].to_numpy()[rs]
    n = np.array([len(x) for x in ids], np.int64)
    qs, flat, ss = _first(np.repeat(qs, n), np.concatenate([np.zeros(0, np.int64), *ids]), np.repeat(inner(v[rs], q[qs]), n), k + 1)
    return pd.DataFrame({"q": visits["q"].to_numpy()[qs], "id": flat, "score": ss})


def search(queries: DataFrame, index: Index) -> DataFrame:
    """(q, id, score): for each distinct query vector ``queries(q, v)`` the k + 1 best found, itself included."""
    key, k = ["tree", "branch", "part"], index.k
    if not index.forest.trees:
        return queries.sparkSession.createDataFrame([], "q long, id long, score double")
    visits = settle(_open(queries, index), "forest_visits")
    crowds = visits.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    items = _route(index).join(crowds, key).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    crowd = crowds.withColumn("crowd", F.col("shares") + 0).drop("shares")
    asked = visits.join(crowd, key).withColumn("share", F.pmod(F.xxhash64("q"), F.col("crowd").cast("long")).cast("int")).drop("crowd")
    by = [*key, "share"]
    met = items.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(functools.partial(_meet, k), "q long, id long, score double")
    return best(met.groupBy("q", "id").agg(F.max("score").alias("score")), "q", k + 1, "id")


def neighbours(df: DataFrame, chosen: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose ``id`` is ``chosen``, without the row itself."""
    rows, index = build(df, id_column, vector, k, target)
    asked = rows.filter(chosen)
    groups = asked.groupBy("v").agg(F.min("id").alias("q"))
    found = search(groups, index)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))).alias("hits"))  # k + 1 each
    own = asked.join(groups, "v").select(F.col("id").alias("query_id"), "q").join(lists, "q")
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    ranked = own.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), "hit.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
