"""Retrieval of earlier cases: chunks, exact vector search, maximal marginal relevance, BM25."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators import scan
from docketry.operators.cells import moment
from docketry.operators.chunks import SEPARATORS, lengths, one_by_one
from docketry.operators.chunks import recursive_chunks as measured_chunks
from docketry.sources.staging import settle

#: Query vectors that are broadcast at a time; a larger stated set is searched in blocks of this size.
QUERY_BLOCK = 20_000
#: Distinct query terms that may be broadcast; beyond that the join shuffles.
FEW_TERMS = 200_000


def chunk_tokens(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(key, pos, chunk): windows of ``size`` white-space tokens that overlap by ``overlap``; none is pure overlap."""
    w = df.select(key, F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - overlap, F.lit(1)), F.lit(size - overlap))
    return w.select(key, "w", F.posexplode(starts).alias("pos", "start")).select(key, "pos", F.array_join(F.slice("w", F.col("start"), size), " ").alias("chunk"))


def recursive_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, count: Callable[[str], int] | None = None, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """``chunks.recursive_chunks`` with a measure of one text, the number of its characters by default."""
    return measured_chunks(df, key, text, size, overlap, (lambda: one_by_one(count)) if count else (lambda: lengths), separators)


def with_parents(hits: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The parent documents of chunk hits: each once for a query, at its best chunk's rank."""
    best = hits.groupBy("q", key).agg(F.min("rank").alias("rank"))
    return best.join(parents, key)


def distance2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def in_blocks(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over a stated set ``queries(q, ...)``, which it may broadcast: counted, and given in blocks of QUERY_BLOCK by the hash of q. Of several blocks, each is
    searched and its rows written before the next, so the driver holds one at a time."""
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    if blocks == 1:
        return search(queries)
    blocks = 2 * blocks  # uneven hashes stay below the block's size
    return functools.reduce(DataFrame.unionByName, [settle(search(queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n)), "query_block") for n in range(blocks)])


def nearest(queries: DataFrame, items: DataFrame, k: int, earlier: bool = False, group: str | None = None) -> DataFrame:
    """(q, id or group, d, rank): the k nearest of ``items(id, v[, ts][, group])`` for each of ``queries(q, qv[, qts])``, by a scan.

    The query set is stated: it is counted, and sent to the tasks in blocks; each task scans its items by matrix products and keeps k
    rows a query before anything is shuffled. ``earlier``: only items dated strictly before the query. ``group``: the best item stands
    for each group. Pairs without a distance come last. ``cells.search`` finds the same rows from an index that rules out whole cells.
    """
    key = group or "id"
    when = lambda df, ts: [moment(df, ts).alias("ts")] if earlier else []
    rows = items.select(F.col(key).alias("key"), "v", *when(items, "ts"))

    def search(some: DataFrame) -> DataFrame:
        return scan.nearest(some.select("q", F.col("qv").alias("v"), *when(some, "qts")), rows, k, group is not None, earlier)

    return in_blocks(queries, search).select("q", F.col("key").alias(key), "d", "rank")


def relevance(distance2: Column) -> Column:
    """A score for unit vectors: 1 where they are equal, 0 at a right angle, from the squared distance."""
    return 1 - F.sqrt(distance2) / F.sqrt(F.lit(2.0))


def metadata_filter(rules: dict) -> Column:
    """The rows that all rules admit: ``{column: value}`` or ``{column: {"$lt": value, ...}}`` with $eq $ne $lt $lte $gt $gte $in."""
    tests = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$in": lambda c, v: c.isin(list(v))}
    out = F.lit(True)
    for column, rule in rules.items():
        for name, value in (rule if isinstance(rule, dict) else {"$eq": rule}).items():
            out = out & tests[name](F.col(column), value)
    return out


def count_found(queries: DataFrame, ranked: DataFrame, wanted: int, strict: bool = False) -> DataFrame:
    """(q, n_found) for each query, at most ``wanted``; with ``strict``, an error for a query that found fewer."""
    n = queries.select("q").join(ranked.groupBy("q").agg(F.count("*").alias("n")), "q", "left").select("q", F.least(F.coalesce("n", F.lit(0)), F.lit(wanted)).alias("n_found"))
    if not strict:
        return n
    lacking = F.raise_error(F.concat(F.lit("too few results for query "), F.col("q").cast("string"))).cast("long")
    return n.select("q", F.when(F.col("n_found") < wanted, lacking).otherwise(F.col("n_found")).alias("n_found"))


def mmr(candidates: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """(q, id, rank): greedy maximal marginal relevance among ``candidates(q, qv, id, v)``, a fetched list for each query."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        v = np.array(frame["v"].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        q = np.asarray(frame["qv"].iloc[0], float)
        relevance, worst, chosen = v @ (q / max(np.linalg.norm(q), 1e-12)), np.full(len(v), -np.inf), []
        while len(chosen) < min(k, len(v)):
            gain = trade * relevance - (1 - trade) * np.where(np.isfinite(worst), worst, 0)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
            worst = np.maximum(worst, v @ v[chosen[-1]])
        return pd.DataFrame({"q": frame["q"].iloc[0], "id": frame["id"].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    return candidates.groupBy("q").applyInPandas(pick, "q long, id long, rank int")


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, f) of white-space tokens."""
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("f"))


def bm25_tables(docs: DataFrame, floor: float = 0.25) -> dict[str, DataFrame]:
    """What BM25 needs of ``docs(id, text)``: ``postings(id, term, f)``, ``sizes(id, len)``, ``weights(term, w)``, ``stats(n, avglen)``.

    ``w`` is the idf; negative ones become ``floor`` times the mean idf. ``save_tables`` keeps them for later searches.
    """
    tf = terms(docs, "id", "text")
    size = docs.select("id", F.regexp_count("text", F.lit(r"(?U)\S+")).alias("len"))
    stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avglen"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(stats)).withColumn("w", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("w").alias("mean"))
    weight = df.join(F.broadcast(mean)).select("term", F.when(F.col("w") < 0, floor * F.col("mean")).otherwise(F.col("w")).alias("w"))
    return {"postings": tf, "sizes": size, "weights": weight, "stats": stats}


def by_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """``postings(term, ...)`` joined to ``asked(q, term, ...)``: broadcast where a count shows few rows. A term of very many postings
    meets its queries in Spark's skew join, which splits it."""
    return postings.join(F.broadcast(asked) if asked.limit(FEW_TERMS + 1).count() <= FEW_TERMS else asked, "term")


def bm25_search(queries: DataFrame, tables: dict[str, DataFrame], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q, id, score, rank) over ``queries(q, text)``, a stated set, which thins the postings before scores are summed."""
    asked = terms(queries, "q", "text").withColumnRenamed("f", "qf")
    wanted = asked.select("term").distinct()
    postings = tables["postings"].join(F.broadcast(wanted) if wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS else wanted, "term", "left_semi")
    hit = postings.join(asked.join(tables["weights"], "term"), "term").join(tables["sizes"], "id").join(F.broadcast(tables["stats"]))
    score = F.sum(F.col("qf") * F.col("w") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avglen"))))
    scored = hit.groupBy("q", "id").agg(F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)


def bm25_of_pairs(pairs: DataFrame, tables: dict[str, DataFrame], key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, bm25) of ``pairs(key, id, text)``: each text against one document only; 0 without a common term."""
    asked = terms(pairs, key, "text").withColumnRenamed("f", "qf").join(pairs.select(key, "id"), key)
    hit = asked.join(tables["postings"], ["id", "term"]).join(tables["weights"], "term").join(tables["sizes"], "id").join(F.broadcast(tables["stats"]))
    found = hit.groupBy(key).agg(F.sum(F.col("qf") * F.col("w") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("avglen")))).alias("bm25"))
    return pairs.select(key).join(found, key, "left").select(key, F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Tables and search in one."""
    return bm25_search(queries, bm25_tables(docs, floor), k, k1, b)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables of an index (chunks with their vectors, postings and the like), each a folder of Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def pool(hidden: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """One vector a text from (texts, tokens, width): the mean over unmasked tokens (zeros where there are none), or the first token's."""
    if how == "cls":
        return hidden[:, 0]
    weight = mask[:, :, None].astype(hidden.dtype)
    return (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A Pandas UDF from texts to vectors; ``load`` gives the model, once a task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), np.float32)))

    return run
