"""Ranked lexical search by Fagin's threshold algorithm.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A document's score for an item is

    sum over the item's terms (repeats included) of  w * ((10^9 tf) div (1000 tf + 8 m)),
    w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 100 - 75 + (75 n N) div L.

1. ``forward``: one pass over the documents writes, for each, its number of terms and its (term, tf) of the items' terms: the
   forward index. Terms are told apart by 64-bit hashes.
2. N, L and df are sums over that table.
3. ``search``: each task takes chunks of the forward index of about CHUNK postings. A chunk's postings, sorted by impact within
   each term, are its lists. For an item, its lists are read in turn, STEP entries of each a round; every document met for the
   first time gets its whole score from the forward index; the threshold is the sum of the impacts reached in the lists. It
   stops when the threshold is strictly below the k-th best score (a document not met scores no more than the threshold, so
   ties are complete), or when all lists are read.
4. The chunks' k best are cut to k for each item in shares, then over all.

The items' distinct terms are what tasks hold: items are searched in blocks, dealt by hash, of about BLOCK term occurrences.

Null texts have no terms. Each row of documents is a document, also where ids or texts repeat; a null doc_id comes after the
others in ties. Distinct texts of one item_id make one item together; null is an id like others. An item without terms, or whose
terms stand nowhere, has no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import kernel
from docketry.llm.kernel import U
from docketry.llm.shared import LOWER, UPPER, settle, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Postings of a chunk, entries of a list read in a round, terms of a block of items, shares in which the chunks' best meet first.
CHUNK, STEP, BLOCK, SHARES = 2_000_000, 128, 500_000, 16

_PART = np.zeros(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _PART[_a : _b + 1] = True


def _terms(column):
    """(first row, hashes, bounds by text) of each block of texts."""
    for first, data, offsets in kernel.blocks(column):
        starts, ends, bounds = kernel.word_spans(data, offsets, _PART)
        yield first, kernel.span_hash(kernel.prefix(kernel.LOWERED[data]), starts, ends), bounds


def item_terms(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(item, h, qf): the term hashes of each item, with their number."""

    def run(batches):
        for batch in batches:
            for first, hashes, bounds in _terms(batch.column("text")):
                at = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) + first
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at)), pa.array(hashes.view(np.int64))], names=["item", "h"])

    kind = items.schema[id_column].dataType.simpleString()
    texts = items.select(F.col(id_column).alias("item"), F.col(text).alias("text")).distinct()
    return texts.mapInArrow(run, f"item {kind}, h long").groupBy("item", "h").agg(F.count("*").alias("qf"))


def forward(docs: DataFrame, id_column: str, text: str, hashes: np.ndarray) -> DataFrame:
    """(doc, n, terms, tfs): of each document with a term, its number of terms and, by places in ``hashes`` (sorted), those asked for."""
    held = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches):
        known = held.value
        for batch in batches:
            for first, found, bounds in _terms(batch.column("text")):
                n = np.diff(bounds)
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                doc = np.repeat(np.arange(len(n)), n)[hit]
                key, tf = np.unique(doc * len(known) + at[hit], return_counts=True)
                some = np.flatnonzero(n)
                ends = np.searchsorted(key, np.append(some * len(known), len(n) * len(known)))
                lists = lambda x, kind, ends=ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(kind)))
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(some + first)), pa.array(n[some].astype(np.int64)), lists(key % len(known), np.int32), lists(tf, np.int32)], names=["doc", "n", "terms", "tfs"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, n long, terms array<int>, tfs array<int>")


class Lists:
    """A chunk of the forward index with its impact-sorted lists."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, total: int, length: int):
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        m = 25 + (75 * n * total) // length
        self.term, self.bounds = term, bounds
        self.impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.docs, self.sorted = doc[order], self.impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from the forward index; ``times`` are the item's numbers of each term."""
        a, b = self.bounds[docs], self.bounds[docs + 1]
        ends = np.cumsum(b - a)
        at = np.arange(ends[-1]) + np.repeat(a - ends + (b - a), b - a)
        sums = np.concatenate(([0], np.cumsum(self.impact[at] * times[self.term[at]])))
        return sums[ends] - sums[ends - (b - a)]

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of the chunk and their scores, by the threshold algorithm; ``tie`` orders equal scores."""
        whole = np.zeros(len(self.start) - 1, np.int64)
        whole[terms] = times
        start, end = self.start[terms], self.start[terms + 1]
        seen = np.zeros(len(self.bounds) - 1, bool)
        docs, scores, depth = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while (start + depth < end).any():
            upto = np.minimum(start + depth + STEP, end)
            met = np.unique(np.concatenate([self.docs[a:b] for a, b in zip(start + depth, upto, strict=True) if a < b]))
            met = met[~seen[met]]
            seen[met] = True
            if len(met):
                docs, scores = np.concatenate((docs, met)), np.concatenate((scores, self.scores(met, whole)))
                if len(docs) > k:
                    keep = np.lexsort((tie[docs], -scores))[:k]
                    docs, scores = docs[keep], scores[keep]
            # what a document not met can score: in each list no more than its last entry read, nothing in a list read out
            open_ = upto < end
            threshold = int((self.sorted[upto[open_] - 1] * times[open_]).sum())
            if len(docs) == k and threshold < scores.min():
                break
            depth += STEP
        return docs[scores > 0], scores[scores > 0]


def _searcher(held, k: int):
    def run(batches):
        ids, items, weights, total, length = held.value
        kept, size = [], 0

        def answer():
            column = lambda c: pa.concat_arrays([b.column(c) for b in kept])
            doc, n, terms = column("doc"), column("n").to_numpy(), column("terms")
            bounds = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy().astype(np.int64))))
            chunk = Lists(n, bounds, terms.flatten().to_numpy().astype(np.int64), column("tfs").flatten().to_numpy().astype(np.int64), weights, total, length)
            tie = np.empty(len(doc), np.int64)
            tie[pc.sort_indices(doc, null_placement="at_end").to_numpy()] = np.arange(len(doc))
            found = [chunk.best(*item, k, tie) for item in items]
            at = pa.array(np.repeat(np.arange(len(items)), [len(d) for d, _ in found]))
            return pa.RecordBatch.from_arrays([ids.take(at), doc.take(pa.array(np.concatenate([d for d, _ in found]))), pa.array(np.concatenate([s for _, s in found]))], names=["item", "doc", "score"])

        for batch in batches:
            kept.append(batch)
            size += len(batch) + len(batch.column("terms").flatten())
            if size >= CHUNK:
                yield answer()
                kept, size = [], 0
        if kept:
            yield answer()

    return run


def search(index: DataFrame, asked: DataFrame, hashes: np.ndarray, k: int) -> DataFrame:
    """(item, doc, score, rank): the k best documents of each item of ``asked(item, h, qf)``, a block whose terms ``hashes`` are."""
    sums = index.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    counted = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toPandas()  # a row a term of the block
    df = np.zeros(len(hashes), np.int64)
    df[counted["t"]] = counted["df"]
    weights = np.array([math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rows = asked.toArrow().sort_by([("item", "ascending")])  # a block of items
    ids = pc.unique(rows["item"])
    own = pc.index_in(rows["item"], ids).to_numpy()
    terms, times = np.searchsorted(hashes, rows["h"].to_numpy().view(U)), rows["qf"].to_numpy()
    cut = np.searchsorted(own, np.arange(len(ids) + 1))
    items = [(terms[a:b], times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    held = index.sparkSession.sparkContext.broadcast((ids, items, weights, sums["n"], sums["l"]))
    kinds = dict(index.dtypes)["doc"], dict(asked.dtypes)["item"]
    met = index.mapInArrow(_searcher(held, k), f"item {kinds[1]}, doc {kinds[0]}, score long").withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(SHARES)))
    best = (F.col("score").desc(), F.col("doc").asc_nulls_last())
    some = met.withColumn("rank", F.row_number().over(Window.partitionBy("item", "share").orderBy(*best))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")


def rank(items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    asked = settle(item_terms(items, item_id, text), "lexical_items")
    blocks = -(-asked.count() // BLOCK)
    blocks = 2 * blocks if blocks > 1 else blocks  # uneven hashes stay below the block's size
    kinds = dict(items.dtypes)[item_id], dict(docs.dtypes)[doc_id]
    out = [docs.sparkSession.createDataFrame([], f"item {kinds[0]}, rank int, doc {kinds[1]}, score long")]
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        hashes = np.unique(some.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(U))  # of a block
        if not len(hashes):
            continue
        index = settle(forward(docs, doc_id, text, hashes), "lexical_forward")
        if not index.isEmpty():
            out.append(search(index, some, hashes, k))
    found = functools.reduce(DataFrame.unionByName, out[1:] or out)
    return found.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


_LOWERED = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_LOWERED}) AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM d, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_LOWERED}) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN d USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0) WHERE rank <= {TOP}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
