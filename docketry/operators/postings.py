"""BM25 over a saved index that grows: blocks of postings with bounds, and an exact search that leaves out blocks below the k-th score.

Index. Documents are put in order of their most frequent term and their length, so that neighbours are alike, and cut into
buckets of BUCKET. A block is a term's postings in one bucket, with its greatest frequency and the least length there: bounds
that stay true when the collection grows, as the weights are put in at search time. A batch of documents becomes a segment of
its own, written once; ``grow`` then writes the merged document frequencies and the totals (documents, words, mean weight) as a
new version, and adds a line to the manifest last, so a reader sees the old version or the new one, whole.

Search. By query, the bounds of a bucket's blocks add up to what none of its documents can exceed. The FIRST buckets with the
highest bounds are scored; their k-th score rules out every bucket whose bound is below it, and the others are scored. Results
equal ``retrieval.bm25`` over all documents. ``opened`` tells the share of postings that a search reads.

Documents are told apart by id: of those that arrive, ids that are in the index are left out (the first one stays), as are null
ids. Null and blank texts count as documents of no words.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docketry.operators import retrieval as R
from docketry.operators.rows import running
from docketry.sources.staging import settle, shared_dir

BUCKET, FIRST = 128, 4
#: Scores are rounded to six places before they are ranked.
SLACK = 2e-6


@dataclass
class Index:
    """``blocks(segment, term, bucket, ids, fs, lens, n, fmax, lmin)``, ``terms(term, df, w)``, ``stats(n, words, avglen)``, ``docs(id)``."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    docs: DataFrame
    folder: str


def _manifest(spark: SparkSession, folder: str):
    try:
        return spark.read.parquet(f"{folder}/manifest").orderBy(F.col("version").desc()).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _segment(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, len) of a batch, and its blocks."""
    size = docs.select("id", F.coalesce(F.regexp_count("text", F.lit(r"(?U)\S+")), F.lit(0)).alias("len"))
    tf = settle(R.terms(docs, "id", "text"), "segment_terms")
    main = tf.groupBy("id").agg(F.max_by("term", F.struct("f", "term")).alias("main"))
    placed = running(size.join(main, "id", "left"), [], [F.col("main"), F.col("len"), F.col("id")], at=F.lit(1).cast("long"))
    buckets = settle(placed.select("id", F.col("len").cast("int").alias("len"), F.floor((F.col("at") - 1) / BUCKET).cast("int").alias("bucket")), "segment_buckets")
    rows = F.sort_array(F.collect_list(F.struct("id", F.col("f").cast("int").alias("f"), "len")))  # at most BUCKET
    blocks = tf.join(buckets, "id").groupBy("term", "bucket").agg(rows.alias("p"), F.count("*").cast("int").alias("n"), F.max("f").cast("int").alias("fmax"), F.min("len").alias("lmin"))
    return buckets.select("id", "len"), blocks.select("term", "bucket", F.col("p.id").alias("ids"), F.col("p.f").alias("fs"), F.col("p.len").alias("lens"), "n", "fmax", "lmin")


def grow(docs: DataFrame, folder: str, floor: float = 0.25) -> Index:
    """Add ``docs(id, text)`` to the index in ``folder``, which is made if it isn't there, and open it."""
    spark = docs.sparkSession
    last = _manifest(spark, folder)
    fresh = docs.select("id", "text").filter("id is not null").dropDuplicates(["id"])
    if last:
        fresh = fresh.join(open_index(spark, folder).docs, "id", "left_anti")
    fresh = settle(fresh, "segment_docs")  # what is in it must not change while its folder is written
    name, version = uuid.uuid4().hex, (last["version"] if last else 0) + 1
    own, blocks = _segment(fresh)
    own.write.parquet(f"{folder}/docs/segment={name}")
    blocks.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket").write.parquet(f"{folder}/blocks/segment={name}")
    segments = [*(last["segments"] if last else []), name]
    counted = spark.read.parquet(f"{folder}/blocks/segment={name}").groupBy("term").agg(F.sum("n").alias("df"))
    if last:
        counted = counted.unionByName(spark.read.parquet(f"{folder}/terms/{last['version']}").select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
    # totals of the segments, not of their rows: a batch adds one row
    total = spark.read.parquet(*(f"{folder}/docs/segment={s}" for s in segments)).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words"))
    total = total.withColumn("avglen", F.try_divide("words", "n"))
    total.coalesce(1).write.parquet(f"{folder}/stats/{version}")
    stats = spark.read.parquet(f"{folder}/stats/{version}")
    raw = settle(counted.join(F.broadcast(stats.select("n"))).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("w")), "term_weights")
    mean = raw.agg(F.avg("w").alias("mean"))
    raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("w") < 0, floor * F.col("mean")).otherwise(F.col("w")).alias("w")).write.parquet(f"{folder}/terms/{version}")
    spark.createDataFrame([(version, segments)], "version int, segments array<string>").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """The newest version of a saved index."""
    last = _manifest(spark, folder)
    if last is None:
        raise FileNotFoundError(f"no index in {folder}")
    part = lambda kind: spark.read.option("basePath", f"{folder}/{kind}").parquet(*(f"{folder}/{kind}/segment={s}" for s in last["segments"]))
    at = last["version"]
    return Index(part("blocks"), spark.read.parquet(f"{folder}/terms/{at}"), spark.read.parquet(f"{folder}/stats/{at}"), part("docs").select("id"), folder)


def _gain(f: Column, length: Column, k1: float, b: float) -> Column:
    return f * (k1 + 1) / (f + k1 * (1 - b + b * length / F.col("avglen")))


def _bounds(asked: DataFrame, index: Index, k1: float, b: float) -> DataFrame:
    """(q, segment, bucket, bound, postings) for every bucket that holds a term of a query; reads no postings."""
    heads = index.blocks.select("segment", "term", "bucket", "n", "fmax", "lmin")
    hit = R.by_terms(heads, asked).join(F.broadcast(index.stats.select("avglen")))
    most = F.sum(F.greatest(F.col("qf") * F.col("w") * _gain(F.col("fmax"), F.col("lmin"), k1, b), F.lit(0.0)))
    return hit.groupBy("q", "segment", "bucket").agg(most.alias("bound"), F.sum("n").alias("postings"))


def _scores(asked: DataFrame, index: Index, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    """(q, id, score) of all documents in the wanted buckets of each query."""
    some = R.by_terms(index.blocks, asked).join(wanted.select("q", "segment", "bucket"), ["q", "segment", "bucket"])
    rows = some.select("q", "qf", "w", F.explode(F.arrays_zip("ids", "fs", "lens")).alias("p")).join(F.broadcast(index.stats.select("avglen")))
    gain = F.col("qf") * F.col("w") * _gain(F.col("p.fs"), F.col("p.lens"), k1, b)
    return rows.groupBy("q", F.col("p.ids").alias("id")).agg(F.round(F.sum(gain), 6).alias("score"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)


def _plan(queries: DataFrame, index: Index, k: int, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(q, term, qf, w) asked for; the first buckets; the others that the first ones' k-th score leaves open; the best of the first."""
    asked = settle(R.terms(queries, "q", "text").withColumnRenamed("f", "qf").join(index.terms.select("term", "w"), "term"), "asked")
    bounds = settle(_bounds(asked, index, k1, b), "bounds")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "segment", "bucket"))
    first = settle(bounds.withColumn("place", place).filter(F.col("place") <= FIRST).drop("place"), "first")
    best = settle(_top(_scores(asked, index, first, k1, b), k), "best")
    kth = best.filter(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    rest = bounds.join(first.select("q", "segment", "bucket"), ["q", "segment", "bucket"], "left_anti").join(kth, "q", "left")
    return asked, first, rest.filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK)), best


def search(queries: DataFrame, index: Index, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q, id, score, rank): the k best documents of each of ``queries(q, text)``."""
    asked, _, rest, best = _plan(queries, index, k, k1, b)
    more = _top(_scores(asked, index, rest, k1, b), k)
    return _top(best.drop("rank").unionByName(more.drop("rank")), k)


def opened(queries: DataFrame, index: Index, k: int, k1: float = 1.5, b: float = 0.75) -> float:
    """The share of the postings of queries' terms that a search reads."""
    asked, first, rest, _ = _plan(queries, index, k, k1, b)
    total = lambda df: df.agg(F.sum("postings")).first()[0] or 0
    return total(first.select("postings").unionByName(rest.select("postings"))) / max(1, total(_bounds(asked, index, k1, b)))


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder for an index in the shared folder."""
    return f"{shared_dir(spark)}/docketry/{name}-{uuid.uuid4().hex}"
