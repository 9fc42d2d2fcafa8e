"""Recursive splitting measured in tokens, and an index of chunks that follows its documents by their content."""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docketry.sources.staging import settle

SEPARATORS = ("\n\n", "\n", " ", "")
Counts = Callable[[list[str]], "np.ndarray"]


def lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def one_by_one(count: Callable[[str], int]) -> Counts:
    return lambda texts: np.array([count(t) for t in texts], np.int64)


#: Letters, digits and white space below U+0250, as byte-level tokenizers part them; texts with other characters go to the library.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_OTHER = re.compile("[^\x00-\u024f]")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Distinct pieces whose counts a task keeps at once.
KNOWN = 500_000


def _parted(path: str) -> bool:
    """Whether a tokenizer file parts texts by the byte-level rule before anything else, so that pieces count alone."""
    with open(path) as f:
        own = json.load(f)
    first = own["pre_tokenizer"] or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    return bool(plain and not own["normalizer"] and own["model"]["type"] == "BPE" and not own["model"].get("dropout") and all(x["special"] for x in own["added_tokens"]))


def by_pieces(counts: Counts) -> Counts:
    """``counts`` of a tokenizer that parts texts by the byte-level rule: each distinct piece is encoded once a task."""
    known: dict[str, int] = {}

    def run(texts: list[str]) -> np.ndarray:
        pieces = [None if _OTHER.search(x) else _PIECES.findall(x) for x in texts]
        new = list({y for x in pieces if x for y in x}.difference(known))
        if new:
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list({y for x in pieces if x for y in x})
            known.update(zip(new, counts(new).tolist(), strict=True))
        rest = iter(counts([x for x, own in zip(texts, pieces, strict=True) if own is None]).tolist())
        return np.fromiter((next(rest) if own is None else sum(map(known.__getitem__, own)) for own in pieces), np.int64, len(texts))

    run.apart = True
    return run


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Counts:
    """Counts of a tokenizer file's tokens, without special ones: ``.json`` (tokenizers) or ``.model`` (sentencepiece). A process
    reads a file once."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has one core, and asks for few texts at a time
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        encode = lambda texts: [len(x) for x in model.encode(texts)]
    else:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        made.encode_special_tokens = True
        encode = lambda texts: [len(x.ids) for x in made.encode_batch(texts, add_special_tokens=False)]

    def counts(texts: list[str]) -> np.ndarray:
        own = dict.fromkeys(texts)  # words and letters repeat: each is encoded once a call
        own = dict(zip(own, encode(list(own)), strict=True))
        return np.fromiter(map(own.__getitem__, texts), np.int64, len(texts))

    return by_pieces(counts) if path.endswith(".json") and _parted(path) else counts


def split(text: str, size: int, overlap: int, counts: Counts, separators: tuple[str, ...] = SEPARATORS, recount: bool = True) -> list[str]:
    """Chunks of at most ``size``: cut at the first separator that occurs, and at finer ones where a part alone is too long.

    Parts and separators are counted once, all of a level together. Of their running sums, the end of a chunk is the last place
    within ``size`` of its start, and the next start the first place within ``overlap`` of that end: two binary searches a
    chunk. Tokens of joined parts may outnumber the parts' own; with ``recount`` chunks are counted again, whole, and one that
    is too long is halved; where ``counts.apart`` says that a tokenizer parts texts at white space, that count is a sum. A single letter of more than ``size`` tokens stays whole.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    parts = [x for x in (text.split(mark) if mark else list(text)) if x]
    if not parts:
        return []
    n, between = counts(parts), int(counts([mark])[0]) if mark else 0
    out: list[str] = []

    def spans(a: int, b: int) -> list[tuple[int, int]]:
        upto, found, i = np.concatenate(([0], np.cumsum(n[a:b] + between))), [], 0
        while True:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + size + between, "right")) - 1)
            found.append((a + i, a + j))
            if j >= b - a:
                return found
            i = min(j, int(np.searchsorted(upto, upto[j] - between - min(overlap, size - int(n[a + j]) - between), "left")))

    sums: list[np.ndarray] = []

    def whole(todo: list[tuple[int, int]], texts: list[str]) -> np.ndarray:
        """Tokens of joined parts. Between parts without white space at their edges, no token reaches over a separator's start."""
        if not mark or not getattr(counts, "apart", False):
            return counts(texts)
        if not sums:
            after = counts([mark + x for x in parts]) if mark[-1] == " " else n + int(counts([mark + "x"])[0] - counts(["x"])[0])
            loose = [x[0].isspace() or x[-1].isspace() for x in parts]
            sums.extend(np.concatenate(([0], np.cumsum(x))) for x in (after, loose))
        i, j = np.array(todo).T
        out, loose = n[i] + sums[0][j] - sums[0][i + 1], np.flatnonzero(sums[1][j] > sums[1][i])
        if len(loose):
            out[loose] = counts([texts[x] for x in loose])
        return out

    def merge(a: int, b: int) -> None:
        todo = spans(a, b)
        while todo:
            texts = [mark.join(parts[i:j]).strip() for i, j in todo]
            long = whole(todo, texts) > size if recount else np.zeros(len(texts), bool)
            if not long.any():
                out.extend(t for t in texts if t)
                return
            todo = [x for (i, j), over in zip(todo, long, strict=True) for x in ([(i, (i + j) // 2), ((i + j) // 2, j)] if over and j - i > 1 else [(i, j)])]
            if not any(over and j - i > 1 for (i, j), over in zip(todo, whole(todo, [mark.join(parts[i:j]).strip() for i, j in todo]) > size, strict=True)):
                out.extend(t for t in (mark.join(parts[i:j]).strip() for i, j in todo) if t)
                return

    big = np.flatnonzero(n > size) if finer else np.zeros(0, np.int64)
    for a, b in zip(np.append(-1, big) + 1, np.append(big, len(parts)), strict=True):
        if a < b:
            merge(int(a), int(b))
        if b < len(parts):
            out += split(parts[b], size, overlap, counts, finer, recount)
    return out


def once(counts: Counts) -> Counts:
    """``counts`` that counts a text once, however often it is asked."""
    known: dict[str, int] = {}

    def run(texts: list[str]) -> np.ndarray:
        new = [x for x in dict.fromkeys(texts) if x not in known]
        if new:
            known.update(zip(new, counts(new).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, texts), np.int64, len(texts))

    run.apart = getattr(counts, "apart", False)
    return run


def chunks_of_sizes(df: DataFrame, key: str, text: str, sizes: Sequence[tuple[int, int]], load: Callable[[], Counts] = lambda: lengths, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, size, pos, chunk) by ``split`` at each of ``sizes`` (size, overlap), in one reading: what the cuts of a text have in
    common, its parts above all, is counted once. ``load`` gives the counter, once a task. Null and empty texts have no chunks."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        counts = load()
        for batch in batches:
            at, size_of, pos, chunks = [], [], [], []
            for row, x in enumerate(batch.column("text").to_pylist()):
                own = counts if counts is lengths or len(sizes) == 1 else once(counts)
                for size, overlap in sizes if x else ():
                    found = split(x, size, overlap, own, separators, counts is not lengths)
                    at += [row] * len(found)
                    size_of += [size] * len(found)
                    pos += range(len(found))
                    chunks += found
            columns = [batch.column("key").take(pa.array(at, pa.int64())), pa.array(size_of, pa.int32()), pa.array(pos, pa.int32()), pa.array(chunks, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "pos", "chunk"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if len(sizes) > 1:  # hours of counting may lie in one row group of a file
        spark = df.sparkSession
        rows = rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "key")
    out = rows.mapInArrow(run, f"key {kind}, size int, pos int, chunk string")
    return out.withColumnRenamed("key", key)


def recursive_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int, load: Callable[[], Counts] = lambda: lengths, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, pos, chunk) of one size."""
    return chunks_of_sizes(df, key, text, [(size, overlap)], load, separators).select(key, "pos", "chunk")


@dataclass
class ChunkIndex:
    """The chunks and texts of the newest version, and how its documents came about: (state, n) of new, changed, same, gone."""

    chunks: DataFrame
    parents: DataFrame
    delta: DataFrame


BUCKETS = 64


def _table(spark: SparkSession, folder: str, name: str, columns: str) -> str:
    """The name, in this session, of a bucketed table whose files lie in ``folder``."""
    title = "docketry_" + uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{name}").hex
    spark.sql(f"CREATE TABLE IF NOT EXISTS {title} ({columns}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {BUCKETS} BUCKETS LOCATION '{folder}/{name}'")
    return title


def _last(spark: SparkSession, folder: str):
    """The manifest's newest line, or None."""
    try:
        return spark.read.parquet(f"{folder}/manifest").orderBy(F.col("version").desc()).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _open(spark: SparkSession, folder: str, made: int, kind: str) -> ChunkIndex:
    docs = spark.table(_table(spark, folder, f"docs-{made}", f"id {kind}, digest string, made long, state string"))
    live = docs.filter("state <> 'gone'")

    def of(name: str, columns: str) -> DataFrame:
        rows = spark.table(_table(spark, folder, name, f"id {kind}, made long, {columns}")).alias("r")
        # equality as two inequalities: it isn't a join key, so buckets of id alone serve the join
        same = (F.col("r.id") == F.col("d.id")) & (F.col("r.made") >= F.col("d.made")) & (F.col("r.made") <= F.col("d.made"))
        return rows.join(live.select("id", "made").alias("d").hint("merge"), same).select("r.*").drop("made")

    return ChunkIndex(of("chunks", "pos int, chunk string"), of("parents", "text string"), docs.groupBy("state").agg(F.count("*").alias("n")))


def open_chunks(spark: SparkSession, folder: str) -> ChunkIndex:
    """The newest version of a saved index."""
    last = _last(spark, folder)
    if last is None:
        raise FileNotFoundError(f"no index in {folder}")
    return _open(spark, folder, last["made"], last["kind"])


#: Ids that may be broadcast; beyond that the join shuffles.
FEW_IDS = 200_000


def narrow(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", how)


def _single(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` with the smallest text of each repeated id: only texts of those are shuffled."""
    repeated = settle(docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "chunk_repeated")
    if repeated.isEmpty():
        return docs
    return narrow(docs, repeated, "left_anti").unionByName(narrow(docs, repeated).groupBy("id").agg(F.min("text").alias("text")))


def follow(docs: DataFrame, folder: str, cut: Callable[[DataFrame], DataFrame], whole: bool = True) -> ChunkIndex:
    """Bring the index in ``folder`` (made if it isn't there) up to ``docs(id, text)``, and open it.

    Documents are compared by the SHA-256 of their text: only new and changed ones are cut, by ``cut`` from (id, text) to (id,
    pos, chunk); unchanged ones are not touched. With ``whole``, documents that aren't in ``docs`` any more are gone, else they
    stay. Chunks and texts are appended in buckets of the document's id with the number of the run that made them; a version is a
    table of ids, digests and the runs their rows come from, and counts once the manifest names it, so readers see all of it or
    nothing. Parents join their chunks without a shuffle. ``docs`` is read anew for its ids, digests and texts, so it must give the
    same rows each time. Null ids are left out; of a repeated id the smallest text counts; null
    texts have no chunks.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["id"]
    last = _last(spark, folder)
    now = _single(docs.select("id", "text").filter("id is not null"))
    digests = settle(now.select("id", F.sha2(F.coalesce("text", F.lit("\x00")), 256).alias("d")), "chunk_docs")
    columns = f"id {kind}, digest string, made long, state string"
    before = spark.table(_table(spark, folder, f"docs-{last['made']}", columns)).filter("state <> 'gone'").select("id", "digest", "made") if last else spark.createDataFrame([], f"id {kind}, digest string, made long")
    version = uuid.uuid4().int >> 66  # rows of an attempt that failed bear a number that no manifest names
    both = digests.join(before, "id", "full")
    state = F.when(F.col("digest").isNull(), "new").when(F.col("d").isNull(), "gone" if whole else "same").when(F.col("d") == F.col("digest"), "same").otherwise("changed")
    fresh = F.col("state").isin("new", "changed")
    plan = settle(both.withColumn("state", state).select("id", F.coalesce("d", "digest").alias("digest"), F.when(fresh, F.lit(version)).otherwise(F.col("made")).alias("made"), "state"), "chunk_plan")
    # texts cross the network once, to their bucket; what they are joined to comes there, and chunks are cut where they lie
    todo = narrow(now.repartition(BUCKETS, "id"), plan.filter(fresh).select("id"))

    def put(rows: DataFrame, name: str, columns: str) -> str:
        title = _table(spark, folder, name, columns)
        how = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
        rows.select(*spark.table(title).columns).write.options(**how).format("parquet").bucketBy(BUCKETS, "id").sortBy("id").mode("append").saveAsTable(title)
        return title

    texts = put(todo.withColumn("made", F.lit(version)), "parents", f"id {kind}, made long, text string")
    put(cut(spark.table(texts).filter(F.col("made") == version).select("id", "text")).withColumn("made", F.lit(version)), "chunks", f"id {kind}, made long, pos int, chunk string")
    put(plan.repartition(BUCKETS, "id"), f"docs-{version}", columns)
    spark.createDataFrame([(last["version"] + 1 if last else 1, version, kind)], "version int, made long, kind string").coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return _open(spark, folder, version, kind)
