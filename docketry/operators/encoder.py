"""An encoder of its own: term vectors by block power iteration over the documents' terms, texts as the mean of their terms' vectors.

``fit`` finds the leading right singular vectors of the sparse matrix of documents and terms (frequency times the logarithm of
inverse document frequency). One round multiplies by the matrix and by its transpose. Documents are dealt into chunks, which keep
their counts as arrays, and terms into blocks of vectors. A chunk is sent the vectors of its distinct terms, makes both products of
its documents, and returns one partial sum for each of these terms; so what is shuffled in a round is a row of ``width`` numbers
for each term of a chunk, not for each term of a document, and no table is broadcast. The columns are made orthonormal with the
Cholesky factor of their Gram matrix, ``width`` x ``width`` numbers, the only thing that reaches the driver.

Like the encoders it stands for, it reads the first ``cut`` tokens of a text (512 by default; None for all), and pools by the mean.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators import retrieval as R
from docketry.sources.staging import settle

CUT = 512
#: Counts (pairs of a document and a term) and bytes of terms that a chunk holds on average; small tables are dealt into a few
#: chunks for each core, of LEAST counts at least.
COUNTS, LEAST, BYTES = 2_000_000, 250_000, 200_000_000
#: Counts and terms that one row of a chunk holds, more or less.
PIECE = 65_536
#: A block holds at most 2 ** BITS terms.
BITS = 14


def weighted_terms(docs: DataFrame, key: str, text: str, cut: int | None = CUT) -> DataFrame:
    """(key, term, f) over lower-cased tokens, of the first ``cut`` of each text."""
    if cut:  # two parts more: an empty one before leading space, and the rest, in which nothing is looked for
        w = F.slice(F.array_remove(F.split(F.lower(text), r"(?U)\s+", cut + 2), ""), 1, cut)
    else:
        w = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\S+)"), F.lit(1))
    # texts are dealt evenly before they are cut, and by their key, so that the pairs need no shuffle of their own
    return docs.select(key, text).repartition(key).select(key, F.explode(w).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("f"))


def _pieces(table: pa.Table) -> pa.Table:
    kinds = {"chunk": pa.int32(), "keys": pa.list_(table["key"].type), "counts": pa.binary(), "cols": pa.binary(), "f": pa.binary(), "first": pa.int32(), "terms": pa.list_(pa.string()), "docs": pa.list_(pa.int64())}
    table = table.combine_chunks()
    chunk = table["chunk"][0].as_py()
    doc, word = table["key"].chunk(0).dictionary_encode("encode"), table["term"].chunk(0).dictionary_encode()
    rows, cols = doc.indices.to_numpy(), word.indices.to_numpy()
    order = np.argsort(rows, kind="stable")
    counts, docs = np.bincount(rows), np.bincount(cols)
    cols, f = cols[order].astype(np.int32), table["f"].to_numpy()[order]
    ends = np.cumsum(counts)
    cuts = np.append(np.flatnonzero(np.diff((ends - counts) // PIECE, prepend=-1)), len(counts)).tolist()
    ends = np.append(0, ends)
    made = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        mine = slice(ends[x], ends[y])
        made.append({"chunk": chunk, "keys": doc.dictionary[x:y].to_pylist(), "counts": counts[x:y].tobytes(), "cols": cols[mine].tobytes(), "f": f[mine].tobytes()})
    for x in range(0, len(docs), PIECE):
        made.append({"chunk": chunk, "first": x, "terms": word.dictionary[x : x + PIECE].to_pylist(), "docs": docs[x : x + PIECE].tolist()})
    return pa.Table.from_pylist(made, schema=pa.schema(kinds))


def deal(terms: DataFrame, key: str) -> DataFrame:
    """``terms(key, term, f)`` by chunks of whole documents: rows with counts (``first`` is null), and rows with the chunk's terms."""
    terms = settle(terms.select(F.col(key).alias("key"), "term", "f"), "encoder_terms")
    size = terms.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
    cores = terms.sparkSession.sparkContext.defaultParallelism
    chunks = max(size["n"] // COUNTS, size["b"] // BYTES, min(3 * cores, size["n"] // LEAST)) + 1
    kind = terms.schema["key"].dataType
    dealt = terms.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int")).groupBy("chunk")
    made = dealt.applyInArrow(_pieces, f"chunk int, keys array<{kind.simpleString()}>, counts binary, cols binary, f binary, first int, terms array<string>, docs array<bigint>")
    return settle(made, "encoder_chunks")


def _columns(width: int) -> list[str]:
    return [f"x{i}" for i in range(width)]


def _array(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob).reshape(-1, width)


def _numbered(table: DataFrame) -> DataFrame:
    """``table`` with (block, pos), its own for each row, written once: blocks are dense from 0."""
    number = F.monotonically_increasing_id()
    out = settle(table.withColumn("number", number), "encoder_index")
    return out.select(F.shiftright("number", BITS).alias("block"), F.col("number").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("pos"), *table.columns)


_BLOCK = pa.schema([("block", pa.int64()), ("m", pa.binary()), ("gram", pa.binary())])
_SENT = pa.schema([("chunk", pa.int32()), ("block", pa.int64()), ("pos", pa.list_(pa.int32())), ("local", pa.list_(pa.int32())), ("m", pa.binary())])


def _block(block: int, m: np.ndarray) -> pa.Table:
    """One row: idf and vector of each of a block's terms, and the Gram matrix of the vectors."""
    return pa.Table.from_pylist([{"block": block, "m": m.tobytes(), "gram": (m[:, 1:].T @ m[:, 1:]).tobytes()}], schema=_BLOCK)


def _blocks(index: DataFrame, width: int) -> DataFrame:
    """``index(block, pos, idf, x0..)`` as a row for each block."""
    names = ["idf", *_columns(width)]

    def run(table: pa.Table) -> pa.Table:
        m = np.empty((len(table), 1 + width))
        m[table["pos"].to_numpy()] = np.stack([table[x].to_numpy() for x in names], axis=1)
        return _block(table["block"][0].as_py(), m)

    return settle(index.select("block", "pos", *names).groupBy("block").applyInArrow(run, "block long, m binary, gram binary"), "encoder_blocks")


def _asked(dealt: DataFrame, index: DataFrame) -> DataFrame:
    """(block, chunk, pos, local): which terms of a block a chunk has, and their numbers in the chunk."""
    words = dealt.filter("first is not null").select("chunk", "first", F.posexplode("terms").alias("at", "term"))
    pairs = words.join(index.select("term", "block", "pos"), "term").groupBy("block", "chunk").agg(F.collect_list(F.struct("pos", (F.col("first") + F.col("at")).alias("local"))).alias("p"))
    return settle(pairs.select("block", "chunk", F.col("p.pos").alias("pos"), F.col("p.local").alias("local")), "encoder_asked")


def _send(asked: DataFrame, blocks: DataFrame, width: int, turn: np.ndarray) -> DataFrame:
    """The idf and the vectors, times ``turn``, that each chunk asked of each block."""

    def run(asks: pa.Table, found: pa.Table) -> pa.Table:
        if not len(asks):
            return _SENT.empty_table()
        m = _array(found["m"][0].as_py(), 1 + width)
        m = np.concatenate((m[:, :1], m[:, 1:] @ turn), axis=1)
        sent = pa.array([m[pos.values.to_numpy()].tobytes() for pos in asks["pos"]], pa.binary())
        return pa.Table.from_arrays([asks["chunk"], asks["block"], asks["pos"], asks["local"], sent], schema=_SENT)

    return asked.groupBy("block").cogroup(blocks.select("block", "m").groupBy("block")).applyInArrow(run, "chunk int, block long, pos array<int>, local array<int>, m binary")


def _chunk(pieces: pa.Table, sent: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """A chunk's entries by column, count and document's start, sums of idf times vector by document, idf by column, which columns are known."""
    join = lambda k, kind: np.concatenate([np.frombuffer(x, kind) for x in pieces[k].to_pylist()])
    cols, f, counts = join("cols", np.int32), join("f", np.float64), join("counts", np.int64)
    m, known = np.zeros((int(cols.max()) + 1, 1 + width)), np.zeros(int(cols.max()) + 1, bool)
    for local, blob in zip(sent["local"], sent["m"], strict=True):
        m[local.values.to_numpy()], known[local.values.to_numpy()] = _array(blob.as_py(), 1 + width), True
    starts = np.cumsum(counts) - counts
    idf, by_doc = m[:, 0], np.empty((len(counts), width))
    for j in range(width):
        by_doc[:, j] = np.add.reduceat((idf * m[:, 1 + j])[cols] * f, starts)
    return cols, f, counts, starts, by_doc, idf, known


def _round(pieces: DataFrame, asked: DataFrame, blocks: DataFrame, width: int, turn: np.ndarray) -> DataFrame:
    """The matrix's transpose times the matrix times the blocks' vectors times ``turn``, by blocks."""

    def products(mine: pa.Table, sent: pa.Table) -> pa.Table:
        cols, f, counts, _, by_doc, idf, _ = _chunk(mine, sent, width)
        out = np.empty((len(idf), 1 + width))
        out[:, 0] = idf
        for j in range(width):
            out[:, 1 + j] = np.bincount(cols, f * np.repeat(by_doc[:, j], counts), len(idf)) * idf
        parts = pa.array([out[local.values.to_numpy()].tobytes() for local in sent["local"]], pa.binary())
        return pa.Table.from_arrays([sent["block"], sent["pos"], parts], names=["block", "pos", "m"])

    def total(table: pa.Table) -> pa.Table:
        at = [x.values.to_numpy() for x in table["pos"]]
        m = np.zeros((max(int(x.max()) for x in at) + 1, 1 + width))
        for pos, blob in zip(at, table["m"], strict=True):
            part = _array(blob.as_py(), 1 + width)
            m[pos, 1:] += part[:, 1:]
            m[pos, 0] = part[:, 0]
        return _block(table["block"][0].as_py(), m)

    sent = _send(asked, blocks, width, turn).groupBy("chunk")
    parts = pieces.groupBy("chunk").cogroup(sent).applyInArrow(products, "block long, pos array<int>, m binary")
    return settle(parts.groupBy("block").applyInArrow(total, "block long, m binary, gram binary"), "encoder_round")


def _turn(blocks: DataFrame, width: int) -> np.ndarray:
    """What makes the blocks' columns orthonormal, in the same space; columns that the others span become 0."""

    def run(batches):
        gram = sum((_array(x, width) for batch in batches for x in batch.column("gram").to_pylist()), np.zeros((width, width)))
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()]})

    grams = blocks.select("gram").mapInArrow(run, "gram binary").collect()
    gram = sum((_array(bytes(r["gram"]), width) for r in grams), np.zeros((width, width)))
    values, axes = np.linalg.eigh(gram)
    good = values > 1e-12 * max(values.max(), 1e-300)
    return axes[:, ::-1] * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)[::-1]


class Space(NamedTuple):
    """What a fit leaves: terms by (block, pos), the blocks' vectors and what turns them, and which terms each chunk has."""

    index: DataFrame
    blocks: DataFrame
    turn: np.ndarray
    asked: DataFrame


def fit(terms: DataFrame, key: str, width: int = 16, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(term, x0..) and (term, idf) of ``terms(key, term, f)``: orthonormal columns that span the leading right singular vectors."""
    return tables(fit_dealt(deal(terms, key), width, rounds))


def tables(space: Space) -> tuple[DataFrame, DataFrame]:
    """A space's vectors and weights by term."""
    turn = space.turn
    width = len(turn)

    def rows(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("m").to_pylist(), strict=True):
                x = _array(blob, 1 + width)[:, 1:] @ turn
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), pa.array(np.arange(len(x), dtype=np.int32)), *(pa.array(x[:, j]) for j in range(width))], names=["block", "pos", *_columns(width)])

    made = space.blocks.select("block", "m").mapInArrow(rows, ", ".join(["block long", "pos int", *(f"{x} double" for x in _columns(width))]))
    return settle(space.index.join(made, ["block", "pos"]).select("term", *_columns(width)), "encoder_vectors"), space.index.select("term", "idf")


def fit_dealt(dealt: DataFrame, width: int = 16, rounds: int = 8) -> Space:
    """``fit`` for terms that ``deal`` has dealt."""
    pieces = dealt.filter("first is null").select("chunk", "counts", "cols", "f")
    n = dealt.agg(F.sum(F.when(F.col("first").isNull(), F.size("keys"))).alias("n")).first()["n"] or 0
    counted = dealt.filter("first is not null").select(F.inline(F.arrays_zip("terms", "docs"))).groupBy(F.col("terms").alias("term")).agg(F.sum("docs").alias("df"))
    index = _numbered(counted.select("term", (F.log(F.lit(float(n + 1)) / (F.col("df") + 1)) + 1).alias("idf")))
    start = [(F.pmod(F.xxhash64(F.lit(i), "term"), F.lit(1_000_003)) / 500_001.5 - 1).alias(x) for i, x in enumerate(_columns(width))]
    blocks, asked = _blocks(index.select("*", *start), width), _asked(dealt, index)
    for _ in range(rounds):
        blocks = _round(pieces, asked, blocks, width, _turn(blocks, width))
    return Space(index, blocks, _turn(blocks, width), asked)


def encode(docs: DataFrame, key: str, text: str, vectors: DataFrame, weights: DataFrame, cut: int | None = CUT) -> DataFrame:
    """(key, v): the mean of the vectors of a text's known tokens, by idf, at length 1; null for texts without any."""
    width = len(vectors.columns) - 1
    dealt = deal(weighted_terms(docs, key, text, cut), key)
    index = _numbered(vectors.join(weights, "term").select("term", "idf", *_columns(width)))
    return encode_dealt(docs, key, dealt, Space(index, _blocks(index, width), np.eye(width), _asked(dealt, index)))


def encode_dealt(docs: DataFrame, key: str, dealt: DataFrame, space: Space) -> DataFrame:
    """``encode`` for the terms of ``docs`` that ``deal`` has dealt, in a space that knows its chunks."""
    width = len(space.turn)
    pieces = dealt.filter("first is null").select("chunk", "keys", "counts", "cols", "f")
    kind = pieces.schema["keys"].dataType.elementType.simpleString()

    def run(mine: pa.Table, sent: pa.Table) -> pa.Table:
        cols, f, _, starts, by_doc, _, known = _chunk(mine, sent, width)
        some = np.logical_or.reduceat(known[cols], starts)
        tokens = np.add.reduceat(known[cols] * f, starts)[some]
        keys = pa.concat_arrays([x.values for x in mine["keys"]]).filter(pa.array(some))
        sums = pa.ListArray.from_arrays(np.arange(0, width * len(tokens) + 1, width, dtype=np.int32), by_doc[some].reshape(-1))
        return pa.table({"key": keys, "sums": sums, "tokens": tokens})

    sent = _send(space.asked, space.blocks, width, space.turn).groupBy("chunk")
    summed = pieces.groupBy("chunk").cogroup(sent).applyInArrow(run, f"key {kind}, sums array<double>, tokens double")
    pooled = summed.select(F.col("key").alias(key), R.l2_normalise(F.transform("sums", lambda x: x / F.col("tokens"))).alias("v"))
    return docs.select(key).join(pooled, key, "left")


def subspace_gap(vectors: DataFrame, exact: np.ndarray, terms: list[str]) -> float:
    """The largest sine of an angle between the fitted columns and ``exact`` ones over a small table's ``terms``."""
    rows: pd.DataFrame = vectors.toPandas().set_index("term").loc[terms]
    singular = np.linalg.svd(rows.to_numpy().T @ exact, compute_uv=False)
    return float(np.sqrt(max(0.0, 1 - min(1.0, singular.min()) ** 2)))
