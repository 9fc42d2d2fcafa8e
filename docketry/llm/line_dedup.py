"""Line dedup: fuzzy lines by MinHash over character shingles, verified, one line kept of each component.

Lines are compared trimmed and with A-Z lower-cased. Equal lines are one class at once; between classes, MinHash signatures
of BANDS bands of ROWS find candidates. Lines of at most FEW shingles have as many independent minima; longer ones have
one-permutation signatures (a bin a minimum, empty ones densified), and so have those that can link with longer ones. By
calculation for independent minima a pair at the threshold of 0.75 is missed with a chance of 0.0049, one at 0.85 of 3e-5.
Candidates are verified on their whole sets of 8-character shingles and joined to components; of each component the first
line, by doc_id and line number, stays. Lines without a word always stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import kernel, linking
from docketry.llm.kernel import LOWERED, U, mix
from docketry.llm.shared import narrow, partitions, settle, table

K, NUM, DEN = 8, 75, 100
BANDS, ROWS = 14, 4
BINS = BANDS * ROWS
#: Shingles up to which a line has independent minima: with fewer in hand, bins copy each other, and bands fail together.
FEW = 53
FACTORS = np.random.Generator(np.random.PCG64(75)).integers(1, 2**62, BINS, dtype=np.int64).astype(U) * U(2) + U(1)
#: Times that an empty bin looks for a full one, each time in a place of its own; the few left take the least hash of all.
ATTEMPTS = 12
BLOCK = 250_000
#: Lines by which a task knows that it has signed an equal one; beyond that it begins anew.
SEEN = 2_000_000
#: Items of a span that are looked at first to tell whether it has more than FEW.
HEAD = 72
#: Signatures that a task packs at once.
HELD = 1_000_000
#: Dropped lines (and eight for each text) that may be broadcast, at four bytes each; beyond that the join shuffles.
BROADCAST_NUMBERS = 4_000_000


def _lines(data: np.ndarray, offsets: np.ndarray):
    """(text, line number, start, end) of each line with a word, trimmed."""
    breaks = np.flatnonzero(data == 10)
    count = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    text = np.repeat(np.arange(len(offsets) - 1), count)
    base = np.concatenate(([0], np.cumsum(count)))
    number = np.arange(len(text)) - base[text]
    starts = np.empty(len(text), np.int64)
    first = number == 0
    starts[first] = offsets[:-1]
    starts[~first] = breaks + 1
    ends = np.empty(len(text), np.int64)
    last = number == count[text] - 1
    ends[last] = offsets[1:]
    ends[~last] = breaks
    solid = np.flatnonzero(kernel._SOLID[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    worded = b > a
    return text[worded], number[worded], solid[a[worded]], solid[b[worded] - 1] + 1


def _shingles(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Hashes of the K-character shingles of each span, end to end, and each one's span; short spans are one shingle. Spans ascend."""
    solid = (data & 0xC0) != 0x80
    if solid.all():
        a, b, wide, sums_at, inverse = start, end, None, sums, kernel._powers(len(sums))[1]
    else:
        wide = np.flatnonzero(solid)
        a, b = np.searchsorted(wide, start), np.searchsorted(wide, end)
        inverse = kernel._powers(len(sums))[1][wide]
        wide = np.append(wide, len(data))
        sums_at = sums[wide]
    n = np.maximum(b - a - K + 1, 0)
    some = np.flatnonzero(n)
    last = len(sums_at) - K
    if last > 0:
        every = sums_at[K:] - sums_at[:-K]
        every *= inverse[:last]
        every += U(K) if wide is None else (wide[K:] - wide[:-K]).astype(U)
        inside = np.zeros(last + 1, np.int8)
        inside[a[some]] = 1
        np.subtract.at(inside, a[some] + n[some], 1)
        items = every[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        items ^= items >> U(32)
        items *= U(0xBF58476D1CE4E5B9)
        items ^= items >> U(29)
    else:
        items = np.zeros(0, U)
    own = np.repeat(np.arange(len(start)), n)
    if len(some) < len(start):
        tiny = np.flatnonzero(n == 0)
        items, own = np.concatenate((items, kernel.span_hash(sums, start[tiny], end[tiny]))), np.concatenate((own, tiny))
        order = np.argsort(own, kind="stable")
        items, own = items[order], own[order]
    return items, own


def _minhash(items: np.ndarray, count: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The signature of each ``mine`` of spans with ``count`` items: the least hash in each bin, empty bins filled from full ones elsewhere, so that a band has several."""
    if not mine.all():
        items, count = items[np.repeat(mine, count)], count[mine]
    top, n = U(2**64 - 1), len(count)
    sig = np.full(n * BINS, top, U)
    at = items & U(0xFFFFFFFF)
    at *= U(BINS)
    at >>= U(32)
    at = at.view(np.int64)
    at += np.repeat(np.arange(0, n * BINS, BINS), count)
    np.minimum.at(sig, at, items)
    sig = sig.reshape(n, BINS)
    short = np.flatnonzero((sig == top).any(axis=1))
    full = sig[short]
    part, bins = full.copy(), np.arange(BINS)
    for attempt in range(ATTEMPTS):
        source = (mix((bins + BINS * (attempt + 1)).astype(U)) % U(BINS)).astype(np.int64)
        part = np.where(part == top, full[:, source], part)
    sig[short] = np.where(part == top, full.min(axis=1, keepdims=True), part)
    return sig


def _minima(items: np.ndarray, count: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The signature of each ``mine`` of spans with ``count`` items by BINS independent minima; each has an item."""
    items, count = items[np.repeat(mine, count)], count[mine]
    sig, start = np.empty((len(count), BINS), U), np.cumsum(count) - count
    for j in range(BINS if len(count) else 0):
        # the product alone would order nearby multipliers alike; its high half, folded in and multiplied again, does not
        value = items * FACTORS[j]
        value ^= value >> U(32)
        value *= FACTORS[BINS - 1 - j]
        sig[:, j] = np.minimum.reduceat(value, start)
    return sig


def _sizes(items: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Distinct items of spans with ``count`` items; where that is at most NUM / DEN of FEW, or above FEW, any number on that side."""
    size, n = count.copy(), len(count)
    start = np.cumsum(size) - size
    some = np.flatnonzero(size * DEN > FEW * NUM)
    # the first HEAD items of a span show for most that it has more than FEW distinct ones
    head = np.minimum(size[some], HEAD)
    at = np.repeat(start[some] - (np.cumsum(head) - head), head) + np.arange(int(head.sum()))
    full = np.zeros(len(some) * 256, bool)
    full[np.repeat(np.arange(0, 256 * len(some), 256), head) + (items[at] >> U(56)).astype(np.int64)] = True
    open_ = np.zeros(n, bool)
    open_[some[np.count_nonzero(full.reshape(-1, 256), axis=1) <= FEW]] = True
    item, line = items[np.repeat(open_, count)], np.repeat(np.flatnonzero(open_), count[open_])
    order = np.lexsort((item, line))
    item, line = item[order], line[order]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (line[1:] != line[:-1]))) if len(item) else np.zeros(0, bool)
    size[open_] = np.bincount(line[new], minlength=n)[open_]
    return size


def _bands(items: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, band hash) of n spans: BANDS each, twice as many for spans that can link with both shorter and longer ones."""
    count = np.bincount(own, minlength=n)
    size, local, flat = _sizes(items, count), [], []
    for k, (mine, make) in enumerate(((size <= FEW, _minima), (size * DEN > FEW * NUM, _minhash))):
        at = np.flatnonzero(mine)
        if not len(at):
            continue
        sig = make(items, count, mine).reshape(len(at), BANDS, ROWS)
        band = np.arange(k * BANDS, (k + 1) * BANDS, dtype=np.int64).astype(U) * U(0x9FB21C651E98DF25)
        for r in range(ROWS):
            band = band + sig[:, :, r] * kernel._MULT[r]
        flat.append(mix(band).reshape(-1))
        local.append(np.repeat(at, BANDS))
    return np.concatenate(local), np.concatenate(flat)


def _keys(batches):
    """(doc_id, digest, line, one, two, chars) of each line with a word."""
    for batch in batches:
        ids, digests = batch.column("doc_id"), batch.column("digest")
        for first, data, offsets in kernel.blocks(batch.column("text"), BLOCK):
            lower = LOWERED[data]
            text, number, start, end = _lines(data, offsets)
            one = kernel.span_hash(kernel.prefix(lower), start, end)
            two = kernel.span_hash(kernel.prefix(lower, other=True), start, end)
            at = pa.array(text + first)
            yield pa.RecordBatch.from_arrays([ids.take(at), digests.take(at), pa.array(number.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "digest", "line", "one", "two"])


def _signer(buckets: int):
    def flush(held):
        one, local, flat = map(np.concatenate, zip(*held, strict=True))
        local += np.repeat(np.cumsum([0, *(len(x[0]) for x in held[:-1])]), [len(x[1]) for x in held])
        return linking.packed(list(linking.pack(one.view(np.int64), np.zeros(len(one), np.int64), local, flat, np.ones(len(flat), bool), buckets)))

    def run(batches):
        seen, held, n = np.zeros(0, U), [], 0  # seen: lines that this task has signed, in order
        for batch in batches:
            for _, data, offsets in kernel.blocks(batch.column("text"), BLOCK):
                lower = LOWERED[data]
                _, _, start, end = _lines(data, offsets)
                if not len(start):
                    continue
                sums = kernel.prefix(lower)
                one = kernel.span_hash(sums, start, end)
                fresh, at = np.unique(one, return_index=True)
                new = ~np.isin(fresh, seen, assume_unique=True)
                if not new.any():
                    continue
                seen = np.sort(np.concatenate((seen if len(seen) < SEEN else seen[:0], fresh[new])))
                at = np.sort(at[new])
                one = one[at]
                held.append((one, *_bands(*_shingles(data, sums, start[at], end[at]), len(at))))
                n += len(held[-1][2])
                if n >= HELD:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return run


def _sets(batches):
    """(id, items) for the lines of a text whose numbers ``wanted`` lists; items is the lower-cased line."""
    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for first, data, offsets in kernel.blocks(batch.column("text"), BLOCK):
            text, number, start, end = _lines(data, offsets)
            longest = int(number.max(initial=0)) + 1
            want = np.array([k * longest + w for k in range(len(offsets) - 1) for w in wanted[first + k] if w < longest], np.int64)
            mine = np.flatnonzero(np.isin(text * longest + number, want))
            if not len(mine):
                continue
            start, end = start[mine], end[mine]
            low = LOWERED[data]
            ids = kernel.span_hash(kernel.prefix(low), start, end)
            raw = low.tobytes()
            texts = [raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(texts, pa.binary())], names=["id", "items"])


def _unpack(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each line."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(x) for x in texts])
    items, own = _shingles(data, kernel.prefix(data), end - np.array([len(x) for x in texts], np.int64), end)
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    at = cut.tolist()
    for x, y in zip(at[:-1], at[1:], strict=True):
        items[x:y].sort()  # np.unique would hash each set first, and takes four times as long
    fresh = np.ones(len(items), bool)
    fresh[1:] = (items[1:] != items[:-1]) | (own[1:] != own[:-1])
    items, at = items[fresh], np.concatenate(([0], np.cumsum(fresh)))[cut].tolist()
    return [items[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, drop): the line numbers that each text of ``docs(doc_id, digest, text)`` loses.

    Rows with equal doc_id and text are one document and lose the same lines. Texts that lose nothing have no row.
    """
    spark = docs.sparkSession
    lines = settle(docs.mapInArrow(_keys, "doc_id long, digest long, line int, one long, two long"), "lines")
    place = F.struct("doc_id", "digest", "line")
    classes = settle(lines.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")), "classes")
    buckets = max(partitions(spark), classes.count() * BANDS // 3_000_000 + 1)
    found = linking.groups(docs.select("text").mapInArrow(_signer(buckets), linking.BLOB))

    def sets(ids: DataFrame) -> DataFrame:
        at = narrow(classes.withColumnRenamed("one", "id"), ids, ["id"]).groupBy("first.doc_id", "first.digest").agg(F.collect_set("first.line").alias("wanted"))
        return narrow(docs, settle(at, "wanted"), ["doc_id", "digest"], "inner").select("text", "wanted").mapInArrow(_sets, "id long, items binary")

    joined = linking.link(found, sets, NUM, DEN, _unpack, inside=True)
    named = classes.join(joined.withColumnRenamed("id", "one"), "one", "left").withColumn("c", F.coalesce("component", "one"))
    named = settle(named.filter("component is not null or n > 1"), "repeated")
    head = named.groupBy("c").agg(F.min("first").alias("keep"))
    repeated = named.join(head, "c").select("one", "two", "keep")
    return lines.join(repeated, ["one", "two"]).filter(place != F.col("keep")).groupBy("doc_id", "digest").agg(F.collect_set("line").alias("drop"))


def dedup_lines(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` less its repeated lines, and ``lines_dropped``.

    Texts that lose no line come back as they are (null stays null); a text all of whose worded lines are repeats of other
    documents' lines becomes what is left of it, often the empty text. A null doc_id sorts before all others; a doc_id is read
    as a long. Other columns, whatever their names, pass through, but a ``lines_dropped`` of the input is replaced.
    """
    names = [c for c in df.columns if c != "lines_dropped"]
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    inner = inner.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("row.text").alias("text"), F.xxhash64("row.text").alias("digest"))
    gone = dropped_lines(inner.select("doc_id", "digest", "text"))
    gone = settle(gone, "gone")
    size = gone.agg(F.coalesce(F.sum(F.size("drop") + 8), F.lit(0)).alias("n")).first()["n"]
    both = inner.join(F.broadcast(gone) if size <= BROADCAST_NUMBERS else gone, ["doc_id", "digest"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False))), "\n")
    return both.select("row", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("kept"), F.coalesce(F.size("drop"), F.lit(0)).alias("lines_dropped")).select(
        *(F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names), F.when(F.col("lines_dropped") < 0, 0).otherwise(F.col("lines_dropped")).alias("lines_dropped")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("lines_dropped").cast("long").alias("lines_dropped"), F.length(text).cast("long").alias("chars_kept"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated lines, n_chars to match; documents of which no word is left go. Null texts lose no line and stay,
    as do blank ones; of equal lines, one in one document stays. A column ``lines_dropped`` keeps the input's values."""
    held = docs.withColumnRenamed("lines_dropped", "__lines_dropped")
    out = dedup_lines(held).filter((F.col("lines_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "lines_dropped" in docs.columns:
        out = out.drop("lines_dropped").withColumnRenamed("__lines_dropped", "lines_dropped")
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))
