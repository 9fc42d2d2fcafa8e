"""N-gram Jaccard join: universe partition, pigeonhole, one-deletion neighbourhoods, exact verification.

Sets r, s with Jaccard >= t differ in at most H = floor((1-t)/(1+t) * (|r|+|s|)) items. A size band hashes the universe of
items into m segments; the sets then agree in all but H segments, and in a segment where they differ by one item, one set
is the other less an item. A prober takes for each segment v = -1 (left out), 0 (its subset) or 1 (its subset, and each
subset with one item deleted), so that sum(v + 1) over its segments exceeds H: some segment then matches an indexed one.
Which v is chosen by cost: subsets of many items are rare in the corpus, so they come first; deletions, which cost one
signature an item, come last and only where the subsets don't suffice. Empty subsets match everything and are never used.

A set is indexed in the scheme of its own band, and probes that scheme and those of the smaller sizes it can link with.
Bands whose probers need deletions index one-deletion neighbourhoods too (and single items, where hashing has put a small set
into so few segments that deletions don't suffice either); the number of bands is logarithmic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import kernel, linking
from docketry.llm.kernel import U, mix
from docketry.llm.shared import narrow, partitions, settle, table

NUM, DEN = 75, 100
K = 5
MASK = 2**64 - 1
#: Signatures that a task holds before it deals them out.
HELD = 1_500_000


def bands(num: int = NUM, den: int = DEN, top: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band; bands are as wide as the sizes that can link, at least one size each."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * den // num))
    return np.array(out, np.int64)


BANDS = bands()


def differ(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """The most items in which sets of sizes a and b with that similarity can differ."""
    return (den - num) * (a + b) // (den + num)


def segments(band: int) -> int:
    """How many segments the scheme of a band has: more, compared with H, for small sets, where hashing is less even."""
    top = int(BANDS[band + 1]) - 1
    return max(4, top) if top <= 96 else (top + 1) // 2 if top <= 200 else int(top * 0.42) + 1


def _scheme(items: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = segments(band)
    salted = mix(items + U((band + 1) * 0xD6E8FEB86659FD93 & MASK))
    at = ((salted >> U(20)) % U(m)).astype(np.int64)
    value = np.zeros(m, U)
    np.add.at(value, at, salted)
    return at, salted, value


def _sign(value: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(value + segment.astype(U) * U(0xA24BAED4963EE407) + U(band * 0x9FB21C651E98DF25 & MASK))


def needs(size: int, band: int) -> int:
    """sum(v + 1) that a prober of that size must exceed in the scheme of a band."""
    return differ(size, min(size, int(BANDS[band + 1]) - 1))


def signatures(items: np.ndarray, extra: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of one set, and which of them probe."""
    size = len(items)
    own = int(np.searchsorted(BANDS, size, "right")) - 1
    sigs, probes = [], []
    band = own
    while band >= 0 and (int(BANDS[band + 1]) - 1) * DEN >= NUM * size:
        at, salted, value = _scheme(items, band)
        count = np.bincount(at, minlength=len(value))
        used = np.flatnonzero(count)
        need = needs(size, band) + 1
        chosen = used[np.argsort(-count[used], kind="stable")][:need]
        sig = _sign(value, np.arange(len(value)), band)
        deep = chosen[count[chosen] > 1][: need - len(chosen)]  # v = 1 where subsets alone don't suffice
        probing = np.zeros(len(value), bool)
        probing[chosen] = True
        shown = used if band == own else chosen
        sigs.append(sig[shown])
        probes.append(probing[shown])
        if 2 * band + 1 in extra:
            sigs.append(_sign(salted, np.full(size, -1), band))
            probes.append(np.full(size, len(chosen) + len(deep) < need))
        if 2 * band in extra:
            near = np.isin(at, deep) if band != own else np.ones(size, bool)
            near &= count[at] > 1
            sigs.append(_sign(value[at[near]] - salted[near], at[near], band))
            probes.append(np.isin(at[near], deep))
        band -= 1
    return (np.concatenate(sigs), np.concatenate(probes)) if sigs else (np.zeros(0, U), np.zeros(0, bool))


def extras(items: np.ndarray) -> list[int]:
    """What this set needs beyond subsets: 2b for deletions in band b; 2b + 1, where even those don't suffice, for its single items."""
    size, out = len(items), []
    band = int(np.searchsorted(BANDS, size, "right")) - 1
    while band >= 0 and (int(BANDS[band + 1]) - 1) * DEN >= NUM * size:
        count, need = np.bincount(_scheme(items, band)[0]), needs(size, band) + 1
        chosen, many = min(need, int((count > 0).sum())), int((count > 1).sum())
        if chosen < need:
            out += [2 * band] if chosen + many >= need else [2 * band, 2 * band + 1]
        band -= 1
    return out


def _profile(batches):
    """(row key, size, set hashes) of each text, and what it needs beyond subsets."""
    for batch in batches:
        sizes, ones, twos, extra = [], [], [], []
        for _, data, offsets in kernel.blocks(batch.column("text")):
            items, cut = kernel.shingle_sets(data, offsets, K)
            a = np.concatenate((np.zeros(1, U), np.cumsum(items)))
            b = np.concatenate((np.zeros(1, U), np.cumsum(mix(items + U(77)))))
            sizes.append(np.diff(cut))
            ones.append(a[cut[1:]] - a[cut[:-1]])
            twos.append(b[cut[1:]] - b[cut[:-1]])
            extra += [extras(items[x:y]) if y > x else [] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        if sizes:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(ones).view(np.int64)), pa.array(np.concatenate(twos).view(np.int64)), pa.array(extra, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "one", "two", "extra"],
            )


def _signer(buckets: int, extra: frozenset[int]):
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            sizes, held, kept = np.zeros(len(ids), np.int64), [], 0
            for first, data, offsets in kernel.blocks(batch.column("text")):
                items, cut = kernel.shingle_sets(data, offsets, K)
                sizes[first : first + len(cut) - 1] = np.diff(cut)
                for k, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if y > x:
                        sig, probe = signatures(items[x:y], extra)
                        held.append((np.full(len(sig), first + k, np.int32), sig, probe))
                        kept += len(sig)
                if kept > HELD:
                    yield linking.packed(list(linking.pack(ids, sizes, *map(np.concatenate, zip(*held, strict=True)), buckets)))
                    held, kept = [], 0
            if held:
                yield linking.packed(list(linking.pack(ids, sizes, *map(np.concatenate, zip(*held, strict=True)), buckets)))

    return run


def _sets(batches):
    """(id, items) of each text, a block of texts at a time, so that no more than that is held beside the input."""
    for batch in batches:
        for first, data, offsets in kernel.blocks(batch.column("text")):
            items, cut = kernel.shingle_sets(data, offsets, K)
            sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut * 8), pa.py_buffer(items)])
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(cut) - 1), sets.cast(pa.binary())], names=["id", "items"])


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents of which each id has one text. Equal sets are one class before any signature
    is made, so exact copies cost one row each."""
    spark = docs.sparkSession
    seen = settle(docs.mapInArrow(_profile, "doc_id long, n_shingles long, one long, two long, extra array<int>"), "profile")
    full = seen.filter("doc_id is not null and n_shingles > 0")
    classes = settle(full.groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("id"), F.min("extra").alias("extra")), "classes")
    total = classes.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    deletions = frozenset(r[0] for r in classes.select(F.explode("extra")).distinct().collect())  # at most twice the number of bands
    buckets = max(partitions(spark), total // 3_000_000 + 1)
    # documents of one class are linked by their equal sets
    member = full.join(classes.select("one", "two", "n_shingles", "id"), ["one", "two", "n_shingles"])
    copies = settle(member.filter("doc_id != id").select(F.col("doc_id").alias("id")).distinct(), "copies")
    texts = docs.filter("doc_id is not null").withColumnRenamed("doc_id", "id")
    blobs = narrow(texts, copies, ["id"], "left_anti").mapInArrow(_signer(int(buckets), deletions), linking.BLOB)
    found = linking.groups(blobs)
    joined = linking.link(found, lambda ids: narrow(texts, ids, ["id"]).mapInArrow(_sets, "id long, items binary"), NUM, DEN)
    of = member.join(joined, "id", "left").select("doc_id", F.coalesce("component", "id").alias("c"))
    return seen.select("doc_id", "n_shingles").join(of.groupBy("doc_id").agg(F.min("c").alias("c")), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id")
    )


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Null or blank texts have no shingles and are linked with nothing; a null doc_id takes part in no link and keeps a null
    component. Repeated rows come back as often as they stand in ``docs``; rows that share a doc_id but not a text are one node
    of the graph: each of their texts is joined under an id of its own, and the components of one doc_id are united. A doc_id
    is read as a long.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    several = settle(several, "several_texts")
    if several.isEmpty():
        return _components(docs)
    own = F.when(F.col("lo").isNull() | (F.col("lo") == digest), F.col("doc_id")).otherwise(F.xxhash64("doc_id", digest))
    split = settle(docs.join(several, "doc_id", "left").select(F.col("doc_id").alias("real"), own.alias("doc_id"), "text", F.col("lo").isNotNull().alias("many")), "split_texts")
    found = settle(_components(split.select("doc_id", "text")), "split_components")
    nodes = found.select("doc_id", "component_id").distinct().join(split.select("doc_id", "real", "many").distinct(), "doc_id")
    least = nodes.filter("many").groupBy("real").agg(F.min("component_id").alias("b"))
    ties = linking.components(nodes.filter("many").join(least, "real").select(F.col("component_id").alias("a"), "b"), "ties")
    united = nodes.join(ties.withColumnRenamed("id", "component_id"), "component_id", "left").select("doc_id", "real", F.coalesce("component", "component_id").alias("c"))
    name = united.groupBy("c").agg(F.min("real").alias("least"))
    label = united.join(name, "c").select("doc_id", "real", "least")
    rows = found.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    return rows.select(F.col("real").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id (of equal ids, all its rows). Null ids, and null and
    blank texts, are linked with nothing and stay; an empty table stays empty."""
    found = jaccard_components(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
