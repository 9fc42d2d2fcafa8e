"""Benchmark decontamination by SimHash over item-sized windows, with exact verification. Only built-in functions.

Words are runs of letters and digits (A-Z lower-cased, other scripts whole), so case and punctuation don't hide a passage. A
window similar to an item shares most of its 5-word shingles, and the window that shares most can begin at a shared one (or
be the text's last): so for a text that holds enough of an item's shingles, a window as long as the item begins at each place
that has enough of them ahead. No arrangement of the shared shingles is lost by that. The windows' SimHash and the items' are
cut into RADIUS + 1 blocks: fingerprints within RADIUS agree in a block, so the block index finds all of them. Pairs within
RADIUS are verified on shingles weighted by their counts, sum of minima over sum of maxima. At similarity 0.75 a pair of
fingerprints lies outside RADIUS with a chance near 1e-5. Items under K words are one shingle, their whole sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.license_scan import BREAK
from docketry.llm.shared import ascii_lower, hold, narrow, settle, table

K, THRESHOLD, RADIUS, BITS = 5, 0.75, 24, 64
#: Shingles of the benchmark that may be broadcast (about 40 bytes each in memory); beyond that the join shuffles.
FEW_SHINGLES = 1_000_000


def shingles(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def hashes(w: Column, n: Column) -> Column:
    return F.when(n >= K, F.transform(F.sequence(F.lit(1), n - (K - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(K))))).otherwise(F.array().cast("array<bigint>"))


def simhash(items: Column) -> Column:
    """64 bits, each the sign of the sum over shingles (repeated ones as often as they stand) of that bit of their hashes."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.aggregate(items, F.lit(0), lambda acc, x: acc + F.call_function("getbit", x, b).cast("int") * 2 - 1))
    return F.aggregate(sums, F.lit(0).cast("long"), lambda acc, s: F.shiftleft(acc, 1).bitwiseOR(F.when(s > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def masks() -> list[int]:
    """The bits of each block, as signed 64-bit integers."""
    out = [sum(1 << b for b in range(BITS) if b % (RADIUS + 1) == k) for k in range(RADIUS + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _blocks(fingerprint: Column) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(k).alias("k"), fingerprint.bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks()))))


def _overlap(a: Column, b: Column) -> Column:
    """Sum over distinct shingles of the lesser count."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def _runs(k: int) -> Column:
    """(pos, h) of each run of k words, for items of k words; the hash holds k."""
    some = F.transform(F.sequence(F.lit(1), F.col("n") - (k - 1)), lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(F.lit(k), F.slice("w", i, F.lit(k))).alias("h")))
    return F.when(F.col("n") >= k, some).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def _short(words: DataFrame, items: DataFrame) -> DataFrame | None:
    """Leaks of the items under K words, as whole sequences; None if there are none of them."""
    lengths = sorted(r[0] for r in items.filter(F.col("n_item").between(1, K - 1)).select("n_item").distinct().collect())
    if not lengths:
        return None
    own = items.filter(F.col("n_item").between(1, K - 1)).select("item_id", F.xxhash64(F.col("n_item"), F.col("iw")).alias("h")).distinct()
    runs = words.select("doc_id", "digest", F.inline(F.concat(*(_runs(k) for k in lengths)))).groupBy("doc_id", "digest", "h").agg(F.min("pos").alias("start_word"))
    few = own.limit(FEW_SHINGLES + 1).count() <= FEW_SHINGLES
    return runs.join(F.broadcast(own) if few else own, "h").select("doc_id", "digest", "item_id", F.lit(1.0).alias("similarity"), "start_word")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, digest, item_id, start_word, similarity): for each text and item at least THRESHOLD similar, its best window.

    Null and empty texts leak nothing, and items without a word are not searched for. Rows with equal doc_id and text are
    one; a null doc_id takes part like any other. Items with equal texts are reported each.
    """
    every = hold(benchmark.select("item_id", "text"), iw=shingles(F.col("text"))).withColumn("n_item", F.size("iw"))
    items = hold(every.filter(F.col("n_item") >= K), ih=hashes(F.col("iw"), F.col("n_item")))
    items = settle(items.select("item_id", "n_item", "ih", simhash(F.col("ih")).alias("fp")).distinct(), "items")
    index = items.select("item_id", "n_item", F.posexplode("ih").alias("at", "h"))
    few = index.limit(FEW_SHINGLES + 1).count() <= FEW_SHINGLES
    key = docs.select(F.col("doc_id"), F.xxhash64("text").alias("digest"), "text")
    words = hold(key, w=shingles(F.col("text"))).select("doc_id", "digest", "w", F.size("w").alias("n"))
    rows = words.select("doc_id", "digest", "n", F.posexplode_outer(hashes(F.col("w"), F.col("n"))).alias("pos", "h"))
    hits = rows.join(F.broadcast(index) if few else index, "h")
    found = hits.groupBy("doc_id", "digest", "item_id", "n_item", "n").agg(F.collect_set("at").alias("seen"), F.collect_set("pos").alias("places"))
    whole = F.col("n_item") - (K - 1)  # shingles of the item, and of a window unless its text is shorter
    # similarity t needs an overlap of t / (1 + t) times both sizes
    need = F.ceil((whole + F.least(whole, F.col("n") - (K - 1))) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).cast("int")
    found = hold(found.withColumn("need", need).filter(F.size("seen") >= F.col("need")), p=F.array_sort("places"))
    last = F.greatest(F.col("n") - F.col("n_item"), F.lit(0))
    ahead = F.filter("p", lambda x, i: (x < last) & F.coalesce(F.get("p", i + F.col("need") - 1) < x + whole, F.lit(False)))
    found = settle(found.select("doc_id", "digest", "n_item", F.array_union(ahead, F.array(last)).alias("starts")), "anchors")
    place = found.select("doc_id", "digest", "n_item", F.explode("starts").alias("start_word")).distinct()
    some = found.select("doc_id", "digest").distinct()
    texts = narrow(key.withColumns({"a": F.coalesce(F.col("doc_id"), F.lit(-1)), "b": F.col("doc_id").isNull()}).drop("doc_id"),
                   some.select("digest", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("a"), F.col("doc_id").isNull().alias("b")), ["digest", "a", "b"]).dropDuplicates(["digest", "a", "b"])
    texts = hold(texts, w=shingles(F.col("text")))
    texts = hold(texts, h=hashes(F.col("w"), F.size("w"))).select("digest", "a", "b", "h")
    place = place.withColumns({"a": F.coalesce(F.col("doc_id"), F.lit(-1)), "b": F.col("doc_id").isNull()})
    window = texts.join(place, ["digest", "a", "b"]).select("doc_id", "digest", "n_item", "start_word", F.slice("h", F.col("start_word") + 1, F.col("n_item") - (K - 1)).alias("wh"))
    window = settle(hold(window, wfp=simhash(F.col("wh"))), "windows")
    block = window.select("doc_id", "digest", "n_item", "start_word", "wfp", _blocks(F.col("wfp")).alias("block")).select("*", "block.*").drop("block")
    mine = items.select("item_id", "n_item", "fp", _blocks(F.col("fp")).alias("block")).select("item_id", "n_item", "fp", "block.*")
    near = block.join(mine, ["n_item", "k", "part"]).filter(F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= RADIUS)
    near = near.select("doc_id", "digest", "n_item", "start_word", "item_id").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")) & (F.col("start_word") == F.col("s")) & (F.col("n_item") == F.col("m"))
    full = near.join(window.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("start_word").alias("s"), F.col("n_item").alias("m"), "wh"), same).join(items.select("item_id", "ih"), "item_id")
    scored = hold(full, c=_overlap(F.col("wh"), F.col("ih"))).withColumn("similarity", F.col("c") / (F.size("wh") + F.size("ih") - F.col("c"))).filter(F.col("similarity") >= THRESHOLD)
    best = scored.groupBy("doc_id", "digest", "item_id").agg(F.max("similarity").alias("similarity"), F.min_by("start_word", F.struct(-F.col("similarity"), "start_word")).alias("start_word"))
    short = _short(words, every)
    return best if short is None else best.unionByName(short)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "item_id", "start_word", F.round("similarity", 9).alias("similarity"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of an equal doc_id and text; null and empty texts stay."""
    found = leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = settle(found.select(F.coalesce("doc_id", F.lit(-1)).alias("__a"), F.col("doc_id").isNull().alias("__b"), F.col("digest").alias("__c")).distinct(), "leaking")
    named = docs.withColumns({"__a": F.coalesce("doc_id", F.lit(-1)), "__b": F.col("doc_id").isNull(), "__c": F.xxhash64("text")})
    return narrow(named, bad, ["__a", "__b", "__c"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
