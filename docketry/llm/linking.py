"""From groups that share a signature to components of verified links, without forming all pairs of a group.

A *group* says: any two members of it may be similar, if at least one of them is a prober. Members first meet the hub with
which they share most groups, and only what verified links have not yet joined is compared further:

1. each member is verified against its hub; links give components (``components``);
2. in groups whose members lie in different components, pairs across components are tried by sketches whose distance bounds
   the sets' difference from below, in blocks inside a task; only those that may be links become rows and are verified.

So a group of n copies costs about n verifications, no link between components is lost, and no group is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.kernel import U, mix
from docketry.llm.shared import partitions, settle

BLOB = "bucket int, ids binary, sizes binary, at binary, sig binary"
GROUPS = "gid long, id long, n int, prober boolean"


def pack(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, sig: np.ndarray, prober: np.ndarray, buckets: int) -> Iterator[dict]:
    """Rows of BLOB: signatures dealt into buckets by their hash, five bytes each, of which one bit says 'prober'.

    ``at`` points into ``ids``/``sizes``. Cutting a signature to 39 bits beside its bucket can only add candidates.
    """
    where = (sig >> U(32)) % U(buckets)
    order = np.argsort(where.astype(np.uint16) if buckets <= 65536 else where, kind="stable")  # of 16 bits by digits
    cuts = np.concatenate(([0], np.cumsum(np.bincount(where.view(np.int64), minlength=buckets)))).tolist()
    short = ((sig[order] & U(0x7FFFFFFFFF)) << U(1)) | prober[order].astype(U)
    short, at = np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :5]), at[order]
    direct = len(sig) <= 24 * len(ids)  # few signatures a member: each has its member beside it
    for b in range(buckets):
        x, y = cuts[b], cuts[b + 1]
        if x == y:
            continue
        if direct:
            here, local = at[x:y], at[:0]
        else:
            here, local = np.unique(at[x:y], return_inverse=True)
        size = sizes[here].astype(np.int32)
        yield {
            "bucket": b, "ids": ids[here].astype(np.int64).tobytes(), "sizes": size.tobytes() if size.any() else b"", "at": local.astype(np.uint16 if len(here) < 65536 else np.uint32).tobytes(),
            "sig": short[x:y].tobytes(),
        }


def packed(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("bucket", pa.int32()), *((k, pa.binary()) for k in ("ids", "sizes", "at", "sig"))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _members(frame: pd.DataFrame) -> pd.DataFrame:
    """The groups of one bucket, each member list once."""
    ids, sizes, sigs = [], [], []
    for row_ids, row_sizes, at, sig in zip(frame["ids"], frame["sizes"], frame["at"], frame["sig"], strict=True):
        here = np.frombuffer(row_ids, np.int64)
        size = np.frombuffer(row_sizes, np.int32) if row_sizes else np.zeros(len(here), np.int32)
        wide = np.zeros((len(sig) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(sig, np.uint8).reshape(-1, 5)
        local = np.frombuffer(at, np.uint16 if len(here) < 65536 else np.uint32) if at else slice(None)
        ids.append(here[local])
        sizes.append(size[local])
        sigs.append(wide.reshape(-1).view(U))
    ids, sizes, sigs = map(np.concatenate, (ids, sizes, sigs))
    order = np.argsort(sigs >> U(1))
    key = sigs[order] >> U(1)
    same = key[1:] == key[:-1]
    order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]  # lone signatures go first
    if not len(order):
        return pd.DataFrame({"gid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int32"), "prober": pd.Series(dtype="bool")})
    order = order[np.lexsort((ids[order], sigs[order] >> U(1)))]
    key, ids, sizes, prober = sigs[order] >> U(1), ids[order], sizes[order], (sigs[order] & U(1)).astype(bool)
    # one row for each (group, member); a prober if any of its rows is one
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
    at = np.flatnonzero(fresh)
    prober = np.logical_or.reduceat(prober, at)
    key, ids, sizes = key[at], ids[at], sizes[at]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(start, len(key)))
    mark = mix(ids.view(U) * U(2) + prober.astype(U) + U(0x51ED270B))
    gid = mix(np.add.reduceat(mark, start) + count.astype(U))
    useful = (count > 1) & np.logical_or.reduceat(prober, start)
    _, once = np.unique(gid, return_index=True)
    keep = np.zeros(len(start), bool)
    keep[once] = True
    keep &= useful
    rows = np.repeat(keep, count)
    return pd.DataFrame({"gid": np.repeat(gid, count)[rows].view(np.int64), "id": ids[rows], "n": sizes[rows], "prober": prober[rows]})


def groups(blobs: DataFrame) -> DataFrame:
    """Distinct groups of at least two members, one of them a prober, as rows of GROUPS."""
    found = blobs.groupBy("bucket").applyInPandas(_members, GROUPS)
    return found.dropDuplicates(["gid", "id"])


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a partition as stars around the smallest id that they reach within it: fewer rounds follow."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for frame in frames:
        for x, y in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            u, v = root(x), root(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
    ids = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"a": np.array(ids, np.int64), "b": np.array([root(x) for x in ids], np.int64)})


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(id, component) for every end of ``edges(a, b)``: the smallest id reachable, by alternating large and small stars.

    Each round is two keyed joins on the edges; it ends when a round changes nothing.
    """
    a, b = F.col("a"), F.col("b")
    now = settle(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().mapInPandas(_contract, "a long, b long"), name)
    mark = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    seen = mark(now)
    while seen["n"]:
        both = now.select("a", "b").union(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.filter(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = settle(small.filter(a != b).distinct(), name)
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(a.alias("id"), b.alias("component")).union(now.select(b.alias("id"), b.alias("component")).distinct())


def plain(payloads: list[bytes]) -> list[np.ndarray]:
    """Payloads that are the sets themselves."""
    return [np.frombuffer(x, U) for x in payloads]


def link(found: DataFrame, sets: Callable[[DataFrame], DataFrame], num: int, den: int, unpack: Callable[[list[bytes]], list[np.ndarray]] = plain, inside: bool = False) -> DataFrame:
    """(id, component) of everything that a link ``den * common >= num * union`` joins to something else.

    ``found``: GROUPS. ``sets(ids)``: (id, items) for each set in ``ids(id)``; ``unpack`` turns items into sorted 64-bit hashes.
    ``inside``: items are small enough to go along with each group, so that pairs across components are verified where they
    meet, and only links that still join something are reported.
    """
    spark = found.sparkSession
    found = settle(found, "groups")
    hub = found.groupBy("gid").agg(F.min_by("id", F.struct(~F.col("prober"), F.col("id"))).alias("hub"))
    meets = found.join(hub, "gid").filter("id != hub").groupBy("id", "hub").agg(F.count("*").alias("votes"))
    first = meets.groupBy("id").agg(F.max_by("hub", F.struct("votes", -F.col("hub"))).alias("b")).select(F.col("id").alias("a"), "b")
    tried = settle(first, "pairs")
    # nearly all members of groups are in a pair; what the others add costs less than a second reading for what is left
    own = settle(sets(found.select("id").distinct()), "sets")
    first = settle(verify(tried, own, num, den, unpack), "hubs")
    joined = components(first)
    label = found.join(joined, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = label.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.min("id").alias("lead"), F.max("id").alias("last")).filter("lo != hi")
    # a group of two whose pair was verified has nothing left to try
    done = tried.select(F.least("a", "b").alias("lead"), F.greatest("a", "b").alias("last"), F.lit(2).cast("long").alias("size")).distinct()
    split = split.join(done, ["lead", "last", "size"], "left_anti").select("gid", "size", "lead")
    left = settle(label.join(split, "gid").select("gid", "id", "prober", "c", "size", "lead"), "split")
    if left.isEmpty():
        return joined
    sketch = own.select("id", F.lit(0).cast("long").alias("n"), F.col("items").alias("bits")) if inside else own.mapInArrow(_sketches(unpack), "id long, n long, bits binary")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    at = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    dealt = left.join(sketch, "id").withColumn("chunks", chunks).withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.xxhash64("gid", F.least("at", "other"), F.greatest("at", "other")).alias("cell"), F.xxhash64("lead", F.pmod("gid", F.lit(SPREAD // 4 if inside else SPREAD))).alias("near"), "id", "prober", "c", "n", "bits", (F.col("at") <= F.col("other")).alias("low"), (F.col("at") >= F.col("other")).alias("high"), F.col("chunks").alias("cells"))
    buckets = max(partitions(spark), left.count() // 100_000 + 1)
    more = dealt.groupBy(F.pmod(F.xxhash64("near", F.when(F.col("cells") > 1, F.col("cell"))), F.lit(buckets)).alias("bucket")).applyInPandas(_survivors(num, den, unpack if inside else None), "a long, b long").distinct()
    second = settle(more if inside else verify(settle(more, "pairs"), own, num, den, unpack), "rest")
    if second.isEmpty():
        return joined
    return components(first.union(second))


#: Members of a group that meet in one piece of work; larger groups are dealt into pairs of chunks.
CHUNK = 4096
#: Members of a cell up to which pairs are tried one by one; arrays cost more there than they save.
SMALL = 8
#: Groups with one smallest member (those of one cluster) go to so many buckets, each of which names a pair once; where items
#: go along, to a quarter of that, so that a set is unpacked less often.
SPREAD = 64


def _sketches(unpack: Callable[[list[bytes]], list[np.ndarray]]):
    """Of each set its size and a parity sketch: bit h mod B counts the items there, modulo 2; B is 4 to 8 times the size.

    Two sketches differ in at most as many bits as their sets differ in items, so they rule out pairs without an error.
    """

    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                made = _sketch(unpack(batch.column("items").to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in made], pa.int64()), pa.array([b for _, b in made], pa.binary())], names=["id", "n", "bits"])

    return run


def _sketch(sets: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """(size, bits) of each set; sets with sketches of one width are counted together."""
    size = np.array([len(x) for x in sets], np.int64)
    width = np.array([max(256, 1 << (4 * n).bit_length()) for n in size.tolist()], np.int64)
    out: list[tuple[int, bytes]] = [(0, b"")] * len(sets)
    for w in set(width.tolist()):
        every = np.flatnonzero(width == w).tolist()
        step = max(1, 262_144 // w)
        for k in range(0, len(every), step):
            mine = every[k : k + step]
            bit = ((np.concatenate([sets[i] for i in mine]) >> U(7)) & U(w - 1)).view(np.int64)
            bit += np.repeat(np.arange(0, w * len(mine), w), size[mine])
            odd = (np.bincount(bit, minlength=w * len(mine)) & 1).astype(bool).reshape(len(mine), w)
            raw = np.packbits(odd, axis=1, bitorder="little").tobytes()
            for n, i in enumerate(mine):
                out[i] = int(size[i]), raw[n * w // 8 : (n + 1) * w // 8]
    return out


def _survivors(num: int, den: int, unpack: Callable | None = None):
    """The pairs of a bucket's cells that lie in different components and whose sizes and sketches allow a link.

    With ``unpack`` the bits are items: the pairs are verified here, and one is reported only if it joins components that the
    bucket's links have not joined before.
    """

    def meet(x: np.ndarray, y: np.ndarray, ids, n, c, prober, low, high, words: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
        step = max(1, 2_000_000 // max(1, len(y) * words[0].shape[1]))
        left, right = words[0], words[1]
        for k in range(0, len(x), step):
            a = x[k : k + step]
            far = np.bitwise_count(left[k : k + step, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
            na, nb = n[a][:, None], n[y][None, :]
            ok = far * (den + num) <= (den - num) * (na + nb)
            ok &= (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (c[a][:, None] != c[y][None, :]) & (prober[a][:, None] | prober[y][None, :])
            ok &= (low[a][:, None] & high[y][None, :]) | (high[a][:, None] & low[y][None, :])
            p, q = np.nonzero(ok)
            yield np.stack((ids[a[p]], ids[y[q]]))

    def few(ids, n, c, prober, low, high, bits) -> np.ndarray:
        """The same for a small cell, pair by pair."""
        whole, pairs = [int.from_bytes(x, "little") for x in bits], []
        for i in range(len(ids)):
            for j in range(i + 1, len(ids)):
                p, q = (i, j) if n[i] <= n[j] else (j, i)
                if c[i] == c[j] or n[p] * den < n[q] * num or not (prober[i] or prober[j]) or not (low[i] and high[j] or high[i] and low[j]):
                    continue
                wide = whole[q]
                if len(bits[p]) < len(bits[q]):  # twice as wide at most, as sizes are that near
                    half = 8 * len(bits[p])
                    wide = (wide >> half) ^ (wide & ((1 << half) - 1))
                if (whole[p] ^ wide).bit_count() * (den + num) <= (den - num) * (n[i] + n[j]):
                    pairs.append((ids[i], ids[j]))
        return np.array(pairs, np.int64).reshape(-1, 2).T

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["cell"].to_numpy(), kind="stable")
        cell, ids, n, c, prober, low, high = (frame[k].to_numpy()[order] for k in ("cell", "id", "n", "c", "prober", "low", "high"))
        bits = frame["bits"].to_numpy()[order]
        of: dict[int, np.ndarray] = {}
        if unpack is not None:
            one = dict(zip(ids.tolist(), bits, strict=True))
            names, made = list(one), {}
            for k in range(0, len(names), 256):
                part = unpack([one[x] for x in names[k : k + 256]])
                of.update(zip(names[k : k + 256], part, strict=True))
                made.update(zip(names[k : k + 256], _sketch(part), strict=True))
            n = np.array([made[x][0] for x in ids.tolist()], np.int64)
            bits = np.array([made[x][1] for x in ids.tolist()] + [b""], object)[:-1]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        def joins(pairs: np.ndarray, label: dict[int, int]) -> np.ndarray:
            good = []
            for p, q in pairs.T.tolist():
                u, v = root(label[p]), root(label[q])
                if u == v:
                    continue
                x, y = of[p], of[q]
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                if common * den >= (len(x) + len(y) - common) * num:
                    parent[max(u, v)] = min(u, v)
                    good.append((p, q))
            return np.array(good, np.int64).reshape(-1, 2).T

        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        out = []
        for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(cell)], strict=True):
            if hi - lo <= SMALL:
                pairs = few(*(x[lo:hi].tolist() for x in (ids, n, c, prober, low, high)), bits[lo:hi])
                out.append(joins(pairs, dict(zip(ids[lo:hi].tolist(), c[lo:hi].tolist(), strict=True))) if unpack is not None else pairs)
                continue
            widths = np.array([len(b) for b in bits[lo:hi]])
            for width in sorted(set(widths.tolist())):
                x = lo + np.flatnonzero(widths == width)
                wide = lo + np.flatnonzero(widths == 2 * width)
                left = np.frombuffer(b"".join(bits[x]), U).reshape(len(x), -1)
                right = left
                if len(wide):
                    both = np.frombuffer(b"".join(bits[wide]), U).reshape(len(wide), 2, -1)
                    right = np.concatenate((left, both[:, 0] ^ both[:, 1]))
                met = meet(x, np.concatenate((x, wide)), ids, n, c, prober, low, high, {0: left, 1: right})
                if unpack is not None:
                    label = dict(zip(ids[lo:hi].tolist(), c[lo:hi].tolist(), strict=True))
                    met = (joins(pairs, label) for pairs in met)
                out += met
        pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.stack((pairs.max(axis=0), pairs.min(axis=0))), axis=1) if pairs.size else pairs
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return run


def _common(unpack: Callable[[list[bytes]], list[np.ndarray]]):
    def run(batches):
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                xs, ys = batch.column("xs").to_pylist(), batch.column("ys").to_pylist()
                distinct = list({*xs, *ys})
                of = dict(zip(distinct, unpack(distinct), strict=True))
                common = []
                for x, y in zip(xs, ys, strict=True):
                    x, y = of[x], of[y]
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    common.append(int((x[at] == y).sum()) if len(x) else 0)
                sizes = [pa.array([len(of[p]) for p in side], pa.int64()) for side in (xs, ys)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), *sizes], names=["a", "b", "common", "na", "nb"])

    return run


def verify(pairs: DataFrame, own: DataFrame, num: int, den: int, unpack: Callable = plain) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets in ``own(id, items)`` really are that similar."""
    sided = pairs.join(own.select(F.col("id").alias("b"), F.col("items").alias("ys")), "b").join(own.select(F.col("id").alias("a"), F.col("items").alias("xs")), "a")
    counted = sided.select("a", "b", "xs", "ys").mapInArrow(_common(unpack), "a long, b long, common long, na long, nb long")
    return counted.filter(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b")
