"""Cells and growing postings against plain Python that tries everything."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import cells as L
from docketry.operators import postings as B
from docketry.operators import retrieval as R
from docketry.operators import scan


def clustered(n, seed, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 20
    return [list(map(float, centres[rng.integers(12)] + rng.normal(size=width) * 0.5)) for _ in range(n)]


def nearest(items, q, k, before=None, grouped=False):
    found = {}
    for i, v, g, ts in items:
        if before is None or ts < before:
            d = 0.0
            for a, b in zip(q, v, strict=True):
                d += (a - b) * (a - b)
            key = g if grouped else i
            found[key] = min(found.get(key, math.inf), round(d, 6))
    return [(key, d) for d, key in sorted((d, key) for key, d in found.items())[:k]]


def by_query(df, key):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append((r[key], r["d"]))
    return out


@pytest.mark.parametrize("grouped", [False, True])
def test_cells(spark, monkeypatch, tmp_path, grouped):
    """Copies in numbers, queries in blocks, a saved index, dates where items are grouped; clusters leave most pairs alone."""
    monkeypatch.setattr(L, "QUERIES", 30)
    rng = np.random.default_rng(8)
    vectors = clustered(1500, 1)
    vectors[:300] = [vectors[0]] * 300
    items = [(i, v, f"g{rng.integers(40)}", int(rng.integers(1000))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*items, (9000, None, "g1", 3), (9001, vectors[5], None if grouped else "g1", 5000)], "id long, v array<float>, grp string, ts long").repartition(6)
    items = [(i, [float(np.float32(x)) for x in v], g, t) for i, v, g, t in items] + ([] if grouped else [(9001, [float(np.float32(x)) for x in vectors[5]], "g1", 5000)])
    index = L.build(df, "grp", "ts") if grouped else L.build(df)
    L.save(index, str(tmp_path / "index"))
    index = L.load(spark, str(tmp_path / "index"))
    asked = [(q, items[q][1], int(rng.integers(1000))) for q in range(0, 1500, 17)] + [(5000, None, 5), (5001, items[3][1], None if grouped else 5), (5002, items[3][1], 0)]
    queries = spark.createDataFrame(asked, "q long, v array<double>, ts long")
    got = by_query(L.search(queries, index, 7), "grp" if grouped else "id")
    want = {q: nearest(items, v, 7, before if grouped else None, grouped) for q, v, before in asked if v is not None and (before is not None or not grouped)}
    assert got == {q: hits for q, hits in want.items() if hits}
    assert L.share(queries, index, 7) < 0.3


def test_cells_small(spark):
    kind = "id long, v array<double>"
    queries = spark.createDataFrame([(1, [0.0, 1.0])], "q long, v array<double>")
    assert L.search(queries, L.build(spark.createDataFrame([], kind)), 3).collect() == []
    few = L.build(spark.createDataFrame([(5, [0.0, 1.0]), (4, [0.0, 1.0]), (6, [3.0, 1.0])], kind))
    assert by_query(L.search(queries, few, 3), "id") == {1: [(4, 0.0), (5, 0.0), (6, 9.0)]}
    assert L.search(queries.limit(0), few, 3).collect() == []


def topics(n, seed):
    """Texts of twenty topics with words of their own."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join([f"t{i % 20}_{rng.zipf(1.5) % 30}" for _ in range(rng.integers(1, 60))] + ["all"] * int(rng.integers(0, 4)))) for i in range(n)]


def same(a, b):
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], r["score"]) for r in df.collect())
    a, b = rows(a), rows(b)
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=2e-6)


def test_grown_index(spark, monkeypatch, tmp_path):
    """Three batches, with ids that come again, equal one build and a scan without an index; topics leave buckets closed."""
    monkeypatch.setattr(B, "BUCKET", 16)
    docs = [*topics(900, 2), (5000, None), (5001, "  ")]
    df = spark.createDataFrame(docs, "id long, text string")
    once, often = str(tmp_path / "once"), str(tmp_path / "often")
    one = B.grow(df, once)
    B.grow(df.filter("id < 300"), often)
    B.grow(df.filter("id < 400").unionByName(spark.createDataFrame([(None, "t1_1 t1_1")], "id long, text string")), often)
    more = B.grow(df.withColumn("text", F.when(F.col("id") < 300, "t2_2 changed").otherwise(F.col("text"))), often)
    queries = spark.createDataFrame([(q, f"t{q}_1 t{q}_2 all t{q}_1 t{(q + 1) % 20}_3") for q in range(20)] + [(50, None), (51, "nowhere"), (52, "all")], "q long, text string")
    for k in (1, 5):
        plain = R.bm25(queries, df.fillna(""), k)  # a null text has no words
        same(B.search(queries, one, k), plain)
        same(B.search(queries, more, k), plain)
    assert [r["n"] for r in more.stats.collect()] == [902] and more.docs.count() == 902
    counts = Counter(t for _, text in docs for t in set((text or "").split()))
    assert {r["term"]: r["df"] for r in more.terms.collect()} == counts
    assert B.opened(queries.filter("q < 20"), one, 5) < 0.6


def test_index_edges(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        B.open_index(spark, str(tmp_path / "none"))
    empty = B.grow(spark.createDataFrame([], "id long, text string"), str(tmp_path / "empty"))
    queries = spark.createDataFrame([(1, "a b")], "q long, text string")
    assert B.search(queries, empty, 3).collect() == []
    grown = B.grow(spark.createDataFrame([(1, "a"), (2, "c d")], "id long, text string"), str(tmp_path / "empty"))
    same(B.search(queries, grown, 3), R.bm25(queries, spark.createDataFrame([(1, "a"), (2, "c d")], "id long, text string"), 3))


def odd_vectors():
    """Copies, equal distances, halves at the sixth place, and vectors that are null, hold a null, infinity or NaN, or are short."""
    rng = np.random.default_rng(11)
    rows = [(i, (rng.integers(-3, 4, 4) / 8).tolist()) for i in range(150)] + [(i, rng.normal(size=4).tolist()) for i in range(150, 220)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(220, 300)]
    return rows + [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan"), 0.0, 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0, 0.0]), (304, [1.0, 2.0]), (305, [0.0883883476, 0.0, 0.0, 0.0]), (306, [0.03125, 0.03125, 0.03125, 0.03125])]


def place(a, b):
    """The order of a pair: rounded distance, infinity, NaN, none."""
    if a is None or b is None or None in a or None in b or len(a) != len(b):
        return (3, 0.0)
    d = sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))
    return (2, 0.0) if d != d else (1, 0.0) if d == float("inf") else (0, math.floor(d * 1e6 + 0.5) / 1e6)


def test_scan_ranks_odd_vectors_as_a_loop_does(spark):
    rows = odd_vectors()
    of = lambda i: i % 7 if i % 50 else None
    items = spark.createDataFrame([(i, v, of(i), (i * 37) % 101) for i, v in rows], "id long, v array<double>, grp long, ts long").repartition(3)
    queries = items.filter("id % 9 = 0 or id >= 300").selectExpr("id q", "v qv", "ts qts")
    d = {0: lambda x: x[1], 1: lambda _: float("inf"), 2: lambda _: float("nan"), 3: lambda _: None}
    shown = lambda p: str(d[p[0]](p))
    asked = [(i, v, (i * 37) % 101) for i, v in rows if i % 9 == 0 or i >= 300]
    want = [(q, i, shown(p), n + 1) for q, v, _ in asked for n, (p, i) in enumerate(sorted((place(v, w), i) for i, w in rows)[:6])]
    assert sorted((r.q, r.id, str(r.d), r["rank"]) for r in R.nearest(queries, items, 6).collect()) == sorted(want)
    want = []
    for q, v, before in asked:
        best = {}
        for i, w in rows:
            if (i * 37) % 101 < before:
                best[of(i)] = min(best.get(of(i), (9, 0.0)), place(v, w))
        want += [(q, g, shown(p), n + 1) for n, (p, _, g) in enumerate(sorted((p, (g is None, g or 0), g) for g, p in best.items())[:5])]
    got = [(r.q, r.grp, str(r.d), r["rank"]) for r in R.nearest(queries, items, 5, earlier=True, group="grp").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("entries", [None, 40])
def test_average_precision_of_vectors(spark, entries):
    rows = [(i, v, i % 3 if i % 11 else None) for i, v in odd_vectors()]
    items = spark.createDataFrame(rows, "id long, v array<double>, label long").repartition(3)
    queries = items.filter("id % 9 = 0 or id >= 300").withColumnRenamed("id", "q")
    want = {}
    for q, v, label in rows:
        if label is not None and (q % 9 == 0 or q >= 300):
            order = sorted((place(v, w), i, other == label) for i, w, other in rows if i != q)
            at = [n + 1 for n, (_, _, same) in enumerate(order) if same]
            want[q] = sum((k + 1) / n for k, n in enumerate(at)) / len(at)
    got = {r.q: r.ap for r in scan.average_precision(queries, items, entries).collect()}
    assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-12 for q in want)
