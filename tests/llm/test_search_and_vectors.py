"""Lexical search, whitening and the projection forest against plain Python, on given tables and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.llm import jaccard_join, lexical, line_dedup, linking, projection_forest, whitening

SF = "/root/testdata/sf0.001"


def ranked(items, docs, k=10):
    """Every item against every document."""
    terms = lambda s: [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall(lexical.TERM, s or "")]
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // length
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in q.items() if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ODD_DOCS = [(1, "Aa bb AA"), (1, "other words"), (2, "aa BB aa"), (3, None), (4, ""), (5, "... !!"), (None, "aa bb aa"), (None, None), (6, "é aa É zz9"), (7, "bb " * 30_000 + "cc"), (8, "aa bb aa"), (9, "b-b_c\x00d\x7fe")]
ODD_ITEMS = [(10, "AA bb aa"), (10, "AA bb aa"), (10, "cc"), (11, None), (12, "nowhere"), (None, "É b c d e"), (13, "aa"), (14, "aa " * 5 + "bb")]


@pytest.mark.parametrize("chunk,step", [(2_000_000, 128), (3, 1), (9, 2)])
def test_lexical_odd_rows(spark, monkeypatch, chunk, step):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    monkeypatch.setattr(lexical, "STEP", step)
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("item", F.lit(1)).repartition(3)
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string").withColumn("doc", F.lit(1))
    for k in (1, 3, 10):
        got = sorted((tuple(r) for r in lexical.rank(items, docs, k=k).collect()), key=str)
        assert got == ranked(ODD_ITEMS, ODD_DOCS, k)


def test_lexical_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    got = sorted((tuple(r) for r in lexical.rank(spark.createDataFrame(ODD_ITEMS, "item_id long, text string"), spark.createDataFrame(ODD_DOCS, "doc_id long, text string")).collect()), key=str)
    assert got == ranked(ODD_ITEMS, ODD_DOCS)


def test_lexical_stops_early():
    """The threshold ends the reading of lists before their end, and lists read out count nothing."""
    n, rng = 4000, np.random.default_rng(5)
    tf = np.sort(rng.integers(1, 9, (n, 2)), axis=1).ravel()
    chunk = lexical.Lists(np.full(n, 50), np.arange(0, 2 * n + 1, 2), np.tile([0, 1], n), tf.astype(np.int64), np.array([900, 40]), n, 50 * n)
    seen = []
    plain = chunk.scores
    chunk.scores = lambda docs, times: (seen.append(len(docs)), plain(docs, times))[1]
    docs, scores = chunk.best(np.array([0, 1]), np.array([1, 1]), 10, np.arange(n))
    whole = plain(np.arange(n), np.array([1, 1]))
    assert docs.tolist() == np.lexsort((np.arange(n), -whole))[:10].tolist()
    assert scores.tolist() == whole[docs].tolist() and sum(seen) < n / 2


def test_lexical_tables(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    got = sorted((tuple(r) for r in lexical.query(spark, SF).collect()), key=str)
    assert got == ranked(read("benchmark", "item_id"), read("documents", "doc_id"))


@pytest.mark.parametrize("items,docs", [([], ODD_DOCS), (ODD_ITEMS, []), ([(1, None)], ODD_DOCS), (ODD_ITEMS, [(1, None), (2, "")])])
def test_lexical_empty(spark, items, docs):
    df = lexical.rank(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.collect() == []


def whitened(vectors):
    """x, fit list, eigenvectors and values by plain numpy in exact integers."""
    x = {i: [math.floor(256 * np.float64(c)) for c in v] for i, v in vectors}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    off = (fit * n - s).astype(float) / n
    e, w = np.linalg.eigh(off.T @ off / n)
    return x, n, s, e[::-1], w[:, ::-1]


def test_whitening_tables(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] is not None]
    x, n, s, e, w = whitened(rows)
    got = whitening.query(spark, SF).toPandas()
    assert len(got) == 4 * len(x) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for c in range(1, 5):
        own = got[got["component"] == c].sort_values("vec_id")
        off = np.array([[(a * n - b) / n for a, b in zip(x[i], s, strict=True)] for i in own["vec_id"]])
        z = off @ w[:, c - 1] / math.sqrt(e[c - 1])
        z *= np.sign(z @ own["whitened"].to_numpy())
        assert np.allclose(z, own["whitened"], atol=1e-9) and np.allclose(own["explained"], e[c - 1] / e.sum(), rtol=1e-9)
        assert own["deviation"].tolist() == [sum((a * n - int(b)) ** 2 for a, b in zip(x[i], s, strict=True)) for i in own["vec_id"]]


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(40, [0.5, 0.25, -0.25])] * 3 + [(None, [0.5, 0.25, -0.25]), (41, [0.5, 0.2501, -0.25])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, nan, 2.0]), (54, [inf, 0.0, 0.0]), (55, [1.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<float>").withColumn("component", F.lit(9)).withColumn("x", F.lit("x")).repartition(5)
    got = whitening.whiten(df).toPandas()
    x, n, s, e, w = whitened([(i, np.float32(v)) for i, v in good])
    assert len(got) == 3 * len(good) and set(got["n"]) == {n} and n == 31 and set(got["component"]) == {1, 2, 3}
    assert got["vec_id"].isna().sum() == 3 and (got["vec_id"] == 40).sum() == 9 and not set(got["vec_id"].dropna()) & set(range(50, 60))
    assert got["identity_error"].max() < 1e-9
    one = got[(got["vec_id"] == 7) & (got["component"] == 1)].iloc[0]
    assert one["deviation"] == sum((a * n - int(b)) ** 2 for a, b in zip(x[7], s, strict=True))


def test_whitening_without_scale(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], kind)).collect()  # one direction only
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in flat) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 7.0])], kind)).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and any(r["deviation"] is None for r in huge)


def test_chan_merging():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (1000, 5))
    parts = [whitening.moments(p) for p in np.split(x, [3, 3, 400, 401])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whitening.merge(whole, p)
    assert whole[0] == 1000 and whole[1].tolist() == x.sum(axis=0).tolist()
    assert np.allclose(whole[3] / 1000, np.cov(x.T, bias=True), rtol=1e-12)


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):  # sum() would compensate
        total += x * y
    return total


def nearest(rows, queries, k):
    """All candidates, by score and then id."""
    out = {}
    for q in queries:
        scored = sorted((-dot(rows[q], v), i) for i, v in rows.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_forest_recall(spark):
    rows = {r[0]: [float(x) for x in r[1]] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()}
    got = by_query(projection_forest.query(spark, "/root/testdata/sf0.1"))
    want = nearest(rows, [i for i in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q, hits in got.items():
        assert len(hits) == 20 and hits == sorted(hits, key=lambda h: (-h[1], h[0])) and q not in dict(hits)
        assert all(s == dot(rows[q], rows[i]) for i, s in hits)


def test_forest_odd_rows(spark, monkeypatch):
    """Copies in numbers, ties, unusable rows and norms that differ; branches of a few rows, queries in parts."""
    monkeypatch.setattr(projection_forest, "BRANCH_BYTES", 8 * 6 * 20)
    monkeypatch.setattr(projection_forest, "QUERIES", 2)
    rng = np.random.default_rng(2)
    rows = {i: [float(np.float32(x)) for x in rng.normal(size=4) * rng.choice([0.2, 1, 5])] for i in range(1, 90)}
    rows |= {i: [0.5, 0.5, -0.5, 0.25] for i in range(100, 300)}
    odd = [(400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 1.0, 1.0]), (480, [float("nan")] * 4), (500, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([*rows.items(), *rows.items(), *odd], "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("leaf", F.lit(1)).repartition(4)
    got = by_query(projection_forest.neighbours(df, F.col("id") % 20 == 0, target=1.0))
    want = nearest(rows, [i for i in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.97


def test_forest_small(spark):
    kind = "vec_id long, embedding array<float>"
    every = F.lit(True)
    assert projection_forest.neighbours(spark.createDataFrame([], kind), every).collect() == []
    assert projection_forest.neighbours(spark.createDataFrame([(20, [1.0, 0.0])], kind), every).collect() == []
    few = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.5])]
    got = by_query(projection_forest.neighbours(spark.createDataFrame(few, kind), every))
    assert got == nearest({i: v for i, v in few}, range(4), 20)


def test_jaccard_joins_every_text_of_an_id(spark):
    """Texts under one id tie what each of them links; copies, blanks, nulls and repeated rows among them."""
    words = lambda k, n=40: [f"{k}{i}" for i in range(n)]
    a, b, c, d = words("a"), words("b"), words("c"), words("d")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (7, near(b)), (8, near(c)), (9, None), (9, " ".join(c)), (9, ""), (2, " ".join(d)), (11, near(d)), (12, "alone here"), (None, " ".join(a)), (None, None)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    want = {1: 1, 5: 1, 7: 1, 8: 8, 9: 8, 2: 2, 11: 2, 12: 12, None: None}
    assert sorted(got, key=str) == sorted(((i, max(0, len((t or "").split()) - 4) or int(bool((t or "").split())), want[i]) for i, t in rows), key=str)


def test_shingle_sets_of_lines_are_sorted_in_place(monkeypatch):
    """Sorted distinct shingles of many lines, as one by one, without a call of np.unique, which hashes, for each line."""
    rng = np.random.default_rng(8)
    lines = ["".join(rng.choice(list("abc de\u00e9\u65e5"), rng.integers(1, 300))).encode() for _ in range(300)] + [b"a", b"a" * 40, "\u65e5\u672c".encode(), b"a" * 8, b"a" * 9]
    shingles = lambda x: {x[k : k + line_dedup.K] for k in range(max(1, len(x) - line_dedup.K + 1))}
    monkeypatch.setattr(np, "unique", lambda *_, **__: pytest.fail("np.unique"))
    sets = line_dedup._unpack(lines)
    alone = [line_dedup._unpack([x])[0] for x in lines]
    assert len(sets) == len(lines) and all(np.array_equal(x, y) for x, y in zip(sets, alone, strict=True))
    assert all((x[1:] > x[:-1]).all() and len(x) == len(shingles(y.decode())) for x, y in zip(sets, lines, strict=True))


@pytest.mark.parametrize("inside", [False, True])
def test_links_read_sets_once_and_try_no_pair_twice(spark, monkeypatch, inside):
    """Sets are asked for once, a group of two whose pair failed isn't tried again, and no link is lost; small and large cells."""
    rng = np.random.default_rng(5)
    made = {k: np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for k in range(1, 40)}
    for near, far in ((3, 2), (31, 30), (33, 32), (20, 19)):
        made[near] = np.sort(np.concatenate((made[far][:38], made[near][:2])))
    groups = {1: [1, 2, 3], 2: [4, 5], 3: list(range(10, 40)), 4: [6, 7], 5: [6, 7, 8]}
    asked, settled = [], {}

    def sets(ids):
        asked.append(1)
        return spark.createDataFrame([(k, v.tobytes()) for k, v in made.items()], "id long, items binary").join(ids, "id", "left_semi")

    def keep(df, name, settle=linking.settle):
        out = settle(df, name)
        settled.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(linking, "settle", keep)
    found = spark.createDataFrame([(g, i, 40, True) for g, ids in groups.items() for i in ids], linking.GROUPS)
    got = {(r.id, r.component) for r in linking.link(found, sets, 75, 100, inside=inside).collect()}
    assert got == {(2, 2), (3, 2), (30, 30), (31, 30), (32, 32), (33, 32), (19, 19), (20, 19)}
    assert len(asked) == 1
    assert {r.gid for r in settled["split"][0].select("gid").distinct().collect()} == {1, 3, 5}


def test_sketches_in_bulk_bound_differences():
    """A sketch has the parity of each place, whatever stands beside it; sizes from none to many."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 40, 63, 64, 65, 300, 5000, 40, 700)] * 3
    for items, (n, bits) in zip(sets, linking._sketch(sets), strict=True):
        width = max(256, 1 << (4 * len(items)).bit_length())
        want = 0
        for x in items.tolist():
            want ^= 1 << ((x >> 7) & (width - 1))
        assert n == len(items) and len(bits) == width // 8 and int.from_bytes(bits, "little") == want


def test_line_signatures_go_packed_by_task():
    """One row a bucket for many blocks of text, with every line's signatures."""
    rng = np.random.default_rng(7)
    lines = ["".join(rng.choice(list("abcdefgh xyz"), 120)) for _ in range(6000)]
    texts = ["\n".join(lines[k : k + 100]) for k in range(0, 6000, 100)]
    rows = [r for b in line_dedup._signer(3)([pa.record_batch({"text": pa.array(texts)})]) for r in b.to_pylist()]
    assert sum(map(len, texts)) > 2 * line_dedup.BLOCK and sorted(r["bucket"] for r in rows) == [0, 1, 2]
    assert sum(len(r["sig"]) for r in rows) == 5 * line_dedup.BANDS * len(lines)
    assert len(np.unique(np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows]))) == len(lines)


def test_line_dedup_keeps_a_column_of_its_name(spark):
    rows = [(1, "a line of some words\nand one of its own, first", "x"), (2, "a line of some words\nand another, quite unlike it", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines_dropped string")
    out = line_dedup.dedup_lines(df)
    assert out.columns.count("lines_dropped") == 1 and {r["doc_id"]: r["lines_dropped"] for r in out.collect()} == {1: 0, 2: 1}
    kept = line_dedup.stage(spark, df, "")
    assert kept.columns == df.columns and {r["doc_id"]: r["lines_dropped"] for r in kept.collect()} == {1: "x", 2: "y"}
