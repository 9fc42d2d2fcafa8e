"""The encoder's space against numpy's singular vectors; replayed batches with broken, empty and missing files."""

import json
import math
from collections import Counter

import numpy as np

from docketry.operators import encoder as E
from docketry.sources import replay as Y


def matrix(docs, cut=None):
    bags = {d: Counter((t or "").lower().split()[:cut]) for d, t in docs}
    bags = {d: b for d, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    words = sorted(df)
    idf = {w: math.log((len(bags) + 1) / (df[w] + 1)) + 1 for w in words}
    return bags, words, idf, np.array([[b[w] * idf[w] for w in words] for b in bags.values()])


def test_space_equals_numpys(spark):
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{i % 4}_{rng.zipf(1.4) % 12}" for _ in range(rng.integers(5, 40)))) for i in range(120)] + [(500, None), (501, "  "), (502, "W1_1 w1_1 w2_2")]
    df = spark.createDataFrame(docs, "d long, text string").repartition(5)
    vectors, weights = E.fit(E.weighted_terms(df, "d", "text", None), "d", 4, 60)
    bags, words, idf, a = matrix(docs)
    exact = np.linalg.svd(a)[2][:4].T
    assert E.subspace_gap(vectors, exact, words) < 1e-6
    assert all(math.isclose(r["idf"], idf[r["term"]], rel_tol=1e-12) for r in weights.collect())
    table = vectors.toPandas().set_index("term").loc[words].to_numpy()
    assert np.allclose(table.T @ table, np.eye(4), atol=1e-9)
    got = {r["d"]: r["v"] for r in E.encode(df, "d", "text", vectors, weights, None).collect()}
    assert got.keys() == {d for d, _ in docs} and got[500] is None and got[501] is None
    for d, b in bags.items():
        v = sum(n * idf[w] * table[words.index(w)] for w, n in b.items())
        assert np.allclose(got[d], v / np.linalg.norm(v), atol=1e-9)


def test_cut_and_rank(spark):
    """Only the first tokens count; where there are fewer dimensions than columns, the others are 0."""
    df = spark.createDataFrame([(1, "a b " + "c " * 20), (2, "a b d")], "d long, text string")
    vectors, weights = E.fit(E.weighted_terms(df, "d", "text", 2), "d", 3, 5)
    assert sorted(r["term"] for r in weights.collect()) == ["a", "b"]
    table = vectors.toPandas().set_index("term").to_numpy()
    assert np.isfinite(table).all() and np.linalg.matrix_rank(table) == 1


def test_chunks_and_blocks(spark, monkeypatch):
    """Many chunks, rows of a chunk and blocks: the same space, and rows of one key in several places are one text; tasks get no table whole."""
    monkeypatch.setattr(E, "COUNTS", 300)
    monkeypatch.setattr(E, "BITS", 5)
    rng = np.random.default_rng(6)
    docs = [(i % 170, " ".join(f"w{i % 4}_{rng.zipf(1.3) % 60}" for _ in range(rng.integers(1, 60)))) for i in range(200)] + [(500, None), (501, "\u2003 W1_1\u00a0w1_1  ")]
    df = spark.createDataFrame(docs, "d long, text string").repartition(7)
    dealt = E.deal(E.weighted_terms(df, "d", "text"), "d")
    assert dealt.select("chunk").distinct().count() > 5
    space = E.fit_dealt(dealt, 4, 30)
    assert space.blocks.count() > 5 and space.index.select("block", "pos").distinct().count() == space.index.count()
    joined = {}
    for d, t in docs:
        joined[d] = " ".join(filter(None, (joined.get(d), t)))
    vectors, weights = E.tables(space)
    bags, words, idf, a = matrix(joined.items())
    assert E.subspace_gap(vectors, np.linalg.svd(a)[2][:4].T, words) < 1e-6
    assert all(math.isclose(r["idf"], idf[r["term"]], rel_tol=1e-12) for r in weights.collect())
    one = E.encode_dealt(df, "d", dealt, space).collect()
    assert sorted(r["d"] for r in one) == sorted(d for d, _ in docs)
    two = {r["d"]: r["v"] for r in E.encode(df, "d", "text", vectors, weights).collect()}
    table = vectors.toPandas().set_index("term").loc[words].to_numpy()
    for d, b in bags.items():
        v = sum(n * idf[w] * table[words.index(w)] for w, n in b.items())
        assert np.allclose(two[d], v / np.linalg.norm(v), atol=1e-9)
    assert all(np.allclose(r["v"], two[r["d"]], atol=1e-9) for r in one if r["d"] != 500) and two[500] is None
    other = spark.createDataFrame([(1, "none of these"), (2, "w1_1 unknown")], "d long, text string")
    found = {r["d"]: r["v"] for r in E.encode(other, "d", "text", vectors, weights).collect()}
    assert found[1] is None and np.allclose(found[2], two[501])


def test_first_tokens(spark):
    """The first tokens of a text, however it begins and ends, are those that a search for all of them finds."""
    texts = ["a b c", " a b c d ", "\u2003\u00a0a\u0085b\x1cc  d", "", "  ", None, "a", "A\nb\n", "\u0130 \u03a3 a\u03a3 b"]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    got = lambda cut: sorted((r["d"], r["term"], r["f"]) for r in E.weighted_terms(df, "d", "text", cut).collect())
    assert got(9) == got(None)
    assert [t for _, t, _ in got(2)] == ["a", "b", "a", "b", "a", "b\x1cc", "a", "a", "b", "i\u0307", "\u03c3"]


def line(i, content):
    return json.dumps({"custom_id": str(i), "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_replay(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text("\n".join([line(1, "a"), "no json", line(2, "b"), '{"custom_id": "3"}', line(1, "again")]) + "\n")
    (tmp_path / "two.jsonl").write_text(line(4, "ü"))
    (tmp_path / "empty.jsonl").write_text("\n")
    (tmp_path / "other.jsonl").write_text(line(9, "other"))
    entries = [("exp: one", "one.jsonl"), ("exp: two", "two.jsonl"), ("exp: empty", "empty.jsonl"), ("exp: lost", "lost.jsonl"), ("expanded: other", "other.jsonl")]
    (tmp_path / "batches.jsonl").write_text("\n".join(json.dumps({"metadata": {"description": d}, "output_file": f}) for d, f in entries) + "\nbroken\n\n")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = Y.replay(spark, str(tmp_path), "exp")
    got = sorted((r["file"], r["line"], r["custom_id"], r["content"], r["error"]) for r in rows.collect() if r["file"] != "lost.jsonl" and r["line"])
    assert got == sorted([("one.jsonl", 1, "1", "a", None), ("one.jsonl", 2, None, None, "line: JSONDecodeError"), ("one.jsonl", 3, "2", "b", None), ("one.jsonl", 4, None, None, "line: KeyError"), ("one.jsonl", 5, "1", "again", None), ("two.jsonl", 1, "4", "ü", None)])
    assert sorted((r["file"], r["error"]) for r in rows.filter("line is null").collect()) == [("empty.jsonl", "file: empty"), ("lost.jsonl", "file: FileNotFoundError")]
    assert rows.rdd.getNumPartitions() == 4  # the other experiment's file is never opened
    every = spark.read.format("batch_outputs").load(f"file://{tmp_path}").collect()
    assert len(every) == 10 and [r["error"] for r in every if r["description"] is None] == ["batches.jsonl, line 6: JSONDecodeError"]
    joined = Y.rejoin(spark.createDataFrame([("1", "x"), ("2", "y"), ("7", "z")], "custom_id string, asked string"), rows).collect()
    assert sorted((r["custom_id"], r["asked"], r["content"]) for r in joined) == [("1", "x", "again"), ("2", "y", "b"), ("7", "z", None)]
