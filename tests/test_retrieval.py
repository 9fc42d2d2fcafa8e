"""Chunks, picks, saved indexes and embeddings against worked cases."""

import random

import numpy as np
import pytest

from docketry.functions import results
from docketry.operators import prompts, retrieval
from docketry.plans import catalog
from pyspark.sql import functions as F


def test_recursive_chunks_respect_size_and_lose_nothing(spark):
    rng = random.Random(1)
    texts = [(k, "\n\n".join("\n".join(" ".join("x" * rng.randrange(1, 30) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 4))) for _ in range(3))) for k in range(20)]
    texts += [(100, None), (101, ""), (102, "y" * 250), (103, "one\n\ntwo three\nfour")]
    df = spark.createDataFrame(texts, "k long, text string")
    rows = retrieval.recursive_chunks(df, "k", "text", 60, 15).collect()
    assert max(len(r.chunk) for r in rows) <= 60 and not {100, 101} & {r.k for r in rows}
    for k, t in texts[:20]:
        own = [r.chunk for r in sorted(rows, key=lambda r: (r.k, r.pos)) if r.k == k]
        assert set(t.split()) == {w for c in own for w in c.split()}
        assert all(c.split("\n")[0] in t for c in own)
    assert "".join(r.chunk for r in rows if r.k == 102).count("y") >= 250
    assert [r.chunk for r in retrieval.recursive_chunks(df.filter("k = 103"), "k", "text", 9, 0).collect()] == ["one", "two three", "four"]
    words = retrieval.recursive_chunks(df.filter("k < 5"), "k", "text", 12, 3, count=lambda s: len(s.split())).collect()
    assert max(len(r.chunk.split()) for r in words) <= 12


def test_mmr_picks_what_a_plain_search_picks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30, 6))
    q = rng.normal(size=6)
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    want = []
    while len(want) < 8:
        left = [i for i in range(30) if i not in want]
        want.append(max(left, key=lambda i: 0.5 * cos(q, v[i]) - 0.5 * max((cos(v[i], v[j]) for j in want), default=0.0)))
    df = spark.createDataFrame([(1, q.tolist(), i, v[i].tolist()) for i in range(30)], "q long, qv array<double>, id long, v array<double>")
    assert [r.id for r in sorted(retrieval.mmr(df, 8).collect(), key=lambda r: r["rank"])] == want


def test_bm25_from_saved_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a d"), (3, None), (4, "e f")], "id long, text string")
    queries = spark.createDataFrame([(9, "a d zzz")], "q long, text string")
    tables = retrieval.bm25_tables(docs)
    retrieval.save_tables(tables, str(tmp_path / "index"))
    again = retrieval.load_tables(spark, str(tmp_path / "index"), *tables)
    got = retrieval.bm25_search(queries, again, 5).collect()
    assert got == retrieval.bm25(queries, docs, 5).collect() and [r.id for r in got][0] == 2


def test_query_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "id long, v array<double>")
    queries = items.selectExpr("id q", "v qv")
    want = sorted(retrieval.nearest(queries, items, 3).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 20)
    assert sorted(retrieval.nearest(queries, items, 3).collect()) == want


def test_pooling_and_an_injected_model(spark):
    hidden = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    mask = np.array([[1, 1, 0], [0, 0, 0]])
    assert retrieval.pool(hidden, mask).tolist() == [hidden[0, :2].mean(axis=0).tolist(), [0.0] * 4]
    assert retrieval.pool(hidden, mask, "cls").tolist() == hidden[:, 0].tolist()

    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts])

    df = spark.createDataFrame([("banana",), ("",), (None,)], "text string")
    assert [list(r[0]) for r in df.select(retrieval.embedder(load)("text")).collect()] == [[6.0, 3.0], [0.0, 0.0], [0.0, 0.0]]


def test_strict_modes_raise(spark):
    line = spark.createDataFrame([('{"response": {"body": {"choices": [{"message": {"content": "{\\"a b.c\\": \\"x\\"}"}}]}}}',), ("no json",)], "line string")
    assert [r[0] for r in line.select(results.answer(F.col("line"), "a b.c")).collect()] == ["x", None]
    with pytest.raises(Exception, match="no a b.c"):
        line.select(results.answer(F.col("line"), "a b.c", strict=True)).collect()
    q = spark.createDataFrame([(1,), (2,)], "q long")
    ranked = spark.createDataFrame([(1, 5)], "q long, id long")
    assert sorted(map(tuple, retrieval.count_found(q, ranked, 1).collect())) == [(1, 1), (2, 0)]
    with pytest.raises(Exception, match="too few"):
        retrieval.count_found(q, ranked, 1, strict=True).collect()
    with pytest.raises(ValueError):
        prompts.template("court", "s", text=4)


def test_precision_at_k_asks_for_every_vector(spark, tmp_path):
    rng = np.random.default_rng(7)
    v, label = rng.normal(size=(60, 4)), rng.integers(0, 3, 60).tolist()
    kind = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(60)], kind).write.parquet(str(tmp_path / "embeddings.parquet"))
    near = np.argsort(((v[:, None] - v) ** 2).sum(axis=2) + np.diag(np.full(60, np.inf)), axis=1)[:, :5]
    got = {r.q: r.precision for r in catalog.QUERIES["precision_at_k"](spark, str(tmp_path)).collect()}
    assert got == {i: sum(label[j] == label[i] for j in near[i]) / 5 for i in range(60)}


def test_recall_at_k_asks_for_every_vector(spark, tmp_path):
    rng = np.random.default_rng(8)
    v, label = rng.normal(size=(60, 4)), rng.integers(0, 3, 60).tolist()
    kind = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([(i, v[i].tolist(), label[i]) for i in range(60)], kind).write.parquet(str(tmp_path / "embeddings.parquet"))
    near = np.argsort(((v[:, None] - v) ** 2).sum(axis=2) + np.diag(np.full(60, np.inf)), axis=1)[:, :5]
    got = {r.q: r.recall for r in catalog.QUERIES["recall_at_k"](spark, str(tmp_path)).collect()}
    assert got == {i: round(sum(label[j] == label[i] for j in near[i]) / (label.count(label[i]) - 1), 9) for i in range(60)}
