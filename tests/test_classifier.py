"""The pair classifier against Newton's method in plain numpy, and its features against plain counts."""

import math
from collections import Counter

import numpy as np
import pytest

from docketry.operators import classifier as C
from docketry.plans import catalog


def newton(x, y, ridge):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    d = np.column_stack((np.ones(len(x)), (x - mean) / np.where(scale > 0, scale, np.inf)))
    w, penalty = np.zeros(d.shape[1]), np.append(0.0, np.full(x.shape[1], ridge))
    for _ in range(200):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + 0.5 * np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty + 1e-12), d.T @ (y - p) - penalty * w)
    return w


@pytest.mark.parametrize("ridge", [1.0, 1e-3])
def test_fit_by_fold(spark, ridge):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4)) * [1, 50, 1e-3, 0] + [0, 7, 0, 2]
    y = (x[:, 0] + x[:, 1] / 40 + rng.normal(size=900) > 0.4).astype(int)
    fold = rng.integers(1, 6, 900)
    rows = [(int(f), [float(v) for v in a], int(b)) for f, a, b in zip(fold, x, y, strict=True)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4, 1), (1, None, 0), (2, [9.0] * 4, None)], "fold int, x array<double>, y int").repartition(7)
    models = C.fit(df, ridge)
    assert sorted(models) == [1, 2, 3, 4, 5] and all(m.settled for m in models.values())
    for f, m in models.items():
        assert np.allclose(m.weights, newton(x[fold != f], y[fold != f], ridge), atol=1e-6)
    scored = C.out_of_fold(df, models).collect()
    assert len(scored) == 903
    for r in scored:
        if r["fold"] is None or r["x"] is None:
            assert r["score"] is None
        else:
            m = models[r["fold"]]
            assert math.isclose(r["score"], m.scores(np.array([r["x"]]))[0], rel_tol=1e-9, abs_tol=1e-12)


def test_fit_separable_and_single(spark):
    """Labels that a feature tells apart, labels of one kind, and a single fold, which trains on itself."""
    kind = "fold int, x array<double>, y int"
    apart = [(i % 2, [float(i)], int(i > 10)) for i in range(20)]
    for m in C.fit(spark.createDataFrame(apart, kind)).values():
        assert m.settled and m.scores(np.array([[0.0], [19.0]])).tolist() == sorted(m.scores(np.array([[0.0], [19.0]])).tolist())
    same = C.fit(spark.createDataFrame([(f, [float(i)], 1) for i in range(6) for f in (1, 2)], kind))
    assert all(np.isfinite(m.weights).all() for m in same.values())
    one = C.fit(spark.createDataFrame([(1, [float(i), float("nan")], i % 2) for i in range(9)], kind))
    assert list(one) == [1] and np.isfinite(one[1].weights).all()
    assert C.fit(spark.createDataFrame([], kind)) == {}


def test_pair_features(spark):
    texts = [("a b c", "b c d"), ("a b c", "B C D"), ("", "x"), (None, None), ("one two", "one two"), ("b b d", "b c d"), ("q", "zz zz zz")]
    df = spark.createDataFrame([(i, a, b, [0.0, 3.0], [4.0, 0.0]) for i, (a, b) in enumerate(texts)], "pair int, text_a string, text_b string, va array<double>, vb array<double>")
    got = {r["pair"]: r["x"] for r in C.pair_features(df, vectors=("va", "vb")).collect()}
    docs = {b or "" for _, b in texts}
    bags = {b: Counter(b.lower().split()) for b in docs}
    mean = sum(sum(v.values()) for v in bags.values()) / len(bags)
    df_ = Counter(t for v in bags.values() for t in v)
    idf = {t: math.log(len(bags) - n + 0.5) - math.log(n + 0.5) for t, n in df_.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(idf.values()) / len(idf) for t, v in idf.items()}
    runs = lambda s, k: {" ".join(s.split()[i : i + k]) for i in range(max(1, len(s.split()) - k + 1))} - {""}
    for i, (a, b) in enumerate(texts):
        a, b = (a or "").lower(), b or ""
        s = sum(n * idf[t] * bags[b][t] * 2.5 / (bags[b][t] + 1.5 * (0.25 + 0.75 * sum(bags[b].values()) / mean)) for t, n in Counter(a.split()).items() if t in bags[b])
        shared = [len(runs(a, k) & runs(b.lower(), k)) / max(1, len(runs(a, k) | runs(b.lower(), k))) for k in (1, 2)]
        assert np.allclose(got[i], [math.log1p(max(s, 0)), *shared, math.log1p(len(runs(a, 1))) - math.log1p(len(runs(b.lower(), 1))), 5.0]), (i, got[i])


def test_pair_scores(spark):
    """Every pair is scored, no conversation stands in two folds, and the folds' evaluation counts all of them."""
    rows = catalog.QUERIES["pair_scores"](spark, "/root/testdata/sf0.01").collect()
    home = {}
    assert len({(r["conv_id"], r["turn"], r["label"]) for r in rows}) == len(rows) > 50
    assert all(home.setdefault(r["conv_id"], r["fold"]) == r["fold"] and r["score"] is not None for r in rows)
    found = catalog.QUERIES["pair_evaluation"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r["n"] for r in found) == len(rows) and sum(r["positives"] for r in found) * 2 == len(rows)
    assert all(0 <= r["ap"] <= 1 for r in found)
