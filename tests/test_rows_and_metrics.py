"""Running sums, group folds, sweeps by fold and correlations against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import metrics as M
from docketry.operators import rows as O


@pytest.mark.parametrize("n,parts", [(0, 8), (1, 8), (700, 3), (20_000, 8)])
def test_number_wide_rows(spark, n, parts):
    """Numbers equal row_number whatever other columns are read."""
    df = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("wide"), "id").repartition(parts)
    got = O.number_rows(df, "k").collect()
    want = sorted(r["k"] for r in df.select("k").collect())
    assert [r["k"] for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(1, n + 1)) and all(r["wide"] == str(r["id"]) * 20 for r in got)
    assert O.number_rows(df, "k").count() == n


def test_running_sums_of_groups(spark):
    """One group holds most rows; ties and nulls in keys; sums of nulls are 0."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(40), rng.choice([None, 1, 2, 5]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, k int, v int, id long").repartition(7)
    got = O.running(df, ["g"], [F.col("k").desc(), F.col("id")], total=F.col("v"), n=F.lit(1)).collect()
    seen = defaultdict(lambda: [0, 0])
    want = {}
    for g, k, v, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[3])):
        seen[g][0] += v or 0
        seen[g][1] += 1
        want[i] = (g, k, v, *seen[g])
    assert {r["id"]: (r["g"], r["k"], r["v"], r["total"], r["n"]) for r in got} == want


@pytest.mark.parametrize("n", [2, 5])
def test_group_folds(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, *range(60)]) if rng.random() < 0.6 else 7 if rng.random() < 0.5 else 1000 + i) for i in range(3000)]
    got = O.group_folds(spark.createDataFrame(rows, "id long, g long").repartition(5), "g", n).collect()
    assert sorted((r["id"], r["g"]) for r in got) == sorted(rows)
    home = defaultdict(set)
    for r in got:
        home[r["g"]].add(r["fold"])
    assert all(len(f) == 1 for f in home.values())
    loads, largest = Counter(r["fold"] for r in got), max(Counter(g for _, g in rows).values())
    assert set(loads) == set(range(1, n + 1)) and max(loads.values()) - min(loads.values()) <= largest


def test_group_folds_small(spark):
    assert O.group_folds(spark.createDataFrame([], "g long"), "g").collect() == []
    assert sorted(r["fold"] for r in O.group_folds(spark.createDataFrame([(1,), (2,), (3,)], "g long"), "g", 5).collect()) == [1, 2, 3]


def swept(rows):
    """Every distinct threshold, from the highest."""
    n, positives = len(rows), sum(y for _, y in rows)
    levels, ap, f1, acc = sorted({s for s, _ in rows}, reverse=True), 0.0, (-1, None), (-1, None)
    for i, level in enumerate(levels):
        taken, tp, step = sum(s >= level for s, _ in rows), sum(y for s, y in rows if s >= level), sum(y for s, y in rows if s == level)
        half = (level + levels[min(i + 1, len(levels) - 1)]) / 2
        ap += step / positives * tp / taken if positives else 0
        f, a = 2 * tp / (taken + positives) if tp else 0.0, (tp + (n - positives) - (taken - tp)) / n
        f1 = max(f1, (f, half), key=lambda x: x[0])
        acc = max(acc, (a, half), key=lambda x: x[0])
    return n, positives, ap if positives else None, *f1, *acc


def test_binary_by_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([0.5, rng.random(), float(rng.randrange(5))]), int(rng.random() < 0.4)) for _ in range(900)]
    rows += [(3, 1.0, 0), (3, 0.5, 0), (4, 2.0, 1), (1, None, 1), (1, 3.0, None)]
    got = {r["fold"]: tuple(r)[1:] for r in M.binary_by_fold(spark.createDataFrame(rows, "f int, s double, y int").repartition(6), "f", "s", "y").collect()}
    folds = defaultdict(list)
    for f, s, y in rows:
        if s is not None and y is not None:
            folds[f].append((s, y))
    assert got.keys() == folds.keys()
    for f, own in folds.items():
        for a, b in zip(got[f], swept(own), strict=True):
            assert a == b or a is not None and math.isclose(a, b, rel_tol=1e-12), (f, got[f], swept(own))


@pytest.mark.parametrize("blocks", [4, 512])
def test_correlations(spark, monkeypatch, blocks):
    """Against every pair; one value of y holds a third of the rows."""
    monkeypatch.setattr(M, "BLOCKS", blocks)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, 400).astype(float)
    y = np.where(rng.random(400) < 0.34, 5.0, np.round(x / 9 + rng.normal(0, 3, 400), 1))
    rows = [(float(a), float(b)) for a, b in zip(x, y, strict=True)]
    r = M.correlations(spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "x double, y double").repartition(5), "x", "y").first()
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    s = [np.sign((a[0] - b[0]) * (a[1] - b[1])) for a, b in itertools.combinations(rows, 2)]
    ties = [sum(a[i] == b[i] for a, b in itertools.combinations(rows, 2)) for i in (0, 1)]
    tau = sum(s) / math.sqrt((len(s) - ties[0]) * (len(s) - ties[1]))
    assert r["n"] == 400 and np.allclose([r["pearson"], r["spearman"], r["kendall"]], [np.corrcoef(x, y)[0, 1], np.corrcoef(rank(x), rank(y))[0, 1], tau], rtol=1e-9)


def test_correlations_without_spread(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)]):
        r = M.correlations(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
        assert (r["n"], r["pearson"], r["spearman"], r["kendall"]) == (len(rows), None, None, None)


def test_inversions():
    rng = np.random.default_rng(9)
    y, w = rng.integers(0, 50, 500), rng.integers(1, 4, 500)
    assert M._inversions(y, w) == sum(int(w[i] * w[j]) for i in range(500) for j in range(i + 1, 500) if y[i] > y[j])
