"""A pair classifier, trained and scored by fold: logistic regression by Newton's steps over distributed sums.

``fit`` trains one model for each fold, on the rows of all others. A step is one pass over the rows: each task sums the gradient,
the Hessian and the loss of every model over its own rows, ``treeReduce`` adds them up, and the driver solves a system of the
features' size for each model. What travels is models x (features + 1)^2 numbers, however many rows there are. The rows are
written once to the shared folder, so a step that is lost is read again, not derived again.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators import retrieval as R
from docketry.sources.staging import settle


@dataclass
class Model:
    """Weights over standardised features, the intercept first."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: int = 0
    settled: bool = False

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self.design(x) @ self.weights


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.where(np.isfinite(flat), flat, 0.0).reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def _add(a, b):
    return b if a is None else a if b is None else {k: tuple(x + y for x, y in zip(a[k], b[k], strict=True)) if k in a and k in b else a.get(k, b.get(k)) for k in a.keys() | b.keys()}


def _summed(rows: DataFrame, of) -> dict:
    """``of(fold, x, y)`` gives a dict of tuples of arrays for the rows of one fold; they are summed over all rows."""

    def run(batches):
        own = None
        for batch in batches:
            x, y, fold = _matrix(batch), batch.column("y").to_numpy().astype(np.float64), batch.column("fold").to_numpy()
            for f in np.unique(fold):
                own = _add(own, of(int(f), x[fold == f], y[fold == f]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["m"])

    parts = rows.select("fold", "x", "y").mapInArrow(run, "m binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeReduce(_add, 3) or {}


def fit(rows: DataFrame, ridge: float = 1.0, tolerance: float = 1e-9, most: int = 60) -> dict[int, Model]:
    """A model for each fold of ``rows(fold, x, y)``, trained without it. ``x`` are arrays of one length, ``y`` is 1 or 0; null and
    non-finite features are 0, rows without fold, features or label don't train. Constant features weigh nothing.

    The penalised likelihood is concave: a step that lowers it is halved, and a model is settled once no weight moves by
    ``tolerance``.
    """
    rows = settle(rows.select("fold", "x", "y").filter("fold is not null and x is not null and y is not null"), "pair_rows")
    sums = _summed(rows, lambda f, x, y: {f: (np.array(float(len(x))), x.sum(axis=0), (x * x).sum(axis=0))})
    models = {}
    for fold in sorted(sums):
        others = [v for f, v in sums.items() if f != fold] or [sums[fold]]
        n, s, q = (sum(v[i] for v in others) for i in range(3))
        mean, spread = s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
        models[fold] = Model(mean, np.where(spread > 1e-9 * np.maximum(1, np.abs(mean)), spread, np.inf), np.zeros(len(mean) + 1))
    penalty = np.append(0.0, np.full(len(next(iter(models.values())).mean), ridge)) if models else None
    before, step = {f: -np.inf for f in models}, {f: None for f in models}
    alone = len(models) == 1
    for _ in range(most):
        live = {f: m for f, m in models.items() if not m.settled}
        if not live:
            break

        def one(fold, x, y, live=live):
            out = {}
            for f, m in live.items():
                if f != fold or alone:
                    d = m.design(x)
                    z = d @ m.weights
                    p = 1 / (1 + np.exp(-z))
                    out[f] = (d.T @ (y - p), (d * (p * (1 - p))[:, None]).T @ d, np.array((y * z - np.logaddexp(0, z)).sum()))
            return out

        found = _summed(rows, one)
        for f, m in live.items():
            gradient, hessian, likelihood = found[f]
            value = float(likelihood - (penalty * m.weights**2).sum() / 2)
            if step[f] is not None and value < before[f] - 1e-12 * abs(before[f]):
                step[f] = step[f] / 2
                m.weights = m.weights - step[f]
            else:
                before[f] = value
                step[f] = np.linalg.solve(hessian + np.diag(penalty + 1e-12), gradient - penalty * m.weights)
                m.weights, m.steps = m.weights + step[f], m.steps + 1
            m.settled = bool(np.abs(step[f]).max() < tolerance)
    return models


def out_of_fold(df: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``df(fold, x, ...)`` with ``score``: each row's log odds by the model that didn't see its fold; null without a model or features."""
    held = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            score = np.full(len(batch), np.nan)
            there = np.flatnonzero(batch.column("x").is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                x, fold = _matrix(batch.take(pa.array(there))), batch.column("fold").to_numpy(zero_copy_only=False)[there]
                for f, m in held.value.items():
                    score[there[fold == f]] = m.scores(x[fold == f])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, from_pandas=True)], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, score double")


def shingles(text: Column, k: int) -> Column:
    """The distinct k-word runs of a text; the whole of a shorter one; empty for null and blank texts."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.array_remove(F.array_distinct(runs), "")


def overlap(a: Column, b: Column, k: int = 2) -> Column:
    """Jaccard similarity of k-word runs; 0 where both texts are blank."""
    x, y = shingles(a, k), shingles(b, k)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))


def pair_features(pairs: DataFrame, key: str = "pair", a: str = "text_a", b: str = "text_b", vectors: tuple[str, str] | None = None) -> DataFrame:
    """``pairs(key, a, b, ...)`` with ``x``: BM25 of b for a over all distinct b (its logarithm of 1 + score), the overlaps of
    their words and of two-word runs, the logarithm of their lengths' ratio, and, given two vector columns, their distance."""
    held = settle(pairs, "pairs")
    asked = held.select(key, F.xxhash64(b).alias("id"), F.lower(F.coalesce(a, F.lit(""))).alias("text"))
    docs = held.select(F.xxhash64(b).alias("id"), F.lower(F.coalesce(b, F.lit(""))).alias("text")).dropDuplicates(["id"])
    tables = R.bm25_tables(docs)
    scored = R.bm25_of_pairs(asked, tables, key)
    out = held.join(scored, key, "left")
    words = lambda c: F.log1p(F.size(shingles(F.col(c), 1)).cast("double"))
    x = [F.log1p(F.greatest(F.coalesce("bm25", F.lit(0.0)), F.lit(0.0))), overlap(F.col(a), F.col(b), 1), overlap(F.col(a), F.col(b), 2), words(a) - words(b)]
    if vectors:
        x.append(F.coalesce(F.sqrt(R.distance2(F.col(vectors[0]), F.col(vectors[1]))), F.lit(0.0)))
    return out.withColumn("x", F.array(*(v.cast("double") for v in x))).drop("bm25")
