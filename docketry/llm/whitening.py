"""Embedding whitening: covariance by Chan's merging, eigenvectors on the driver, a second pass that verifies the identity.

Entries become integers, x = floor(256 c) (at the ends of 64 bits where a double is beyond them). The statistics come from each
distinct x once. Each task keeps a count, the exact sums, the mean and the centred scatter of its rows; ``merge`` joins two such
tuples by Chan's formula, and ``treeReduce`` applies it in as many levels as keep what meets on the driver within MEETS bytes.
Only one such tuple, of (dimension)^2 doubles, is the model.

Rows whose vector is null, empty, or holds null or non-finite entries take no part; nor do vectors shorter than the longest
ones. Repeated rows and ids come back as often as they stand there, but count once in the statistics. A component whose
eigenvalue is no more than 1e-12 of the trace has no scale and isn't returned (equal vectors only: no rows come back). Where a
row's deviation is beyond 64 bits it is null. Other columns of the table are not read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import discard, settle, table
from docketry.llm.vectors import matrix, usable

COMPONENTS = 4
MEETS = 64 << 20
#: Rows of a matrix that are centred at a time.
BLOCK = 4096
_LONG = 2**63 - 1

Moments = tuple[int, np.ndarray | None, np.ndarray | None, np.ndarray | None]
NONE: Moments = (0, None, None, None)


def _sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of columns, as Python integers."""
    if x.dtype == np.int64 and len(x) * max(abs(int(x.min())), abs(int(x.max()))) > _LONG:
        x = x.astype(object)
    return x.sum(axis=0).astype(object)


def moments(x: np.ndarray) -> Moments:
    """(count, sums, mean, centred scatter) of the rows of ``x``."""
    if not len(x):
        return NONE
    sums = _sums(x)
    mean = np.array([float(s) for s in sums]) / len(x)
    centred = x.astype(np.float64) - mean
    return len(x), sums, mean, centred.T @ centred


def merge(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula: scatters add, and the outer product of the means' difference weighs in."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * (b[0] / n))


def reduced(rows: DataFrame, column: str, dimension: int, change=None) -> Moments:
    """The moments of a list column, one tuple a task, merged over a tree; ``change`` maps each matrix of rows first."""

    def run(batches):
        own = NONE
        for batch in batches:
            x = matrix(batch.column(column), np.int64)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                own = merge(own, moments(change(part) if change else part))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["m"])

    tuples = rows.select(column).mapInArrow(run, "m binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    fan = max(2, MEETS // (16 * dimension * dimension + 1))
    depth = max(2, math.ceil(math.log(max(2, tuples.getNumPartitions()), fan)))
    return tuples.treeReduce(merge, depth)


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and each of the first components."""
    rows = usable(df, id_column, vector).select("id", F.transform("v", lambda c: F.floor(c.cast("double") * 256)).alias("x"))
    fit = settle(rows.select("x").distinct(), "whitening")
    kind = f"id {df.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    first = fit.first()
    if first is None:
        return df.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_column)
    n, sums, _, scatter = reduced(fit, "x", len(first["x"]))
    values, axes = np.linalg.eigh(scatter / n)
    order = np.argsort(values)[::-1][:components]
    trace = float(np.trace(scatter) / n)
    order = [i for i in order if values[i] > 1e-12 * trace]
    values, axes = values[order], axes[:, order]
    if not len(order):
        return df.sparkSession.createDataFrame([], kind).withColumnRenamed("id", id_column)
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])
    scaled, k = axes / np.sqrt(values) / n, len(order)

    def apart(x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: Python integers where 64 bits don't hold them."""
        most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
        return x * n - sums.astype(np.int64) if most <= _LONG else x.astype(object) * n - sums

    def project(x: np.ndarray) -> np.ndarray:
        return apart(x).astype(np.float64) @ scaled

    _, _, _, again = reduced(fit, "x", k, project)
    error = float(np.abs(again / n - np.eye(k)).max())
    discard(fit)

    def deviations(off: np.ndarray) -> list:
        if off.dtype == np.int64 and off.shape[1] * max(abs(int(off.min())), abs(int(off.max()))) ** 2 <= _LONG:
            return (off * off).sum(axis=1).tolist()
        return [s if s <= _LONG else None for s in (sum(int(v) ** 2 for v in row) for row in off)]

    share = values / trace

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), np.int64)
            for at in range(0, len(x), BLOCK):
                part = x[at : at + BLOCK]
                m, off = len(part), apart(part)
                here = pa.array(np.repeat(np.arange(at, at + m), k))
                flat = (off.astype(np.float64) @ scaled).ravel()
                dev = pa.array(deviations(off), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                arrays = [batch.column("id").take(here), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), dev, pa.array(flat), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, kind).withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
