"""What the operators on vectors share: usable rows, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, v) of the rows with a finite vector; the longest length among them is the dimension, others take no part."""
    rows = df.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter(finite(F.col("v")))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    return rows.filter(F.size("v") == F.lit(longest or 0))


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column without nulls as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False) if len(column) else np.zeros((0, 0), kind)
