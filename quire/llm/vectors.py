"""Vectors as blocks: what the embedding operators share.

A block is a bounded number of vectors packed into one row, so that tasks work on matrices.
Which block a vector is in depends on a hash of its id; the number of blocks grows with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the vectors that can be compared: not null, no null or
    non-finite component, not all zero."""
    e = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return e.where("vec_id is not null and embedding is not null").where(
        fine & F.exists("embedding", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; first by their largest component, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix of doubles."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
