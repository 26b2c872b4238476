"""Embedding tables as arrays, and which of their rows take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """False for a vector that is null, empty or zero, or holds a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dimension(rows: DataFrame, vector: str) -> int:
    """The commonest length of ``vector``, the larger of equals; 0 for no rows."""
    first = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first["d"] if first else 0


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)  # so that squares neither overflow nor vanish
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
