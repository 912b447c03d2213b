"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_vector(column: str, dim: int) -> Column:
    """True for vectors of ``dim`` finite components, not all zero."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(column) == dim) & finite & F.exists(F.col(column), lambda x: x != 0), F.lit(False))


def dimension(rows: DataFrame, column: str) -> int:
    """The most frequent number of components (the larger of equally frequent ones); 0 without vectors."""
    found = rows.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def as_rows(array: pa.Array, dim: int) -> np.ndarray:
    """(n, dim) doubles of an Arrow list column without nulls."""
    return np.asarray(array.flatten(), dtype=np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in doubles; equal pairs give equal values wherever they stand."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    dot = lambda x, y: np.add.reduce(x * y, axis=1)
    return np.clip(dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)), -1.0, 1.0)
