"""Vector columns: usability, Arrow transport and cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite numbers that are not all zero."""
    e = F.coalesce(embedding, F.array().cast("array<float>"))
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is 0, null where lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, 0.0).otherwise(dot(a, b) / n))


def raw_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list<float> Arrow column without nulls as float32 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length (float32); rows must not be all zero."""
    if not len(m):
        return m.astype(np.float32)
    x = m.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list<float> Arrow column without nulls as rows of unit length (float32)."""
    return unit(raw_matrix(column, dim))


def best_of(cos: np.ndarray, keep: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of all values at most ``slack`` below the ``keep``-th largest of their row."""
    if cos.shape[1] <= keep:
        return np.indices(cos.shape).reshape(2, -1)
    return np.nonzero(cos >= np.partition(cos, cos.shape[1] - keep, axis=1)[:, -keep, None] - slack)


def first_of_row(rows: np.ndarray, cos: np.ndarray, order: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best entries of each row: largest cosine, then smallest ``order``."""
    by = np.lexsort((order, -cos, rows))
    r = rows[by]
    return by[np.arange(len(r)) - np.searchsorted(r, r) < keep]


def unit_rows(df: DataFrame, dim: int) -> DataFrame:
    """Keep usable vectors only; the other columns stay as they are."""
    return df.where(usable(F.col("embedding"), dim))
