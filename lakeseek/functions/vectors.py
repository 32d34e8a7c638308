"""Distances between array columns, in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column; nulls and other lengths than the first row's become NaN."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and column.null_count == 0 and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    rows = column.to_pylist()
    width = next((len(r) for r in rows if r), 0)
    return np.array([r if r is not None and len(r) == width else [np.nan] * width for r in rows], float).reshape(len(rows), width)


def l2_squared(vector: Column, query: list[float]) -> Column:
    """Squared distance to a constant vector; null where the vector is null or of another length."""
    q = np.asarray(query, np.float64)

    def f(column: pa.Array) -> pa.Array:
        m = _matrix(column)
        if m.shape[1] != len(q):
            return pa.nulls(len(m), pa.float64())
        d = ((m - q) ** 2).sum(1)
        return pa.array(d, mask=np.isnan(d))

    return F.arrow_udf(f, "double")(vector)


def nearest(vector: Column, centroids: list[list[float]], n: int = 1) -> Column:
    """Numbers of the n nearest of a bounded list of centroids, nearest first; ties go to the lower number."""
    c = np.asarray(centroids, np.float64)

    def f(column: pa.Array) -> pa.Array:
        m = np.nan_to_num(_matrix(column))
        d = (m**2).sum(1)[:, None] - 2 * m @ c.T + (c**2).sum(1)
        order = np.argsort(d, axis=1, kind="stable")[:, :n]
        return pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))

    return F.arrow_udf(f, "array<int>")(vector)


def cosine(a: Column, query: list[float]) -> Column:
    q = np.asarray(query, np.float64)

    def f(column: pa.Array) -> pa.Array:
        m = _matrix(column)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = m @ q / np.linalg.norm(m, axis=1) / np.linalg.norm(q)
        return pa.array(d, mask=np.isnan(d))

    return F.arrow_udf(f, "double")(a)


def from_binary(packed: Column) -> Column:
    """Little-endian float32 bytes as an array column."""

    def f(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, "<f4") for x in column.to_pylist()], pa.list_(pa.float32()))

    return F.arrow_udf(f, "array<float>")(packed)
