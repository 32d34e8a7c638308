"""BM25 arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tf_factor(tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / mean))


def quantise(factor: Column) -> Column:
    """Hundredths, cut off."""
    return F.floor(factor * 100).cast("long")


def idf(n_docs: Column, df: Column, weight: Column | float = 1.0) -> Column:
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return weight * F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
