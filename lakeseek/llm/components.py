"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Edges up to which one task finds the components.
SMALL = 200_000


def _joined(batches):
    """``(node, label)`` of each node of all edges ``(u, v)``, by union-find."""
    parent, kind = {}, None

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        kind = batch.column("u").type
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], ["node", "label"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """``(node, label)`` of each node of the edges ``(a, b)``: the least node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014): each points neighbours
    at the least node around, until nothing changes; the rounds grow with the logarithm of
    the longest chain, each is two aggregations and joins by key, and nothing but a count and a
    hash of the edges comes to the driver. The rounds' tables go through the shared checkpoint folder.
    Up to ``small`` edges are joined in one task instead: each round costs dozens of small tasks and files, however few edges it has.
    """
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    now = K.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(now)
    if 0 < before[0] <= small:
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_joined, f"node {kind}, label {kind}")
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = K.materialise(small)
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
