"""Graph search over vectors: overlapping partitions, a pruned neighbour graph in each, greedy beam search."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import workspace
from .vector import assign, kmeans

#: Points of a partition up to which its build takes the distances of a point to all at once.
DENSE = 8192


def robust_prune(vectors: np.ndarray, point: int, candidates: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Nearest first; a candidate goes if one already taken is nearer to it by the factor alpha than the point is."""
    pool = candidates[candidates != point]
    distance = ((vectors[pool] - vectors[point]) ** 2).sum(1)
    order = np.lexsort((pool, distance))
    pool, distance = pool[order], distance[order]
    x = vectors[pool]
    norm = (x**2).sum(1)
    between = alpha * (norm[:, None] + norm - 2 * x @ x.T)
    open_, out = np.ones(len(pool), bool), []
    for k, name in enumerate(pool.tolist()):
        if open_[k]:
            out.append(name)
            if len(out) == degree:
                break
            open_ &= between[k] > distance
    return out


def beam(vectors: np.ndarray, neighbours: list[list[int]], start: int, query: np.ndarray, width: int, known: list[float] | None = None) -> list[tuple[float, int]]:
    """The best ``width`` points that a greedy walk from ``start`` meets, nearest first. ``known`` are the squared distances of all points, if they are at hand."""
    d0 = float(((vectors[start] - query) ** 2).sum()) if known is None else known[start]
    seen, todo, best = {start}, [(d0, start)], [(-d0, start)]
    while todo:
        d, point = heapq.heappop(todo)
        if len(best) >= width and d > -best[0][0]:
            break
        new = [k for k in neighbours[point] if k not in seen]
        seen.update(new)
        if new:
            for dk, k in zip(((vectors[new] - query) ** 2).sum(1).tolist() if known is None else [known[k] for k in new], new):
                if len(best) < width or dk < -best[0][0]:
                    heapq.heappush(todo, (dk, k))
                    heapq.heappush(best, (-dk, k))
                    if len(best) > width:
                        heapq.heappop(best)
    return sorted((-d, k) for d, k in best)


def build_local(vectors: np.ndarray, degree: int = 16, alpha: float = 1.2, width: int = 32) -> list[list[int]]:
    """A pruned graph over one partition: each point's candidates come from a walk over the graph so far, in two passes with back edges.

    Lists may grow to twice the degree before they are pruned, and all have the degree at most in the end.
    """
    n = len(vectors)
    norm = (vectors**2).sum(1)
    rng = np.random.default_rng(5)
    neighbours = [[int(x) for x in rng.choice(n, min(degree, n - 1), replace=False) if x != k] if n > 1 else [] for k in range(n)]
    start = int(np.argmin(((vectors - vectors.mean(0)) ** 2).sum(1))) if n else 0
    for a in (1.0, alpha):
        for k in rng.permutation(n).tolist():
            # One product for all distances of a point costs less than many small ones, unless the partition is large.
            known = np.maximum(0, norm + norm[k] - 2 * vectors @ vectors[k]).tolist() if n <= DENSE else None
            met = [x for _, x in beam(vectors, neighbours, start, vectors[k], width, known)]
            neighbours[k] = robust_prune(vectors, k, np.array(sorted({*met, *neighbours[k]} - {k}), np.int64), degree, a) if n > 1 else []
            for x in neighbours[k]:
                if k not in neighbours[x]:
                    neighbours[x].append(k)
                    if len(neighbours[x]) > 2 * degree:
                        neighbours[x] = robust_prune(vectors, x, np.array(neighbours[x], np.int64), degree, a)
    return [robust_prune(vectors, k, np.array(x, np.int64), degree, alpha) if len(x) > degree else x for k, x in enumerate(neighbours)]


def graph_build(points: DataFrame, rows_per_partition: int = 2000, degree: int = 16, overlap: int = 2) -> DataFrame:
    """``(part, id, vector, neighbours, start)``: each point is in the partitions of its ``overlap`` nearest centroids, each of which is a graph of its own.

    Edges name ids, so the graphs' union is one graph (``graph_edges``). It is built once, into a table in the shared folder, however often it is read.
    """
    rows = points.select("id", "vector").filter("vector IS NOT NULL")
    n = rows.count()
    centroids = kmeans(rows, max(1, -(-n // rows_per_partition)))
    if not centroids:
        return points.sparkSession.createDataFrame([], "part int, id long, vector array<float>, neighbours array<bigint>, start boolean")
    placed = assign(rows, centroids, min(overlap, len(centroids))).withColumn("part", F.explode("nearest"))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, v = group["id"].to_numpy(), np.array(group["vector"].to_pylist(), np.float64)
        graph = build_local(v, degree)
        start = int(np.argmin(((v - v.mean(0)) ** 2).sum(1)))
        return pa.table({"part": group["part"], "id": group["id"], "vector": group["vector"], "neighbours": pa.array([ids[x].tolist() for x in graph], pa.list_(pa.int64())), "start": pa.array(np.arange(len(ids)) == start)})

    path = workspace(points.sparkSession, "graph")
    # By number, so that small exchanges aren't merged into one task: a partition's work isn't its bytes.
    placed.select("part", "id", "vector").repartition(4 * len(centroids), "part").groupBy("part").applyInArrow(one, "part int, id long, vector array<float>, neighbours array<bigint>, start boolean").write.parquet(path)
    return points.sparkSession.read.parquet(path)


def graph_edges(graph: DataFrame) -> DataFrame:
    """``(src, dst)`` of all partitions together."""
    return graph.select(F.col("id").alias("src"), F.explode("neighbours").alias("dst")).distinct()


def graph_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two graphs as one: partitions are kept apart, so a union under other numbers is a graph that searches as both do."""
    shift = left.agg(F.coalesce(F.max("part"), F.lit(-1)).alias("m")).first().m + 1
    return left.unionByName(right.withColumn("part", F.col("part") + shift))


def graph_search(graph: DataFrame, queries: list[tuple[int, list[float]]], k: int, width: int = 64) -> DataFrame:
    """``(q, id, distance)``: the k best points that a walk through every partition's graph finds for each query (a bounded list)."""
    sent = graph.sparkSession.sparkContext.broadcast([(q, np.asarray(v, np.float64)) for q, v in queries])

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, v = group["id"].to_numpy(), np.array(group["vector"].to_pylist(), np.float64)
        graph = [np.searchsorted(ids, x).tolist() for x in group["neighbours"].to_pylist()]
        start = int(np.argmax(group["start"].to_numpy()))
        out = [(q, int(ids[x]), d**0.5) for q, w in sent.value for d, x in beam(v, graph, start, w, max(k, width))[:k]]
        return pa.table({c: pa.array([r[n] for r in out], t) for n, (c, t) in enumerate((("q", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())))})

    from pyspark.sql import Window

    found = graph.groupBy("part").applyInArrow(one, "q long, id long, distance double").dropDuplicates(["q", "id"]).withColumn("distance", F.round("distance", 6))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k).select("q", "id", "distance", "rank")
