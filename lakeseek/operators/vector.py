"""Vector search: exact scan, and inverted lists with product quantisation, refined by exact distances."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .base import SearchIndex, named


def distance(column: Column, query: list[float], metric: str = "l2") -> Column:
    """Distance to a constant vector: Euclidean (l2), or one minus the cosine."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"no such metric: {metric}")
    return F.sqrt(V.l2_squared(column, query)) if metric == "l2" else 1 - V.cosine(column, query)


def knn_scan(rows: DataFrame, column: str, query: list[float], k: int, keys: list[str], metric: str = "l2") -> DataFrame:
    """The k rows of least distance, ties by key; one pass, and k rows from each task."""
    near = rows.withColumn("distance", F.round(distance(F.col(column), query, metric), 6)).filter("distance IS NOT NULL")
    return near.orderBy("distance", *keys).limit(k)


def knn_join(left: DataFrame, right: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``(q, id, distance, rank)``: for each query vector ``(q, vector)`` the k nearest of ``(id, vector)``, ties by id.

    Both sides are cut into blocks by hash, and each two blocks meet in one task, where matrix
    products give the distances and only the best k of each query go on. A task holds two blocks, of ``block`` queries and eight times
    as many points, and the distances of 64 queries, whatever the tables' sizes; the work is their product. Nothing comes to the driver but two counts.
    """
    queries = left.select(F.col("q").cast("long").alias("id"), "vector").filter("vector IS NOT NULL")
    points = right.select(F.col("id").cast("long").alias("id"), "vector").filter("vector IS NOT NULL")
    rows, columns = max(1, -(-queries.count() // block)), max(1, -(-points.count() // (8 * block)))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    each = queries.withColumn("i", number(rows)).withColumn("j", every(columns)).withColumn("query", F.lit(True))
    each = each.unionByName(points.withColumn("j", number(columns)).withColumn("i", every(rows)).withColumn("query", F.lit(False)))

    def best(group: pa.Table) -> pa.Table:
        asks = group["query"].to_numpy(zero_copy_only=False)
        ids, vectors = group["id"].to_numpy(), V._matrix(group["vector"].combine_chunks())
        names, q, ids, m = ids[asks], vectors[asks], ids[~asks], vectors[~asks]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        norm, turned = (m**2).sum(1), -2 * m.T
        for at in range(0, len(q) if len(m) else 0, 64):
            part = q[at : at + 64]
            d = part @ turned  # in place from here on: a matrix and its partitioned copy are held, of 64 queries
            d += norm
            d += (part**2).sum(1)[:, None]
            np.sqrt(np.maximum(0, d, out=d), out=d)
            d[np.isnan(d)] = np.inf
            edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            x, y = np.nonzero(d <= edge[:, None] + 1e-6)  # ties stay
            exact = np.sqrt(((part[x] - m[y]) ** 2).sum(1))
            some = np.isfinite(exact)
            out.append((names[at + x[some]], ids[y[some]], exact[some]))
        q_of, id_of, distance = (np.concatenate(c) for c in zip(*out))
        return pa.table({"q": q_of, "id": id_of, "distance": distance})

    found = each.groupBy("i", "j").applyInArrow(best, "q long, id long, distance double").withColumn("distance", F.round("distance", 6))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")))
    return ranked.filter(F.col("rank") <= k)


def assign(points: DataFrame, centroids: list[list[float]], n: int = 1) -> DataFrame:
    """Each point with the numbers of its n nearest centroids."""
    return points.withColumn("nearest", V.nearest(F.col("vector"), centroids, n))


def medoid(points: DataFrame, key: str = "id") -> DataFrame:
    """The point nearest to the mean of all, ties by key: ``(key, distance)``."""
    mean = [r.m for r in points.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("d").collect()]
    near = points.select(key, F.round(F.sqrt(V.l2_squared(F.col("vector"), mean)), 6).alias("distance")) if mean else points.select(key, F.lit(None).cast("double").alias("distance"))
    return near.filter("distance IS NOT NULL").orderBy("distance", key).limit(1)


def kmeans(points: DataFrame, k: int, rounds: int = 10, seed: int = 7) -> list[list[float]]:
    """Centroids by Lloyd's rounds over all points; the first ones by distance-weighted seeding on a bounded sample.

    A round sends one row of sums for each centroid and task to the driver side of an
    aggregation; the points stay where they are.
    """
    first = points.select("vector").filter("vector IS NOT NULL").orderBy(F.xxhash64("vector", F.lit(seed))).limit(max(1000, 20 * k)).collect()
    x = np.array([r.vector for r in first], np.float64)
    if not len(x):
        return []
    rng = np.random.default_rng(seed)
    c = [x[0]]
    d = ((x - c[0]) ** 2).sum(1)
    while len(c) < min(k, len(x)) and d.max() > 0:
        # The largest of ln(u) / w picks with probability proportional to w.
        c.append(x[np.argmax(np.log(rng.random(len(x))) / np.maximum(d, 1e-12))])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.array(c)
    for _ in range(rounds):
        centroids = c

        def sums(batches, centroids=centroids):
            total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for b in batches:
                m = V._matrix(b.column("vector"))
                own = np.argmin((m**2).sum(1)[:, None] - 2 * m @ centroids.T + (centroids**2).sum(1), 1)
                np.add.at(total, own, m)
                count += np.bincount(own, minlength=len(count))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(list(total), pa.list_(pa.float64())), pa.array(count)], ["c", "total", "n"])

        found = points.select("vector").filter("vector IS NOT NULL").mapInArrow(sums, "c long, total array<double>, n long")
        merged = found.filter("n > 0").groupBy("c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[k]) for k in range(c.shape[1]))).alias("total")).collect()
        new = c.copy()
        for r in merged:
            new[r.c] = np.array(r.total) / r.n
        if np.abs(new - c).max() < 1e-6:
            break
        c = new
    return c.tolist()


class IvfPqIndex(SearchIndex):
    """Codes by nearest centroid. ``candidates`` probes the nearest lists of each part, takes the best ``refine`` of each list by quantised distance; ``verify`` ranks exactly.

    A part is what was trained together: the files of one build. Its centroids and codebooks keep its number through compaction, so
    merged indexes are searched as before. With as many probes as lists and as large a ``refine`` as lists are long, the result is exact.
    """

    name, ranked = "vector", True

    def __init__(self, column: str, rows_per_centroid: int = 1000, subspaces: int = 16, bits: int = 6, probes: int = 16, refine: int = 100, sample: int = 20_000, seed: int = 7, metric: str = "l2", **options):
        super().__init__(column, **options)
        self.metric = metric
        self.rows_per_centroid, self.subspaces, self.bits, self.probes, self.refine, self.sample, self.seed = rows_per_centroid, subspaces, bits, probes, refine, sample, seed

    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        rows = named(rows)
        spark = rows.sparkSession
        vector = F.col(self.column)
        if self.metric == "cosine":  # of vectors of length 1, the nearest have the greatest cosine
            norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
            vector = F.transform(vector, lambda x: (x / norm).cast("double"))
        points = rows.filter(F.col(self.column).isNotNull()).withColumn("vector", vector)
        n = points.count()
        centroids = kmeans(points, max(1, round(n / self.rows_per_centroid)), seed=self.seed)
        books = self._codebooks(points)
        sent = spark.sparkContext.broadcast(books)

        def encode(column: pa.Array) -> pa.Array:
            return pa.array([x.tobytes() for x in _encode(V._matrix(column), sent.value)], pa.binary())

        part = uuid.uuid4().hex
        codes = assign(points, centroids).select("index_id", F.lit(part).alias("part"), "file_path", "uid", "row_index", F.col("nearest")[0].alias("centroid"), F.arrow_udf(encode, "binary")("vector").alias("code"))
        of = rows.select("index_id").distinct()
        each = lambda values, schema: spark.createDataFrame(values, schema).withColumn("part", F.lit(part)).crossJoin(of)  # noqa: E731  (a few rows for each index)
        return {
            "codes": codes.repartition("index_id", "centroid").sortWithinPartitions("index_id", "centroid"),
            "centroids": each([(i, c) for i, c in enumerate(centroids)], "centroid int, vector array<double>"),
            "codebooks": each([(i, b.ravel().tolist(), b.shape[0]) for i, b in enumerate(books)], "subspace int, book array<double>, n int"),
        }

    def _codebooks(self, points: DataFrame) -> list[np.ndarray]:
        """A codebook for each subspace, trained on a bounded sample (``sample``)."""
        some = points.select("vector").orderBy(F.xxhash64("vector", F.lit(self.seed))).limit(self.sample).collect()
        x = np.array([r.vector for r in some], np.float64)
        books, rng = [], np.random.default_rng(self.seed)
        for part in np.array_split(np.arange(x.shape[1] if x.ndim == 2 else 0), self.subspaces):
            y = x[:, part] if len(x) else np.zeros((0, 0))
            c = y[rng.permutation(len(y))[: 1 << self.bits]]
            for _ in range(8):
                own = np.argmin((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1), 1) if len(c) else np.zeros(0, int)
                for k in range(len(c)):
                    if (own == k).any():
                        c[k] = y[own == k].mean(0)
            books.append(c)
        return books

    def candidates(self, tables: dict[str, DataFrame], query: list[float]) -> DataFrame:
        q = np.asarray(query, np.float64)
        if self.metric == "cosine":
            q = q / max(1e-12, float(np.linalg.norm(q)))
        known = tables["centroids"].dropDuplicates(["part", "centroid"]).withColumn("d", V.l2_squared(F.col("vector"), q.tolist()))
        nearest = Window.partitionBy("part").orderBy("d", "centroid")
        lists = known.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= self.probes).select("part", "centroid")
        books: dict[str, list[np.ndarray]] = {}
        for r in tables["codebooks"].dropDuplicates(["part", "subspace"]).orderBy("part", "subspace").collect():
            books.setdefault(r.part, []).append(np.array(r.book).reshape(r.n, -1))
        tables_of = {i: _distance_table(q, b) for i, b in books.items()}

        def distance(parts: pa.Array, codes: pa.Array) -> pa.Array:
            out = np.zeros(len(codes))
            names, raw = np.array(parts.to_pylist()), codes.to_pylist()
            for i, table in tables_of.items():
                at = np.flatnonzero(names == i)
                if len(at):
                    c = np.frombuffer(b"".join(raw[k] for k in at), np.uint8).reshape(len(at), -1)
                    out[at] = sum(t[c[:, s]] for s, t in enumerate(table))
            return pa.array(out)

        scored = tables["codes"].join(lists, ["part", "centroid"], "left_semi").withColumn("d", F.arrow_udf(distance, "double")("part", "code"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("part", "centroid").orderBy("d", "file_path", "row_index"))).filter(F.col("rank") <= self.refine)
        return ranked.select("file_path", "uid", "row_index")

    def verify(self, rows: DataFrame, query: list[float], k: int | None) -> DataFrame:
        near = rows.withColumn("distance", F.round(distance(F.col(self.column), query, self.metric), 6)).filter("distance IS NOT NULL")
        return near.orderBy("distance", "file_path", "row_index").limit(k) if k is not None else near


def _encode(m: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    out, at = np.zeros((len(m), len(books)), np.uint8), 0
    for s, c in enumerate(books):
        y = m[:, at : at + c.shape[1]]
        at += c.shape[1]
        out[:, s] = np.argmin((y**2).sum(1)[:, None] - 2 * y @ c.T + (c**2).sum(1), 1) if len(c) else 0
    return out


def _distance_table(q: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for c in books:
        out.append(((q[at : at + c.shape[1]] - c) ** 2).sum(1))
        at += c.shape[1]
    return out
