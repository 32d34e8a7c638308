"""Building of graphs and of blocks of the join by distance."""

import numpy as np
from pyspark.sql import functions as F

from lakeseek.operators import graph, vector


def _pruned(vectors, point, candidates, degree, alpha):
    """The rule of ``robust_prune``, word for word."""
    far = lambda a, b: float(((vectors[a] - vectors[b]) ** 2).sum())
    pool, out = sorted((c for c in candidates if c != point), key=lambda c: (far(c, point), c)), []
    while pool and len(out) < degree:
        best = pool.pop(0)
        out.append(best)
        pool = [c for c in pool if alpha * far(c, best) > far(c, point)]
    return out


def test_prune_keeps_its_rule():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 8))
    for point in range(50):
        candidates = rng.choice(200, 60, replace=False)
        assert graph.robust_prune(vectors, point, candidates, 16, 1.2) == _pruned(vectors, point, candidates.tolist(), 16, 1.2)


def test_degree_and_distances(monkeypatch):
    """Lists end within the degree, of small partitions and of large ones, whose distances aren't made at once."""
    vectors = np.random.default_rng(4).normal(size=(400, 8))
    for dense in (0, 8192):
        monkeypatch.setattr(graph, "DENSE", dense)
        built = graph.build_local(vectors, degree=8)
        assert max(map(len, built)) <= 8 and all(k not in x and len(set(x)) == len(x) for k, x in enumerate(built))


def test_graph_is_built_once(spark, sf_dir):
    """What is read of a graph is a table, and its partitions aren't merged into one task."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    built = graph.graph_build(points, rows_per_partition=50)
    assert "FlatMapGroups" not in built._jdf.queryExecution().optimizedPlan().toString()
    assert len(built.inputFiles()) > 1


def test_join_holds_few_distances(spark):
    """A task holds the distances of 64 queries: with so many points that those of 256 would take 250 MB for one matrix and several more for what was made of it."""
    import tracemalloc

    import pyarrow as pa

    taken = {}

    class Rows:
        def __getattr__(self, _):
            return lambda *a, **k: self

        def applyInArrow(self, f, schema):
            taken["f"] = f
            raise InterruptedError

    points = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "id long, vector array<float>")
    grouped = type(points).groupBy
    try:
        type(points).groupBy = lambda self, *a: Rows() if a == ("i", "j") else grouped(self, *a)
        vector.knn_join(points.withColumnRenamed("id", "q"), points, 3)
    except InterruptedError:
        pass
    finally:
        type(points).groupBy = grouped
    x = np.random.default_rng(1).normal(size=(30256, 4)).astype(np.float32)
    group = pa.table({"id": np.arange(len(x)), "vector": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 4).cast(pa.list_(pa.float32())), "query": np.arange(len(x)) < 256})
    tracemalloc.start()
    found = taken["f"](group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 256 * 3 and peak < 90e6
