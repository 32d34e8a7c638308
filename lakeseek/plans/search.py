"""The search planner: indexed files through candidates, the others by scan, one verification for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.base import BUCKET_ROWS, SearchIndex
from ..operators.bm25 import Bm25Index, corpus_stats
from ..sources import lake as L
from ..sources import storage
from ..sources.catalog import Catalog

_TABLES = {
    "bm25": ("postings", "frequencies", "stats"),
    "substring": ("postings",),
    "substring_token": ("postings",),
    "uuid": ("postings", "lengths"),
    "vector": ("codes", "centroids", "codebooks"),
    "logs": ("tokens", "dictionary"),
}


def index_tables(catalog: Catalog, index: SearchIndex, index_ids: list[str]) -> dict[str, DataFrame]:
    return {t: rows for t in _TABLES[index.name] if (rows := catalog.read(index_ids, t)) is not None}


def unindexed(files: DataFrame, covered: DataFrame) -> DataFrame:
    """Files that no index covers."""
    return files.join(covered, "file_path", "left_anti")


def scan_newest(lake: L.Lake, files: list[str], index: SearchIndex, query, k: int, *columns: str) -> DataFrame | None:
    """The first k matches of the last files, if a part of the files holds so many: batches of files, newest first, each twice as large as the one before."""
    left, size = sorted(files, reverse=True), 1
    taken: list[str] = []
    while len(left) > size:
        taken, left, size = taken + left[:size], left[size:], 2 * size
        found = index.verify(L.with_uid(lake.scan(taken, *columns), index.stride), query, k)
        if found.count() >= k:
            return found
    return None


def search(lake: L.Lake, catalog: Catalog, index: SearchIndex, query, k: int, columns: tuple[str, ...] = (), version: int | None = None, expand=None) -> DataFrame:
    """The k rows of the lake that match (best, for a ranked index), with their locator, the indexed column and ``columns``.

    Candidates are kept to live files, so a stale index can't return rows that are gone.
    More of them than the index's threshold, or a query that it can't answer, are answered by a scan.
    Files that aren't indexed are always read: the result is a full scan's, whatever the
    state of the indexes (for quantised vectors, up to the index's recall). Two small
    things come to the driver, the file lists and whether the threshold is passed; the
    rest is one lazy plan. ``expand`` makes a ranked query of terms and weights out of the vocabulary and the
    query (``bm25.keyword_expansion``, ``bm25.EmbeddingExpansion``); its few rows come to the driver. Of an index that prefers
    the last files, a scan for k rows reads these first and stops when it has them.
    """
    spark: SparkSession = lake.spark
    wanted = tuple(dict.fromkeys((index.column, *columns)))
    files = lake.files(version).select("file_path").distinct()
    live = sorted(r.file_path for r in files.collect())
    if not live:
        return spark.createDataFrame([], "file_path string, row_index long")
    covering = catalog.indexes(index.name, index.column).collect()
    useful = [r for r in covering if set(r.file_path) & set(live)]
    covered = sorted({f for r in useful for f in r.file_path} & set(live))
    tail = sorted(set(live) - set(covered))
    if expand is not None:
        tables = index_tables(catalog, index, [r.index_id for r in useful])
        known = tables["frequencies"].select("term") if useful else None
        if tail:
            more = lake.scan(tail, index.column).select(F.explode(index.tokens(F.col(index.column))).alias("term"))
            known = more if known is None else known.unionByName(more)
        query = {r.term: float(r.weight) for r in expand(known.distinct(), query).collect()}
    whole = L.with_uid(lake.scan(live, *wanted), index.stride)
    candidates = index.candidates(index_tables(catalog, index, [r.index_id for r in useful]), query) if covered else None
    if candidates is not None:
        here = candidates.join(files, "file_path", "left_semi")
        if index.name != "bm25" and here.limit(index.brute_force_threshold + 1).count() > index.brute_force_threshold:
            candidates = None
    if candidates is None and index.newest_first and k is not None and (found := scan_newest(lake, live, index, query, k, *wanted)) is not None:
        return found.select("file_path", "row_index", *wanted)
    if candidates is None:
        rows = whole if covered or tail else whole.limit(0)
    else:
        indexed = L.with_uid(lake.scan(covered, *wanted), index.stride)
        key = ["file_path", "row_index"] if "row_index" in here.columns else ["file_path", "uid"]
        rows = indexed.join(here.select(*key).distinct(), key, "left_semi")
        if tail:
            rows = rows.unionByName(L.with_uid(lake.scan(tail, *wanted), index.stride))
    if isinstance(index, Bm25Index):
        # Scores are the corpus's: indexes that cover each file once, and live ones only, know size and mean length of theirs; the others are counted.
        text = F.col(index.column)
        named = [f for r in useful for f in r.file_path]
        known = useful and len(named) == len(set(named)) and set(named) <= set(live)
        parts = [index_tables(catalog, index, [r.index_id for r in useful])["stats"].select("n_docs", "avgdl")] if known else []
        if counted := tail if known else live:
            parts.append(corpus_stats(lake.scan(counted, index.column).filter(text.isNotNull()), index.tokens(text)))
        each = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        stats = each.agg(F.sum("n_docs").alias("n_docs"), (F.sum(F.col("avgdl") * F.col("n_docs")) / F.sum("n_docs")).alias("avgdl"))
        found = index.verify(rows.filter(text.isNotNull()), query, k, stats)
    else:
        found = index.verify(rows, query, k)
    extra = [c for c in ("score", "distance") if c in found.columns]
    return found.select("file_path", "row_index", *wanted, *extra)


def build_index(lake: L.Lake, catalog: Catalog, index: SearchIndex, row_threshold: int = 10_000, version: int | None = None) -> list[str]:
    """Index the files that no index covers yet: bin-packed groups, an index for each; returns their ids.

    All groups are built together, as rows of one table with the group's id, and committed in one version of the metadata after their tables are written.
    """
    from .maintain import pack_files

    spark = lake.spark
    todo = unindexed(lake.files(version).select("file_path").distinct(), catalog.covered(index.name, index.column))
    paths = [r.file_path for r in todo.orderBy("file_path").collect()]
    if not paths:
        return []
    counts = {r.file_path: r["count"] for r in lake.scan(paths).groupBy("file_path").count().collect()}
    groups = [(catalog.fresh_id(), group) for group in pack_files([(p, counts.get(p, 0)) for p in paths], row_threshold)]
    rows = L.with_uid(lake.scan(paths, index.column), index.stride)
    size = {i: max(1, -(-sum(n for _, n in group) // BUCKET_ROWS)) for i, group in groups}
    if len(groups) == 1:
        named = rows.withColumn("index_id", F.lit(groups[0][0])).withColumn("buckets", F.lit(size[groups[0][0]]))
    else:
        of = spark.createDataFrame([(p, i, size[i]) for i, group in groups for p, _ in group], "file_path string, index_id string, buckets int")
        named = rows.join(F.broadcast(of), "file_path")
    catalog.write(index.build(named))
    while index.scratch:
        storage.delete(spark, index.scratch.pop())
    catalog.commit(index.name, index.column, [(i, [p for p, _ in group], [n for _, n in group]) for i, group in groups])
    return [i for i, _ in groups]
