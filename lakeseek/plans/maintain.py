"""Maintenance of indexes: bin packing, compaction, greedy cover, vacuum."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.base import SearchIndex
from ..sources import lake as L
from ..sources.catalog import Catalog

BINPACK_ROWS = 10_000


def pack_files(files: list[tuple[str, int]], threshold: int = BINPACK_ROWS) -> list[list[tuple[str, int]]]:
    """Groups of files in their order: a group is closed before it would pass the threshold; one file always fits.

    The list is metadata (a row for each file not indexed yet), and the rule is sequential.
    """
    out: list[list[tuple[str, int]]] = []
    size = 0
    for path, n in files:
        if out and size + n <= threshold:
            out[-1].append((path, n))
            size += n
        else:
            out.append([(path, n)])
            size = n
    return out


def pack_groups(files: DataFrame, order: list[str], count: str, threshold: int = BINPACK_ROWS) -> DataFrame:
    """The same as a column ``bin``, numbered from 0: one pass over the ordered list, a row for each file, in one task that holds a number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", bin long"

    def fold(batches):
        number, size = -1, 0
        for batch in batches:
            bins = []
            for n in batch.column(count).to_pylist():
                if number >= 0 and size + n <= threshold:
                    size += n
                else:
                    number, size = number + 1, n
                bins.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64())], [*batch.schema.names, "bin"])

    return files.coalesce(1).sortWithinPartitions(*order, count).mapInArrow(fold, schema)


def small_indexes(metadata: DataFrame, threshold: int) -> DataFrame:
    """Indexes of fewer rows than the threshold."""
    return metadata.filter(F.aggregate("record_counts", F.lit(0).cast("long"), lambda s, x: s + x) < threshold)


def live_overlap(metadata: DataFrame, live: DataFrame) -> DataFrame:
    """Indexes that cover a live file at least."""
    each = metadata.select("index_id", F.explode("file_path").alias("file_path")).join(live.select("file_path"), "file_path", "left_semi")
    return metadata.join(each.select("index_id").distinct(), "index_id", "left_semi")


def greedy_cover(metadata: DataFrame, live: DataFrame) -> list[str]:
    """Indexes that cover all that any covers of the live files, each time the one that adds most (the least id, of equals)."""
    files = {r.file_path for r in live.select("file_path").collect()}
    sets = {r.index_id: set(r.file_path) & files for r in metadata.select("index_id", "file_path").collect()}
    out, open_files = [], set().union(*sets.values()) if sets else set()
    while open_files:
        best = min(sets, key=lambda i: (-len(sets[i] & open_files), i))
        out.append(best)
        open_files -= sets.pop(best)
    return out


def merge_metadata(metadata: DataFrame, order: str, count: str) -> DataFrame:
    """Sidecars of several indexes as one's: block numbers are shifted by the blocks of the files before."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return metadata.withColumn("offset", F.coalesce(F.sum(count).over(w), F.lit(0)))


def compact(catalog: Catalog, index: SearchIndex, threshold: int = BINPACK_ROWS) -> list[str]:
    """Merge groups of small indexes; a new one comes and the old ones go in one version of the metadata, so a crash leaves unnamed files at most."""
    from .search import index_tables

    small = small_indexes(catalog.indexes(index.name, index.column), threshold).orderBy("index_timestamp", "index_id").collect()
    by_id = {r.index_id: r for r in small}
    made = []
    for group in pack_files([(r.index_id, sum(r.record_counts)) for r in small], threshold):
        if len(group) < 2:
            continue
        ids, new = [i for i, _ in group], catalog.fresh_id()
        catalog.write({t: rows.withColumn("index_id", F.lit(new)) for t, rows in index.merge(index_tables(catalog, index, ids)).items()})
        files = {f: n for i in ids for f, n in zip(by_id[i].file_path, by_id[i].record_counts)}
        catalog.commit(index.name, index.column, [(new, list(files), list(files.values()))], drop=ids)
        made.append(new)
    return made


def vacuum(lake: L.Lake, catalog: Catalog, index: SearchIndex, since=None, older_than: float = 3600) -> tuple[list[str], list[str]]:
    """Drop metadata of indexes that a greedy cover of the retained files doesn't need, then index folders that nothing names and that are older than the guard.

    Returns the ids dropped from the metadata, and the folders deleted. The guard must be longer than any build.
    """
    metadata = catalog.indexes(index.name, index.column)
    keep = set(greedy_cover(metadata, lake.retained(since)))
    dropped = sorted(r.index_id for r in metadata.select("index_id").collect() if r.index_id not in keep)
    if dropped:
        catalog.replace(dropped)
    named = {r.index_id for r in catalog.indexes().select("index_id").collect()}
    orphans = sorted(catalog.index_files(older_than) - named)
    for index_id in orphans:
        catalog.drop_files(index_id)
    return dropped, orphans
