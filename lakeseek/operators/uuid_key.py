"""Key lookup: a table of key prefixes sorted by prefix prunes, containment decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import SearchIndex, named

PREFIX = 8


def shared_prefixes(keys: DataFrame, key: str = "key", buckets: int = 2) -> DataFrame:
    """``(key, lcp)``: how long a prefix each distinct key shares with the one before it in order.

    Keys are put into ranges by their first characters, within which a window compares
    neighbours; the last key of a range goes before the first of the next one that has keys.
    """
    parts = keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("range", F.substring(key, 1, buckets))
    before = F.lag(key).over(Window.partitionBy("range").orderBy(key))
    # One row for each range in the window over all.
    last = parts.groupBy("range").agg(F.max(key).alias("last")).withColumn("carried", F.lag("last").over(Window.orderBy("range"))).select("range", "carried")
    each = parts.withColumn("before", before).join(last, "range").withColumn("before", F.coalesce("before", "carried"))
    same = F.expr(f"CASE WHEN before IS NULL THEN 0 WHEN startswith({key}, before) THEN length(before) ELSE aggregate(sequence(1, greatest(1, least(length({key}), length(before)))), 0, (n, i) -> CASE WHEN n = i - 1 AND substring({key}, i, 1) = substring(before, i, 1) THEN i ELSE n END) END")
    return each.select(key, same.cast("long").alias("lcp"))


class UuidIndex(SearchIndex):
    """First characters of the lower-cased key -> block. Keys that contain the query are found, whatever the case.

    A query as long as the longest key can only be a whole key, and is looked up; a shorter one may stand inside a key, and is answered by a
    scan. With ``anchored`` only keys that start with the query are found, and all queries are looked up.
    """

    name = "uuid"

    def __init__(self, column: str, stride: int = 1, prefix: int = PREFIX, anchored: bool = False, **options):
        super().__init__(column, **options)
        self.stride, self.prefix, self.anchored = stride, prefix, anchored

    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        rows = named(rows)
        keys = rows.filter(F.col(self.column).isNotNull())
        each = keys.select("index_id", F.substring(F.lower(F.col(self.column)), 1, self.prefix).alias("prefix"), "file_path", "uid").distinct()
        return {
            "postings": each.repartitionByRange("index_id", "prefix").sortWithinPartitions("index_id", "prefix", "file_path", "uid"),
            "lengths": keys.groupBy("index_id").agg(F.max(F.length(self.column)).alias("longest")),
        }

    def candidates(self, tables: dict[str, DataFrame], query: str) -> DataFrame | None:
        key = query.lower()
        if len(key) < 2:
            return None
        if not self.anchored and (tables["lengths"].agg(F.max("longest")).first()[0] or 0) > len(key):
            return None
        match = F.col("prefix") == key[: self.prefix] if len(key) >= self.prefix else F.col("prefix").startswith(key)
        return tables["postings"].filter(match).select("file_path", "uid").distinct()

    def verify(self, rows: DataFrame, query: str, k: int | None) -> DataFrame:
        holds = F.startswith if self.anchored else F.contains
        found = rows.filter(holds(F.lower(F.col(self.column)), F.lit(query.lower())))
        return found.limit(k) if k is not None else found
