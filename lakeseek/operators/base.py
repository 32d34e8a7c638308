"""What a search index is: tables built from rows, candidates out of the tables, exact verification."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate blocks beyond which a scan is cheaper than reading them one by one.
BRUTE_FORCE_THRESHOLD = 1000


#: Rows of an index for which its tables have a bucket, which one task writes.
BUCKET_ROWS = 4096


def named(rows: DataFrame) -> DataFrame:
    """The rows with an ``index_id`` and the number of its ``buckets``; those that have none are one index's, in four buckets for each task of an exchange."""
    rows = rows if "index_id" in rows.columns else rows.withColumn("index_id", F.lit("one"))
    return rows if "buckets" in rows.columns else rows.withColumn("buckets", F.lit(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def bucket(key: str) -> Column:
    """Bucket of a row by its key. An exchange by index and bucket writes as many files as there are buckets, where one by key would write one for each index and task."""
    return F.pmod(F.xxhash64(key), F.col("buckets").cast("long")).cast("int")


class SearchIndex(ABC):
    """An index over one column. Rows are ``(index_id, file_path, row_index, uid, <column>)``: those of several indexes are built in one pass.

    ``candidates`` may give more blocks than match, never fewer; ``verify`` decides on the rows' own values.
    """

    name: str
    ranked = False
    stride = 1
    #: Whether ``verify`` prefers rows of the last files, so that a scan for k rows may stop at them.
    newest_first = False

    def __init__(self, column: str, brute_force_threshold: int = BRUTE_FORCE_THRESHOLD):
        self.column, self.brute_force_threshold = column, brute_force_threshold
        #: Folders that ``build`` has written besides the tables; they can go when these are stored.
        self.scratch: list[str] = []

    @abstractmethod
    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        """The tables by name, each with the ``index_id`` of its rows."""

    @abstractmethod
    def candidates(self, tables: dict[str, DataFrame], query) -> DataFrame | None:
        """``(file_path, uid)`` that may hold matches; None if the index can't answer this query."""

    @abstractmethod
    def verify(self, rows: DataFrame, query, k: int | None) -> DataFrame:
        """Rows that match (the best k of them, for a ranked index)."""

    def merge(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables of several indexes as one's; rows name their files, so a union is enough."""
        return {name: rows.drop("index_id") for name, rows in tables.items()}
