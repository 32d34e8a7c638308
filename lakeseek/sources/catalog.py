"""Index metadata and index data: which files each index covers, and its tables."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import storage

METADATA = "index_id string, index_type string, column_name string, file_path array<string>, record_counts array<long>, rows_indexed long, index_timestamp timestamp"


class Catalog:
    """Indexes of one lake. ``<path>/data/<table>/index_id=<id>`` are Parquet folders; the metadata table's commit makes them visible."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.metadata = storage.VersionedTable(spark, f"{self.path}/metadata", METADATA)

    def indexes(self, index_type: str | None = None, column: str | None = None) -> DataFrame:
        rows = self.metadata.read()
        rows = rows.filter(F.col("index_type") == index_type) if index_type else rows
        return rows.filter(F.col("column_name") == column) if column else rows

    def covered(self, index_type: str, column: str) -> DataFrame:
        """``(file_path)`` of all files that some index covers."""
        return self.indexes(index_type, column).select(F.explode("file_path").alias("file_path")).distinct()

    def fresh_id(self) -> str:
        return f"i{uuid.uuid4().hex}"

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Write the tables of one or several new indexes, by ``index_id``; they aren't visible before ``commit``."""
        for name, rows in tables.items():
            kind = rows.drop("index_id").schema.json()
            if storage.read_text(self.spark, f"{self.path}/schemas/{name}") != kind:
                storage.write_text(self.spark, f"{self.path}/schemas/{name}", kind)
            rows.write.mode("append").partitionBy("index_id").parquet(f"{self.path}/data/{name}")

    def read(self, index_ids: list[str], table: str) -> DataFrame | None:
        """A table of several indexes, with the index_id of each row."""
        if not index_ids:
            return None
        kind = StructType.fromJson(json.loads(storage.read_text(self.spark, f"{self.path}/schemas/{table}"))).add("index_id", "string")
        base = f"{self.path}/data/{table}"
        paths = [p for i in index_ids if storage.exists(self.spark, p := f"{base}/index_id={i}")]
        return self.spark.read.schema(kind).option("basePath", base).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def commit(self, index_type: str, column: str, indexes: list[tuple[str, list[str], list[int]]], drop: list[str] = ()) -> None:
        """Make indexes ``(id, files, rows of each)`` visible and drop others, in one version of the metadata."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = self.spark.createDataFrame([(i, index_type, column, files, counts, sum(counts), now) for i, files, counts in indexes], METADATA)
        self.metadata.update(lambda old: old.filter(~F.col("index_id").isin(list(drop))).unionByName(rows))

    def replace(self, drop: list[str]) -> None:
        self.metadata.update(lambda old: old.filter(~F.col("index_id").isin(drop)))

    def index_files(self, older_than: float | None = None) -> set[str]:
        """Ids of indexes whose files haven't changed for so many seconds."""
        found = (f.rpartition("/")[0].rpartition("/index_id=")[2] for f in storage.list_files(self.spark, f"{self.path}/data", older_than) if "/index_id=" in f)
        return set(found)

    def drop_files(self, index_id: str) -> None:
        fs, p = storage._fs(self.spark, f"{self.path}/data/*/index_id={index_id}")
        for status in fs.globStatus(p) or []:
            fs.delete(status.getPath(), True)
