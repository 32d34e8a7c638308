"""Incremental indexing of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import SearchIndex
from ..plans.search import build_index
from ..sources.catalog import Catalog
from ..sources.lake import ParquetLake


def index_stream(spark: SparkSession, path: str, schema: str, catalog: Catalog, index: SearchIndex, checkpoint: str, row_threshold: int = 10_000, watch: str | None = None, **trigger) -> StreamingQuery:
    """Watch a folder (or what the pattern ``watch`` matches) and index its new files in micro-batches.

    The stream only says that there are new files; which ones are indexed is the
    anti join with the catalog, so a repeated batch does nothing twice.
    """

    def handle(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            build_index(ParquetLake(spark, path), catalog, index, row_threshold)

    arrivals = spark.readStream.schema(schema).parquet(watch or path)
    return arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
