"""Files, folders and atomically swapped tables on any Hadoop file system."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has set; where neither is (tests), and all runs on this machine, one of our own."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/lakeseek-work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as ``list_files`` names it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def list_files(spark: SparkSession, path: str, older_than: float | None = None, suffix: str = "") -> list[str]:
    """Files under a folder, sorted; with ``older_than`` only those not changed for so many seconds."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out, files = [], fs.listFiles(p, True)
    limit = (datetime.now(timezone.utc) - timedelta(seconds=older_than)).timestamp() * 1000 if older_than is not None else None
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if name.startswith(("_", ".")) or not name.endswith(suffix):
            continue
        if limit is None or status.getModificationTime() <= limit:
            out.append(status.getPath().toString())
    return sorted(out)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, size, modified)`` of the files under a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Taken(Exception):
    """Another writer has made the file first."""


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Write a small file as a whole: another is written and renamed. With ``replace`` a reader sees the old or the new one; without it, ``Taken`` is raised if there is one."""
    _, p = _fs(spark, path)
    _, new = _fs(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.valueOf("OVERWRITE" if replace else "NONE")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(new), fs.makeQualified(p), options)
    except Exception as e:
        fs.delete(new, False)
        if not replace and fs.exists(p):
            raise Taken(path) from e
        raise


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


class VersionedTable:
    """A small Parquet table of which each commit is a new folder, and a file ``versions/<n>`` that names it.

    A version's file is made by a rename that fails where there is one, so of two writers of one version the second finds out, and does its change
    again to what the first has left. A reader sees the last version that is named, whole; a crash leaves an unnamed folder at most.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        fs, p = _fs(self.spark, f"{self.path}/versions")
        if not fs.exists(p):
            return 0
        return max((int(n) for s in fs.listStatus(p) if (n := s.getPath().getName()).isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{read_text(self.spark, f'{self.path}/versions/{version}')}")

    def update(self, change) -> int:
        """Commit what ``change`` makes of the current rows; it is called again if another writer comes first."""
        while True:
            now = self.version()
            folder = f"rows-{uuid.uuid4().hex}"
            change(self.read(now)).coalesce(1).write.parquet(f"{self.path}/{folder}")
            try:
                write_text(self.spark, f"{self.path}/versions/{now + 1}", folder, replace=False)
                return now + 1
            except Taken:
                delete(self.spark, f"{self.path}/{folder}")

    def replace(self, rows: DataFrame) -> int:
        return self.update(lambda _: rows)

    def append(self, rows: DataFrame) -> int:
        return self.update(lambda now: now.unionByName(rows))
