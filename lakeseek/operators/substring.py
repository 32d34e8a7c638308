"""Substring search: postings of character or token n-grams prune, containment decides."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ngrams as N
from ..functions import postings as P
from ..functions import text as T
from ..functions.counts import slices
from .base import SearchIndex, bucket, named


def substring_scan(rows: DataFrame, column: str, query: str, k: int | None = None) -> DataFrame:
    """Rows whose text contains the query, whatever the case."""
    found = rows.filter(T.contains_folded(F.col(column), query))
    return found.limit(k) if k is not None else found


def holding_all(postings: DataFrame, wanted: list[int]) -> DataFrame:
    """Blocks ``(file_path, uid)`` that hold each of the wanted keys; the filter reaches the scan of the sorted postings."""
    found = P.unpacked(postings.filter(F.col("gram").isin(wanted)), ["file_path", "gram"])
    return found.groupBy("file_path", "uid").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(set(wanted))).drop("n")


def _stored(rows: DataFrame, keys) -> DataFrame:
    """``(index_id, gram, file_path, uids)``: packed postings of the rows, by bucket of their index. Lists are made where the rows are, so that lists are exchanged and not their numbers."""
    lists = P.packed_postings(rows, ["index_id", "buckets", "file_path"], keys)
    spread = lists.withColumn("bucket", bucket("gram")).repartition("index_id", "bucket")
    return spread.sortWithinPartitions("index_id", "gram").select("index_id", "gram", "file_path", "uids")


def _row_hashes(batch: pa.RecordBatch):
    """Parts of the batch, their ``hashes``, and how many each row has."""
    for part in slices(batch, pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False), P.HELD // 4):
        yield part, part.column("hashes").flatten().to_numpy(zero_copy_only=False), pc.list_value_length(part.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)


class SubstringIndex(SearchIndex):
    """Distinct n-grams of the normalised text by block, as packed lists of blocks. Grams never span rows, as a match doesn't."""

    name = "substring"

    def __init__(self, column: str, stride: int = 1, gram: int = N.GRAM, **options):
        super().__init__(column, **options)
        self.stride, self.gram = stride, gram

    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        rows = named(rows)
        normal = rows.filter(F.col(self.column).isNotNull()).select("index_id", "buckets", "file_path", "uid", T.normalise(F.col(self.column)).alias("text"))
        return {"postings": _stored(normal, partial(N.row_grams, n=self.gram))}

    def candidates(self, tables: dict[str, DataFrame], query: str) -> DataFrame | None:
        wanted = N.query_codes(T.normalise_query(query), self.gram)
        return holding_all(tables["postings"], wanted) if wanted else None

    def verify(self, rows: DataFrame, query: str, k: int | None) -> DataFrame:
        return substring_scan(rows, self.column, query, k)


class TokenSubstringIndex(SearchIndex):
    """Distinct words, and pairs of consecutive words, by block, as hashes (one that clashes costs a block to verify); a query's inner words are whole words of any match, its first and last may be cut."""

    name = "substring_token"

    def __init__(self, column: str, stride: int = 1, **options):
        super().__init__(column, **options)
        self.stride = stride

    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        rows = named(rows)
        words = rows.filter(F.col(self.column).isNotNull()).select("index_id", "buckets", "file_path", "uid", T.tokens(F.col(self.column)).alias("words"))
        pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))).otherwise(F.array())
        hashes = words.select("index_id", "buckets", "file_path", "uid", F.concat(F.transform("words", lambda w: F.xxhash64(w)), pairs).alias("hashes"))
        return {"postings": _stored(hashes, _row_hashes)}

    def candidates(self, tables: dict[str, DataFrame], query: str) -> DataFrame | None:
        import regex

        found = list(regex.finditer(T.TOKEN, query.lower()))
        whole = [m.group() for m in found if m.start() > 0 and m.end() < len(query.lower())]
        # Consecutive words of the query are consecutive in a match.
        wanted = {f"{a} {b}" for a, b in zip(whole, whole[1:])} or set(whole)
        if not wanted:
            return None
        hashes = tables["postings"].sparkSession.range(1).select(*(F.xxhash64(F.lit(w)) for w in sorted(wanted))).first()
        return holding_all(tables["postings"], list(hashes))

    def verify(self, rows: DataFrame, query: str, k: int | None) -> DataFrame:
        return substring_scan(rows, self.column, query, k)


class RegexSearch:
    """Case-sensitive regular expression scan, newest file first."""

    def __init__(self, column: str):
        self.column = column

    def scan(self, rows: DataFrame, pattern: str, k: int | None = None) -> DataFrame:
        found = rows.filter(F.col(self.column).rlike(pattern))
        return found.orderBy(F.desc("file_path"), "row_index").limit(k) if k is not None else found
