"""Log search: templates and typed variable tokens; a query goes to the tokens that may contain it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import workspace
from .base import SearchIndex, bucket, named

#: Distinct tokens from which a symbol-class type has a partition of its own, and lines from which a token counts as dictionary.
TYPE_TOKENS, DICTIONARY_LINES = 1000, 1000


def token_postings(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(mask, token, keys...)`` of the variables of each cleaned ``line``."""
    each = lines.select(*keys, F.explode(F.array_distinct(T.variables(T.clean_line(F.col("line"))))).alias("token"))
    return each.withColumn("mask", T.type_mask(F.col("token")).cast("int"))


def grouped_tokens(postings: DataFrame, key: str) -> DataFrame:
    """``(mask, token, lines)``: the sorted distinct lines of each token."""
    return postings.groupBy("mask", "token").agg(F.sort_array(F.collect_set(key)).alias("lines"))


def split_types(tokens: DataFrame, least: int = TYPE_TOKENS) -> DataFrame:
    """``(mask, n_tokens, own)``: which types are so large that they are kept apart."""
    return tokens.groupBy("mask").agg(F.count_distinct("token").alias("n_tokens")).withColumn("own", F.col("n_tokens") > least)


def merge_postings(groups: DataFrame) -> DataFrame:
    """``(mask, token, lines)`` of several groups as one: the union of each token's lines."""
    return groups.groupBy("mask", "token").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def templates(lines: DataFrame) -> DataFrame:
    """``(template, n_lines)``."""
    return lines.select(T.template(T.clean_line(F.col("line"))).alias("template")).filter("template IS NOT NULL").groupBy("template").agg(F.count(F.lit(1)).alias("n_lines"))


def fill_timestamps(lines: DataFrame, order: str, ts: str, group: str | None = None) -> DataFrame:
    """Missing timestamps take that of the last line before that has one."""
    from pyspark.sql import Window

    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order)
    return lines.withColumn(ts, F.last(ts, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


class LogIndex(SearchIndex):
    """Templates, and variable tokens partitioned by type; a query of one word is looked up in both.

    Lines that the query matches as a regular expression are found; with ``exact``, those that have it as a word.
    """

    name, newest_first = "logs", True

    def __init__(self, column: str, stride: int = 1, type_tokens: int = TYPE_TOKENS, dictionary_lines: int = DICTIONARY_LINES, exact: bool = False, **options):
        super().__init__(column, **options)
        self.stride, self.type_tokens, self.dictionary_lines, self.exact = stride, type_tokens, dictionary_lines, exact

    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        rows = named(rows)
        lines = rows.withColumn("line", F.col(self.column))
        postings = token_postings(lines, ["index_id", "buckets", "file_path", "uid"])
        if self.stride > 1:
            postings = postings.distinct()  # a line's tokens are distinct already
        # A row for each distinct token decides on types and dictionary. Types are at most 64 for each index, and a token of the dictionary
        # stands for more than ``dictionary_lines`` postings: both go to the tasks, so that no task gets all postings of a type.
        path = workspace(rows.sparkSession, "tokens")
        self.scratch.append(path)
        postings.groupBy("index_id", "mask", "token").agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
        known = rows.sparkSession.read.parquet(path)
        types = known.groupBy("index_id", "mask").agg((F.count(F.lit(1)) > self.type_tokens).alias("own"))
        common = known.filter(F.col("n") > self.dictionary_lines).select("index_id", "token")
        rare = postings.join(F.broadcast(common), ["index_id", "token"], "left_anti")
        tagged = rare.join(F.broadcast(types), ["index_id", "mask"]).withColumn("mask", F.when(F.col("own"), F.col("mask")).otherwise(-1)).drop("own")
        template = lines.select("index_id", T.template(T.clean_line(F.col("line"))).alias("text")).filter("text IS NOT NULL").distinct()
        spread = tagged.withColumn("bucket", bucket("token")).repartition("index_id", "bucket").drop("bucket", "buckets")
        return {
            "tokens": spread.sortWithinPartitions("index_id", "mask", "token"),
            "dictionary": common.select("index_id", F.col("token").alias("text")).unionByName(template),
        }

    def candidates(self, tables: dict[str, DataFrame], query: str) -> DataFrame | None:
        """None (scan) if templates or the dictionary may hold the query, or it has several words; else blocks by token."""
        words = query.split()
        if len(words) != 1 or query != words[0] or not any(c.isdigit() for c in query) or any(c in r"\.^$*+?{}[]|()" for c in query):
            return None
        if not tables["dictionary"].filter(F.contains("text", F.lit(query))).isEmpty():
            return None
        mask = T.type_mask_of(query)
        masks = [mask] if self.exact else T.superset_masks(mask)
        found = tables["tokens"].filter(F.col("mask").isin([-1, *masks]))
        match = F.col("token") == query if self.exact else F.contains("token", F.lit(query))
        return found.filter(match).select("file_path", "uid").distinct()

    def verify(self, rows: DataFrame, query: str, k: int | None) -> DataFrame:
        line = F.col(self.column)
        found = rows.filter(F.array_contains(T.words(T.clean_line(line)), query) if self.exact else line.rlike(query))
        return found.orderBy(F.desc("file_path"), "row_index").limit(k) if k is not None else found

    def merge(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {"tokens": tables["tokens"].drop("index_id").distinct(), "dictionary": tables["dictionary"].select("text").distinct()}
