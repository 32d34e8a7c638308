"""The relational steps that index building and searching are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_pages(sidecar: DataFrame, candidates: DataFrame) -> DataFrame:
    """Locators of candidate blocks: inner join on (file_path, uid)."""
    return sidecar.join(candidates, ["file_path", "uid"])


def enrich(results: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """Results with what is known of their key, if anything."""
    return results.join(info, key, "left")


def exclusive_sum(rows: DataFrame, value: str, order: list[str], by: list[str], out: str) -> DataFrame:
    """Sum of the rows before, within groups; 0 for the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def first_per_group(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, by order."""
    least = F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order))
    return rows.groupBy(*by).agg(least.alias("r")).select(*by, "r.*")


def distinct_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct()


def symbol_counts(texts: DataFrame, column: str) -> DataFrame:
    """``(ch, n, before)``: symbols of all texts, and how many symbols sort before each (the C array)."""
    counts = texts.select(F.explode(F.split(F.col(column), "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    # As many rows as there are different symbols.
    return counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def previous_symbol(rows: DataFrame, by: str, order: str, symbol: str) -> DataFrame:
    """Each symbol with the one before it in the text."""
    return rows.withColumn("previous", F.lag(symbol).over(Window.partitionBy(by).orderBy(order)))


def sample_rows(rows: DataFrame, fraction: float, seed: int = 1) -> DataFrame:
    return rows.sample(fraction=fraction, seed=seed)


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, with probability by weight: the least of -ln(u) / w."""
    return rows.filter(F.col(weight) > 0).withColumn("__u", -F.log(F.rand(seed)) / F.col(weight)).orderBy("__u").limit(n).drop("__u")


def count_lost(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """``(lost)``: how many of the rows ``before`` aren't among those ``after``, doubles counted.

    Groups ``by`` some columns with as many rows and the same sums of two hashes of 64 bits are equal; only the others' rows are compared.
    """
    columns = before.columns

    def digests(rows: DataFrame) -> DataFrame:
        parts = [p for salt in (1, 2) for h in [F.xxhash64(F.lit(salt), *columns)] for p in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(f"p{k}") for k, p in enumerate(parts)))

    changed = F.broadcast(digests(before).exceptAll(digests(after)).select(*by))
    held = lambda rows: rows.select(*columns).join(changed, by, "left_semi").select(*columns)
    return held(before).exceptAll(held(after)).agg(F.count(F.lit(1)).alias("lost"))
