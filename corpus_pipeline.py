"""A corpus pipeline: quality rules, line deduplication, near duplicates, decontamination, packing.

All stages take rows with nulls in any column, empty and very long texts, repeated rows and ids, empty tables, and further columns of any name;
each docstring says what becomes of them. All but the last return the columns that they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lakeseek.llm.kernels as K
from lakeseek.llm.decontaminate import decontaminate
from lakeseek.llm.jaccard import drop_near_duplicates
from lakeseek.llm.line_dedup import line_dedup
from lakeseek.llm.packing import pack_documents
from lakeseek.llm.quality import quality_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of calibrated quality 0.5 or more, the model trained on ``labels``.

    Cases: a null text, or one without letters and digits, has quality 0 and goes; a document without id is judged as any other; a
    quality of just 0.5 is kept; repeated rows are judged alike and stay as many; an empty table stays empty.
    """
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has.

    A document goes if it lost lines and has no text left, or if it is an earlier one in which a few words of some lines were changed: what would be left of
    it are just those lines, that no longer look like the copy that they are part of.

    Cases: null and empty texts lose nothing and stay; rows of the same id and text lose the same lines; those of one id and
    several texts are several documents; null ids go before all others; ``n_chars`` is counted again where lines went; an empty table stays empty.
    """
    count, copy = (K.fresh(docs.columns, c) for c in ("__removed_lines", "__edited_copy"))
    cleaned = line_dedup(docs, count=count, copy=copy)
    changed = F.col(count) > 0
    kept = cleaned.filter(~F.col(copy) & (~changed | (F.trim(F.col("text")) != "")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join, that of the least (id, hash of the text).

    Cases: of repeated rows (one id and text, nulls being equal) one stays; the texts of one id are judged each by itself; rows without id, text or words are similar to
    none; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of 12 words or more with an item of ``benchmark``.

    Cases: null and empty texts share nothing and stay, and so do all without any item; repeated rows are judged alike; ids, null or
    not, play no part; an empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of lexical neighbours: rows ``(pack_id, position, doc_id, first_word, n_words, seed_id)``.

    Cases: texts that are null or without words are in no window; rows without id, and repeated rows, are packed each; of equal scores the least
    id goes first; further columns are left out; an empty table gives no windows.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained model, patience alignment and greedy packing aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet to the shared folder and read again as the next one's input; what is no longer needed is deleted."""
    folder = K.shared_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            K.delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
