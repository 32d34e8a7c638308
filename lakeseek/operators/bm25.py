"""Full-text search by BM25: block postings prune, corpus-wide row scores rank."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counts as C
from ..functions import scoring as S
from ..functions import text as T
from ..sources.storage import workspace
from .base import SearchIndex, bucket, named


def term_frequencies(docs: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """``(keys, term, tf, length)`` of each document that has words."""
    each = docs.select(*keys, tokens.alias("words")).withColumn("length", F.size("words").cast("long"))
    return each.select(*keys, "length", F.explode("words").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """``(term, df)``; the terms of one document are distinct in ``tf``."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """``(n_docs, avgdl)`` in one row."""
    return docs.select(F.size(tokens).alias("n")).filter("n >= 0").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avgdl"))


def weights(query: str | dict[str, float]) -> dict[str, float]:
    """Weight of each query term; a repeated word counts as often as it stands there."""
    if isinstance(query, dict):
        return query
    out: dict[str, float] = {}
    for word in T.query_tokens(query):
        out[word] = out.get(word, 0.0) + 1.0
    return out


def keyword_expansion(vocabulary: DataFrame, query: str) -> DataFrame:
    """``(term, weight)``: the vocabulary's terms that stand in the query, by how often they do."""
    return vocabulary.filter(F.contains(F.lit(query), F.col("term"))).select("term", T.occurrences(query, F.col("term")).alias("weight"))


def embedding_expansion(vocabulary: DataFrame, query_vector: list[float], n: int = 20) -> DataFrame:
    """``(term, weight)``: the n terms whose ``embedding`` has the greatest cosine similarity to the query's."""
    from ..functions.vectors import cosine

    return vocabulary.select("term", cosine(F.col("embedding"), query_vector).alias("weight")).orderBy(F.desc("weight"), "term").limit(n)


class EmbeddingExpansion:
    """Expands a query by the n terms of the vocabulary that are most like it, by ``embed``: a function from a list of texts to vectors.

    The terms' vectors are made where the vocabulary is, and kept as a table at ``cache`` if it is named.
    """

    def __init__(self, embed, n: int = 20, cache: str | None = None):
        self.embed, self.n, self.cache = embed, n, cache

    def __call__(self, vocabulary: DataFrame, query: str) -> DataFrame:
        from ..sources import storage

        embed, spark = self.embed, vocabulary.sparkSession

        def vectors(terms: pa.Array) -> pa.Array:
            return pa.array([[float(x) for x in v] for v in embed(terms.to_pylist())], pa.list_(pa.float64()))

        known = vocabulary.select("term").distinct().withColumn("embedding", F.arrow_udf(vectors, "array<double>")("term"))
        if self.cache:
            if not storage.exists(spark, f"{self.cache}/_SUCCESS"):
                known.write.mode("overwrite").parquet(self.cache)
            known = spark.read.parquet(self.cache)
        return embedding_expansion(known, [float(x) for x in embed([query])[0]], self.n)


def rank_rows(docs: DataFrame, keys: list[str], tokens: Column, query: str | dict[str, float], k: int | None, stats: DataFrame | None = None) -> DataFrame:
    """``(keys, score)`` of the rows with a query term, by corpus-wide BM25; the best k, ties by key.

    One pass tokenises; only the query's terms are exploded, so the aggregation's input is small
    whatever the vocabulary.
    """
    weight = weights(query)
    if not weight:
        return docs.select(*keys).limit(0).withColumn("score", F.lit(0.0))
    wanted = F.array(*(F.lit(t) for t in weight))
    each = docs.select(*keys, tokens.alias("words")).filter("words IS NOT NULL")
    each = each.select(*keys, F.size("words").alias("length"), F.filter("words", lambda w: F.array_contains(wanted, w)).alias("hits"))
    stats = stats if stats is not None else each.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))
    tf = each.filter(F.size("hits") > 0).select(*keys, "length", F.explode("hits").alias("term")).groupBy(*keys, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    # As many rows as the query has terms, and one.
    df = F.broadcast(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    own = F.element_at(F.create_map(*(x for t, w in weight.items() for x in (F.lit(t), F.lit(float(w))))), F.col("term"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("s", S.idf(F.col("n_docs"), F.col("df"), own) * S.tf_factor(F.col("tf"), F.col("length"), F.col("avgdl")))
    out = scored.groupBy(*keys).agg(F.round(F.sum("s"), 6).alias("score"))
    return out.orderBy(F.desc("score"), *keys).limit(k) if k is not None else out


class Bm25Index(SearchIndex):
    """Postings (term, file, block, quantised greatest factor), document frequencies, and size and mean length of each indexed file group."""

    name, ranked = "bm25", True

    def __init__(self, column: str, stride: int = 16, quality: float = 1.0, tokenizer: str = T.TOKEN, **options):
        super().__init__(column, **options)
        self.stride, self.quality, self.tokenizer = stride, quality, tokenizer

    def tokens(self, column: Column) -> Column:
        """Words by the tokenizer: a regular expression, or the path of a tokenizer's file (its tokens of the lower-cased text)."""
        if self.tokenizer.endswith(".json"):
            return T.file_tokens(F.lower(column), self.tokenizer)
        return F.regexp_extract_all(F.lower(column), F.lit(self.tokenizer), F.lit(0))

    def build(self, rows: DataFrame) -> dict[str, DataFrame]:
        """The texts are tokenised once, into a table of each row's distinct words in the shared folder, from which the index's three are made.

        What is exchanged are the terms of blocks, with a number for index and file; the list of files and a mean for each index come to the driver.
        """
        rows = named(rows)
        spark = rows.sparkSession
        words = rows.filter(F.col(self.column).isNotNull()).select("index_id", "buckets", "file_path", "uid", self.tokens(F.col(self.column)).alias("words"))
        path = workspace(spark, "terms")
        self.scratch.append(path)
        C.word_counts(words, ["index_id", "buckets", "file_path", "uid"]).write.parquet(path)
        made = spark.read.parquet(path)
        stats = made.groupBy("index_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avgdl"))
        mean = {r.index_id: r.avgdl for r in stats.collect()}
        files = made.select("index_id", "file_path", "buckets").distinct().collect()
        groups = {(r.index_id, r.file_path): k for k, r in enumerate(files)}
        numbers = {i: k for k, i in enumerate(mean)}
        # A few numbers go along with the terms; the names come back after the exchange.
        of = F.broadcast(spark.createDataFrame([(k, numbers[r.index_id], r.buckets) for k, r in enumerate(files)], "file int, number int, buckets int"))
        names = F.broadcast(spark.createDataFrame([(k, r.index_id, r.file_path) for k, r in enumerate(files)], "file int, index_id string, file_path string"))
        ids = F.broadcast(spark.createDataFrame([(k, i) for i, k in numbers.items()], "number int, index_id string"))
        at = lambda found: found.join(of, "file").withColumn("bucket", bucket("term")).repartition("number", "bucket")
        pages = at(C.block_scores(made, groups, [mean[r.index_id] for r in files])).groupBy("number", "bucket", "term", "file", "uid").agg(F.max("score").alias("score")).join(names, "file")
        df = at(C.row_counts(made, groups)).groupBy("number", "bucket", "term").agg(F.sum("df").alias("df")).join(ids, "number")
        return {
            "postings": pages.select("index_id", "term", "file_path", "uid", "score").sortWithinPartitions("index_id", "term"),
            "frequencies": df.select("index_id", "term", "df").sortWithinPartitions("index_id", "term"),
            "stats": stats.withColumn("tokenizer", F.lit(self.tokenizer)),
        }

    def page_scores(self, tables: dict[str, DataFrame], query: str | dict[str, float]) -> DataFrame:
        """``(file_path, uid, score)``: idf over all indexes, greatest factor of the block, summed over the query's terms."""
        weight = weights(query)
        self.check_tokenizers(tables["stats"])
        wanted = list(weight)
        total = tables["stats"].agg(F.sum("n_docs").alias("n_docs"))
        df = tables["frequencies"].filter(F.col("term").isin(wanted)).groupBy("term").agg(F.sum("df").alias("df"))
        own = F.create_map(*(x for t, w in weight.items() for x in (F.lit(t), F.lit(float(w))))) if weight else F.create_map()
        idf = df.crossJoin(F.broadcast(total)).select("term", S.idf(F.col("n_docs"), F.col("df"), F.element_at(own, F.col("term"))).alias("idf")) if weight else df.select("term", F.lit(0.0).alias("idf"))
        hits = tables["postings"].filter(F.col("term").isin(wanted)).join(F.broadcast(idf), "term")
        return hits.groupBy("file_path", "uid").agg(F.round(F.sum(F.col("idf") * F.col("score") / 100), 6).alias("score"))

    def check_tokenizers(self, stats: DataFrame) -> None:
        if {r.tokenizer for r in stats.select("tokenizer").distinct().collect()} - {self.tokenizer}:
            raise ValueError("these indexes were built with another tokenizer")

    def candidates(self, tables: dict[str, DataFrame], query) -> DataFrame | None:
        """All blocks with a query term, best first; ``quality`` below 1 keeps that share of k blocks for an approximate search."""
        return self.page_scores(tables, query)

    def top_pages(self, tables: dict[str, DataFrame], query, k: int) -> DataFrame:
        return self.page_scores(tables, query).orderBy(F.desc("score"), "file_path", "uid").limit(max(1, int(k * self.quality)))

    def verify(self, rows: DataFrame, query, k: int | None, stats: DataFrame | None = None) -> DataFrame:
        ranked = rank_rows(rows, ["file_path", "row_index"], self.tokens(F.col(self.column)), query, k, stats)
        return rows.join(ranked, ["file_path", "row_index"])

    def merge(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        self.check_tokenizers(tables["stats"])
        stats = tables["stats"].agg(F.sum("n_docs").alias("n_docs"), (F.sum(F.col("avgdl") * F.col("n_docs")) / F.sum("n_docs")).alias("avgdl"), F.first("tokenizer").alias("tokenizer"))
        return {
            "postings": tables["postings"].drop("index_id").repartition("term").sortWithinPartitions("term", "file_path", "uid"),
            "frequencies": tables["frequencies"].groupBy("term").agg(F.sum("df").alias("df")).sortWithinPartitions("term"),
            "stats": stats,
        }
