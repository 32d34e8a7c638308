"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole store in one table, as it was written: its chunks, recipes and manifest, each verified."""
    from .token_store import token_store, verify

    store = verify(token_store(_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("long")
    chunks = store.chunks.select(F.lit("chunk").alias("kind"), none.alias("doc_id"), "digest", "n_tokens", F.lit(1).cast("long").alias("n_chunks"), "payload", "verified")
    recipes = store.recipes.select(F.lit("recipe").alias("kind"), F.col("id").alias("doc_id"), "digest", "n_tokens", "n_chunks", "payload", "verified")
    manifest = store.manifest.select(F.lit("manifest").alias("kind"), none.alias("doc_id"), "digest", "n_tokens", none.alias("n_chunks"), "payload", "verified")
    return chunks.unionByName(recipes).unionByName(manifest)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_format

    return chat_format(_table(spark, sf_dir, "conversations"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_removed")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    from .license_templates import TEMPLATES
    from .licenses import CONTAINMENT

    values = ",\n".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    return f"""
        WITH template(license, body) AS (VALUES {values}),
        tw AS (SELECT license, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM template),
        ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM tw),
        size AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
        dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
        ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM dw),
        hit AS (SELECT doc_id, license, count(*) AS n_shared FROM ds JOIN ts USING (shingle) GROUP BY doc_id, license)
        SELECT doc_id, license, n_shared, CAST(n_shared AS DOUBLE) / n AS containment
        FROM hit JOIN size USING (license)
        WHERE n_shared >= ceil(round({CONTAINMENT} * n, 9))
    """


_SQL = {
    "op4_ngram_jaccard_join": """
        WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        ds AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS grams
               FROM dw WHERE len(w) > 0),
        sets AS (SELECT count(DISTINCT doc_id) AS n_docs, min(doc_id) AS least, grams, row_number() OVER () AS s FROM ds WHERE doc_id IS NOT NULL GROUP BY grams),
        g AS (SELECT s, unnest(grams) AS gram FROM sets),
        common AS (SELECT x.s AS a, y.s AS b, count(*) AS n FROM g x JOIN g y ON x.gram = y.gram AND x.s <> y.s GROUP BY x.s, y.s),
        near AS (SELECT a, b, r.n_docs FROM common JOIN sets l ON l.s = a JOIN sets r ON r.s = b
                 WHERE CAST(n AS DOUBLE) / (len(l.grams) + len(r.grams) - n) >= 0.6),
        reach AS (SELECT s AS a, s AS b FROM sets UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),
        class AS (SELECT a AS s, min(least) AS class_id FROM reach JOIN sets ON sets.s = reach.b GROUP BY a),
        links AS (SELECT a AS s, sum(n_docs) AS n FROM near GROUP BY a)
        SELECT DISTINCT doc_id, class_id, CAST(n_docs - 1 + coalesce(links.n, 0) AS BIGINT) AS n_links
        FROM ds JOIN sets USING (grams) JOIN class USING (s) LEFT JOIN links USING (s)
        UNION ALL
        SELECT DISTINCT doc_id, doc_id AS class_id, CAST(0 AS BIGINT) AS n_links FROM dw WHERE doc_id IS NOT NULL AND coalesce(len(w), 0) = 0
    """,
    "op5_decontaminate": """
        WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
        dg AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS p, w FROM dw WHERE len(w) >= 12),
        bg AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS q, w FROM bw WHERE len(w) >= 12),
        d AS (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS gram FROM dg),
        b AS (SELECT item_id, q, array_to_string(w[q:q + 11], ' ') AS gram FROM bg),
        hit AS (SELECT doc_id, item_id, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island
                FROM d JOIN b USING (gram))
        SELECT doc_id, item_id, min(p) - 1 AS doc_word, min(q) - 1 AS item_word, CAST(count(*) + 11 AS BIGINT) AS n_words
        FROM hit GROUP BY doc_id, item_id, p - q, island
    """,
    "op3_chat_format": """
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                          ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
        FROM conversations GROUP BY conv_id
    """,
}


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_token_store, op3_chat_format, op4_ngram_jaccard_join, op5_decontaminate, op6_quality_rules, op7_secret_scan, op8_line_dedup, op9_packing, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return _SQL | {"op10_license_scan": _license_sql()}
