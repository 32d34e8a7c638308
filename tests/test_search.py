"""Indexed search gives what a scan gives, whatever the state of the indexes."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeseek.functions import ngrams, text
from lakeseek.operators import bm25, graph, logs, substring, uuid_key, vector
from lakeseek.plans import maintain, search
from lakeseek.sources import lake, storage
from lakeseek.sources.catalog import Catalog


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    """Four files of documents, with keys and log lines, and rows of nulls and empty texts."""
    at = tmp_path_factory.mktemp("lake")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("key", F.md5(F.col("doc_id").cast("string"))).withColumn("line", F.concat(F.lit("got user="), "doc_id", F.lit(" from "), "source"))
    docs = docs.unionByName(spark.createDataFrame([(9000, None, None, None), (9001, "", None, "x")], "doc_id long, text string, key string, line string"), allowMissingColumns=True)
    out = []
    for k in range(4):
        docs.filter(F.col("doc_id") % 4 == k).coalesce(1).write.parquet(f"{at}/{k}")
        out += storage.list_files(spark, f"file://{at}/{k}", suffix=".parquet")
    return out


def _ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


@pytest.mark.parametrize(
    "index, query",
    [
        (substring.SubstringIndex("text"), "the of"),
        (substring.SubstringIndex("text"), "no such words here"),
        (substring.SubstringIndex("text"), "a"),
        (substring.TokenSubstringIndex("text"), "the of and"),
        (substring.TokenSubstringIndex("text", stride=8), "the of"),
        (uuid_key.UuidIndex("key"), "e45f"),
        (uuid_key.UuidIndex("key", anchored=True), "8f14"),
        (uuid_key.UuidIndex("key"), "8f14e45fceea167a5a36dedd4bea2543"),
        (logs.LogIndex("line"), "user=12"),
        (logs.LogIndex("line"), "from"),
        (logs.LogIndex("line", exact=True), "user=12"),
        (logs.LogIndex("line", exact=True, dictionary_lines=1), "user=1"),
    ],
)
def test_indexed_is_scan(spark, files, tmp_path, index, query):
    """With a part indexed, all indexed, after compaction, and after vacuum."""
    table = lake.ManifestLake(spark, f"file://{tmp_path}/lake")
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    everything = lake.scan(spark, files, "doc_id", index.column)
    want = _ids(index.verify(everything, query, None))
    table.commit(files[:2], datetime(2024, 1, 1))
    assert len(search.build_index(table, catalog, index, row_threshold=1)) == 2
    table.commit(files, datetime(2024, 1, 2))
    assert _ids(search.search(table, catalog, index, query, None, ("doc_id",))) == want
    search.build_index(table, catalog, index)
    assert search.build_index(table, catalog, index) == []
    assert _ids(search.search(table, catalog, index, query, None, ("doc_id",))) == want
    made = maintain.compact(catalog, index, 1 << 40)
    assert len(made) == 1 and catalog.indexes().count() == 1
    assert _ids(search.search(table, catalog, index, query, None, ("doc_id",))) == want
    dropped, orphans = maintain.vacuum(table, catalog, index, older_than=0)
    assert dropped == [] and len(orphans) >= 3
    assert _ids(search.search(table, catalog, index, query, None, ("doc_id",))) == want
    table.commit(files[:1], datetime(2024, 1, 3))
    live = _ids(index.verify(lake.scan(spark, files[:1], "doc_id", index.column), query, None))
    assert _ids(search.search(table, catalog, index, query, None, ("doc_id",))) == live
    k = min(1, len(live))
    assert search.search(table, catalog, index, query, k, ("doc_id",)).count() == k


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vectors_through_the_life_of_indexes(spark, sf_dir, tmp_path, metric):
    """Several indexes of several files: recall of 0.9 with the usual probes, exact with all, the same after compaction and vacuum."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    points.withColumn("f", F.col("vec_id") % 3).repartition(3, "f").write.partitionBy("f").parquet(f"file://{tmp_path}/points")
    files = storage.list_files(spark, f"file://{tmp_path}/points", suffix=".parquet")
    table, catalog = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog")
    usual = vector.IvfPqIndex("embedding", rows_per_centroid=20, metric=metric)
    every = vector.IvfPqIndex("embedding", probes=1 << 30, refine=1 << 30, brute_force_threshold=1 << 30, metric=metric)
    queries = [(r.vec_id, list(r.embedding)) for r in points.orderBy("vec_id").limit(3).collect()]
    scan = lake.scan(spark, files, "vec_id", "embedding")
    truth = {q: [(r.vec_id, r.distance) for r in usual.verify(scan, v, 10).collect()] for q, v in queries}

    def holds():
        near = exact = 0
        for q, v in queries:
            found = {r.vec_id for r in search.search(table, catalog, usual, v, 10, ("vec_id",)).collect()}
            near += len(found & {i for i, _ in truth[q]})
        for q, v in queries[:1]:
            exact += [(r.vec_id, r.distance) for r in search.search(table, catalog, every, v, 10, ("vec_id",)).collect()] == truth[q]
        return near >= 0.9 * 30 and exact == 1

    table.commit(files[:2], datetime(2024, 1, 1))
    assert len(search.build_index(table, catalog, usual, row_threshold=1)) == 2
    table.commit(files, datetime(2024, 1, 2))
    assert holds()
    search.build_index(table, catalog, usual)
    assert catalog.indexes().count() == 3 and holds()
    assert len(maintain.compact(catalog, usual, 1 << 40)) == 1 and holds()
    maintain.vacuum(table, catalog, usual, older_than=0)
    assert catalog.indexes().count() == 1 and holds()


def test_logs_stop_at_the_newest_files(spark, files, tmp_path):
    """A scan for k rows gives those of the last files, as one over all files does."""
    table, catalog, index = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog"), logs.LogIndex("line")
    table.commit(files, datetime(2024, 1, 1))
    rows = lake.scan(spark, files, "doc_id", "line")
    for k in (1, 5, 10_000):
        want = [r.doc_id for r in index.verify(rows, "from src1", k).collect()]
        assert [r.doc_id for r in search.search(table, catalog, index, "from src1", k, ("doc_id",)).collect()] == want


def test_versions_are_exclusive(spark, tmp_path):
    """Of two writers of one version one does its change again; nothing is lost, and a reader always finds the last whole version."""
    table = storage.VersionedTable(spark, f"file://{tmp_path}/t", "n long")
    other = storage.VersionedTable(spark, f"file://{tmp_path}/t", "n long")
    row = lambda n: spark.createDataFrame([(n,)], "n long")
    table.append(row(1))
    calls = []

    def slow(now):
        calls.append(table.version())
        if len(calls) == 1:
            other.append(row(2))  # another writer comes in between
        return now.unionByName(row(3))

    assert table.update(slow) == 3 and calls == [1, 2]
    assert sorted(r.n for r in table.read().collect()) == [1, 2, 3] and sorted(r.n for r in table.read(1).collect()) == [1]

    def crash(now):
        raise RuntimeError("crash")

    with pytest.raises(RuntimeError):
        table.update(crash)
    row(9).write.parquet(f"file://{tmp_path}/t/rows-left-behind")  # a crash after the rows were written
    assert table.version() == 3 and sorted(r.n for r in other.read().collect()) == [1, 2, 3]
    with pytest.raises(storage.Taken):
        storage.write_text(spark, f"file://{tmp_path}/t/versions/3", "x", replace=False)
    storage.write_text(spark, f"file://{tmp_path}/text", "a")
    storage.write_text(spark, f"file://{tmp_path}/text", "b")
    assert storage.read_text(spark, f"file://{tmp_path}/text") == "b"
    assert [f for f in (tmp_path / "t").iterdir() if f.name.startswith(".") and "crc" not in f.name] == []


def test_one_build_for_all_groups(spark, files, tmp_path):
    """Groups of files are indexed in one pass and one commit, and give what indexes built one by one do."""
    index = bm25.Bm25Index("text")
    together, apart = Catalog(spark, f"file://{tmp_path}/together"), Catalog(spark, f"file://{tmp_path}/apart")
    table = lake.ManifestLake(spark, f"file://{tmp_path}/lake")
    table.commit(files, datetime(2024, 1, 1))
    ids = search.build_index(table, together, index, row_threshold=1)
    assert len(ids) == 4 and together.metadata.version() == 1
    for k in range(4):
        single = lake.ManifestLake(spark, f"file://{tmp_path}/lake{k}")
        single.commit(files[k : k + 1], datetime(2024, 1, 1))
        search.build_index(single, apart, index)
    rows = lambda catalog, name: sorted(tuple(r) for r in catalog.read([r.index_id for r in catalog.indexes().collect()], name).drop("index_id").collect())
    for name in ("postings", "frequencies", "stats"):
        assert rows(together, name) == rows(apart, name)


def test_expanded_search(spark, files, tmp_path):
    """A query is expanded by the vocabulary of indexes and of files without one, by keyword and by embedding."""
    table, catalog, index = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog"), bm25.Bm25Index("text")
    table.commit(files[:2], datetime(2024, 1, 1))
    search.build_index(table, catalog, index)
    table.commit(files, datetime(2024, 1, 2))
    rows = lake.scan(spark, files, "doc_id", "text")
    vocabulary = rows.select(F.explode(index.tokens(F.col("text"))).alias("term")).distinct()
    weights = {r.term: float(r.weight) for r in bm25.keyword_expansion(vocabulary, "withand").collect()}
    assert {"with", "and"} <= set(weights)
    want = bm25.rank_rows(rows, ["file_path", "row_index"], index.tokens(F.col("text")), weights, 10).collect()
    got = search.search(table, catalog, index, "withand", 10, expand=bm25.keyword_expansion).collect()
    assert sorted(r.score for r in got) == sorted(r.score for r in want) and want
    letters = lambda texts: [[t.count(c) + 0.01 for c in "abcdefghij"] for t in texts]
    expand = bm25.EmbeddingExpansion(letters, 3, f"file://{tmp_path}/vectors")
    first = [r.score for r in search.search(table, catalog, index, "bad face", 5, expand=expand).collect()]
    assert first and first == [r.score for r in search.search(table, catalog, index, "bad face", 5, expand=expand).collect()]


def test_tokenizer_files(spark, files, tmp_path):
    """Words by a tokenizer's file, in the index and in search."""
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    own = Tokenizer(WordLevel({"the": 0, "and": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = Whitespace()
    own.save(f"{tmp_path}/own.json")
    table, catalog = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog")
    table.commit(files, datetime(2024, 1, 1))
    index = bm25.Bm25Index("text", tokenizer=f"{tmp_path}/own.json")
    search.build_index(table, catalog, index)
    assert {r.term for r in catalog.read([r.index_id for r in catalog.indexes().collect()], "frequencies").collect()} == {"the", "and", "?"}
    found = search.search(table, catalog, index, "and", 5, ("doc_id",)).collect()
    assert len(found) == 5 and all("and" in r.text.lower() for r in found)


def test_ranked_search_includes_the_tail(spark, files, tmp_path):
    table, catalog, index = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog"), bm25.Bm25Index("text")
    table.commit(files[:2], datetime(2024, 1, 1))
    search.build_index(table, catalog, index)
    table.commit(files, datetime(2024, 1, 2))
    found = search.search(table, catalog, index, "the with and", 15, ("doc_id",)).select("doc_id", "score").toPandas()
    rows = lake.scan(spark, files, "doc_id", "text")
    want = bm25.rank_rows(rows, ["file_path", "row_index"], index.tokens(F.col("text")), "the with and", 15)
    want = want.join(rows, ["file_path", "row_index"]).select("doc_id", "score").toPandas()
    assert sorted(map(tuple, found.values)) == sorted(map(tuple, want.values))


def test_deletes_and_other_tokenizers_are_refused(spark, files, tmp_path):
    table, catalog = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog")
    table.commit(files, datetime(2024, 1, 1), content=1)
    with pytest.raises(ValueError):
        search.search(table, catalog, substring.SubstringIndex("text"), "the", 5)
    table.commit(files, datetime(2024, 1, 2))
    search.build_index(table, catalog, bm25.Bm25Index("text", tokenizer=r"\S+"))
    with pytest.raises(ValueError):
        search.search(table, catalog, bm25.Bm25Index("text"), "the", 5)


def test_vacuum_drops_dead_indexes(spark, files, tmp_path):
    table, catalog, index = lake.ManifestLake(spark, f"file://{tmp_path}/lake"), Catalog(spark, f"file://{tmp_path}/catalog"), uuid_key.UuidIndex("key")
    table.commit(files[:2], datetime(2024, 1, 1))
    search.build_index(table, catalog, index, row_threshold=1)
    table.commit(files[:1], datetime(2024, 1, 2))
    assert maintain.vacuum(table, catalog, index, datetime(2023, 1, 1), older_than=3600) == ([], [])
    dropped, orphans = maintain.vacuum(table, catalog, index, datetime(2024, 1, 1, 12), older_than=0)
    assert len(dropped) == 1 and orphans == dropped


def test_vector_recall(spark, sf_dir, tmp_path):
    """Inverted lists and graphs find 9 of 10 true neighbours over many queries."""
    source = lake.ParquetLake(spark, f"{sf_dir}/embeddings.parquet")
    catalog, index = Catalog(spark, f"file://{tmp_path}/catalog"), vector.IvfPqIndex("embedding", rows_per_centroid=50, probes=8)
    search.build_index(source, catalog, index)
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = [(r.id, list(r.vector)) for r in points.orderBy("id").limit(10).collect()]
    truth = {(r.q, r.id) for r in vector.knn_join(points.withColumnRenamed("id", "q").filter("q < 10"), points, 10).collect()}
    near = {(q, r.vec_id) for q, v in queries for r in search.search(source, catalog, index, v, 10, ("vec_id",)).collect()}
    assert len(near & truth) >= 0.9 * len(truth)
    walked = {(r.q, r.id) for r in graph.graph_search(graph.graph_build(points, rows_per_partition=100), queries, 10).collect()}
    assert len(walked & truth) >= 0.9 * len(truth)


def test_phases_are_all_items(spark):
    frame = spark.createDataFrame([([*range(10)],)], "x array<int>")
    assert frame.select(text.phases(F.col("x"), 3)).first()[0] == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]


def test_expansion_by_embedding(spark):
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "term string, embedding array<double>")
    assert [r.term for r in bm25.embedding_expansion(words, [1.0, 0.1], 2).collect()] == ["a", "c"]


def test_merge_keeps_offsets(spark, tmp_path):
    """Three shards; 'd' stands in one row of the first, 'f' in one of the first and one of the third."""
    shards = [["a", "d", "h", "z", "f"], ["b", "e"], ["c", "f"]]
    catalog, index, paths = Catalog(spark, f"file://{tmp_path}/catalog"), bm25.Bm25Index("text", stride=1), []
    for k, words in enumerate(shards):
        spark.createDataFrame([(10 * k + n, w) for n, w in enumerate(words)], "n long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/lake/{k}")
    table = lake.ParquetLake(spark, f"file://{tmp_path}/lake")
    search.build_index(table, catalog, index, row_threshold=1)
    assert len(maintain.compact(catalog, index)) == 1
    for query, want in (("d", [1]), ("f", [4, 21])):
        assert sorted(r.n for r in search.search(table, catalog, index, query, 10, ("n",)).collect()) == want


@given(st.lists(st.integers(1, 30), max_size=40), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_bin_packing(sizes, threshold):
    groups = maintain.pack_files([(str(k), n) for k, n in enumerate(sizes)], threshold)
    assert [x for g in groups for x in g] == [(str(k), n) for k, n in enumerate(sizes)]
    assert all(len(g) == 1 or sum(n for _, n in g) <= threshold for g in groups)
    assert all(sum(n for _, n in a) + b[0][1] > threshold for a, b in zip(groups, groups[1:]))


@given(st.text(alphabet="abAB .,-ü中", min_size=0, max_size=30), st.integers(0, 29), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_grams_of_a_part_are_grams_of_the_whole(whole, at, n):
    part = whole[at : at + n]
    assert set(ngrams.query_codes(text.normalise_query(part))) <= set(ngrams.query_codes(text.normalise_query(whole)))


@given(st.text(alphabet="09AFafGZgz-é", min_size=1, max_size=12), st.integers(0, 11), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_type_mask_of_a_part_is_covered(whole, at, n):
    assert text.type_mask_of(whole) in text.superset_masks(text.type_mask_of(whole[at : at + n]))


def test_vectors_of_other_lengths_and_nulls(spark):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [3.0, 1.0]), (4, [0.0, 1.0])], "id long, vector array<float>")
    assert [(r.id, r.distance) for r in vector.knn_scan(points, "vector", [0.0, 1.0], 5, ["id"]).collect()] == [(1, 0.0), (4, 0.0), (3, 3.0)]
    assert vector.medoid(points.limit(0)).count() == 0
    assert np.allclose(sorted(vector.kmeans(points, 2)), [[0, 1], [3, 1]])
