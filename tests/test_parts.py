"""Tables of several part files give what their SQL says, as those of one file do."""

import pytest

from compare import rows
from lakeseek.plans import registry
from lakeseek.sources import lake

SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """Tables in five files; the documents' blocks of 16 go over their ends, and ids follow the order of the files."""
    at = tmp_path_factory.mktemp("parts")
    for name, key in (("documents", "doc_id"), ("conversations", "conv_id"), ("embeddings", "vec_id")):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartitionByRange(5, key).sortWithinPartitions(key).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def parts_sql(parts):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{parts}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("key", ["A4_page_max_tf", "K2_bm25_pages", "A5_page_score", "A8_zone_map", "S2_read_pages", "S9_row_ranges", "W3_row_numbers"])
def test_blocks_go_through_parts(key, spark, parts, parts_sql):
    mine, theirs = QUERIES[key](spark, parts).toPandas(), parts_sql.execute(SQL[key]).fetchdf()
    assert rows(mine) == rows(theirs)


def test_ranges_over_buckets(spark):
    """Ranges longer than a bucket, that overlap, that end before they begin."""
    numbers = spark.range(5000).select(lake.F.lit("f").alias("file_path"), lake.F.col("id").alias("row_index"))
    ranges = spark.createDataFrame([("f", 10, 2500), ("f", 2400, 2600), ("f", 30, 20), ("g", 0, 9)], "file_path string, row_start long, row_end long")
    assert sorted(r.row_index for r in lake.read_ranges(numbers, ranges).collect()) == list(range(10, 2601))


@pytest.mark.parametrize("key", ["S5_layout", "W1_offsets", "T8_newest_logs", "T11_reverse_files"])
def test_files_of_parts(key, spark, sf_dir, duck, monkeypatch):
    """No task writes a whole file of the four, and rows and blocks are numbered through the parts."""
    written = []
    whole = registry._four_files
    monkeypatch.setattr(registry, "_four_files", lambda *a: written.append(whole(*a)) or written[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        mine = QUERIES[key](spark, sf_dir).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows(mine) == rows(duck.execute(SQL[key]).fetchdf())
    assert len(registry.storage.list_files(spark, written[0], suffix=".parquet")) >= 16


def test_log_index_has_no_task_for_a_type(spark, tmp_path):
    """Types and common tokens are sent to the postings, which aren't exchanged by type; what the index says is as before."""
    from lakeseek.operators import logs

    lines = [(f"i{k % 2}", 2, "f", k, f"got a{k} b1 b1 C{k // 20} at 7") for k in range(80)]
    rows = spark.createDataFrame(lines, "index_id string, buckets int, file_path string, uid long, line string")
    made = logs.LogIndex("line", type_tokens=5, dictionary_lines=20).build(rows)
    # Of the 40 lines of an index, b1 and 7 are in all, each C in ten, each a in one. Tokens a are of one type, and more than five.
    assert {(r.index_id, r.token, r.mask, r.uid) for r in made["tokens"].collect()} == {x for k in range(80) for x in ((f"i{k % 2}", f"a{k}", 5, k), (f"i{k % 2}", f"C{k // 20}", -1, k))}
    assert {tuple(r) for r in made["dictionary"].collect()} == {(i, t) for i in ("i0", "i1") for t in ("b1", "7", "got <*> <*> <*> <*> at <*>")}
    plan = made["tokens"]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
