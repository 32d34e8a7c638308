"""Packed lists of rows give back what was put in, whatever the numbers and however tasks cut them."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeseek.functions import ngrams, postings
from lakeseek.operators import substring

NUMBERS = st.lists(st.one_of(st.integers(0, 300), st.integers(0, 1 << 62)), min_size=1, max_size=40, unique=True).map(sorted)


@given(st.lists(NUMBERS, min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_lists_round_trip(lists):
    n = np.array([len(x) for x in lists])
    flat, count = postings._unpacked(postings._packed(np.array(sum(lists, []), np.int64), np.cumsum(n) - n))
    assert flat.tolist() == sum(lists, []) and count.tolist() == n.tolist()


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
@pytest.mark.parametrize("far", [0, 1 << 40])
def test_index_has_every_gram(spark, monkeypatch, held, far):
    """Rows of several indexes and files, of a block that several lists share, short and empty ones."""
    monkeypatch.setattr(postings, "HELD", held)
    texts = ["abcabc", "", "ab", "xabcx", "日本語日本語", "😀😀😀abc", None]
    rows = [(f"i{k % 2}", 3, f"f{k % 3}", k // 8 + far * (k > 30), texts[k % 7]) for k in range(60)]
    made = substring.SubstringIndex("text", 8).build(spark.createDataFrame(rows, "index_id string, buckets int, file_path string, uid long, text string"))["postings"]
    want = {(i, g, f, u) for i, _, f, u, t in rows for g in ngrams.query_codes(t or "")}
    assert {tuple(r) for r in postings.unpacked(made, ["index_id", "gram", "file_path"]).collect()} == want


def test_exchanged_lists_are_few(spark):
    """A thousand equal rows have a list for each gram of a task, not a thousand."""
    rows = spark.range(0, 1000, 1, 1).selectExpr("'f' AS file_path", "id AS uid", "'the quick brown fox' AS text")
    assert substring.SubstringIndex("text").build(rows)["postings"].count() == len(ngrams.query_codes("thequickbrownfox"))
    assert substring.TokenSubstringIndex("text").build(rows)["postings"].count() == 7


def test_buckets_bound_the_files(spark, tmp_path):
    """Of many small indexes each has one file, not one from each task."""
    rows = spark.range(0, 200, 1, 4).selectExpr("concat('i', id % 20) AS index_id", "1 AS buckets", "concat('f', id % 20) AS file_path", "id AS uid", "concat('some words ', id) AS text")
    substring.SubstringIndex("text").build(rows)["postings"].write.partitionBy("index_id").parquet(f"{tmp_path}/p")
    assert len(list(tmp_path.glob("p/*/*.parquet"))) == 20
