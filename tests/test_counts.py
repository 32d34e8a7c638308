"""Word counts, blocks' scores and lost rows, against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeseek.functions import counts
from lakeseek.operators import bm25, relational

TEXTS = ["a b a", "", "b", "a a a a c", "...", "c b a b", "d"] * 3


@pytest.fixture(params=[1, 1 << 20])
def tables(spark, monkeypatch, request):
    monkeypatch.setattr(counts, "_WORDS", request.param)
    data = [("i" if k < 14 else "j", 3, f"f{k // 7}", k % 7 // 2, k, t) for k, t in enumerate(TEXTS)] + [("i", 3, "f0", 0, 99, None)]
    return bm25.Bm25Index("text", 2).build(spark.createDataFrame(data, "index_id string, buckets int, file_path string, uid long, row_index long, text string"))


def test_index_of_blocks(tables):
    """Blocks that are cut by batches and parts of batches are whole in the index."""
    want, df = {}, Counter()
    for index, ks in (("i", range(14)), ("j", range(14, 21))):
        found = {k: re.findall(r"\w+", TEXTS[k]) for k in ks}
        mean = sum(map(len, found.values())) / len(found)
        for k, ws in found.items():
            for w, n in Counter(ws).items():
                key = (index, w, f"f{k // 7}", k % 7 // 2)
                want[key] = max(want.get(key, 0), int(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) * 100))
                df[index, w] += 1
    assert {tuple(r)[:4]: r.score for r in tables["postings"].collect()} == want
    assert {(r.index_id, r.term): r.df for r in tables["frequencies"].collect()} == df
    assert {r.index_id: r.n_docs for r in tables["stats"].collect()} == {"i": 14, "j": 7}


def test_build_exchanges_no_words(tables):
    """Words are counted where their rows are: the first exchange is that of blocks' terms, without the names of files."""
    plan = tables["postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("RepartitionByExpression") == 1


def test_lost_rows(spark):
    row = "block long, x string"
    before = spark.createDataFrame([(b, f"x{k}") for b in range(20) for k in range(5)] + [(3, "x1"), (4, None)], row)
    assert relational.count_lost(before, before, ["block"]).first().lost == 0
    after = before.filter("NOT (block = 3 AND x = 'x1') AND NOT (block = 7 AND x = 'x0') AND x IS NOT NULL").union(spark.createDataFrame([(3, "x1"), (7, "y"), (50, "z")], row))
    assert relational.count_lost(before, after, ["block"]).first().lost == 3
    assert relational.count_lost(after, before, ["block"]).first().lost == 2
    assert relational.count_lost(before, before.filter(F.lit(False)), ["block"]).first().lost == 102
