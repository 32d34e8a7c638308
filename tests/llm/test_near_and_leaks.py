"""The n-gram Jaccard join, decontamination, line dedup."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from compare import rows
from lakeseek.llm import jaccard, registry
from lakeseek.llm.components import components
from lakeseek.llm.decontaminate import contamination, decontaminate
from lakeseek.llm.jaccard import drop_near_duplicates, ngram_jaccard_join, similar_sets
from lakeseek.llm.line_dedup import line_dedup, patience


def _pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def _near(frame):
    return sorted((r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in frame.collect())


@pytest.fixture(scope="module")
def copies(spark):
    """Chains and groups of near copies, from two to hundreds, at all similarities."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for group, n in enumerate((2, 3, 30, 250, 1, 1, 5)):
        own = [rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 60)) if group != 3 else 40)]
        for _ in range(n):
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.03 else w for w in own))
    texts += ["w1 w2", "w1 w2", "w1", ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("which", ["documents", "awkward", "copies"])
def test_join_is_brute_force(which, request):
    docs = request.getfixturevalue(which)
    want = brute.jaccard_rows(_pairs(docs))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_jaccard_join(docs).collect())
    assert any(n for *_, n in want) and got == want


def test_join_is_sql(spark, sf_dir, duck):
    key = "op4_ngram_jaccard_join"
    got = registry.queries()[key](spark, sf_dir).toPandas()
    assert got.n_links.max() > 0 and rows(got) == rows(duck.execute(registry.oracle_sql()[key]).fetchdf())


def test_links_count_all_copies(spark):
    """Three and two copies of two near texts, and two of another; one id with two texts that are near."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41))
    docs = [(1, a), (2, b), (3, a), (4, b), (5, a), (6, "x y z"), (7, "x y z"), (8, "alone here"), (9, None)]
    got = sorted(tuple(r) for r in ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 1, 4), (5, 1, 4), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0)]
    got = sorted(tuple(r) for r in ngram_jaccard_join(spark.createDataFrame([(1, a), (1, b), (1, b)], "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (1, 1, 1)]


@pytest.mark.parametrize("chunk, orders", [(7, 3), (50, 1), (3, 4)])
def test_pieces_and_orders_change_nothing(copies, chunk, orders):
    assert _near(similar_sets(copies, chunk=chunk, orders=orders)) == brute.similar_sets(_pairs(copies))


def test_pieces_of_few_tokens_change_nothing(copies, monkeypatch):
    expected = sorted(map(tuple, ngram_jaccard_join(copies).collect()))
    monkeypatch.setattr(jaccard, "PART_TOKENS", 50)
    placed = jaccard._placed(jaccard._sets(copies, "doc_id", "text", 3, 0.6)[1], 400, 0.6)
    assert placed.filter("i <> j").count()
    assert sorted(map(tuple, ngram_jaccard_join(copies).collect())) == expected


def test_counting_of_common_tokens_takes_little_memory():
    sets, held, n = 400, 20, 50_000
    row = np.sort(np.random.default_rng(1).random((n, sets)).argsort(1)[:, :held], axis=1).ravel()
    code = np.repeat(np.arange(n), held)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    tracemalloc.start()
    out = jaccard._common(row, code, [np.arange(sets)] * 2, np.ones((sets, sets), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    each = np.zeros((sets, n), np.float32)
    each[row, code] = 1
    assert (out == each @ each.T).all()
    assert peak < 300e6


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_of_few_edges_take_few_jobs(spark, kind):
    rng = random.Random(3)
    numbers = [(k, k + 1) for k in range(-30, 30)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    edges = spark.createDataFrame(numbers, "a long, b long")
    edges = edges.select(*((F.unhex(F.hex(c)) if kind == "binary" else F.col(c)).alias(c) for c in ("a", "b")))
    expected = sorted(map(tuple, components(edges, small=0).collect()))
    spark.sparkContext.setJobGroup("few", "")
    try:
        assert sorted(map(tuple, components(edges).collect())) == expected
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) < 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_of_each_group_stays(copies, awkward):
    for docs in (copies, awkward):
        left = drop_near_duplicates(docs, chunk=20)
        assert left.columns == docs.columns and set(map(tuple, left.collect())) <= set(map(tuple, docs.collect()))
        key = lambda x: (x[0] or -1, x[1] or "")
        assert sorted(_pairs(left), key=key) == sorted(brute.keep_one(_pairs(docs)), key=key)


def test_texts_and_not_ids_are_dropped(spark):
    """A text isn't dropped because another of its id is; of repeated rows one stays."""
    t, u, v = (" ".join(f"{c}{k}" for k in range(20)) for c in "tuv")
    docs = [(1, t), (5, t), (5, u), (7, v), (7, v), (None, v), (None, v), (9, None), (9, None)]
    left = drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(_pairs(left), key=repr) == sorted([(1, t), (5, u), (7, v), (None, v), (9, None)], key=repr)


def test_join_of_nothing(awkward):
    assert ngram_jaccard_join(awkward.limit(0)).count() == 0 and drop_near_duplicates(awkward.limit(0)).count() == 0


def test_leaks_are_sql(spark, sf_dir, duck):
    got = registry.queries()["op5_decontaminate"](spark, sf_dir).toPandas()
    assert len(got) and rows(got) == rows(duck.execute(registry.oracle_sql()["op5_decontaminate"]).fetchdf())


@pytest.mark.parametrize("broadcast_bytes", [16_000_000, 0])
def test_every_long_shared_span_is_found(spark, broadcast_bytes):
    """Spans of every length around the guarantee, at both ends and between, with repeats; by broadcast and by shuffle."""
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcdefgh") + str(rng.randrange(3 if k == 0 else 40)) for _ in range(60))) for k in range(4)]
    items += [(4, "too short to be found"), (5, None), (None, items[0][1])]
    docs = []
    for k in range(60):
        n, item = rng.randrange(9, 16), items[k % 4][1].split()
        at = rng.choice((0, len(item) - n, rng.randrange(len(item) - n)))
        lead, tail = ([f"x{rng.randrange(99)}" for _ in range(rng.randrange(3))] for _ in range(2))
        docs.append((k, ", ".join([*lead, *item[at : at + n], *tail]).upper()))
    docs += [(100, None), (101, ""), (102, items[1][1] + " " + items[1][1]), (None, items[2][1])]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, spans string, key string")
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.doc_word, r.item_word, r.n_words) for r in contamination(frame, benchmark, broadcast_bytes=broadcast_bytes).collect())
    want = sorted((i if i is not None else -1, *rest) for i, *rest in brute.shared_spans(docs, items))
    assert want and got == want
    clean = decontaminate(frame, benchmark, broadcast_bytes=broadcast_bytes)
    assert clean.columns == frame.columns
    hit = {r[0] for r in want}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in docs if i is not None and i not in hit)
    assert contamination(frame, benchmark.limit(0), broadcast_bytes=broadcast_bytes).count() == 0
    assert decontaminate(frame.limit(0), benchmark, broadcast_bytes=broadcast_bytes).count() == 0


def test_leaks_with_clashing_names(awkward, spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for size in (16_000_000, 0):
        left = decontaminate(awkward, benchmark, broadcast_bytes=size)
        assert left.columns == awkward.columns and left.exceptAll(awkward).isEmpty() and left.count() == awkward.count()


@pytest.mark.parametrize("broadcast_bytes", [16_000_000, 0])
def test_leaks_of_long_and_repeated_rows(spark, broadcast_bytes):
    """A span in the middle of a very long text, repeated documents, and an item that stands there twice."""
    item = " ".join(f"leak{k}" for k in range(30))
    long = " ".join(f"w{k % 7919}" for k in range(80_000))
    docs = [(1, f"{long} {item} {long}"), (2, item), (2, item), (3, long), (4, "中" * 300_000)]
    items = [(7, item), (7, item), (8, "other words " * 10)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in contamination(frame, benchmark, broadcast_bytes=broadcast_bytes).collect())
    assert got == sorted([(1, 7, 80_000, 0, 30)] * 2 + [(2, 7, 0, 0, 30)] * 4)
    assert sorted(r.doc_id for r in decontaminate(frame, benchmark, broadcast_bytes=broadcast_bytes).collect()) == [3, 4]


def _deduped(frame):
    return sorted((r.doc_id, r.text, r.n) for r in line_dedup(frame.select("doc_id", "text"), count="n").collect())


def test_line_dedup_is_brute_force(documents):
    assert _deduped(documents) == sorted(brute.without_shared_lines(_pairs(documents)))


def test_line_dedup_of_planted_passages(spark):
    """Passages of one line and of many short ones, at the beginning, the end and between; each stays once."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    passages = [line(60), "\n".join(line(4) for _ in range(15)), "\n".join(line(9) for _ in range(7)), "\n".join([line(3), "", line(20), line(2), line(30)])]
    docs = []
    for k in range(40):
        parts = [line(rng.randrange(3, 20)) for _ in range(rng.randrange(1, 6))]
        parts.insert(rng.randrange(len(parts) + 1), passages[k % 4])
        docs.append((k, "\n".join(parts)))
    got = _deduped(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == sorted(brute.without_shared_lines(docs))
    for k, passage in enumerate(passages):
        assert [i for i, text, _ in got if passage in text] == [k]


def test_line_dedup_finds_blocks_whose_lines_stood_elsewhere(spark):
    """Each line of the block is first held by another document, the block by the third."""
    a, b = "one two three four five six seven", "eins zwei drei vier fünf sechs sieben"
    docs = [(1, f"{a}\nx"), (2, f"{b}\ny"), (3, f"{a}\n{b}\nz"), (4, f"q\n{a}\n{b}")]
    got = _deduped(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == [(1, f"{a}\nx", 0), (2, f"{b}\ny", 0), (3, f"{a}\n{b}\nz", 0), (4, "q", 2)]


def test_line_dedup_aligns_with_every_earlier_holder(spark):
    """The first holder of both passages has them in another order, a later one has the other passage; and a short line follows a passage only in the second holder."""
    x, y, a = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("x", 60), ("y", 70), ("a", 20)))
    docs = [(1, f"{x}\nmid\n{y}"), (2, x), (3, y), (4, f"{y}\nother\n{x}"), (5, f"{a}\np"), (6, f"{a}\nb c\nq"), (7, f"r\n{a}\nb c")]
    got = _deduped(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == sorted(brute.without_shared_lines(docs))
    assert got[3] == (4, "other", 2) and got[6] == (7, "r", 2)


def test_line_dedup_takes_tails_moved_and_overlapping_blocks(spark):
    """A short line after a block that only the second holder has; blocks in another order, doubled, and over each other."""
    w = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    a, b, c, d, x, y = w("a", 5), w("b", 5), w("c", 5), w("d", 2), w("x", 20), w("y", 30)
    docs = [(1, f"{a}\n{b}\n{c}"), (2, f"zz\n{a}\n{b}\n{c}\n{d}"), (3, f"qq\n{a}\n{b}\n{c}\n{d}"), (4, f"{x}\nm\n{y}"), (5, f"{y}\n{x}\n{x}\nown")]
    p, q, r = w("p", 7), w("q", 7), w("r", 7)
    docs += [(6, f"{p}\n{q}\nbreak\n{q}\n{r}"), (7, f"new\n{p}\n{q}\n{r}\nend")]
    got = _deduped(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == sorted(brute.without_shared_lines(docs))
    assert got[2][1] == "qq" and got[4][1] == "own" and got[6][1] == "new\nend"


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_many_overlapping_holders_is_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"{chr(97 + k)}{n}" for n in range(rng.randrange(1, 9))) for k in range(14)]
    docs = [(k, "\n".join(rng.choice([*pool, "", f"own {k} {n}"]) for n in range(rng.randrange(1, 16)))) for k in range(120)]
    got = _deduped(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == sorted(brute.without_shared_lines(docs)) and sum(n for *_, n in got) > 50


def test_edited_copies_are_told(spark):
    """A copy with a few words changed is one; a document that has a passage in common is none."""
    rng = random.Random(2)
    line = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    own = [line(20) for _ in range(10)]
    edited = [x.replace(x.split()[3], "changed", 1) if k in (2, 3, 7) else x for k, x in enumerate(own)]
    docs = [(1, "\n".join(own)), (2, "\n".join(edited)), (3, "\n".join([line(18), *own[4:7], line(22), line(9)])), (4, line(30))]
    out = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), copy="again")
    assert {r.doc_id: r.again for r in out.collect()} == {1: False, 2: True, 3: False, 4: False}


def test_line_dedup_cases(awkward):
    out = line_dedup(awkward, count="n")
    assert out.columns == [*awkward.columns, "n"]
    got = [(r.doc_id, r.text, r.n) for r in out.collect()]
    base = next(t for i, t in _pairs(awkward) if i == 1)
    assert (None, base, 0) in got  # nulls first: it is the first that holds the lines
    assert [x for x in got if x[0] == 2] == [(2, "", 4 - 1)] * 2 and (1, "", 3) in got
    assert (13, "\nAnd a tail of its own.", 3) in got
    assert (3, None, 0) in got and (4, "", 0) in got and (5, " \n\t ", 0) in got
    assert line_dedup(awkward.limit(0)).count() == 0
    assert out.drop("n", "text").exceptAll(awkward.drop("text")).isEmpty()


def test_patience_is_an_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_filter_keeps_column_order(documents):
    assert drop_near_duplicates(documents.withColumn("a", F.lit(1)).select("a", *documents.columns)).columns == ["a", *documents.columns]
