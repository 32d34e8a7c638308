"""Retrieval packing and the corpus pipeline."""

import collections
import tracemalloc

import numpy as np
import pytest

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from lakeseek.llm import packing
from lakeseek.llm.packing import Block, Seeds, Shard, nearest_seeds, pack_documents
from lakeseek.llm.quality import quality


def _pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def _packs(frame):
    out = collections.defaultdict(list)
    for r in frame.orderBy("pack_id", "position").collect():
        out[r.pack_id].append((r.doc_id, r.first_word, r.n_words))
    key = lambda p: [(x[0] is not None, x) if x[0] is not None else (False, ()) for x in p]
    return sorted(out.values(), key=key)


@pytest.mark.parametrize("window, shard, round_bytes", [(2048, 8192, 24_000_000), (300, 40, 5_000)])
def test_packs_are_brute_force(documents, window, shard, round_bytes):
    key = lambda p: [(True, x) for x in p]
    assert _packs(pack_documents(documents, window=window, shard=shard, round_bytes=round_bytes)) == sorted(brute.packs(_pairs(documents), window), key=key)


@pytest.mark.parametrize("shard, round_bytes", [(8192, 24_000_000), (50, 20_000)])
def test_every_document_goes_to_its_nearest_seed(documents, shard, round_bytes):
    """Exact, so the recall is 1: over several shards and rounds of seeds."""
    got = sorted((r.id, r.n, r.seed_id, r.score) for r in nearest_seeds(documents, shard=shard, round_bytes=round_bytes).collect())
    want = sorted(brute.nearest(_pairs(documents)))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-6 or x[3] == y[3] for x, y in zip(got, want))


@pytest.mark.parametrize("every, group", [(20, 8192), (2, 3), (1000, 4)])
def test_each_word_is_packed_once(awkward, every, group):
    packs = _packs(pack_documents(awkward, window=64, every=every, group=group))
    assert all(sum(n for *_, n in p) <= 64 for p in packs)
    got = collections.Counter()
    for p in packs:
        for i, _, n in p:
            got[i] += n
    want = collections.Counter()
    for i, t in _pairs(awkward):
        want[i] += len(brute.words(t))
    assert got == +want
    assert pack_documents(awkward.limit(0)).count() == 0


def test_neighbours_share_windows(spark):
    """Documents of one subject are packed together rather than with those of another, over shards and parts of groups."""
    docs = [(k, " ".join(f"subject{k % 19}x{(k + n) % 30}" for n in range(25))) for k in range(400)]
    for options in ({}, {"shard": 60, "group": 10}):
        packs = _packs(pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), window=100, **options))
        assert all(len({i % 19 for i, _, _ in p}) == 1 for p in packs)


def test_pipeline_is_brute_force(spark, sf_dir, documents):
    """The stages one by one in plain Python; the trained model's decisions are taken from the operator."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {r.doc_id for r in quality(documents, labels).filter("keep").collect()}
    docs = sorted((i, t) for i, t in _pairs(documents) if i in kept)
    copies = brute.edited_copies(docs)
    assert copies
    docs = [(i, t) for i, t, n in brute.without_shared_lines(docs) if i not in copies and (not n or t.strip())]
    docs = brute.keep_one(docs)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {r[0] for r in brute.shared_spans(docs, items)}
    docs = [(i, t) for i, t in docs if i not in leaks]
    out = corpus_pipeline.run(spark, sf_dir)
    key = lambda p: [(True, x) for x in p]
    assert len(docs) > 50 and _packs(out) == sorted(brute.packs(docs, 2048), key=key)


def test_stages_keep_columns_and_cases(spark, sf_dir, awkward):
    docs = awkward
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    packed = corpus_pipeline.packing_stage(spark, docs.withColumns({"seed_id": F.lit("x"), "pack_id": F.lit("y"), "score": F.lit("z")}), sf_dir)
    assert packed.columns == ["pack_id", "position", "doc_id", "first_word", "n_words", "seed_id"]
    assert sum(r.n_words for r in packed.collect()) == sum(len(brute.words(t)) for _, t in _pairs(docs))
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf_dir).count() == 0
    left = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir)
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(i or -1 for i, _ in brute.keep_one(_pairs(docs)))
    deduped = corpus_pipeline.line_dedup_stage(spark, docs, sf_dir)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in deduped.collect())
    # What no line was taken from stays, empty or not.
    ids = [r.doc_id for r in deduped.collect()]
    assert {3, 4, 5, 8, None} <= set(ids) and 2 not in ids


def test_scores_of_a_shard_are_sums_of_its_postings():
    rng = np.random.default_rng(5)
    shard, n_docs, n_terms = Shard.__new__(Shard), 300, 40
    weight = rng.random((n_terms, n_docs)).astype(np.float32) * (rng.random((n_terms, n_docs)) < np.linspace(0.005, 0.9, n_terms)[:, None])
    term, doc = np.nonzero(weight)
    shard.n, shard.seen = n_docs, np.arange(n_terms, dtype=np.uint64)
    shard.posting = np.stack([doc.astype(np.int32), weight[term, doc].view(np.int32)], 1).view(np.int64).ravel()
    shard.bounds = np.searchsorted(term, np.arange(n_terms + 1))
    shard.common = np.where(np.arange(n_terms) >= 30, np.arange(n_terms) - 30, -1)
    shard.matrix = weight[30:].astype(np.float32)
    held = [[], [0], [39], list(range(40)), [], [29, 1], [5, 31]]  # queries without terms, with short, long and common ones
    query, place = np.repeat(np.arange(len(held)), [len(x) for x in held]), np.array([x for own in held for x in own])
    out = shard.scores(np.arange(n_terms + 1, dtype=np.uint64), query, place, len(held))
    assert np.allclose(out, [weight[x].sum(0) for x in held], rtol=1e-5)


@pytest.fixture(scope="module")
def indexed(spark):
    """Payloads of documents and of seeds, and the corpus's documents and mean length."""
    rng = np.random.default_rng(3)
    words = np.char.add("w", np.minimum(rng.zipf(1.3, (6000, 200)), 30_000).astype(str))
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(words.tolist())], "doc_id long, text string").repartition(8, "doc_id")
    made = sorted(packing._index(docs, "doc_id", "text", 20).collect(), key=lambda r: r.block)
    of = lambda kind: [(r.block, bytes(r.payload)) for r in made if r.kind == kind]
    n_docs = sum(r.n_docs for r in made)
    return of(0), of(1), n_docs, sum(r.n_words for r in made) / n_docs


def _peak(f):
    """What f returns, and the most bytes that it held besides what was there."""
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_an_index_follows_its_postings(indexed):
    """An executor went beyond its memory in the shards of the pipeline's packing."""
    docs, queries, n_docs, mean = indexed
    shard, most = _peak(lambda: Shard([Block(*x, 20) for x in docs], n_docs, mean))
    assert len(shard.own_code) > 300_000 and most - shard.matrix.nbytes < 30 * len(shard.own_code)
    seeds, most = _peak(lambda: Seeds(queries, n_docs, mean))
    assert most < 40 * len(seeds.code)


def test_no_cut_of_shards_or_of_the_matrix_changes_a_score(indexed, monkeypatch):
    docs, queries, n_docs, mean = indexed
    seeds, found = Seeds(queries, n_docs, mean), []
    for cells, groups in ((packing.CELLS, [docs]), (20 * n_docs, [docs]), (0, [docs[:3], docs[3:]])):
        monkeypatch.setattr(packing, "CELLS", cells)
        shards = [Shard([Block(*x, 20) for x in group], n_docs, mean) for group in groups]
        assert all(s.matrix.size <= cells for s in shards) and (cells == 0 or shards[0].matrix.size)
        which, score = (np.concatenate(x) for x in zip(*(s.nearest(seeds) for s in shards)))
        found.append((which.tolist(), np.round(score, 6).tolist()))
    assert found[0] == found[1] == found[2] and max(found[0][0]) > 100


@pytest.mark.parametrize("postings", [1, 4_000])
def test_shards_closed_by_their_postings_are_brute_force(documents, postings):
    docs = documents.repartition(12, "doc_id")
    got = sorted((r.id, r.n, r.seed_id, r.score) for r in nearest_seeds(docs, postings=postings).collect())
    want = sorted(brute.nearest(_pairs(documents)))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-6 or x[3] == y[3] for x, y in zip(got, want))


def _blocks(spark, docs, every):
    made = sorted(packing._index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4, "doc_id"), "doc_id", "text", every).collect(), key=lambda r: r.block)
    n_docs, of = sum(r.n_docs for r in made), lambda kind: [(r.block, bytes(r.payload)) for r in made if r.kind == kind]
    mean = sum(r.n_words for r in made) / n_docs
    return lambda: [Block(*x, every) for x in of(0)], Seeds(of(1), n_docs, mean), n_docs, mean


def test_seeds_and_documents_of_a_subject_are_scored_together(spark, monkeypatch):
    """The CPU seconds of scoring were over the budget: each batch of seeds met the common terms of all documents."""
    monkeypatch.setattr(packing, "LEAST", 100)
    rng = np.random.default_rng(7)
    docs = [(k, " ".join(f"s{k % 4}w{x}" for x in np.minimum(rng.zipf(1.3, 40), 3000))) for k in range(5000)]
    blocks, seeds, n_docs, mean = _blocks(spark, docs, 3)
    parts = list(seeds.subjects.split(blocks()))
    of = [[i for b in part for i, n in zip(b.ids.to_pylist(), b.count) if n] for part in parts]
    assert sorted(i for own in of for i in own) == [k for k in range(5000) if k % 3] and sum(len(b.ids) for part in parts for b in part) == 5000
    assert sum(len(own) > 0 for own in of) >= 4 and all(len({i % 4 for i in own}) <= 1 for own in of)
    whole, found = Shard(blocks(), n_docs, mean), {}
    for part in parts:
        index = Shard(part, n_docs, mean)
        found |= {i: x for i, *x in zip(index.ids.to_pylist(), *index.nearest(seeds))}
    which, score = whole.nearest(seeds)
    assert [found[i][0] for i in whole.ids.to_pylist()] == which.tolist() and np.allclose([found[i][1] for i in whole.ids.to_pylist()], score, atol=1e-6)


@pytest.mark.parametrize("queries", [1, 7, 1024])
def test_of_equal_scores_the_first_id_counts_in_any_batch(spark, monkeypatch, queries):
    monkeypatch.setattr(packing, "QUERIES", queries)
    docs = [(k, " ".join(f"w{(k * 7 + j) % 23}" for j in range(1 + k % 6))) for k in range(300)]
    blocks, seeds, n_docs, mean = _blocks(spark, docs, 2)
    index = Shard(blocks(), n_docs, mean)
    got = {i: int(seeds.id[w]) if w >= 0 else None for i, w in zip(index.ids.to_pylist(), index.nearest(seeds)[0])}
    want = {i: seed for i, _, seed, _ in brute.nearest(docs, 2) if i % 2}
    assert {i: got[i] for i in want} == want
