"""Token counts, the token store, and chat formatting."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import rows
from lakeseek.llm import bpe, registry
from lakeseek.llm import token_store as store_of
from lakeseek.llm.chat import chat_format
from lakeseek.llm.token_counts import token_counts
from lakeseek.llm.token_store import reconstruct, token_store, verify


def _pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'strveldmRE19a中é.,!　 \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=300, deadline=None)
def test_pretokens_are_the_patterns_matches(text):
    import regex

    found, offsets = bpe.pretokens(pa.array([text, "x", text], pa.large_string()))
    want = [m.encode() for m in regex.findall(bpe.PATTERN, text)]
    assert found.to_pylist() == [*want, b"x", *want] and offsets.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_token_counts(which, request):
    docs = request.getfixturevalue(which)
    encode = bpe.encoding(bpe.RANKS).encode_ordinary
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts(docs).collect())
    assert got == sorted((i or -1, len(encode(t or ""))) for i, t in _pairs(docs))


def test_token_counts_of_nothing(awkward):
    assert token_counts(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_store_round_trip(which, request):
    docs = request.getfixturevalue(which)
    store = token_store(docs)
    encode = bpe.encoding(bpe.RANKS).encode_ordinary
    back = sorted((r.id or -1, r.ids) for r in reconstruct(store).collect())
    assert back == sorted((i or -1, encode(t or "")) for i, t in _pairs(docs))
    chunks = store.chunks.collect()
    assert len({c.digest for c in chunks}) == len(chunks) and all(hashlib.sha256(c.payload).digest() == c.digest and len(c.payload) == 2 * c.n_tokens for c in chunks)
    assert _unverified(store) == []
    shards = {r.shard: r for r in store.manifest.collect()}
    assert shards[-1].n_docs == docs.count() and shards[-1].n_tokens == sum(len(x) for _, x in back)
    tops = [bytes(shards[k].digest) for k in sorted(shards) if k >= 0]
    assert store_of.merkle(tops) == bytes(shards[-1].digest)


def _unverified(store):
    """What ``verify`` says isn't whole."""
    told = verify(store)
    out = [("chunk", bytes(r.digest)) for r in told.chunks.filter("NOT verified").collect()]
    out += [("recipe", r.row) for r in told.recipes.filter("NOT verified").collect()]
    return out + [("manifest", r.shard) for r in told.manifest.filter("NOT verified").collect()]


@pytest.fixture(scope="module")
def whole(spark):
    """A store of documents of many chunks, in several shards, cut off from its files so that tests can change it."""
    texts = [" ".join(f"word{(k * 7919 + n * n) % 5003}" for n in range(400 * (k + 1))) for k in range(6)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = token_store(docs, shards=3)
    held = [[tuple(r) for r in x.collect()] for x in (store.chunks, store.recipes, store.manifest)]
    return held, [x.schema for x in (store.chunks, store.recipes, store.manifest)]


def _with(spark, whole, table, change):
    """The store with a change to the rows of one table."""
    held, schemas = whole
    rows = [list(x) for x in held]
    rows[table] = change(rows[table])
    return store_of.Store(*(spark.createDataFrame(r, s) for r, s in zip(rows, schemas)))


def _swap_first(rows):
    """The first two addresses of the longest recipe in the other order."""
    k = max(range(len(rows)), key=lambda n: rows[n][4])
    p = rows[k][5]
    return [*rows[:k], (*rows[k][:5], p[32:64] + p[:32] + p[64:]), *rows[k + 1 :]]


CHANGES = {
    "missing chunk": (0, lambda rows: rows[1:]),
    "altered chunk": (0, lambda rows: [(rows[0][0], rows[0][1], bytes([rows[0][2][0] ^ 1]) + rows[0][2][1:]), *rows[1:]]),
    "shortened chunk": (0, lambda rows: [(rows[0][0], rows[0][1], rows[0][2][:-2]), *rows[1:]]),
    "chunks exchanged": (0, lambda rows: [(*rows[0][:2], rows[1][2]), (*rows[1][:2], rows[0][2]), *rows[2:]]),
    "addresses reordered": (1, _swap_first),
    "recipe cut short": (1, lambda rows: [(*r[:5], r[5][:-32]) if r[4] > 1 else r for r in rows]),
    "wrong count": (1, lambda rows: [(*r[:3], r[3] + 1, *r[4:]) for r in rows]),
    "wrong root": (1, lambda rows: [(*r[:2], hashlib.sha256(b"x").digest(), *r[3:]) for r in rows]),
}


@pytest.mark.parametrize("name", CHANGES)
def test_store_notices_damage(spark, whole, name):
    table, change = CHANGES[name]
    damaged = _with(spark, whole, table, change)
    assert _unverified(_with(spark, whole, 0, list)) == []
    kinds = {k for k, _ in _unverified(damaged)}
    assert "recipe" in kinds and ("chunk" in kinds or table == 1 or name == "missing chunk")
    good = {r.row: r.ids for r in reconstruct(_with(spark, whole, 0, list)).collect()}
    got = {r.row: (r.ids, r.intact) for r in reconstruct(damaged).collect()}
    assert set(got) == set(good) and any(not ok for _, ok in got.values())
    assert all(ids == good[row] if ok else ids is None for row, (ids, ok) in got.items())


def test_manifest_notices_damage(spark, whole):
    """A recipe that is gone or of another id, a root or a leaf that was changed, and a shard that is missing."""
    shard = next(r[0] for r in whole[0][2] if r[0] >= 0 and r[3] > 0)
    bad = lambda table, change: {s for k, s in _unverified(_with(spark, whole, table, change)) if k == "manifest"}
    assert -1 in bad(1, lambda rows: rows[1:]) and -1 in bad(1, lambda rows: [(r[0], 99, *r[2:]) if r[1] == 1 else r for r in rows])
    assert bad(2, lambda rows: [(*r[:2], hashlib.sha256(b"x").digest(), *r[3:]) if r[0] == shard else r for r in rows]) == {shard}
    assert bad(2, lambda rows: [(*r[:5], r[5][:-1] + b"\0") if r[0] == shard and r[5] and r[5][-1] else r for r in rows]) <= {shard}
    assert bad(2, lambda rows: [r for r in rows if r[0] != shard]) == {shard}


def test_chunks_and_roots_are_brute_force(spark, awkward):
    """Cuts by the rolling hash's own formula, addresses, recipes and both levels of the manifest, one document at a time."""
    mod, r = 1 << 64, 0x9E3779B97F4A7C15

    def mixed(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % mod
        return x ^ x >> 32

    def ends(ids):
        each = [(x + 0x632BE5AB) * 0xC2B2AE3D27D4EB4F % mod for x in ids]
        each, begun = [x ^ x >> 29 for x in each], 0
        for k in range(1, len(ids) + 1):
            rolled = k >= 16 and mixed((sum(x * pow(r, n, mod) for n, x in enumerate(each[k - 16 : k])) + 16) % mod)
            if k == len(ids) or k - begun == 2048 or k - begun >= 64 and k >= 16 and rolled % 256 == 0:
                yield begun, k
                begun = k

    def tree(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
        while len(level) > 1:
            pairs = [level[k : k + 2] for k in range(0, len(level), 2)]
            level = [hashlib.sha256(b"\1" + b"".join(p)).digest() if len(p) == 2 else p[0] for p in pairs]
        return level[0] if level else hashlib.sha256(b"").digest()

    encode = bpe.encoding(bpe.RANKS).encode_ordinary
    store = token_store(awkward, shards=1)
    chunks, recipes = {}, []
    for i, t in _pairs(awkward):
        ids = encode(t or "")
        own = [b"".join(x.to_bytes(2, "little") for x in ids[a:b]) for a, b in ends(ids)]
        addresses = [hashlib.sha256(x).digest() for x in own]
        chunks |= dict(zip(addresses, own))
        recipes.append((i, len(ids), tree(addresses), b"".join(addresses)))
    assert {bytes(r.digest): bytes(r.payload) for r in store.chunks.collect()} == chunks
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((r.id, r.n_tokens, bytes(r.digest), bytes(r.payload)) for r in store.recipes.collect()), key=key) == sorted(recipes, key=key)
    leaves = [hashlib.sha256(repr((i, n)).encode() + root).digest() for i, n, root, _ in sorted(recipes, key=key)]
    roots = {r.shard: bytes(r.digest) for r in store.manifest.collect()}
    assert roots == {0: tree(leaves), -1: tree([tree(leaves)])}


def test_store_of_nothing(awkward):
    store = token_store(awkward.limit(0))
    assert store.chunks.count() == 0 and store.recipes.count() == 0
    top = store.manifest.collect()
    assert [(r.shard, bytes(r.digest), r.n_docs) for r in top] == [(-1, hashlib.sha256(b"").digest(), 0)]


def test_store_shares_passages(spark):
    shared = " ".join(f"passage{k}" for k in range(3000))
    docs = spark.createDataFrame([(k, f"lead {k} " * (k + 1) + shared) for k in range(6)], "doc_id long, text string")
    store = token_store(docs)
    total = sum(r.n_chunks for r in store.recipes.collect())
    assert store.chunks.count() < 0.5 * total


def test_query_of_store(spark, sf_dir):
    out = registry.queries()["op2_token_store"](spark, sf_dir).toPandas()
    assert set(out.kind) == {"chunk", "recipe", "manifest"} and out.verified.all()


def test_chat_is_sql(spark, sf_dir, duck):
    got = registry.queries()["op3_chat_format"](spark, sf_dir).toPandas()
    assert rows(got) == rows(duck.execute(registry.oracle_sql()["op3_chat_format"]).fetchdf())


def test_chat_cases(spark):
    turns = [(1, 2, "user", "b", "x"), (1, 1, None, "a", "x"), (1, None, "system", None, "x"), (1, 2, "user", "b", "x"), (None, 1, "user", "é中" * 50_000, "x"), (None, 2, "user", "", "x"), (2, 1, "", "", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, conv string")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat_format(frame).collect()}
    line = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {1: (4, line("system", "") + line("", "a") + 2 * line("user", "b")), None: (2, line("user", "é中" * 50_000) + line("user", "")), 2: (1, line("", ""))}
    assert chat_format(frame.limit(0)).count() == 0
