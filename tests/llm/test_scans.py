"""Quality rules, the secret scan, the licence scan."""

import collections
import math
import random
import string

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import brute
from compare import rows
from lakeseek.llm import registry
from lakeseek.llm import secrets as S
from lakeseek.llm.license_templates import TEMPLATES
from lakeseek.llm.licenses import license_scan
from lakeseek.llm.quality import quality, quality_filter, with_quality
from lakeseek.llm.secrets import secret_scan


def test_quality_on_held_out_labels(spark):
    """Fitted on half of the labels, it tells the others apart, and its probabilities are calibrated."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    got = with_quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.filter(half)).join(labels.filter(~half), "doc_id").select("p_quality", "quality").toPandas()
    hit = (got.p_quality >= 0.5) == (got.quality == 1)
    assert len(got) > 1000 and hit.mean() > 0.95
    assert abs(got.p_quality.mean() - got.quality.mean()) < 0.05


def test_quality_is_brute_force(spark):
    """Features, fitting, calibration and scores of a small model in plain Python, on the rows in the operator's order."""
    rng = random.Random(8)
    good, bad = ([f"{c}{k}" for k in range(60)] for c in "ab")
    rows = [(k, " ".join(rng.choice(good if rng.random() < (0.7 if k % 2 else 0.3) else bad) for _ in range(rng.randrange(4, 30))) + (" Ünï, x x x" if k % 5 == 0 else ""), k % 2) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: (r.p_quality, r.grade, r.keep) for r in quality(docs, labels, bits=9).collect()}
    ordered = [rows[k][1:] for k in np.random.default_rng(17).permutation(len(rows))]
    model = brute.quality_model(ordered, 9)
    assert all(abs(got[i][0] - model(t)) < 1e-4 for i, t, _ in rows) and len({p for p, *_ in got.values()}) > 50
    assert all(grade == (p >= 0.1) + (p >= 0.5) + (p >= 0.9) and keep == (p >= 0.5) for p, grade, keep in got.values())


def test_quality_sample_bounds_the_labelled_rows(spark):
    """Of repeated labels and ids, and of more labels than ``sample``, so many rows are fitted on; the share of good labels shows it."""
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 3 + [(2, 1)], "doc_id long, quality int")
    for sample, p in ((5, 6 / 7), (1000, 152 / 153)):
        assert {round(r.p_quality, 4) for r in quality(docs, labels, sample=sample).collect()} == {round(p, 4)}


def test_quality_ties_at_the_threshold(spark):
    """A probability that equals the threshold is kept."""
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(tuple(r) for r in quality(docs, none, keep=0.5).collect())
    assert got == [(1, 0.5, True, 2), (2, 0.0, False, 0)]
    assert [r.doc_id for r in quality_filter(docs, none, keep=0.5).collect()] == [1]


def test_quality_cases(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (8, 0, 0), (9, 0, 0), (None, 1, 0), (2, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality(awkward, labels)
    assert got.columns == ["doc_id", "p_quality", "keep", "grade"] and got.count() == awkward.count()
    p = collections.defaultdict(set)
    for r in got.collect():
        p[r.doc_id].add(r.p_quality)
    assert p[3] == p[4] == p[5] == p[8] == {0.0} and len(p[2]) == 1 and p[9] == p[10]
    kept = quality_filter(awkward, labels)
    assert kept.columns == awkward.columns and kept.exceptAll(awkward).isEmpty()
    assert quality(awkward.limit(0), labels).count() == 0
    none = {r.p_quality for r in quality(awkward, labels.limit(0)).filter("doc_id = 1").collect()}
    assert none == {0.5}


def _secrets(docs: list[tuple], least: int = 16, rate: float = 0.01, level: float = 0.005, bits: int = 64) -> set:
    """Each candidate's tests in plain Python, and the false-discovery rule by sorting."""
    erfc = lambda x: 0.5 * math.erfc(x / math.sqrt(2))

    def tail(x, mean, var):
        df = 2 * mean**2 / var
        return min(1, max(1e-300, erfc((np.cbrt(x / mean) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))))

    infer = lambda v: next(k for k, a in S.ALPHABETS.items() if set(v) <= set(a))
    seen: collections.Counter = collections.Counter()
    candidates, run = [], 0
    for i, text in docs:
        last = 0
        for m in regex.finditer(r"[A-Za-z0-9+/_-]{%d,}" % least, text or ""):
            seen.update(text[last : m.start()])
            last, parts = m.end(), [(x.start() + m.start(), x.end() + m.start(), x.group()) for x in regex.finditer("[^-_]+", m.group())]
            joined = "".join(x[2] for x in parts)
            one = len(parts) > 1 and any(set(joined) <= set(S.ALPHABETS[k]) for k in S._JOINED)
            own = [(parts[0][0], parts[-1][1], joined)] if one else [(m.start(), m.end(), m.group())]
            own += parts if len(joined) < len(m.group()) else []
            candidates += [(run, i, a, b, infer(v), v) for a, b, v in own if len(v) >= least and len(v) * math.log2(len(S.ALPHABETS[infer(v)])) >= bits]
            run += 1
        seen.update((text or "")[last:])
    symbols = S.ALPHABETS["token"]
    f = [seen[c] + (S._PRIOR[c] if c in S._PRIOR else S._PRIOR[c.lower()] / 20 if c.isalpha() else 5) for c in symbols]
    q = [0.9 * x / sum(f) + 0.1 / len(f) for x in f]
    found = []
    for run, i, a, b, name, v in candidates:
        alphabet = S.ALPHABETS[name]
        n, size = len(v), len(alphabet)
        codes, count = [alphabet.index(c) for c in v], collections.Counter(v)
        uniform = tail(sum(x * x for x in count.values()) * size / n - n, size - 1, 2 * (size - 1) * (n - 1) / n)
        share = (size - size // 2) / size
        p = 2 * share * (1 - share)
        turns = sum((x >= size // 2) != (y >= size // 2) for x, y in zip(codes, codes[1:]))
        runs = max(1e-300, 2 * erfc(abs(turns - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p))))
        level_of = [c - (size - 1) / 2 for c in codes]
        serial = max(1e-300, 2 * erfc(abs(sum(x * y for x, y in zip(level_of, level_of[1:]))) / math.sqrt((n - 1) * ((size**2 - 1) / 12) ** 2)))
        half = -sum(math.log(min(1, x)) for x in (uniform, runs, serial))
        if math.exp(-half) * (1 + half + half**2 / 2) < level:
            continue
        chi = sum(count[c] ** 2 / x for c, x in zip(symbols, q)) / n - n
        text_p = tail(chi, len(q) - 1, 2 * (len(q) - 1) + (sum(1 / x for x in q) - len(q) ** 2 - 2 * len(q) + 2) / n)
        found.append((name, int(math.log2(n)), math.floor(min(-math.log10(text_p), 290) * 20), run, (text_p, a, -b, (i, a, b, name))))
    out: dict = {}
    for stratum in {x[:2] for x in found}:
        own = [x for x in found if x[:2] == stratum]
        ok = [x[2] for x in own if 10 ** (-x[2] / 20) <= rate * sum(y[2] >= x[2] for y in own) / len(own)]
        for x in own:
            if ok and x[2] >= min(ok):
                out[x[3]] = min(out.get(x[3], x[4]), x[4])
    return {x[3] for x in out.values()}


def _planted() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(11)
    prose = "the quick brown fox jumps over the lazy dog and then-some-words-with-hyphens-in-between follow it for a while"
    kinds = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + "234567"]
    docs, secrets = [], []
    for k in range(120):
        text = " ".join(rng.choice(prose.split()) for _ in range(80))
        if k % 4 == 0:
            key = "".join(rng.choice(kinds[k // 4 % 3]) for _ in range(rng.choice((32, 40, 64))))
            secrets.append((k, len(text) + 5, len(text) + 5 + len(key)))
            text += " key " + key + " end"
        elif k % 4 == 1:
            text += " aaaaaaaaaaaaaaaaBBBBBBBBBBBBBBBBB 12345678901234567890123 AAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"
        docs.append((k, text))
    return docs, secrets


def test_secret_scan_is_brute_force(spark):
    docs, secrets = _planted()
    docs += [(None, docs[0][1]), (0, docs[0][1]), (500, None), (501, ""), (502, "é" * 5000)]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, start string, value string")
    got = [(r.doc_id, r.start, r.end, r.encoding) for r in secret_scan(frame).collect()]
    assert set(got) == _secrets(docs)
    assert got.count(next(x for x in got if x[0] == 0)) == 2 and any(x[0] is None for x in got)
    caught = {x[:3] for x in got if x[0] is not None}
    assert len(caught & set(secrets)) >= 0.9 * len(secrets) and not caught - set(secrets)
    assert secret_scan(frame.limit(0)).count() == 0


def test_secrets_of_every_encoding(spark):
    """Keys of digits or of letters of one case, a UUID, a key with a prefix, and one alone in its corpus are found; counters and words aren't."""
    rng = random.Random(1)
    key = lambda kind, n: "".join(rng.choice(kind) for _ in range(n))
    words = "the and of with from that which have this some over where then there about people world house water through".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    uuid = "-".join(key("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
    keys = [key(string.ascii_lowercase, 48), key(string.digits, 40), uuid, "key_" + key(string.ascii_letters + string.digits, 32), key("0123456789ABCDEF", 40), key(string.ascii_letters + string.digits + "-_", 44)]
    docs = [(k, f"{prose(40)} {x} {prose(40)}") for k, x in enumerate(keys)]
    docs += [(100 + k, f"{prose(60)} {x} {prose(9)}") for k, x in enumerate(["12345678901234567890123", "a" * 30, "aB" * 20, "1234567812345678", "thewordswithoutanyspacesinbetween", "a-phrase-with-hyphens-between-its-words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])]
    got = secret_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end, r.encoding) for r in got} == _secrets(docs)
    assert {r.doc_id for r in got} == set(range(len(keys)))
    assert all(dict(docs)[r.doc_id][r.start : r.end] in (keys[r.doc_id], keys[r.doc_id].removeprefix("key_")) for r in got)
    alone = [(1, "a1f09c37be52d8461fb9e0c7a35d2846")]
    assert secret_scan(spark.createDataFrame(alone, "doc_id long, text string")).count() == 1 == len(_secrets(alone))


def test_secret_scan_of_documents(documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert {(r.doc_id, r.start, r.end, r.encoding) for r in secret_scan(documents).collect()} == _secrets(docs)


def test_licences_are_sql(spark, sf_dir, duck):
    key = "op10_license_scan"
    got = registry.queries()[key](spark, sf_dir).toPandas()
    assert len(got) and rows(got) == rows(duck.execute(registry.oracle_sql()[key]).fetchdf())


def test_licence_cases(spark, awkward):
    rng = random.Random(4)
    docs, want = [], set()
    for k, (name, text) in enumerate(TEMPLATES.items()):
        words = text.split()
        docs.append((k, "before it " * rng.randrange(1, 40) + text.upper() + " and after " * 9))
        want.add((k, name))
        docs.append((1000 + k, " ".join(words[: len(words) // 2])))
    docs += [(None, next(iter(TEMPLATES.values()))), (5000, None), (5001, ""), (5002, "two words")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license) for r in license_scan(frame).collect()}
    assert want <= got and (None, next(iter(TEMPLATES))) in got and not any(i in (5000, 5001, 5002) for i, _ in got)
    assert license_scan(frame.limit(0)).count() == 0 and license_scan(frame, templates={"none": "", "short": "a b"}).count() == 0
    assert {(r.doc_id, r.license) for r in license_scan(awkward).collect()} == _held([(r.doc_id, r.text or '') for r in awkward.collect()]) == set()


def _held(docs, least=0.8):
    gram = lambda t: {tuple(w[k : k + 3]) for w in [regex.findall(r"[\p{L}\p{N}]+", t.lower())] for k in range(len(w) - 2)}
    own = {k: gram(v) for k, v in TEMPLATES.items() if gram(v)}
    return {(i, k) for i, t in docs for g in [gram(t)] for k, v in own.items() if len(v & g) >= math.ceil(round(least * len(v), 9))}


@pytest.mark.parametrize("long", [True, False])
def test_licences_with_words_changed(spark, long):
    """Of copies of which some words are others, those that hold enough are found: recall of 0.9 against exact containment, for whole licences and for notices."""
    rng = random.Random(6)
    some = {k: v for k, v in TEMPLATES.items() if (len(v.split()) > 60) == long}
    docs = [(n, "so it begins " + " ".join("changed" if rng.random() < (0.03 if long else 0.02) else w for w in v.split()) + " and goes on") for n, v in enumerate([*some.values()] * (6 if long else 20))]
    found = {(r.doc_id, r.license) for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = _held(docs)
    exact = _held(docs, 1.0)
    assert len(want) > len(exact) > 0 and found <= want and len(found) >= 0.9 * len(want)


def test_query_of_quality_covers_all_documents(spark, sf_dir, documents):
    got = registry.queries()["op6_quality_rules"](spark, sf_dir)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in documents.collect())
