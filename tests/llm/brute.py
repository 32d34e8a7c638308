"""Slow, plain versions of the operators, one document at a time."""

from __future__ import annotations

import collections
import math

import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(text: str | None, n: int = 3) -> set:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def _similar(docs: list, threshold: float) -> tuple[dict, list]:
    """Documents by their set, and the pairs of similar different sets."""
    sets = collections.defaultdict(set)
    for doc, t in docs:
        if grams(t):
            sets[frozenset(grams(t))].add(doc)
    keys, pairs = list(sets), []
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            j = len(a & b) / len(a | b)
            if j >= threshold - 1e-9:
                pairs.append((a, b, j))
    return sets, pairs


def _classes(sets: dict, pairs: list) -> dict:
    """Least document of the class of each set."""
    parent = {a: a for a in sets}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    for a, b, _ in pairs:
        parent[find(a)] = find(b)
    least: dict = {}
    for a, docs in sets.items():
        least[find(a)] = min(least.get(find(a), min(docs)), min(docs))
    return {a: least[find(a)] for a in sets}


def similar_sets(docs: list[tuple], threshold: float = 0.6) -> list[tuple]:
    """Pairs of different sets, by their least ids."""
    sets, pairs = _similar([x for x in docs if x[0] is not None], threshold)
    return sorted((*sorted((min(sets[a]), min(sets[b]))), round(j, 9)) for a, b, j in pairs)


def jaccard_rows(docs: list[tuple], threshold: float = 0.6) -> list[tuple]:
    """(id, class, links) of each (id, set)."""
    docs = [x for x in docs if x[0] is not None]
    sets, pairs = _similar(docs, threshold)
    least = _classes(sets, pairs)
    links = {a: len(ids) - 1 for a, ids in sets.items()}
    for a, b, _ in pairs:
        links[a], links[b] = links[a] + len(sets[b]), links[b] + len(sets[a])
    out = [(i, least[a], links[a]) for a, ids in sets.items() for i in ids]
    return sorted(out + [(i, i, 0) for i in {i for i, t in docs if not grams(t)}])


def keep_one(docs: list[tuple], threshold: float = 0.6) -> list[tuple]:
    """The distinct (id, text) of which one of each class stays, the one of the least id and ``order`` of the text."""
    sets, pairs = _similar([((i, t), t) for i, t in set(docs) if i is not None], threshold)
    least = _classes(sets, pairs)
    return [x for x in set(docs) if x[0] is None or not grams(x[1]) or least[frozenset(grams(x[1]))] == x]


def shared_spans(docs: list[tuple], items: list[tuple], least: int = 12) -> list[tuple]:
    out = []
    for i, t in docs:
        a = words(t)
        for item, u in items:
            if item is None:
                continue
            b = words(u)
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and not (p and q and a[p - 1] == b[q - 1]):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                            n += 1
                        if n >= least:
                            out.append((i, item, p, q, n))
    return out


def without_shared_lines(docs: list[tuple], least: int = 13) -> list[tuple]:
    """(id, text, removed lines): each document against every earlier one, every common block of lines. Ids are distinct here."""
    own = {i: [(n, x, len(x.split())) for n, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in docs}
    out = []
    for i, t in docs:
        gone: set = set()
        for j, _ in docs:
            if j >= i:
                continue
            a, b = own[i], own[j]
            at: dict = {}
            for q, (_, x, _) in enumerate(b):
                at.setdefault(x, []).append(q)
            for p, (_, x, _) in enumerate(a):
                for q in at.get(x, ()):
                    if p and q and a[p - 1][1] == b[q - 1][1]:
                        continue
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n][1] == b[q + n][1]:
                        n += 1
                    if sum(a[p + k][2] for k in range(n)) >= least:
                        gone |= {a[p + k][0] for k in range(n)}
        text = t if t is None or not gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        out.append((i, text, len(gone)))
    return out


def edited_copies(docs: list[tuple]) -> set:
    """Ids of documents that are told to be edited copies of the first holder of some run of their lines, or that have the same lines as an earlier one."""
    from lakeseek.llm.line_dedup import COPY, edited_copy, patience

    import numpy as np

    own = {i: [(x, len(x.split())) for x in (t or "").split("\n") if x.strip()] for i, t in docs}
    runs = lambda a: {tuple(a[p:q]) for p in range(len(a)) for q in range(p + 1, len(a) + 1) if sum(n for _, n in a[p:q]) >= 13 and (sum(n for _, n in a[p + 1 : q]) < 13 or sum(n for _, n in a[p : q - 1]) < 13)}
    of = {i: runs(a) for i, a in own.items()}
    first: dict = {}
    for i in sorted(of):
        for r in of[i]:
            first.setdefault(r, i)
    out = set()
    for i, a in own.items():
        for j in {first[r] for r in of[i]} - {i}:
            b = own[j]
            if j < i:
                left = [k for k, x in enumerate(a) if x in b]
                right = [k for k, x in enumerate(b) if x in a]
                pairs = patience([a[k] for k in left], [b[k] for k in right])
                x, y = (np.array([side[p[n]] for p in pairs], np.int64) for n, side in ((0, left), (1, right)))
                if a == b or edited_copy(np.array([n for _, n in a]), np.array([n for _, n in b]), x, y, COPY):
                    out.add(i)
    return out


def nearest(docs: list[tuple], every: int = 20, k1: float = 1.2, b: float = 0.75) -> list[tuple]:
    """(id, words, seed or None, score) of each document, by BM25 over all; ids are distinct here."""
    rows = sorted(((i, words(t)) for i, t in docs if words(t)), key=lambda r: (r[0] is not None, r[0] or 0))
    n, mean = len(docs), max(1, sum(len(w) for _, w in rows) / max(1, len(docs)))
    tf = {i: collections.Counter(w) for i, w in rows}
    df = collections.Counter(t for c in tf.values() for t in c)
    weight = {i: {t: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * sum(c.values()) / mean)) for t, f in c.items() if df[t] > 1} for i, c in tf.items()}
    seeds = [i for i, _ in rows if i is not None and i % every == 0]
    out = []
    for i, w in rows:
        if i in seeds:
            out.append((i, len(w), i, math.inf))
            continue
        scores = [(sum(x for t, x in weight[i].items() if t in weight[s]) / math.sqrt(max(1e-9, sum(weight[s].values()))), s) for s in seeds]
        most = max((x for x, _ in scores), default=0)
        out.append((i, len(w), *(next((s, round(x, 6)) for x, s in scores if x >= most * (1 - 1e-5)) if most > 0 else (None, 0.0))))
    return out


def packs(docs: list[tuple], window: int, every: int = 20) -> list[list[tuple]]:
    """Windows of (id, first word, words)."""
    out, by_seed = [], collections.defaultdict(list)
    for i, n, seed, score in nearest(docs, every):
        out += [[(i, at, window)] for at in range(0, n - window + 1, window)]
        if n % window:
            by_seed[seed].append((-score, (i is not None, i or 0), n, i))
    for own in by_seed.values():
        bins: list = []
        for _, _, n, i in sorted(own):
            rest = n % window
            fits = [(w[0], -w[1], k) for k, w in enumerate(bins) if w[0] >= rest]
            if fits:
                w = bins[min(fits)[2]]
            else:
                w = [window, 0, []]
                bins.append(w)
            w[0] -= rest
            w[2].append((i, n - rest, rest))
            w[1] = sum(len(x[2]) for x in bins)  # when it was last added to
        out += [w[2] for w in bins]
    return out


M64 = 1 << 64


def _span(values: list[int]) -> int:
    """The polynomial hash of the kernels, in integers."""
    total = 0
    for k, x in enumerate(values):
        v = (x + 0x632BE5AB) * 0xC2B2AE3D27D4EB4F % M64
        total += (v ^ v >> 29) * pow(0x9E3779B97F4A7C15, k, M64)
    return _mix((total + len(values)) % M64)


def _mix(x: int) -> int:
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % M64
    return x ^ x >> 32


def quality_features(text: str, bits: int) -> dict[int, float]:
    """Words, word pairs and character grams of one text by hashed index."""
    own = [_span([ord(c) for c in w]) for w in WORD.findall(text)]
    pairs = [_mix((a * 0xBF58476D1CE4E5B9 + b) % M64) for a, b in zip(own, own[1:])]
    out: dict[int, float] = collections.defaultdict(float)
    for h in [*set(own), *set(pairs)]:
        out[h % (1 << bits)] += 1 / len(own)
    if again := sum(a == b for a, b in zip(own, own[1:])):
        out[0x2A5A5 % (1 << bits)] += again / len(own)
    for k in range(len(text) - 2):
        g = 0
        for c in text[k : k + 3]:
            g = (g * 0x9E3779B1 + ord(c)) % (1 << 32)
        out[g * 0x85EBCA6B % (1 << 32) >> 32 - bits] += 1 / (len(text) - 2)
    return dict(out)


def quality_model(rows: list[tuple], bits: int):
    """A function from a text to its probability: logistic regression by Adagrad on three quarters of (text, good), Platt scaling on the rest."""
    each = [quality_features(t, bits) for t, _ in rows]
    good = [bool(g) for _, g in rows]
    fits = [k % 4 != 3 for k in range(len(rows))]
    n_up, n_down = (sum(f and g is up for f, g in zip(fits, good)) for up in (True, False))
    w, constant, seen, seen_constant = [0.0] * (1 << bits), 0.0, [1e-12] * (1 << bits), 1e-12
    margin = lambda x: sum(w[k] * v for k, v in x.items()) + constant
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    for _ in range(120):
        error = [(sigmoid(margin(x)) - g) * (0.5 / (n_up if g else n_down)) if f else 0.0 for x, g, f in zip(each, good, fits)]
        slope = [1e-7 * x for x in w]
        for x, e in zip(each, error):
            for k, v in x.items():
                slope[k] += e * v
        for k, g in enumerate(slope):
            seen[k] += g * g
            w[k] -= 0.3 * 10 * g / math.sqrt(seen[k])
        seen_constant += sum(error) ** 2
        constant -= 0.3 * sum(error) / math.sqrt(seen_constant)
    z = [(margin(x), g) for x, g, f in zip(each, good, fits) if not f]
    up = sum(g for _, g in z)
    target = [(up + 1) / (up + 2) if g else 1 / (len(z) - up + 2) for _, g in z]
    mean = sum(x for x, _ in z) / len(z)
    scale = max(1e-9, math.sqrt(sum((x - mean) ** 2 for x, _ in z) / len(z)))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = [sigmoid(a * x / scale + b) for x, _ in z]
        ga, gb = sum((q - t) * x / scale for q, t, (x, _) in zip(p, target, z)), sum(q - t for q, t in zip(p, target))
        haa, hab, hbb = (sum(q * (1 - q) * (x / scale) ** e for q, (x, _) in zip(p, z)) + (1e-6 if e != 1 else 0) for e in (2, 1, 0))
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return lambda t: sigmoid(a / scale * margin(quality_features(t, bits)) + b) if WORD.search(t or "") else 0.0
