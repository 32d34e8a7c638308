"""Licence scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .license_templates import TEMPLATES

#: Words of a shingle, and the share of a template's shingles that a text must hold.
SHINGLE, CONTAINMENT = 3, 0.8
#: Probability that the bands of one window miss a match at most, and rows of a band.
MISS, ROWS = 0.01, 2
#: Longest window in shingles; a longer template is retrieved by any of its parts of that length.
LONGEST = 32


def settings(containment: float = CONTAINMENT, miss: float = MISS) -> dict[int, tuple[int, int, int]]:
    """Window length -> (stride, rows of a band, bands).

    Parts of up to 4 shingles have windows of just their length at every place, so that a
    copy has a window of the same set. Longer parts have the next power of two as
    window and a quarter of it as stride. A part of more than half a window, of which the
    needed share is there, then has a Jaccard similarity j of about kept / (window + part - kept) with some
    window, and the bands are as many as 1 - (1 - j^rows)^bands >= 1 - miss needs.
    """
    out = {size: (1, 1, 1) for size in (1, 2, 3, 4)}
    for size in (8, 16, LONGEST):
        part = size // 2 + 1
        kept = containment * part
        j = kept / (size + part - kept)
        out[size] = (size // 4, ROWS, math.ceil(math.log(miss) / math.log(1 - j**ROWS)))
    return out


def needed(size: int, containment: float = CONTAINMENT) -> int:
    """Shingles that a text must hold of a template of that many."""
    return math.ceil(round(containment * size, 9))


class Templates:
    """Shingles of all templates, and the band keys of their parts by window length."""

    def __init__(self, templates: dict[str, str], containment: float):
        self.names, self.containment = list(templates), containment
        words, _, _, offsets = K.words(pa.array(list(templates.values()), pa.large_string()))
        shingles, at = K.grams(words, offsets, SHINGLE)
        self.shingles = [np.unique(shingles[a:b]) for a, b in zip(at, at[1:])]
        self.by_size, plan = {}, settings(containment)
        n = max(rows * bands for _, rows, bands in plan.values())
        rng = np.random.default_rng(41)
        self.factor = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
        for k, (a, b) in enumerate(zip(at, at[1:])):
            for c in range(a, b, LONGEST):
                part = shingles[c : min(b, c + LONGEST)]
                size = next(s for s in plan if len(part) <= s)
                stride, rows, bands = plan[size]
                entry = self.by_size.setdefault(size, (stride, rows, bands, [[] for _ in range(bands)]))
                least = [self.hashed(part, h).min() for h in range(rows * bands)]
                for band in range(bands):
                    entry[3][band].append((int(self.key([np.array([x]) for x in least[band * rows : (band + 1) * rows]])[0]), k))
        for size, (stride, rows, bands, keys) in self.by_size.items():
            tables = []
            for own in keys:
                own.sort()
                lut = np.zeros(1 << 16, bool)
                lut[[x & 0xFFFF for x, _ in own]] = True
                tables.append((lut, np.array([x for x, _ in own], np.uint32), np.array([k for _, k in own])))
            self.by_size[size] = (stride, rows, bands, tables)

    def hashed(self, shingles: np.ndarray, h: int) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32) * self.factor[h] + self.shift[h]
        return x ^ (x >> np.uint32(15))

    @staticmethod
    def key(least: list[np.ndarray]) -> np.ndarray:
        out = least[0].astype(np.uint32)
        for x in least[1:]:
            out = out * np.uint32(0x9E3779B1) + x
        return out ^ (out >> np.uint32(16))

    def candidates(self, shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pairs (text, template) of which some window has a band in common."""
        n, found = len(shingles), []
        if not n:
            return np.zeros((0, 2), np.int64)
        ladder = sorted(self.by_size)
        kept: dict[int, dict[int, np.ndarray]] = {}
        for h in range(max((r * b for _, r, b, _ in self.by_size.values()), default=0)):
            level, width = self.hashed(shingles, h), 1  # minima of consecutive runs of ``width`` shingles, not overlapping
            for size in ladder:
                stride, rows, bands, tables = self.by_size[size]
                if h >= rows * bands:
                    continue
                while width < stride:
                    level = np.minimum.reduceat(level, np.arange(0, len(level), 2)) if len(level) % 2 else np.minimum(level[::2], level[1::2])
                    width *= 2
                blocks = size // stride
                least = level
                if blocks > 1:
                    least = level.copy()
                    for k in range(1, blocks):
                        np.minimum(least[: len(level) - k], level[k:], out=least[: len(level) - k]) if len(level) > k else None
                kept.setdefault(size, {})[h % rows] = least
                if h % rows == rows - 1:
                    lut, keys, which = tables[h // rows]
                    key = self.key([kept[size][k] for k in range(rows)])
                    hit = np.flatnonzero(lut[key & np.uint32(0xFFFF)])
                    low, high = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                    some = high > low
                    if some.any():
                        hit, low, high = hit[some], low[some], high[some]
                        template = which[K.expand(low, high - low)]
                        begin = np.repeat(hit, high - low) * stride
                        # A window may reach over texts; each of them is a candidate.
                        first = np.searchsorted(offsets, begin, "right") - 1
                        last = np.searchsorted(offsets, np.minimum(begin + size, n) - 1, "right") - 1
                        found.append(np.stack([K.expand(first, last - first + 1), np.repeat(template, last - first + 1)], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text, template, shingles in common, shingles of the template) of all verified matches."""
        words, _, _, offsets = K.words(texts)
        shingles, at = K.grams(words, offsets, SHINGLE)
        out, own, last = [], None, -1
        for text, template in self.candidates(shingles, at).tolist():
            if text != last:
                own, last = np.unique(shingles[at[text] : at[text + 1]]), text
            want = self.shingles[template]
            if len(own):
                place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                common = int((own[place] == want).sum())
                if common >= needed(len(want), self.containment):
                    out.append((text, template, common, len(want)))
        return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """``(id_col, license, n_shared, containment)``: the templates of whose word trigrams a document holds a share of ``containment`` at least ; one rule for notices of a line and for whole licences.

    Overlapping windows of each text's trigrams have MinHash signatures in bands (``settings``
    derives stride and bands from the similarity that a match has with its best
    window, so that at most ``MISS`` of matching windows are missed; a template of
    up to 4 trigrams is never missed). Bands in common with a template retrieve it, and its
    trigrams are then counted exactly in the document. The templates are a fixed list.

    Cases: a null or empty text, or one of fewer than three words, matches nothing, nor does
    such a template; a null id stays null; repeated rows each give their matches, and a template that
    stands several times in a text gives one row; an empty table gives an empty result;
    other columns are left out; a text of any length is scanned whole.
    """
    listed = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if v}
    made: list[Templates] = []
    sent = docs.sparkSession.sparkContext.broadcast(listed)  # a fixed list

    def scan(batches):
        if not made:
            made.append(Templates(sent.value, containment))
        for part in K.slices(batches, "text"):
            rows = made[0].matches(K.strings(part.column("text"))) if made[0].names else []
            text, template, common, size = map(list, zip(*rows)) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(text, pa.int64())), pa.array([made[0].names[k] for k in template], pa.string()), pa.array(common, pa.int64()), pa.array([c / n for c, n in zip(common, size)], pa.float64())],
                ["id", "license", "n_shared", "containment"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, "id long, license string, n_shared long, containment double").withColumnRenamed("id", id_col)
