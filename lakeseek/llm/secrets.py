"""Secret scan by a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

#: Characters of a candidate at least, rate of false discoveries, and the level at which the battery rejects randomness.
LEAST, RATE, LEVEL = 16, 0.01, 0.005
#: Bits that a uniformly random string of a candidate's encoding and length has at least: fewer are no key, and too few for the tests (16 digits have 53, 20 have 66).
BITS = 64

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets in the order in which they are tried; the first that holds all characters is the candidate's encoding.
ALPHABETS = {
    "decimal": _DIGIT,
    "hex": _DIGIT + "abcdef",
    "HEX": _DIGIT + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER,
    "base62": _DIGIT + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
    "token": _UPPER + _LOWER + _DIGIT + "+/-_",
}
#: Encodings of one case: a run that separators cut into parts of one of these is one string (a UUID is 32 hexadecimal digits).
_JOINED = ("decimal", "hex", "HEX", "lower", "upper", "base32", "base36", "BASE36")
#: What a character counts for in the corpus's text before any is read: letters as prose has them, the other symbols rarely.
_PRIOR = {c: 1000.0 * f for c, f in zip(_LOWER, (0.08, 0.015, 0.03, 0.04, 0.12, 0.02, 0.02, 0.055, 0.07, 0.003, 0.008, 0.04, 0.025, 0.07, 0.075, 0.02, 0.002, 0.06, 0.065, 0.09, 0.03, 0.01, 0.02, 0.003, 0.02, 0.002))}


_PARTS = re.compile("[^-_]+")


def _sf_normal(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in np.asarray(z, float).tolist()])


def _sf_chi(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Upper tail of a scaled chi-squared variable of that mean and variance (Wilson-Hilferty)."""
    df = 2 * mean**2 / var
    return _sf_normal((np.cbrt(x / mean) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))


def battery(codes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """p-values, under uniform random symbols, of each string's chi-squared, runs and serial-correlation tests, and its symbol counts."""
    n = np.diff(offsets).astype(float)
    which = K.owner(offsets)
    counts = np.bincount(which * size + codes, minlength=len(n) * size).reshape(-1, size)
    chi = (counts**2).sum(1) * size / n - n
    uniform = _sf_chi(chi, np.full(len(n), size - 1.0), 2.0 * (size - 1) * (n - 1) / n)
    inner = np.ones(len(codes), bool)
    inner[offsets[:-1]] = False  # positions with a predecessor in the same string
    high = codes >= size // 2
    turns = K.sums((inner & (high != np.concatenate([[False], high[:-1]]))).astype(np.int64), offsets)
    share = (size - size // 2) / size
    p = 2 * share * (1 - share)
    runs = 2 * _sf_normal(np.abs(turns - (n - 1) * p) / np.sqrt((n - 1) * p * (1 - p)))
    level = codes - (size - 1) / 2
    product = np.where(inner, level * np.concatenate([[0.0], level[:-1]]), 0.0)
    serial = 2 * _sf_normal(np.abs(K.sums(product, offsets)) / np.sqrt((n - 1) * ((size**2 - 1) / 12) ** 2))
    return np.clip(uniform, 1e-300, 1), np.clip(runs, 1e-300, 1), np.clip(serial, 1e-300, 1), counts


def fisher(*ps: np.ndarray) -> np.ndarray:
    """Fisher's combination of three p-values: the chi-squared tail of 6 degrees of freedom has a closed form."""
    half = -sum(np.log(p) for p in ps)
    return np.exp(-half) * (1 + half + half**2 / 2)


def not_text(counts: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """p-values of chi-squared tests that strings with these symbol counts are text of those symbol frequencies.

    The variance is that of the statistic at the string's own length, so that rare symbols in short strings
    don't pass for more than they are.
    """
    n, size = counts.sum(1).astype(float), counts.shape[1]
    q = 0.9 * frequency / max(frequency.sum(), 1) + 0.1 / size
    q = q / q.sum()
    chi = (counts**2 / q).sum(1) / n - n
    var = 2.0 * (size - 1) + ((1 / q).sum() - size**2 - 2 * size + 2) / n
    return np.clip(_sf_chi(chi, np.full(len(n), size - 1.0), var), 1e-300, 1)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rate: float = RATE, level: float = LEVEL, bits: int = BITS) -> DataFrame:
    """``(id_col, start, end, encoding, p_random, p_text)`` of each string found to be a secret (places are code points).

    In each run of at least ``least`` characters of [A-Za-z0-9+/_-], these are candidates: the run, or where hyphens and underlines cut it into
    parts of one encoding of a single case, the parts together; and each part of at least ``least`` characters, so that a prefix is
    left aside. A candidate's encoding is the smallest alphabet that holds it, and there it must have ``bits``. Nothing else keeps a string from the
    tests. Under its alphabet a chi-squared test of uniformity, a
    runs test and a serial-correlation test are combined (Fisher); a candidate that they reject at
    ``level`` is not random. Of the others a chi-squared test against the character frequencies of
    the text around all candidates of the corpus (over all 64 symbols, so that digits are rare) gives the p-value that text looks like that; within the
    candidates of an encoding and a length class (powers of two) the Benjamini-Hochberg
    rule at ``rate`` takes those that are not text. p-values are taken up to a grid of
    1/20 of a decade, so the histogram that gives the rule's thresholds stays small. Of the candidates of one run that are found, the one of
    the least p_text is returned (of equal ones the first, then the longest).

    Cases: a null or empty text has no candidates; a null id stays null; repeated rows and repeated
    strings are each tested and returned; an empty table gives an empty result; other
    columns are left out; texts of any length are scanned whole.
    """
    spark = docs.sparkSession
    names = list(ALPHABETS)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def find(batches):
        run = K.task_key()
        for part in K.slices(batches, "text"):
            out, run = _candidates(part, least, bits, run)
            yield out

    found = K.materialise(source.mapInArrow(find, "id long, run long, start long, end long, encoding int, value string, seen array<bigint>"))
    seen = found.filter("seen IS NOT NULL").select(F.posexplode("seen").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    counted = {chr(r.k): r.n for r in seen}
    symbols = ALPHABETS["token"]
    frequency = np.array([counted.get(c, 0) + _PRIOR.get(c, _PRIOR.get(c.lower(), 100.0) / 20 if c.isalpha() else 5.0) for c in symbols])

    def test(batches):
        whole = np.zeros(256, np.int64)
        whole[[ord(c) for c in symbols]] = np.arange(len(symbols))
        for b in batches:
            code = b.column("encoding").to_numpy()
            random = np.ones(len(code))
            raw, offsets = K.utf8(K.strings(b.column("value")))
            raw = np.frombuffer(raw, np.uint8)
            counts = np.bincount(K.owner(offsets) * len(symbols) + whole[raw], minlength=len(code) * len(symbols)).reshape(-1, len(symbols))
            text = not_text(counts, frequency) if len(code) else np.ones(0)
            for k in np.unique(code):
                rows = np.flatnonzero(code == k)
                alphabet = ALPHABETS[names[k]]
                lut = np.zeros(256, np.int64)
                lut[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
                each = np.diff(offsets)[rows]
                uniform, runs, serial, _ = battery(lut[raw[K.expand(offsets[rows], each)]], np.concatenate([[0], np.cumsum(each)]), len(alphabet))
                random[rows] = fisher(uniform, runs, serial)
            size = np.floor(np.log2(np.maximum(1, np.diff(offsets)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("id", "run", "start", "end", "encoding")), pa.array(size), pa.array(random), pa.array(text), pa.array(np.floor(np.minimum(-np.log10(text), 290) * 20).astype(np.int32))],
                ["id", "run", "start", "end", "encoding", "size", "p_random", "p_text", "grid"],
            )

    tested = found.filter("seen IS NULL").select("id", "run", "start", "end", "encoding", "value").mapInArrow(test, "id long, run long, start long, end long, encoding int, size int, p_random double, p_text double, grid int")
    stratum = ["encoding", "size"]
    counted = tested.filter(F.col("p_random") >= level).groupBy(*stratum, "grid").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*stratum).orderBy(F.desc("grid"))
    limits = (
        counted.withColumn("upto", F.sum("n").over(down))
        .withColumn("all", F.sum("n").over(Window.partitionBy(*stratum)))
        .filter(F.pow(F.lit(10.0), -F.col("grid") / 20) <= F.lit(rate) * F.col("upto") / F.col("all"))
        .groupBy(*stratum)
        .agg(F.min("grid").alias("limit"))
    )
    # At most one row for each encoding and power of two.
    flagged = tested.filter(F.col("p_random") >= level).join(F.broadcast(limits), stratum).filter(F.col("grid") >= F.col("limit"))
    fields = ["id", "start", "end", "encoding", "p_random", "p_text"]
    one = flagged.groupBy("run").agg(F.min(F.struct("p_text", "start", (-F.col("end")).alias("last"), F.struct(*fields).alias("row"))).alias("least")).select("least.row.*")
    named = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("encoding") + 1)
    return one.select(F.col("id").alias(id_col), "start", "end", named.alias("encoding"), "p_random", "p_text")


def _candidates(part: pa.RecordBatch, least: int, bits: int, run: int) -> tuple[pa.RecordBatch, int]:
    """A slice's candidates, with the number of their run, and one row of how often it has each ASCII character outside of them; the next run's number."""
    cp, offsets = K.codepoints(K.strings(part.column("text")))
    if "secret" not in K._LUT:
        lut = np.zeros(0x110000, np.uint8)
        lut[[ord(c) for c in ALPHABETS["token"]]] = 1
        K._LUT["secret"] = lut
    starts, ends, _ = K.runs(K._LUT["secret"].take(cp).view(bool), offsets)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    text = np.searchsorted(offsets, starts, "right") - 1
    rows = []
    sets = [(k, name in _JOINED, math.log2(len(a)), set(a)) for k, (name, a) in enumerate(ALPHABETS.items())]

    def add(t, a, b, value):
        symbols = set(value)
        k, _, each, _ = next(x for x in sets if symbols <= x[3])
        if len(value) >= least and len(value) * each >= bits:
            rows.append((t, run, a, b, k, value))

    for a, b, t in zip(starts.tolist(), ends.tolist(), text.tolist()):
        value, at = cp[a:b].tobytes().decode("utf-32-le"), a - int(offsets[t])
        parts = [m.span() for m in _PARTS.finditer(value)]
        joined = "".join(value[x:y] for x, y in parts)
        symbols = set(joined)
        if len(parts) > 1 and any(single and symbols <= own for _, single, _, own in sets):
            add(t, at + parts[0][0], at + parts[-1][1], joined)
        else:
            add(t, at, at + len(value), value)
        if len(joined) < len(value):
            for x, y in parts:
                add(t, at + x, at + y, value[x:y])
        run += 1
    t, r, a, b, k, v = zip(*rows) if rows else ([],) * 6
    ids = part.column("id").take(pa.array(t, pa.int64()))
    outside = np.bincount(cp[cp < 128], minlength=128)
    taken = cp[K.expand(starts, ends - starts)]
    seen = outside - np.bincount(taken[taken < 128], minlength=128)
    one = lambda array, kind: pa.concat_arrays([pa.array(array, kind), pa.nulls(1, kind)])
    lists = pa.array([*([None] * len(rows)), seen.tolist()], pa.list_(pa.int64()))
    columns = [pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), one(r, pa.int64()), one(a, pa.int64()), one(b, pa.int64()), one(k, pa.int32()), one(v, pa.string()), lists]
    return pa.RecordBatch.from_arrays(columns, ["id", "run", "start", "end", "encoding", "value", "seen"]), run
