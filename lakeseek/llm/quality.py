"""Quality rules: hashed word and character n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Hashed features, labelled rows that the model is fitted on at most, and the probability of good quality from which a document is kept.
BITS, SAMPLE, KEEP = 18, 4000, 0.5
#: Fixed thresholds of the probability; a document's grade is how many of them it reaches.
GRADES = (0.1, 0.5, 0.9)
#: Length of the character grams.
CHARS = 3
_FIT_CHARS = 300_000
_EPOCHS, _RATE, _L2 = 120, 0.3, 1e-7
#: Features that one pass takes at once.
_STEP = 1 << 19


#: Feature of a word's pair with itself.
_SAME = 0x2A5A5


def _repeats(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of each text are the same as the one before."""
    same = np.zeros(len(words), np.int64)
    same[1:] = words[1:] == words[:-1]
    same[offsets[:-1][offsets[:-1] < len(words)]] = 0
    return K.sums(same, offsets)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the texts: index, weight, and the texts' offsets in them.

    Each distinct word and word pair of a text weighs 1 / its words, so that the
    weights of a text that repeats itself sum to little; each character gram of the
    text as it stands weighs 1 / its character grams.
    """
    cp, offsets = K.codepoints(texts)
    n, lut = len(cp), K.table("word", r"[\p{L}\p{N}]")
    starts, ends, per_text = K.runs(lut.take(cp).view(bool), offsets)
    hashed = K.span_hash(K.prefix_sums(cp), starts, ends)
    mask = np.uint64((1 << bits) - 1)
    count = np.maximum(1, np.diff(per_text))
    parts = []
    for size in (1, 2):
        own, own_offsets = (hashed, per_text) if size == 1 else K.grams(hashed, per_text, 2)
        own, own_offsets = K.distinct(own, own_offsets)
        text = K.owner(own_offsets)
        parts.append(((own & mask).astype(np.uint32), (1.0 / count[text]).astype(np.float32), text))
    again = _repeats(hashed, per_text)
    parts.append((np.full(len(again), _SAME & int(mask), np.uint32), (again / count).astype(np.float32), np.arange(len(again))))
    if n >= CHARS:
        grams = np.zeros(n - CHARS + 1, np.uint32)
        for k in range(CHARS):
            grams *= np.uint32(0x9E3779B1)
            grams += cp[k : n - CHARS + 1 + k]
        grams *= np.uint32(0x85EBCA6B)
        grams >>= np.uint32(32 - bits)
        each = np.maximum(np.diff(offsets) - CHARS + 1, 0)
        text = np.repeat(np.arange(len(each)), each)
        parts.append((grams[K.expand(offsets[:-1], each)], (1.0 / np.maximum(1, each))[text].astype(np.float32), text))
    index, weight, text = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(text, kind="stable")
    return index[order], weight[order], np.searchsorted(text[order], np.arange(len(texts) + 1))


def margins(texts: pa.Array, model: np.ndarray, bits: int) -> np.ndarray:
    """What the features of each text sum to under the model, its constant with them."""
    cp, offsets = K.codepoints(texts)
    n, lut = len(cp), K.table("word", r"[\p{L}\p{N}]")
    starts, ends, per_text = K.runs(lut.take(cp).view(bool), offsets)
    hashed = K.span_hash(K.prefix_sums(cp), starts, ends)
    mask = np.uint64((1 << bits) - 1)
    out = np.full(len(texts), float(model[-1]))
    count = np.maximum(1, np.diff(per_text))
    for size in (1, 2):
        own, own_offsets = K.distinct(*((hashed, per_text) if size == 1 else K.grams(hashed, per_text, 2)))
        out += K.sums(model[own & mask].astype(np.float64), own_offsets) / count
    out += float(model[_SAME & int(mask)]) * _repeats(hashed, per_text) / count
    if n >= CHARS:
        grams = np.zeros(n - CHARS + 1, np.uint32)
        for k in range(CHARS):
            grams *= np.uint32(0x9E3779B1)
            grams += cp[k : n - CHARS + 1 + k]
        grams *= np.uint32(0x85EBCA6B)
        grams >>= np.uint32(32 - bits)
        total = np.concatenate([[0.0], np.cumsum(model[grams], dtype=np.float64), np.zeros(CHARS)])
        each = np.maximum(np.diff(offsets) - CHARS + 1, 0)
        out += (total[offsets[:-1] + each] - total[np.minimum(offsets[:-1], len(total) - 1)]) / np.maximum(1, each)
    return out


def sparse(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of the texts with those of one index added up: text, index, weight, in that order."""
    size, parts, first = 1 << bits, [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))], 0
    for part in K.slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text", _FIT_CHARS):
        own, own_weight, offsets = features(part.column("text"), bits)
        both, at = np.unique(K.owner(offsets) * size + own, return_inverse=True)
        parts.append(((both // size + first).astype(np.int32), (both % size).astype(np.int32), np.bincount(at, own_weight, len(both)).astype(np.float32)))
        first += part.num_rows
    return tuple(np.concatenate(x) for x in zip(*parts))


def fit(text: np.ndarray, index: np.ndarray, weight: np.ndarray, good: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Weights, constant, and slope and shift of the calibration, in one array, of rows of ``sparse`` features.

    Three quarters of the rows fit the weights (full-batch Adagrad, both classes of the
    same total weight), the others the calibration (Platt scaling). With one class or no rows
    the model is the constant (good + 1) / (rows + 2).
    """
    n, size = len(good), 1 << bits
    if n < 8 or good.all() or not good.any():
        p = (good.sum() + 1) / (n + 2)
        return np.concatenate([np.zeros(size + 1), [1.0, np.log(p / (1 - p))]]).astype(np.float32)
    held = np.arange(n) % 4 == 3
    if good[held].all() or not good[held].any() or good[~held].all() or not good[~held].any():
        held[:] = False
    own = ~held[text]
    index_fit, weight_fit, text_fit = index[own], weight[own], text[own]
    y = good.astype(np.float64)
    share = np.where(good, 0.5 / max(1, (good & ~held).sum()), 0.5 / max(1, (~good & ~held).sum())) * ~held
    w, constant, seen, seen_constant = np.zeros(size), 0.0, np.full(size, 1e-12), 1e-12
    for _ in range(_EPOCHS):
        z = _margins(w, text_fit, index_fit, weight_fit, n) + constant
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        slope = _L2 * w
        for a in range(0, len(text_fit), _STEP):
            cut = slice(a, a + _STEP)
            slope += np.bincount(index_fit[cut], error[text_fit[cut]] * weight_fit[cut], size)
        seen += slope**2
        w -= _RATE * 10 * slope / np.sqrt(seen)
        seen_constant += error.sum() ** 2
        constant -= _RATE * error.sum() / np.sqrt(seen_constant)
    z = _margins(w, text, index, weight, n) + constant
    rows = held if held.any() else np.ones(n, bool)
    a, b = _platt(z[rows], y[rows])
    return np.concatenate([w, [constant, a, b]]).astype(np.float32)


def _margins(w: np.ndarray, text: np.ndarray, index: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for a in range(0, len(text), _STEP):
        cut = slice(a, a + _STEP)
        out += np.bincount(text[cut], w[index[cut]] * weight[cut], n)
    return out


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that calibrate margins, by Newton's method on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(float(np.std(z)), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        ab -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0] / scale), float(ab[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", sample: int = SAMPLE, bits: int = BITS) -> np.ndarray:
    """Fit on at most ``sample`` labelled rows (a label with its document), those of the least hash of the id.

    The tasks that read the texts hash their features; one task gets these, at most 2^bits numbers of a row
    however long its text is, and sends the weights back.
    """
    seed = 17
    order = (F.xxhash64("id", F.lit(seed)), "id", "label")
    picked = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL").orderBy(*order).limit(sample)
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    # At most ``sample`` labels are broadcast, and as many of their rows go on, should ids be repeated.
    rows = known.join(F.broadcast(picked), "id").orderBy(*order, F.xxhash64("text")).limit(sample)

    def hashed(batches):
        for part in K.slices(batches, "text", _FIT_CHARS):
            text, index, weight = sparse(K.strings(part.column("text")), bits)
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("hash"), cut(index), cut(weight)], ["id", "label", "hash", "index", "weight"])

    def one(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("id", "ascending"), ("label", "ascending"), ("hash", "ascending")])
        rows = rows.take(pa.array(np.random.default_rng(seed).permutation(rows.num_rows)))
        index = [np.frombuffer(x, np.int32) for x in rows["index"].to_pylist()]
        weight = np.concatenate([np.frombuffer(x, np.float32) for x in rows["weight"].to_pylist()])
        text = np.repeat(np.arange(len(index), dtype=np.int32), [len(x) for x in index])
        model = fit(text, np.concatenate(index), weight, rows["label"].to_numpy() > 0, bits)
        return pa.table({"model": pa.array([model.tobytes()], pa.binary())})

    made = rows.select("id", "label", F.xxhash64("text").alias("hash"), "text").repartition(K.partitions(docs.sparkSession)).mapInArrow(hashed, "id long, label int, hash long, index binary, weight binary")
    sent = made.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(one, "model binary").collect()
    none = np.zeros(0, np.int32)
    return np.frombuffer(sent[0].model, np.float32) if sent else fit(none, none, none.astype(np.float32), np.zeros(0, bool), bits)


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS, out: str = "p_quality", **options) -> DataFrame:
    """The documents with the calibrated probability that their quality is good.

    A logistic regression on hashed words, word pairs and character grams is fitted on
    a bounded sample of the labelled rows (``sample``, a parameter); all documents are scored over their
    whole texts in Arrow batches, in the same pass that reads them.

    Cases: a null text, or one without any letter or digit, has probability 0; labels without id or label are left out, and
    repeated ones count each; without labels of both classes everything has the share
    of good labels (0.5 without any); repeated rows get equal values; an empty table gives
    an empty result; other columns stay, one named like ``out`` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, sample=sample, bits=bits, **options))

    def score(texts: pa.Array) -> pa.Array:
        w, out = model.value, []
        letters = K.table("word", r"[\p{L}\p{N}]")
        for part in K.slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
            own = K.strings(part.column("text"))
            z = margins(own, w[: (1 << bits) + 1], bits)
            p = 1 / (1 + np.exp(-np.clip(float(w[-2]) * z + float(w[-1]), -30, 30)))
            cp, offsets = K.codepoints(own)
            p[K.sums((letters.take(cp) > 0).astype(np.int64), offsets) == 0] = 0
            out.append(p)
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(out, F.arrow_udf(score, "double")(F.col(text_col).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, grades: tuple[float, ...] = GRADES, **options) -> DataFrame:
    """``(id_col, p_quality, keep, grade)`` of each document: whether its probability reaches ``keep``, and how many of the fixed ``grades`` it reaches (of equal to one, it does); see ``with_quality``."""
    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text"))
    grade = sum((F.col("p_quality") >= g).cast("int") for g in grades) if grades else F.lit(0)
    return with_quality(own, labels, id_col, "__text", **options).select(id_col, "p_quality", (F.col("p_quality") >= keep).alias("keep"), grade.alias("grade"))


def quality_filter(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """The documents of probability ``keep`` or more, with their columns as they are."""
    p = K.fresh(docs.columns, "__quality")
    return with_quality(docs, labels, out=p, **options).filter(F.col(p) >= keep).drop(p)
