"""Benchmark decontamination by winnowing: fingerprints find the places, extension finds the whole shared span."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Words of a fingerprinted gram and grams of a window: every shared span of GRAM + WINDOW - 1 words has a common fingerprint.
GRAM, WINDOW = 6, 7
#: Bytes of benchmark text up to which the benchmark is broadcast; beyond it fingerprints are joined by shuffle.
BROADCAST_BYTES = 16_000_000

_SPAN = "struct<item_id: bigint, doc_word: bigint, item_word: bigint, n_words: bigint>"


def winnow(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the grams that are the rightmost minimum of some window of their text, and the texts' offsets in them.

    A text of fewer grams than a window is one window.
    """
    count = np.diff(offsets)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    best, at = hashes.copy(), np.zeros(n, np.int8)
    room = (offsets[1:] - 1)[K.owner(offsets)] - np.arange(n)  # grams to the right in the same text
    for k in range(1, min(window, n)):
        better = np.zeros(n, bool)
        better[: n - k] = hashes[k:] <= best[: n - k]
        better &= room >= k
        best[better] = hashes[np.flatnonzero(better) + k]
        at[better] = k
    starts = K.expand(offsets[:-1], np.where(count >= window, count - window + 1, np.minimum(count, 1)))
    picked = starts + at[starts]
    picked = picked[np.concatenate([[True], picked[1:] != picked[:-1]])] if len(picked) else picked
    return picked, np.searchsorted(picked, offsets)


class Index:
    """Words and fingerprints of the benchmark items."""

    def __init__(self, ids: list[int], texts: pa.Array, gram: int, window: int):
        self.ids, self.gram, self.window, self.least = np.array(ids, np.int64), gram, window, gram + window - 1
        self.words, _, _, self.offsets = K.words(texts)
        hashes, offsets = K.grams(self.words, self.offsets, gram)
        picked, _ = winnow(hashes, offsets, window)
        item = K.owner(offsets)[picked]
        order = np.argsort(hashes[picked], kind="stable")
        self.keys, self.item, self.at = hashes[picked][order], item[order], (picked - offsets[:-1][item])[order]
        bits = min(20, max(8, len(self.keys).bit_length() + 5))
        self.mask, self.filter = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.filter[self.keys & self.mask] = True

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows (item id, document's word, item's word, words) of all maximal shared spans of at least ``least`` words, and the texts' offsets in them."""
        words, _, _, offsets = K.words(texts)
        hashes, gram_offsets = K.grams(words, offsets, self.gram)
        picked, per_text = winnow(hashes, gram_offsets, self.window)
        keys = hashes[picked]
        near = np.flatnonzero(self.filter[keys & self.mask])
        low, high = np.searchsorted(self.keys, keys[near], "left"), np.searchsorted(self.keys, keys[near], "right")
        which = np.repeat(near, high - low)
        entry = K.expand(low, high - low)
        doc = K.owner(per_text)[which]
        place = picked[which] - gram_offsets[:-1][doc]
        item, at = self.item[entry], self.at[entry]
        order = np.lexsort((place, place - at, item, doc))
        out, last = [], None
        for d, i, p, q in zip(doc[order].tolist(), item[order].tolist(), place[order].tolist(), at[order].tolist()):
            if last and last[:3] == (d, i, p - q) and p < last[3]:
                continue  # inside the span before
            a, b = words[offsets[d] : offsets[d + 1]], self.words[self.offsets[i] : self.offsets[i + 1]]
            back = min(p, q)
            same = a[p - back : p][::-1] == b[q - back : q][::-1]
            left = back if same.all() else int(np.argmin(same))
            ahead = min(len(a) - p, len(b) - q)
            same = a[p : p + ahead] == b[q : q + ahead]
            right = ahead if same.all() else int(np.argmin(same))
            last = (d, i, p - q, p + right)
            if left + right >= self.least:
                out.append((d, self.ids[i], p - left, q - left, left + right))
        found = np.array(out, np.int64).reshape(-1, 5)
        return found[:, 1:], np.searchsorted(found[:, 0], np.arange(len(texts) + 1))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("item_text")).filter("item IS NOT NULL AND item_text IS NOT NULL")


def with_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", gram: int = GRAM, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, out: str = "spans") -> DataFrame:
    """The documents with a column ``out`` of their spans shared with benchmark items.

    All maximal runs of at least gram + window - 1 words that a document and an item
    have in common are found, each with the item, the places of its first word and
    its length in words (words are [\\p{L}\\p{N}]+ of the lower-cased text).

    A benchmark of up to ``broadcast_bytes`` bytes is sent to the tasks, so that documents
    are read once and not exchanged. A larger one is joined on fingerprints by shuffle, and
    the pairs found are extended, each document meeting the items that it shares one with.

    Cases: a null or empty text, or an item without id or text or of fewer words than
    the least span, shares nothing; repeated rows are each marked; an item that stands
    there twice is found twice; with an empty table nothing is found; other columns of
    the documents stay, one named like ``out`` is replaced.
    """
    items = _items(benchmark, item_id, item_text)
    sent = _sent(items, broadcast_bytes)
    if sent:
        made: list[Index] = []

        def mark(texts: pa.Array) -> pa.Array:
            if not made:
                made.append(Index(sent.value[0], pa.array(sent.value[1], pa.large_string()), gram, window))
            parts = [_as_lists(*made[0].spans(K.strings(b.column("text")))) for b in K.slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text")]
            return pa.concat_arrays(parts) if parts else _as_lists(np.zeros((0, 4), np.int64), np.zeros(1, np.int64))

        return docs.withColumn(out, F.arrow_udf(mark, f"array<{_SPAN}>")(F.col(text_col).cast("string")))
    return _with_spans_by_shuffle(docs, items, text_col, gram, window, out)


def _sent(items: DataFrame, most: int):
    """The items as a broadcast variable, if they have at most so many bytes."""
    if items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0] > most:
        return None
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(([r.item for r in rows], [r.item_text for r in rows]))


def _as_lists(rows: np.ndarray, offsets: np.ndarray) -> pa.Array:
    struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["item_id", "doc_word", "item_word", "n_words"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), struct)


def _with_spans_by_shuffle(docs: DataFrame, items: DataFrame, text_col: str, gram: int, window: int, out: str) -> DataFrame:
    """The same for a benchmark of any size: texts are keyed by their content."""

    def prints(batches):
        for part in K.slices(batches, "text"):
            words, _, _, offsets = K.words(K.strings(part.column("text")))
            hashes, gram_offsets = K.grams(words, offsets, gram)
            picked, per_text = winnow(hashes, gram_offsets, window)
            keys, per_text = K.distinct(hashes[picked], per_text)
            yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(K.owner(per_text))), pa.array(keys.view(np.int64))], ["key", "print"])

    key = F.sha2(F.col(text_col).cast("string"), 256)
    texts = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").dropDuplicates(["key"])
    own = items.withColumn("key", F.sha2(F.concat_ws(":", "item", "item_text"), 256))
    pairs = (
        texts.mapInArrow(prints, "key string, print long")
        .join(own.select("key", F.col("item_text").alias("text")).mapInArrow(prints, "item_key string, print long".replace("item_key", "key")).withColumnRenamed("key", "item_key"), "print")
        .select("key", "item_key")
        .distinct()
    )
    # A document's text goes once to each of its salts, in front of the items there.
    each = K.materialise(pairs.withColumn("salt", F.pmod(F.xxhash64("item_key"), F.lit(16)).cast("int")))
    nothing = F.lit(None).cast("long")
    texts_of = each.select("key", "salt").distinct().join(texts, "key").select("key", "salt", nothing.alias("item"), "text")
    items_of = each.join(own.select(F.col("key").alias("item_key"), "item", F.col("item_text").alias("text")), "item_key").select("key", "salt", "item", "text")
    both = texts_of.unionByName(items_of).repartition(K.partitions(docs.sparkSession), "key", "salt").sortWithinPartitions("key", "salt", F.asc_nulls_first("item"))

    def extend(batches):
        text = None
        for part in K.slices(batches, "text"):
            keys, rows = [], [np.zeros((0, 4), np.int64)]
            for key, item, own_text in zip(*(part.column(c).to_pylist() for c in ("key", "item", "text"))):
                if item is None:
                    text = pa.array([own_text], pa.large_string())
                    continue
                rows.append(Index([item], pa.array([own_text], pa.large_string()), gram, window).spans(text)[0])
                keys += [key] * len(rows[-1])
            table = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(4))], ["key", "item_id", "doc_word", "item_word", "n_words"])

    found = both.select("key", "item", "text").mapInArrow(extend, "key string, item_id long, doc_word long, item_word long, n_words long")
    lists = found.groupBy("key").agg(F.collect_list(F.struct("item_id", "doc_word", "item_word", "n_words")).alias("spans"))
    own, there, held = (K.fresh([*docs.columns, out], c) for c in ("__key", "__found", "__held"))
    joined_back = docs.withColumn(own, key).join(lists.select(F.col("key").alias(there), F.col("spans").alias(held)), F.col(own) == F.col(there), "left")
    return joined_back.withColumn(out, F.coalesce(held, F.expr(f"CAST(array() AS array<{_SPAN}>)"))).drop(own, there, held)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", gram: int = GRAM, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each shared span: ``(id_col, item_id, doc_word, item_word, n_words)``; see ``with_spans``."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sent = _sent(_items(benchmark, item_id, item_text), broadcast_bytes)
    if not sent:
        marked = with_spans(own, benchmark, "text", item_id, item_text, gram, window, broadcast_bytes)
        return marked.select(F.col("id").alias(id_col), F.explode("spans").alias("s")).select(id_col, "s.item_id", "s.doc_word", "s.item_word", "s.n_words")

    def mark(batches):
        index = None
        for part in K.slices(batches, "text"):
            index = index or Index(sent.value[0], pa.array(sent.value[1], pa.large_string()), gram, window)
            rows, offsets = index.spans(K.strings(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(K.owner(offsets))), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4))], ["id", "item_id", "doc_word", "item_word", "n_words"])

    return own.mapInArrow(mark, "id long, item_id long, doc_word long, item_word long, n_words long").withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that share no span with the benchmark, with their columns as they are; see ``with_spans``."""
    spans = K.fresh(docs.columns, "__spans")
    return with_spans(docs, benchmark, text_col, out=spans, **options).filter(F.size(spans) == 0).drop(spans)
