"""Word counts of rows, and what a BM25 index needs of them, by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .scoring import K1, B

_WORDS = 2_000_000


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in runs of ``most`` in size, or of one row."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings, and the number of each string's."""
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def word_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, length, terms, counts)`` of each row's ``words`` (not null): how many there are, the distinct ones, and how often each is there. A row's words are together, so nothing is exchanged."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", length long, terms array<string>, counts array<int>"
    most = _WORDS

    def f(batches):
        for whole in batches:
            for part in slices(whole, _lengths(whole.column("words")), most):
                length = _lengths(part.column("words"))
                words, codes = _coded(part.column("words").flatten())
                n = max(1, len(words))
                key, count = np.unique(np.repeat(np.arange(len(length)), length) * n + codes, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(length) + 1) * n), pa.int32())
                terms = pa.ListArray.from_arrays(ends, words.take(pa.array(key % n)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(length), terms, pa.ListArray.from_arrays(ends, pa.array(count, pa.int32()))], [*keys, "length", "terms", "counts"])

    return rows.select(*keys, "words").mapInArrow(f, schema)


def _by_group(counted: DataFrame, groups: dict[tuple, int], schema: str, f: Callable) -> DataFrame:
    """``f(batch, group of each row, row of each term, distinct terms, code of each term)`` over runs of rows that ``groups`` numbers by ``(index_id, file_path)``."""
    most = _WORDS

    def run(batches):
        for whole in batches:
            for part in slices(whole, _lengths(whole.column("terms")), most):
                ids, a = _coded(part.column("index_id"))
                files, b = _coded(part.column("file_path"))
                pairs, each = np.unique(a * max(1, len(files)) + b, return_inverse=True)
                ids, files = ids.to_pylist(), files.to_pylist()
                group = np.array([groups[ids[p // len(files)], files[p % len(files)]] for p in pairs.tolist()], np.int64)[each]
                row = np.repeat(np.arange(part.num_rows), _lengths(part.column("terms")))
                yield f(part, group, row, *_coded(part.column("terms").flatten()))

    return counted.mapInArrow(run, schema)


def block_scores(counted: DataFrame, groups: dict[tuple, int], means: list[float]) -> DataFrame:
    """``(file, term, uid, score)``: greatest BM25 factor of each term in each block, in hundredths, cut off (``scoring``). ``file`` is the number of ``(index_id, file_path)`` in ``groups``, whose mean length is in ``means``. A block that goes over the end of a batch comes twice."""
    mean = np.array(means)

    def f(part, group, row, terms, codes):
        uid, length = part.column("uid").to_numpy(zero_copy_only=False), part.column("length").to_numpy()
        new = np.concatenate([[True], (uid[1:] != uid[:-1]) | (group[1:] != group[:-1])])
        block, first = np.cumsum(new) - 1, np.flatnonzero(new)
        tf = part.column("counts").flatten().to_numpy().astype(np.float64)
        score = np.floor(tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length[row] / mean[group[row]])) * 100).astype(np.int64)
        key = np.sort(((codes * len(first) + block[row]) << 9) | score)  # less than 100 (K1 + 1), so 9 bits hold it; the last of equal keys is the greatest
        key = key[np.concatenate([key[1:] >> 9 != key[:-1] >> 9, [True]])] if len(key) else key
        at = first[(key >> 9) % len(first)]
        return pa.RecordBatch.from_arrays([pa.array(group[at], pa.int32()), terms.take(pa.array((key >> 9) // len(first))), pa.array(uid[at]), pa.array(key & 511)], ["file", "term", "uid", "score"])

    return _by_group(counted, groups, "file int, term string, uid long, score long", f)


def row_counts(counted: DataFrame, groups: dict[tuple, int]) -> DataFrame:
    """``(file, term, df)``: in how many rows each term is, summed up where the rows are."""

    def f(part, group, row, terms, codes):
        key, n = np.unique(group[row] * max(1, len(terms)) + codes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key // max(1, len(terms)), pa.int32()), terms.take(pa.array(key % max(1, len(terms)))), pa.array(n)], ["file", "term", "df"])

    return _by_group(counted, groups, "file int, term string, df long", f)
