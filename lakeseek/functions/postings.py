"""Postings as packed lists: for each key of a group of rows, the numbers of the rows that have it, as gaps in bytes of 7 bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .counts import slices

#: Postings that are sorted at once.
HELD = 1_500_000


def _packed(numbers: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Ascending lists that begin at ``starts``, each as its first number and gaps, the low 7 bits first; the eighth bit says that more follow."""
    gaps = np.diff(numbers, prepend=0)
    gaps[starts] = numbers[starts]
    width = 1 + sum((gaps >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        some = np.flatnonzero(width > k)
        out[at[some] + k] = (gaps[some] >> 7 * k & 127) | ((width[some] > k + 1).astype(np.int64) << 7)
    ends = np.append(at[starts], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each has."""
    raw = np.frombuffer(b"".join(lists.to_pylist()), np.uint8)
    size = pc.binary_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    last = raw < 128
    starts = np.append(0, np.flatnonzero(last)[:-1] + 1) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    gaps = np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts) if len(raw) else np.zeros(0, np.int64)
    seen = np.append(0, np.cumsum(last))
    ends = np.append(0, np.cumsum(size))
    n = seen[ends[1:]] - seen[ends[:-1]]
    first, total = np.cumsum(n) - n, np.cumsum(gaps)
    return total - np.repeat((total - gaps)[first], n), n


def packed_postings(rows: DataFrame, group: list[str], keys: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]) -> DataFrame:
    """``(group, gram, uids)``: the distinct ``uid`` of the rows that have each key, in a list for so many postings as a task holds at once; so a key has several lists.

    ``keys`` cuts a batch into parts, and gives the keys of all rows of each (longs, which may repeat), and how many each row has.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*group).schema) + ", gram long, uids binary"
    most = HELD

    def lists(names: tuple, uid: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        coded = pa.array(key).dictionary_encode()
        known, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(known)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        base = uid.min()
        if int(uid.max() - base) < 1 << 32:
            both = np.sort((rank[codes] << 32) | (uid - base))
            both = both[np.append(True, both[1:] != both[:-1])]
            of, uid = both >> 32, (both & 0xFFFFFFFF) + base
        else:
            at = np.lexsort((uid, rank[codes]))
            of, uid = rank[codes][at], uid[at]
            new = np.append(True, (of[1:] != of[:-1]) | (uid[1:] != uid[:-1]))
            of, uid = of[new], uid[new]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        packed = _packed(uid, starts)
        return pa.RecordBatch.from_arrays([*(pa.repeat(x, len(starts)) for x in names), pa.array(known[order][of[starts]]), packed], [*group, "gram", "uids"])

    def f(batches):
        held: dict[tuple, list] = {}
        n = 0
        for whole in batches:
            for part, key, count in keys(whole):
                coded = [part.column(c).dictionary_encode() for c in group]
                codes = np.stack([c.indices.to_numpy() for c in coded])
                uid = part.column("uid").to_numpy()
                distinct, own = np.unique(codes, axis=1, return_inverse=True)
                own = own.ravel()
                for g in range(distinct.shape[1]):
                    names = tuple(c.dictionary[int(k)] for c, k in zip(coded, distinct[:, g]))
                    mine = own == g
                    held.setdefault(names, []).append((np.repeat(uid[mine], count[mine]), key[np.repeat(mine, count)]))
                n += len(key)
                if n >= most:
                    yield from (lists(names, *map(np.concatenate, zip(*x))) for names, x in held.items() if any(len(k) for _, k in x))
                    held, n = {}, 0
        yield from (lists(names, *map(np.concatenate, zip(*x))) for names, x in held.items() if any(len(k) for _, k in x))

    return rows.mapInArrow(f, schema)


def unpacked(postings: DataFrame, columns: list[str]) -> DataFrame:
    """``(columns, uid)``: a row for each number of the lists ``uids``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in postings.select(*columns).schema) + ", uid long"

    def f(batches):
        for whole in batches:
            for part in slices(whole, pc.binary_length(whole.column("uids")).to_numpy(zero_copy_only=False), 1_000_000):
                uid, n = _unpacked(part.column("uids"))
                own = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(own) for c in columns), pa.array(uid)], [*columns, "uid"])

    return postings.select(*columns, "uids").mapInArrow(f, schema)
