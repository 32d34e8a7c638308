"""Numpy kernels over Arrow string columns, shared by the training-data operators.

Everything here works on a *slice* of rows at a time (``slices``), so memory
follows the slice and the longest single text, never the partition.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Characters of text that one slice holds at most (one longer text is a slice of its own).
SLICE_CHARS = 2_000_000

#: Items that one pass over a long array takes at once, so that what it needs besides stays small.
_STEP = 1 << 18

_R = U64(0x9E3779B97F4A7C15)
_LUT: dict[str, np.ndarray] = {}
_POW = np.ones(1, U64)
_INV = np.ones(1, U64)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``limit`` bytes a slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def strings(column: pa.Array) -> pa.Array:
    """The column as large_string without nulls (a null text counts as an empty one)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def table(name: str, *patterns: str) -> np.ndarray:
    """uint8 by code point: k + 1 for the first regular expression that matches it, else 0."""
    if name not in _LUT:
        import regex

        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        out = np.zeros(0x110000, np.uint8)
        for k, pattern in reversed(list(enumerate(patterns))):
            for m in regex.finditer(f"(?:{pattern})+", text):
                shift = [x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1)]
                out[shift[0] : shift[1] + 1] = k + 1
        _LUT[name] = out
    return _LUT[name]


def codepoints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets of the texts in them."""
    offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return np.frombuffer(utf8(texts)[0].decode("utf-8").encode("utf-32-le"), np.uint32), offsets


def utf8(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of the texts in them."""
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        inverse = U64(pow(int(_R), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POW = np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, _R))])
            _INV = np.concatenate([[U64(1)], np.cumprod(np.full(size - 1, inverse))])
    return _POW[:n], _INV[:n]


def prefix_sums(cp: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``span_hash`` takes the hash of any span out of them."""
    powers, out = _powers(len(cp))[0], np.zeros(len(cp) + 1, U64)
    for a in range(0, len(cp), _STEP):
        v = cp[a : a + _STEP].astype(U64)
        v += U64(0x632BE5AB)
        v *= U64(0xC2B2AE3D27D4EB4F)
        v ^= v >> U64(29)
        v *= powers[a : a + _STEP]
        part = out[a + 1 : a + 1 + len(v)]
        np.cumsum(v, out=part)
        part += out[a]
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    inverse = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross texts: starts, ends, and offsets of the texts in the runs."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ([\\p{L}\\p{N}]+ of the lower-cased text): 64-bit hashes, code point starts and ends, offsets of the texts in the words.

    Lower-casing can change a text's length, so positions refer to ``lower(text)``.
    """
    cp, offsets = codepoints(pc.utf8_lower(texts))
    starts, ends, per_text = runs(table("word", r"[\p{L}\p{N}]").take(cp).view(bool), offsets)
    return span_hash(prefix_sums(cp), starts, ends), starts, ends, per_text


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words, and the texts' offsets in them; a text of fewer than n words has none."""
    count = np.maximum(np.diff(offsets) - (n - 1), 0)
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    if not out_offsets[-1]:
        return np.zeros(0, U64), out_offsets
    whole = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        whole *= U64(0xBF58476D1CE4E5B9)
        whole += hashes[k : len(whole) + k]
    return mix(whole)[expand(offsets[:-1], count)], out_offsets


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)


def owner(offsets: np.ndarray) -> np.ndarray:
    """Index of the text of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values (0 where it has none)."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and the new offsets."""
    if not len(values):
        return values, offsets
    out, at = [], np.zeros(len(offsets), np.int64)
    for k in range(len(offsets) - 1):
        part = np.sort(values[offsets[k] : offsets[k + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        out.append(part)
        at[k + 1] = at[k] + len(part)
    return np.concatenate(out), at


def pack(array: np.ndarray, codec: str = "lz4") -> bytes:
    """Bytes of an integer array, each byte plane on its own and compressed (8 bytes of head: the length)."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.copy() if len(raw) else np.zeros(0, np.uint8)
    return len(raw).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec=codec, asbytes=True)


def unpack(raw: bytes, dtype, codec: str = "lz4") -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * size, codec=codec, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(dtype)


def fresh(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_key() -> int:
    """The task's partition in the high bits, for keys that a retry of the task gives again."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def ensure_checkpoint_dir(spark) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` has set; where neither is (tests), and all runs on this machine, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = f"file://{tempfile.gettempdir()}/lakeseek-checkpoints-{os.getuid()}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def materialise(df):
    """Cut the lineage through the shared checkpoint folder (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark, name: str) -> str:
    """A fresh folder for a written table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark, path: str) -> None:
    """Delete a written table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
