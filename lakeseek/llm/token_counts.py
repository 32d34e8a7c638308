"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K

#: Distinct pre-tokens whose counts a task keeps at most.
KNOWN = 2_000_000

_ROWS = "block long, bucket int, part int, payload binary"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = bpe.RANKS, buckets: int | None = None) -> DataFrame:
    """Tokens of each document: ``(id_col, n_tokens, n_pretokens)``, one row for each input row.

    The texts are cut into blocks. A block has a dictionary of its distinct
    pre-tokens and, for each document, how often it holds which of them. Only the
    dictionaries are exchanged by pre-token: all copies of a pre-token meet in one
    bucket, where its pieces are counted once. The counts then join the block's
    frequencies, and a product and a sum give the documents' tokens. No ids are
    made for whole texts.

    Cases: a null or empty text has 0 tokens; a null id is kept as null; repeated
    rows and ids give a row each; an empty table gives an empty result; other
    columns are neither read nor returned; a text of any length is one row of
    its block.
    """
    spark = docs.sparkSession
    parts = K.partitions(spark)
    bpe.ship(spark, ranks)
    buckets = buckets or parts
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def split(batches):
        block = K.task_key()
        for part in K.slices(batches, "text", bpe.BLOCK_BYTES):
            vocabulary, codes, offsets = bpe.local_vocabulary(K.strings(part.column("text")))
            pairs, counts = np.unique(K.owner(offsets) * max(1, len(vocabulary)) + codes, return_counts=True)
            doc, code = np.divmod(pairs, max(1, len(vocabulary)))
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
            delta = np.diff(code, prepend=0)
            delta[bounds[:-1][bounds[:-1] < len(code)]] = code[bounds[:-1][bounds[:-1] < len(code)]]  # each document starts anew
            head = [_ids(part.column("id")), K.pack(bounds.astype(np.uint32)), K.pack(delta.astype(np.uint32), "zstd"), K.pack(counts.astype(np.uint32), "zstd"), K.pack(np.diff(offsets).astype(np.uint32))]
            hashed = _bucket(vocabulary, buckets)
            order = np.argsort(hashed, kind="stable")
            edges = np.searchsorted(hashed[order], np.arange(buckets + 1))
            head.append(K.pack(order.astype(np.uint32)))
            yield _batch([(block, block % buckets, -1, _join(head))])
            sorted_words = vocabulary.take(pa.array(order))
            rows = []
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    rows.append((block, b, b, _binary(sorted_words.slice(edges[b], edges[b + 1] - edges[b]))))
            yield _batch(rows)
            block += 1

    def count(batches):
        known, one = {}, bpe.encoding(ranks)._encode_single_piece
        for batch in batches:
            rows = []
            for block, bucket, part, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if part >= 0:
                    counts = []
                    for word in _words(payload):
                        n = known.get(word)
                        if n is None:
                            if len(known) >= KNOWN:
                                known.clear()  # what comes again is counted again
                            n = known[word] = len(one(word))
                        counts.append(n)
                    payload = K.pack(np.array(counts, np.uint32))
                rows.append((block, bucket, part, payload))
            yield _batch(rows)

    def total(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["part"].to_pylist(), group["payload"].to_pylist()), key=lambda x: x[0])
        ids, bounds, delta, counts, pretokens, order = _split(rows[0][1])
        bounds, delta = K.unpack(bounds, np.uint32).astype(np.int64), K.unpack(delta, "uint32", "zstd").astype(np.int64)
        counts, order = K.unpack(counts, "uint32", "zstd").astype(np.int64), K.unpack(order, np.uint32)
        by_code = np.zeros(len(order), np.int64)
        if len(order):
            by_code[order] = np.concatenate([K.unpack(x, np.uint32) for _, x in rows[1:]])
        running = np.cumsum(delta)
        base = np.zeros(len(delta), np.int64)
        if len(delta):
            lead = np.concatenate([[0], running])[bounds[:-1]]
            base = np.repeat(lead, np.diff(bounds))
        tokens = K.sums(by_code[running - base] * counts, bounds)
        return pa.table({"id": _read_ids(ids), "n_tokens": tokens, "n_pretokens": K.unpack(pretokens, np.uint32).astype(np.int64)})

    counted = source.mapInArrow(split, _ROWS).repartition(parts, "bucket").mapInArrow(count, _ROWS)
    out = counted.groupBy("block").applyInArrow(total, "id long, n_tokens long, n_pretokens long")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_pretokens")


def _bucket(vocabulary: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each pre-token, by its bytes alone."""
    _, offs, data = vocabulary.buffers()
    offsets = np.frombuffer(offs, np.int64, len(vocabulary) + 1, vocabulary.offset * 8)
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    hashed = K.span_hash(K.prefix_sums(raw), offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
    return (hashed % np.uint64(buckets)).astype(np.int64)


def _binary(words: pa.Array) -> bytes:
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint32)
    _, offs, data = words.buffers()
    offsets = np.frombuffer(offs, np.int64, len(words) + 1, words.offset * 8)
    raw = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()
    return _join([K.pack(lengths), len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)])


def _words(payload: bytes) -> list[bytes]:
    lengths, raw = _split(payload)
    text = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="lz4", asbytes=True)
    bounds = np.concatenate([[0], np.cumsum(K.unpack(lengths, np.uint32), dtype=np.int64)]).tolist()
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def _join(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _split(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _ids(column: pa.Array) -> bytes:
    valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
    return _join([K.pack(pc.fill_null(column, 0).to_numpy(zero_copy_only=False)), K.pack(valid.view(np.uint8))])


def _read_ids(raw: bytes) -> pa.Array:
    values, valid = _split(raw)
    return pa.array(K.unpack(values, np.int64), mask=~K.unpack(valid, np.uint8).view(bool))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], ["block", "bucket", "part", "payload"])
