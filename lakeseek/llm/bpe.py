"""Pre-tokenization and byte-pair pieces, shared by token counting and the token store."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import kernels as K

#: Default vocabulary: a public byte-level BPE as ranks; every operator takes the path as a parameter.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merging; ``pretokens`` gives its matches without a regular expression.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in one block, and entries that a worker's cache of pieces keeps.
BLOCK_BYTES = 8_000_000
CACHE = 150_000


def _classes() -> np.ndarray:
    if "pretoken" not in K._LUT:
        lut = K.table("letters", r"\p{L}", r"\p{N}") + np.uint8(0)
        lut[lut == 0] = 3
        space = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        lut[space] = 0
        K._LUT["pretoken"] = lut
    return K._LUT["pretoken"]


def pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of the texts in a row (large_binary, sharing the texts' bytes), and the texts' offsets in them.

    They partition each text exactly as the matches of ``PATTERN`` do.
    """
    raw, byte_offsets = K.utf8(texts)
    cp, offsets = K.codepoints(texts)
    n = len(cp)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
    kind = _classes().take(cp)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    change = head[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]  # a run of one class starts
    start = change.copy()
    # The last white space before something else is a token of its own, or joins it if it is a plain space.
    last = np.flatnonzero(change[1:] & ~head[1:n] & (kind[:-1] == 0))  # a run of white space ends here, in the same text
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # Contractions: an apostrophe that starts a token, with s, t, re, ve, m, ll or d behind it.
    at = np.flatnonzero((cp == 39) & start)
    if len(at):
        room = offsets[np.searchsorted(offsets, at, "right")] - at  # to the end of the text
        padded = np.concatenate([cp[:n], np.zeros(3, cp.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        one = (room > 1) & np.isin(a, [115, 116, 109, 100])
        two = (room > 2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        length = np.where(one, 2, np.where(two, 3, 0))
        keep = length > 0
        at, length, room = at[keep], length[keep], room[keep]
        start[at + 1] = False
        after = at[length < room] + length[length < room]
        start[after[kind[after] == 1]] = True  # letters go on as a token of their own
    starts = np.flatnonzero(start)
    per_text = np.searchsorted(starts, offsets)
    if len(raw) != n:
        width = 1 + (cp >= 0x80).view(np.int8) + (cp >= 0x800).view(np.int8) + (cp >= 0x10000).view(np.int8)
        starts = (np.cumsum(width, dtype=np.int64) - width)[starts]
    bounds = np.concatenate([starts, [len(raw)]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]), per_text


def ship(spark, path: str) -> None:
    """Send the vocabulary's file to all executors, which needn't have it at that path."""
    spark.sparkContext.addFile(path)


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """Ids of pre-tokens; a piece list is computed once and kept in a bounded cache."""

    def __init__(self, path: str):
        self._one, self._kept = encoding(path)._encode_single_piece, {}

    def ids(self, tokens: list[bytes]) -> list[list[int]]:
        kept, one, out = self._kept, self._one, []
        for token in tokens:
            ids = kept.get(token)
            if ids is None:
                ids = one(token)
                if len(kept) >= CACHE:
                    kept.clear()
                if len(token) < 64:
                    kept[token] = ids
            out.append(ids)
        return out


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def local_vocabulary(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts, the code of each pre-token in order, and the texts' offsets in the codes."""
    tokens, offsets = pretokens(texts)
    coded = tokens.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets
