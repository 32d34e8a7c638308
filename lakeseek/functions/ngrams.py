"""Distinct character n-grams of texts, as integers, by numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .counts import slices

#: Characters of a gram; three code points of 21 bits make a long.
GRAM = 3
_BATCH = 1_000_000


def code(gram: str) -> int:
    return sum(ord(c) << (21 * (len(gram) - 1 - k)) for k, c in enumerate(gram))


def query_codes(text: str, n: int = GRAM) -> list[int]:
    return sorted({code(text[k : k + n]) for k in range(len(text) - n + 1)})


def row_grams(batch: pa.RecordBatch, n: int = GRAM) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch, the distinct grams of all rows of each by its ``text`` (not null), and how many each row has."""
    for part in slices(batch, pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), _BATCH):
        texts = part.column("text")
        cp = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(length)])
        grams = np.zeros(max(0, len(cp) - n + 1), np.int64)
        for k in range(n):
            grams = (grams << 21) | cp[k : len(cp) - n + 1 + k]
        lists = [np.unique(grams[a : max(a, b - n + 1)]) for a, b in zip(begin[:-1], begin[1:])]
        yield part, np.concatenate(lists) if lists else np.zeros(0, np.int64), np.array([len(x) for x in lists], np.int64)


def gram_postings(rows: DataFrame, columns: list[str], n: int = GRAM) -> DataFrame:
    """``(columns, gram)``: distinct grams of each row's ``text`` (which is normalised already), with the row's other columns."""
    kept = rows.select(*columns, "text").filter("text IS NOT NULL")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", gram long"

    def f(batches):
        for whole in batches:
            for part, flat, count in row_grams(whole, n):
                owner = pa.array(np.repeat(np.arange(len(count)), count))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(owner) for c in columns), pa.array(flat)], [*columns, "gram"])

    return kept.mapInArrow(f, schema)
