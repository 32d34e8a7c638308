"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", head: str = HEAD, middle: str = MIDDLE, tail: str = TAIL) -> DataFrame:
    """One formatted text for each conversation: ``(conv_col, n_turns, text)``.

    Each turn becomes head + role + middle + content + tail, in the order of
    (turn, role, content), nulls first. The rows are exchanged and sorted by conversation; then the
    byte lengths of all segments are computed as columns, their running sum gives the
    offsets, and scatter indices copy headers and contents into one preallocated
    Arrow buffer.

    Cases: a null role or content counts as an empty one; a null turn goes first; the
    rows of a null conversation form one conversation; repeated rows are kept; an empty
    table gives an empty result; other columns are left out; a long conversation may
    span Arrow batches.
    """
    rows = (
        turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("at"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
        .repartition("conv")
        .sortWithinPartitions("conv", F.col("at").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    constants = [x.encode() for x in (head, middle, tail)]

    def assemble(batches):
        kept: list[pa.RecordBatch] = []
        for batch in K.slices(batches, "text"):
            last = batch.column("conv")[batch.num_rows - 1]
            ids = batch.column("conv")
            same = pc.is_null(ids) if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
            first = int(np.argmax(same.to_numpy(zero_copy_only=False)))
            if first:
                yield _format(pa.Table.from_batches([*kept, batch.slice(0, first)]), constants)
                kept = []
            kept.append(batch.slice(first))  # its conversation may go on
        if kept:
            yield _format(pa.Table.from_batches(kept), constants)

    out = rows.mapInArrow(assemble, "conv long, n_turns long, text string")
    return out.select(F.col("conv").alias(conv_col), "n_turns", "text")


def _format(table: pa.Table, constants: list[bytes]) -> pa.RecordBatch:
    """Format the rows of whole conversations, which are in order."""
    conv = table["conv"].combine_chunks()
    n = len(conv)
    columns = [K.utf8(K.strings(table[c].combine_chunks())) for c in ("role", "text")]
    sources = [constants[0], columns[0][0], constants[1], columns[1][0], constants[2]]
    lengths = np.empty((n, 5), np.int64)
    begins = np.zeros((n, 5), np.int64)
    for k, constant in ((0, constants[0]), (2, constants[1]), (4, constants[2])):
        lengths[:, k] = len(constant)
    for k, (_, offsets) in ((1, columns[0]), (3, columns[1])):
        lengths[:, k], begins[:, k] = np.diff(offsets), offsets[:-1]
    ends = np.cumsum(lengths.reshape(-1))
    starts = (ends - lengths.reshape(-1)).reshape(n, 5)
    out = np.empty(int(ends[-1]), np.uint8)
    for k, source in enumerate(sources):
        out[K.expand(starts[:, k], lengths[:, k])] = np.frombuffer(source, np.uint8)[K.expand(begins[:, k], lengths[:, k])]
    values, valid = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), pc.is_valid(conv).to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    offsets = np.concatenate([starts[first, 0], [len(out)]]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(np.diff(np.concatenate([first, [n]]))), text.cast(pa.string())], ["conv", "n_turns", "text"])
