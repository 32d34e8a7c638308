"""Line deduplication by pairwise alignment: shared runs of lines pair documents with the first holder, patience diff aligns them."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Words of an aligned block from which it is deleted.
BLOCK_WORDS = 13
#: Share of the words of both that makes a document an edited copy of another.
COPY = 0.65
#: Parts into which the documents of one owner are cut at most.
SALTS = 64

_GONE = "key binary, removed array<int>, is_copy boolean"


def document_key(id_col: Column, text: Column) -> Column:
    """Binary key of a document that sorts like (id with nulls first, hash of the text)."""
    number = F.coalesce(id_col.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))
    digits = [F.lpad(F.hex(x), 16, "0") for x in (number, F.xxhash64(text))]
    return F.unhex(F.concat(F.when(id_col.isNull(), "00").otherwise("01"), *digits))


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that hold anything but white space: hash, number in the text, words, and offsets of the texts in them."""
    raw, offsets = K.utf8(texts)
    data = np.frombuffer(raw, np.uint8)
    starts, ends, per_text = K.runs(data != 10, offsets)
    solid = (data > 32).view(np.int8)
    first = solid.copy()
    first[1:] &= 1 - solid[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = solid[offsets[:-1][offsets[:-1] < len(data)]]
    words = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    number = breaks[starts] - breaks[offsets[:-1]][K.owner(per_text)]
    count = words[ends] - words[starts]
    keep = count > 0
    hashed = K.span_hash(K.prefix_sums(data), starts[keep], ends[keep])
    return hashed, number[keep], count[keep], np.concatenate([[0], np.cumsum(keep)])[per_text]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal items: the longest increasing chain of the items unique in both, then the same
    between its links; where nothing is unique, equal items at the ends of the gap."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict = {}
        for k in range(a0, a1):
            once[a[k]] = -1 if a[k] in once else k
        there: dict = {}
        for k in range(b0, b1):
            there[b[k]] = -1 if b[k] in there else k
        both = [(k, there[x]) for x, k in once.items() if k >= 0 and there.get(x, -1) >= 0]
        if not both:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(both):  # in the order of a
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
            ends[k : k + 1] = [n]
            back.append(ends[k - 1] if k else -1)
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        chain.reverse()
        last = (a0 - 1, b0 - 1)
        for i, j in chain:
            out.append((i, j))
            todo.append((last[0] + 1, i, last[1] + 1, j))
            last = (i, j)
        todo.append((last[0] + 1, a1, last[1] + 1, b1))
    return sorted(out)


def windows(hashed: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs of consecutive lines of a text that have ``least`` words, from each line onwards and up to each line: hash, first line, end.

    A block of lines of so many words is the union of the runs inside it: of two neighbouring lines, either a run
    from the first one ends in the block, or one up to the block's end begins before the second.
    """
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    text = K.owner(offsets)
    ends = np.searchsorted(total, total[:-1] + least)
    ahead = np.flatnonzero(ends <= offsets[1:][text])
    begins = np.searchsorted(total, total[1:] - least, "right") - 1
    back = np.flatnonzero((total[1:] >= least) & (begins >= offsets[:-1][text]))
    starts, ends = np.concatenate([ahead, begins[back]]), np.concatenate([ends[ahead], back + 1])
    return K.span_hash(K.prefix_sums(hashed), starts, ends), starts, ends


def blocks(own: np.ndarray, words: np.ndarray, other: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the own lines in aligned common blocks of at least ``least`` words, and all aligned places of both. The lines that only one of the two has take no part in the alignment."""
    left, right = np.flatnonzero(np.isin(own, other)), np.flatnonzero(np.isin(other, own))
    pairs = patience(own[left].tolist(), other[right].tolist())
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    i, j = np.array(pairs).T
    i, j = left[i], right[j]
    block = np.cumsum(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)])) - 1
    return i[np.bincount(block, words[i])[block] >= least], i, j


def shared(own: np.ndarray, words: np.ndarray, other: np.ndarray, other_words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which own lines are in a block of at least ``least`` words that the other has too, and all aligned places of both.

    Patience diff aligns the blocks that stand in the same order in both. Those that it leaves, because they stand
    in another order, twice, or over lines that are already aligned, are found by their runs.
    """
    gone = np.zeros(len(own), bool)
    at, i, j = blocks(own, words, other, least)
    gone[at] = True
    hashed, starts, ends = windows(own, words, np.array([0, len(own)]), least)
    if not gone.all() and len(hashed):
        some = np.isin(hashed, windows(other, other_words, np.array([0, len(other)]), least)[0])
        for a, b in zip(starts[some].tolist(), ends[some].tolist()):
            gone[a:b] = True
    return gone, i, j


def edited_copy(words: np.ndarray, other_words: np.ndarray, i: np.ndarray, j: np.ndarray, share: float = COPY) -> bool:
    """Whether ``share`` of the words of both texts stand in lines that are aligned, or line by line opposite each
    other between aligned ones with nearly as many words: lines in which words were changed."""
    i, j = (np.concatenate([[-1], x, [len(n)]]) for x, n in ((i, words), (j, other_words)))
    own, there = int(words[i[1:-1]].sum()), int(other_words[j[1:-1]].sum())
    if not own:
        return False
    for k in np.flatnonzero((np.diff(i) > 1) & (np.diff(i) == np.diff(j))).tolist():
        a, b = words[i[k] + 1 : i[k + 1]], other_words[j[k] + 1 : j[k + 1]]
        near = np.abs(a - b) <= 1 + np.maximum(a, b) // 5
        own, there = own + int(a[near].sum()), there + int(b[near].sum())
    return own >= share * words.sum() and there >= share * other_words.sum()


_LINES = "key binary, whole long, n_words long, hashes binary, words binary, numbers binary, windows array<bigint>"


def removed_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``(key, removed, is_copy)``: numbers of the lines that go, of each document that loses any, and whether it is an edited copy of an earlier one."""
    spark = docs.sparkSession
    source = docs.select(document_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")

    def split(batches):
        for part in K.slices(batches, "text"):
            hashed, number, words, offsets = lines(K.strings(part.column("text")))
            own, starts, _ = windows(hashed, words, offsets, least)
            text = np.searchsorted(offsets, starts, "right") - 1
            order = np.argsort(text, kind="stable")
            runs, at = K.distinct(own[order], np.searchsorted(text[order], np.arange(part.num_rows + 1)))
            whole = K.span_hash(K.prefix_sums(hashed), offsets[:-1], offsets[1:]).view(np.int64)
            some = np.flatnonzero(np.diff(at)).tolist()
            cut = lambda x, kind: [K.pack(x[offsets[k] : offsets[k + 1]].astype(kind)) for k in some]  # noqa: E731, B023
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([at[some], at[-1:]]).astype(np.int32)), pa.array(runs.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(some, pa.int64())), pa.array(whole[some]), pa.array(K.sums(words, offsets)[some], pa.int64()), *(pa.array(cut(x, kind), pa.binary()) for x, kind in ((hashed, np.uint64), (words, np.uint32), (number, np.uint32))), lists],
                ["key", "whole", "n_words", "hashes", "words", "numbers", "windows"],
            )

    held = K.materialise(source.mapInArrow(split, _LINES))
    # Of texts of the same lines, the first stands for all; the others lose every line.
    first = held.groupBy("whole").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    one = K.materialise(held.join(first.select("key"), "key", "left_semi").dropDuplicates(["key"]))
    again = held.select("key", "whole", "numbers").join(first.filter("key < last").select("whole", F.col("key").alias("first")), "whole").filter("first < key").select("key", "numbers").dropDuplicates(["key"])

    def all_lines(batches):
        for batch in batches:
            gone = [K.unpack(x, np.uint32).astype(np.int32) for x in batch.column("numbers").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32())), pa.array([True] * len(gone), pa.bool_())], ["key", "removed", "is_copy"])

    copies = again.mapInArrow(all_lines, _GONE)
    # Each run pairs the documents that hold it with the first of them alone, so there are no more pairs than runs.
    each = one.select("key", F.explode("windows").alias("window"))
    holder = each.groupBy("window").agg(F.min("key").alias("owner"), F.max("key").alias("last")).filter("owner < last").select("window", "owner")
    pairs = K.materialise(each.join(holder, "window").filter("owner < key").select("owner", "key").distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")))
    # An owner's lines go once to each of its salts, in front of the documents that it is aligned with.
    lines_of = one.select("key", "hashes", "words", "numbers")
    owners = pairs.select("owner", "salt").distinct().join(lines_of, pairs["owner"] == lines_of["key"]).select("owner", "salt", F.lit(0).alias("side"), "key", "hashes", "words", "numbers")
    later = pairs.join(lines_of, "key").select("owner", "salt", F.lit(1).alias("side"), "key", "hashes", "words", "numbers")
    both = owners.unionByName(later).repartition(K.partitions(spark), "owner", "salt").sortWithinPartitions("owner", "salt", "side")

    def align(batches):
        other = other_words = None
        for batch in K.slices(batches, "hashes"):
            keys, gone, copy = [], [], []
            for k, (side, hashes, words, numbers) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("side", "hashes", "words", "numbers")))):
                own, own_words = K.unpack(hashes, np.uint64), K.unpack(words, np.uint32).astype(np.int64)
                if not side:
                    other, other_words = own, own_words
                    continue
                at, i, j = shared(own, own_words, other, other_words, least)
                if at.any():
                    keys.append(k)
                    gone.append(K.unpack(numbers, np.uint32)[at].astype(np.int32))
                    copy.append(edited_copy(own_words, other_words, i, j))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(keys, pa.int64())), pa.array(gone, pa.list_(pa.int32())), pa.array(copy, pa.bool_())], ["key", "removed", "is_copy"])

    found = both.select("side", "key", "hashes", "words", "numbers").mapInArrow(align, _GONE)
    # A document has few owners, and each of its lines at most once from each.
    return found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"), F.max("is_copy").alias("is_copy")).unionByName(copies)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = BLOCK_WORDS, count: str | None = None, copy: str | None = None) -> DataFrame:
    """The documents without the blocks of lines that they have in common with an earlier document.

    Documents are in the order of (id, hash of the text), nulls first. A line goes if it is in a block of
    consecutive lines (blank ones don't count) of at least ``least`` words together that stands in any earlier
    document too; what goes stays where it stood first. The result depends on the texts alone.

    Each block is made of runs, the shortest that have ``least`` words from a line onwards or up to a line. A
    run pairs the documents that hold it with the first of them, which holds the block's lines there
    as well as any other does; so pairs grow with the runs and not with their square, and no block is
    missed, however common. Pairs are aligned by patience diff over the hashes of the lines that both have, and
    aligned blocks of at least ``least`` words are deleted from the later document; so are common blocks that
    an alignment leaves, as they stand in another order or overlap. Texts of the same lines are one class, of which
    only the first takes part in this. ``count`` names a column for the number of deleted lines, ``copy`` one that
    tells whether the document is an earlier one with at most a few words of its lines changed (``edited_copy``).

    Cases: a null text stays null; an empty one has no lines; a text whose lines all go is
    left with its blank lines or ''; rows of the same id and text are one
    document in this, and all lose the same lines; rows of one id and several texts are
    several documents; lines are compared byte by byte; repeated lines of one document
    stay unless an earlier one has them; an empty table gives an empty result; other
    columns stay as they are.
    """
    gone = removed_lines(docs, id_col, text_col, least)
    key, own, removed, is_copy = (K.fresh(docs.columns, c) for c in ("__key", "__gone", "__removed", "__is_copy"))
    joined = docs.withColumn(key, document_key(F.col(id_col), F.col(text_col))).join(gone.select(F.col("key").alias(own), F.col("removed").alias(removed), F.col("is_copy").alias(is_copy)).hint("shuffle_hash"), F.col(key) == F.col(own), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda _, k: ~F.array_contains(removed, k)), "\n")
    out = joined.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(kept))
    if count:
        out = out.withColumn(count, F.coalesce(F.size(removed), F.lit(0)).cast("long"))
    if copy:
        out = out.withColumn(copy, F.coalesce(F.col(is_copy), F.lit(False)))
    return out.drop(key, own, removed, is_copy)
