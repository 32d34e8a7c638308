"""Exact n-gram Jaccard self-join by prefix filters under several global orders."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .token_counts import _join, _split

#: Words of a gram, least Jaccard similarity, token orders, and sets that are compared in one piece.
GRAM, THRESHOLD, ORDERS, CHUNK = 3, 0.6, 3, 400
#: Tokens of a part of a big component, and pairs of sets that are counted at once, so that memory stays small.
PART_TOKENS, CELLS = 2_000_000, 1 << 20

_ROWS = "block long, bucket int, part int, payload binary"
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def token_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-grams as ascending 48-bit hashes, and the texts' offsets in them; a text of fewer than n words has all its words as one gram."""
    words, _, _, offsets = K.words(texts)
    hashes, at = K.grams(words, offsets, n)
    count = np.diff(offsets)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for k in short.tolist():
            whole = np.full(1, count[k], np.uint64)
            for at_word in range(offsets[k], offsets[k + 1]):
                whole = K.mix(whole * _SEEDS[0] + words[at_word : at_word + 1])
            extra.append(whole[0])
        hashes = np.insert(hashes, at[short], np.array(extra, np.uint64))
        at = at + np.concatenate([[0], np.cumsum((count > 0) & (count < n))])
    return K.distinct(hashes >> np.uint64(16), at)


def needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Tokens in common that a set of that size needs with any partner."""
    return np.ceil(threshold * sizes - 1e-9).astype(np.int64)


def _sets(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(id, hash, key, size)``: the set of each row with an id; ``(key, n_docs, size, prefix, tokens, dfs)``: the distinct sets that can have a partner, with the ids that have them.

    tokens are those that some other document has too, in the order (document
    frequency, hash); as a token of one document alone goes before them in every order
    and pairs nothing, only ``prefix`` of them remain of the prefix, and a set of none has no partner.
    """
    spark = docs.sparkSession
    parts = K.partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")

    def split(batches):
        block = K.task_key()
        edges = np.array([(k << 48) // parts for k in range(parts + 1)], np.uint64)
        for part in K.slices(batches, "text", 4_000_000):
            tokens, offsets = token_sets(K.strings(part.column("text")), n)
            signs = [K.sums(K.mix(tokens ^ s), offsets) for s in _SEEDS[:2]]
            head = [K.pack(part.column("id").to_numpy()), K.pack(part.column("hash").to_numpy()), K.pack(np.diff(offsets).astype(np.uint32)), *(x.tobytes() for x in signs)]
            rows = [(block, block % parts, -1, _join(head))]
            order = np.argsort(tokens, kind="stable")
            tokens, doc = tokens[order], K.owner(offsets)[order].astype(np.uint32)
            cut = np.searchsorted(tokens, edges)
            for k in range(parts):
                a, b = cut[k], cut[k + 1]
                if a < b:
                    rows.append((block, k, k, _join([K.pack(np.diff(tokens[a:b], prepend=np.uint64(0))), K.pack(doc[a:b])])))
            yield _batch(rows)
            block += 1

    def frequencies(group: pa.Table) -> pa.Table:
        blocks, marks, payloads = (group[c].to_pylist() for c in ("block", "part", "payload"))
        own = [(k, *_split(payloads[k])) for k in range(len(blocks)) if marks[k] >= 0]
        tokens = [np.cumsum(K.unpack(x, np.uint64), dtype=np.uint64) for _, x, _ in own]
        rows = [(blocks[k], group["bucket"][0].as_py(), -1, payloads[k]) for k in range(len(blocks)) if marks[k] < 0]
        if tokens:
            seen, counts = np.unique(np.concatenate(tokens), return_counts=True)
            seen, counts = seen[counts > 1], counts[counts > 1].astype(np.uint32)
            for (k, _, docs), mine in zip(own, tokens):
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, mine), len(seen) - 1)
                    hit = seen[at] == mine
                    if hit.any():
                        rows.append((blocks[k], 0, marks[k], _join([K.pack(np.diff(mine[hit], prepend=np.uint64(0))), K.pack(K.unpack(docs, np.uint32)[hit]), K.pack(counts[at[hit]])])))
        return pa.Table.from_batches([_batch(rows)])

    def prefixes(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["part"].to_pylist(), group["payload"].to_pylist()), key=lambda x: x[0])
        ids, texts, sizes, *signs = _split(rows[0][1])
        ids, texts, sizes = K.unpack(ids, np.int64), K.unpack(texts, np.int64), K.unpack(sizes, np.uint32).astype(np.int64)
        lists = [_split(x) for _, x in rows[1:]]
        join = lambda k, kind: np.concatenate([K.unpack(x[k], kind) for x in lists]) if lists else np.zeros(0, kind)
        tokens = np.concatenate([np.cumsum(K.unpack(x[0], np.uint64), dtype=np.uint64) for x in lists]) if lists else np.zeros(0, np.uint64)
        doc, df = join(1, np.uint32).astype(np.int64), join(2, np.uint32)
        shared = np.bincount(doc, minlength=len(ids))
        prefix = sizes - needed(sizes, threshold) + 1 - (sizes - shared)
        alive = (prefix > 0) & (sizes > 0)
        keep = alive[doc]
        tokens, doc, df = tokens[keep], doc[keep], df[keep]
        order = np.lexsort((tokens, df, doc))
        tokens, doc, df = tokens[order], doc[order], df[order]
        bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
        key = np.frombuffer(signs[0], np.uint64), np.frombuffer(signs[1], np.uint64)
        pieces = [(K.pack(tokens[bounds[k] : bounds[k + 1]]), K.pack(df[bounds[k] : bounds[k + 1]])) if alive[k] else (None, None) for k in range(len(ids))]
        return pa.table(
            {
                "id": pa.array(ids),
                "hash": pa.array(texts),
                "key": pa.array([int(n).to_bytes(4, "big") + int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big") for n, a, b in zip(sizes, *key)], pa.binary()),
                "size": pa.array(sizes.astype(np.int32)),
                "prefix": pa.array(prefix.astype(np.int32)),
                "tokens": pa.array([x for x, _ in pieces], pa.binary()),
                "dfs": pa.array([x for _, x in pieces], pa.binary()),
            }
        )

    counted = source.mapInArrow(split, _ROWS).groupBy("bucket").applyInArrow(frequencies, _ROWS)
    each = K.materialise(counted.groupBy("block").applyInArrow(prefixes, "id long, hash long, key binary, size int, prefix int, tokens binary, dfs binary"))
    alive = each.filter("tokens IS NOT NULL")
    held = alive.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))
    one = alive.groupBy("key").agg(*(F.first(c).alias(c) for c in ("size", "prefix", "tokens", "dfs")))
    return each.select("id", "hash", "key", "size"), K.materialise(one.join(held, "key"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "bucket", "part", "payload"])


def _placed(sets: DataFrame, chunk: int, threshold: float) -> DataFrame:
    """The sets with the pieces in which they are compared: ``(group, i, j, side)``.

    Sets that share a token of their prefixes under the first order are of one
    component, so a component holds all partners. One of more than ``chunk`` sets, or ``PART_TOKENS`` tokens, is
    cut into parts of about that many, and each two parts are a piece.
    """

    def prefix_tokens(batches):
        """Each token's least set of the batch, and edges from it to the batch's others that hold the token."""
        for batch in K.slices(batches, "tokens", 8_000_000):
            lists = [K.unpack(x, np.uint64)[:p] for x, p in zip(batch.column("tokens").to_pylist(), batch.column("prefix").to_pylist())]
            token = np.concatenate(lists).view(np.int64)
            node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in lists])
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            first = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            least = np.repeat(node[first], np.diff(np.concatenate([first, [len(token)]])))
            edges = np.unique(np.stack([least, node], 1)[least != node], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token[first], edges[:, 0]])), pa.array(np.concatenate([np.full(len(first), False), np.full(len(edges), True)])), pa.array(np.concatenate([node[first], edges[:, 1]]))], ["at", "edge", "node"])

    def stars(batches):
        """Edges from the least set of each token to the others, and those that are edges already."""
        last = None
        for batch in batches:
            at, edge, node = batch.column("at").to_numpy(), batch.column("edge").to_numpy(zero_copy_only=False), batch.column("node").to_numpy()
            if not len(at):
                continue
            a = at.copy()
            tokens = np.flatnonzero(~edge)
            if len(tokens):
                own = at[tokens]
                first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
                least = node[tokens][first]
                if last and last[0] == own[0]:
                    least[0] = last[1]  # the token goes on from the batch before
                a[tokens] = np.repeat(least, np.diff(np.concatenate([first, [len(own)]])))
                last = (own[-1], a[tokens[-1]])
            some = a != node
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(node[some])], ["a", "b"])

    # 64-bit hashes stand for the sets here; should two have the same one, their components are compared as one.
    numbered = sets.withColumn("node", F.xxhash64("key"))
    each = numbered.select("node", "prefix", "tokens").mapInArrow(prefix_tokens, "at long, edge boolean, node long").repartition(K.partitions(sets.sparkSession), "edge", "at").sortWithinPartitions("edge", "at", "node")
    label = K.materialise(components(each.mapInArrow(stars, "a long, b long")).select("node", F.col("label").alias("group")))
    # Sizes of partners differ by a factor of 1 / threshold at most, so their classes by one.
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")
    labelled = numbered.join(label, "node").withColumn("level", level)
    counts = labelled.groupBy("group", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("n_tokens"))
    parts = F.ceil(F.greatest(F.col("n") / chunk, F.col("n_tokens") / PART_TOKENS)).cast("int")
    # One row for each component; a component has few classes.
    plan = counts.groupBy("group").agg(F.sum("n").alias("all"), F.sum("n_tokens").alias("all_tokens"), F.map_from_entries(F.collect_list(F.struct("level", parts))).alias("parts"))
    placed = labelled.join(plan, "group").withColumn("whole", (F.col("all") <= chunk) & (F.col("all_tokens") <= PART_TOKENS))
    own = F.when(F.col("whole"), 0).otherwise(F.pmod(F.xxhash64("key"), F.element_at("parts", F.col("level"))).cast("int"))
    code = lambda level, part: level.cast("long") * F.lit(1 << 32) + part
    near = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(F.filter(F.sequence(F.lit(0), F.coalesce(F.try_element_at("parts", F.col("level") + d), F.lit(0))), lambda k: k < F.coalesce(F.try_element_at("parts", F.col("level") + d), F.lit(0))), lambda k: code(F.col("level") + d, k))))
    placed = placed.withColumn("own", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(code(F.col("level"), own)))
    pieces = F.transform(F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(near), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    return placed.withColumn("piece", F.explode(pieces)).select("group", "piece.i", "piece.j", "own", "key", "n_docs", "size", "prefix", "tokens", "dfs")


def _compare(rows: list[dict], i: int, j: int, threshold: float, orders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right, Jaccard) of a piece's sets: of one part with itself, or of two parts with each other."""
    own = np.array([r["own"] for r in rows])
    sides = [np.arange(len(rows))] * 2 if i == j else [np.flatnonzero(own == i), np.flatnonzero(own == j)]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(sides[0]) or not len(sides[1]):
        return none
    lists = [K.unpack(r["tokens"], np.uint64) for r in rows]
    size, prefix = np.array([r["size"] for r in rows]), np.array([r["prefix"] for r in rows])
    each = np.array([len(x) for x in lists])
    tokens, row = np.concatenate(lists), np.repeat(np.arange(len(rows)), each)
    frequency = np.log2(np.concatenate([K.unpack(r["dfs"], np.uint32) for r in rows])).astype(np.int8)
    code = np.unique(tokens, return_inverse=True)[1]
    a, b = size[sides[0]], size[sides[1]]
    candidate = (a[:, None] >= threshold * b - 1e-9) & (b >= threshold * a[:, None] - 1e-9)
    if i == j:
        candidate = np.triu(candidate, 1)
    for k in range(orders):
        if k == 0:
            order = np.arange(len(tokens))  # as it comes: document frequency, then hash
        else:
            order = np.lexsort((K.mix(tokens ^ _SEEDS[k]), frequency, row))
        rank = np.empty(len(tokens), np.int64)
        rank[order] = np.arange(len(tokens)) - np.repeat(np.cumsum(each) - each, each)
        inside = rank < prefix[row]
        candidate &= _common(row[inside], code[inside], sides, candidate) > 0
        if not candidate.any():
            return none
    common = _common(row, code, sides, candidate)
    left, right = np.nonzero(candidate)
    common = common[left, right].astype(np.int64)
    union = a[left] + b[right] - common
    keep = common >= threshold * union - 1e-9
    return sides[0][left[keep]], sides[1][right[keep]], common[keep] / union[keep]


def _common(row: np.ndarray, code: np.ndarray, sides: list[np.ndarray], candidate: np.ndarray, step: int = 4096) -> np.ndarray:
    """Tokens that each two sets of both sides have in common, for sets that are in some candidate pair.

    A token that few pairs of sets have is counted pair by pair; the others make products of slabs of the incidence matrices.
    """
    busy = [np.flatnonzero(candidate.any(1)), np.flatnonzero(candidate.any(0))]
    own = []
    for side, some in zip(sides, busy):
        place = np.full(int(row[-1]) + 1 if len(row) else 1, -1)
        place = np.full(max(len(place), int(side.max()) + 1), -1)
        place[side[some]] = np.arange(len(some))
        at = place[row]
        own.append((at[at >= 0], code[at >= 0]))
    width = int(code.max()) + 1 if len(code) else 0
    held = [np.bincount(c, minlength=width) for _, c in own]
    n, m = len(busy[0]), len(busy[1])
    pairs = held[0] * held[1]
    few = (pairs > 0) & (pairs * 400 <= n * m)
    sorted_sides = []
    for r, c in own:
        order = np.argsort(c, kind="stable")
        sorted_sides.append((r[order], c[order]))
    (r0, c0), (r1, c1) = sorted_sides
    out = np.zeros((n, m), np.float32)
    begin = np.concatenate([[0], np.cumsum(held[1])])
    some = np.flatnonzero(few[c0])
    ends, at = np.cumsum(held[1][c0[some]]), 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        part, at = some[at:to], to
        count = held[1][c0[part]]
        cell = np.repeat(r0[part] * m, count) + r1[K.expand(begin[c0[part]], count)]
        out += np.bincount(cell, minlength=n * m).reshape(n, m)
    column = np.cumsum((pairs > 0) & ~few) - 1
    total = int(column[-1]) + 1 if width else 0
    dense = [(r[k], column[c[k]]) for r, c in ((r0, c0), (r1, c1)) for k in [np.flatnonzero((pairs > 0)[c] & ~few[c])]]
    for at in range(0, total, step):
        slabs = []
        for (r, c), rows in zip(dense, (n, m)):
            low, high = np.searchsorted(c, [at, at + step])
            slab = np.zeros((rows, min(step, total - at)), np.float32)
            slab[r[low:high], c[low:high] - at] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    whole = np.zeros(candidate.shape, np.float32)
    whole[np.ix_(*busy)] = out
    return whole


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of edges that connect what all of them do."""
    parent, keep = list(range(n)), []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            keep.append(k)
    return np.array(keep, np.int64)


def _compared(sets: DataFrame, chunk: int, threshold: float, orders: int, whole: bool = False) -> DataFrame:
    """Of each piece's similar sets: rows ``(a, b, jaccard)`` of so many pairs that they connect the same as all (of all, if ``whole``), and ``(a, n_links)`` of each set's similar documents."""
    keys = ["group", "i", "j"]
    ordered = _placed(sets, chunk, threshold).repartition(K.partitions(sets.sparkSession), *keys).sortWithinPartitions(*keys, "key")

    def compare(batches):
        held: list[dict] = []
        out: list[tuple] = []

        def flush():
            if len(held) > 1:
                left, right, similarity = _compare(held, held[0]["i"], held[0]["j"], threshold, orders)
                docs = np.array([r["n_docs"] for r in held])
                links = np.bincount(left, docs[right], len(held)) + np.bincount(right, docs[left], len(held))
                out.extend((held[k]["key"], None, None, int(links[k])) for k in np.flatnonzero(links).tolist())
                if not whole:
                    some = _forest(len(held), left, right)
                    left, right, similarity = left[some], right[some], similarity[some]
                out.extend((held[a]["key"], held[b]["key"], x, 0) for a, b, x in zip(left.tolist(), right.tolist(), similarity.tolist()))
            held.clear()

        def made():
            columns = list(zip(*out)) if out else [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.float64(), pa.int64()))], ["a", "b", "jaccard", "n_links"])

        for batch in K.slices(batches, "tokens", 8_000_000):
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    flush()
                    if len(out) > 50_000:
                        yield made()
                held.append(row)
        flush()
        yield made()

    return ordered.mapInArrow(compare, "a binary, b binary, jaccard double, n_links long")


def _classes(rows: DataFrame, compared: DataFrame, *columns: str) -> DataFrame:
    """The distinct ``columns`` of the rows with ``key`` and ``group``: the class of similar sets (a set without partners is one)."""
    label = components(compared.filter("b IS NOT NULL").select("a", "b"))
    return rows.filter("size > 0").select(*columns, "key").distinct().join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("label", "key")).drop("label")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, class_id, n_links)`` of each document: its class, and the documents that it is similar to.

    Two documents are similar if their sets of word n-grams have a Jaccard similarity of ``threshold`` or more.
    Classes are the connected components of that, named by their least id; ``n_links`` is the number of
    other documents that are similar to this one, those of the same set with them. So all pairs are
    counted and those of copies needn't be listed; ``similar_sets`` lists the pairs of different sets.

    A set's prefix under a total order of tokens is so long that two sets of that similarity
    must share a token of it, whatever the order. Under the first, document frequency (counted over all
    documents) and hash, the sets that share one fall into components, within which all is
    compared; a pair is a candidate only if it shares prefix tokens under all of the ``orders`` (the
    others are frequency classes, then different hashes). Candidates are verified
    by their whole sets. Nothing is capped: a big component is cut into pieces, each two of which meet.

    Cases: rows without id are left out; a document without text or words is a class of its own without
    links; one of fewer than n words has all of them as its gram; repeated rows (one id, one set) are one
    document, while one id with several sets has a row for each and can be linked with itself; an empty table
    gives an empty result; other columns are left out; texts of any length are compared whole.
    """
    rows, sets = _sets(docs, id_col, text_col, n, threshold)
    compared = K.materialise(_compared(sets, chunk, threshold, orders))
    classed = _classes(rows, compared, "id")
    least = classed.groupBy("group").agg(F.min("id").alias("class_id"))
    links = compared.filter("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("other"))
    with_words = (
        classed.join(least, "group")
        .join(sets.select("key", "n_docs").join(links, "key", "left"), "key", "left")
        .select(F.col("id").alias("doc_id"), "class_id", (F.coalesce(F.col("n_docs") - 1, F.lit(0)) + F.coalesce("other", F.lit(0))).alias("n_links"))
    )
    without = rows.filter("size = 0").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).distinct()
    return with_words.unionByName(without).withColumnRenamed("doc_id", id_col)


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """``(doc_a, doc_b, jaccard)``: all pairs of different similar sets, each named by the least id that has it, doc_a <= doc_b; see ``ngram_jaccard_join``."""
    rows, sets = _sets(docs, id_col, text_col, n, threshold)
    first = rows.groupBy("key").agg(F.min("id").alias("id"))
    left, right = (first.select(F.col("key").alias(c), F.col("id").alias(f"id_{c}")) for c in ("a", "b"))
    pairs = _compared(sets, chunk, threshold, orders, whole=True).filter("b IS NOT NULL")
    return pairs.join(left, "a").join(right, "b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"), "jaccard")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, threshold: float = THRESHOLD, orders: int = ORDERS, chunk: int = CHUNK) -> DataFrame:
    """One document of each class of similar ones, that of the least (id, hash of the text); columns stay as they are.

    A document is what has one id and one text, nulls being equal: of repeated rows one stays (any of them, if their other columns
    differ), and of the texts of one id each is judged by itself. Documents without id, text or words are similar to none;
    see ``ngram_jaccard_join`` for the other cases.
    """
    rows, sets = _sets(docs, id_col, text_col, n, threshold)
    compared = K.materialise(_compared(sets, chunk, threshold, orders))
    classed = _classes(rows, compared, "id", "hash").withColumn("doc", F.struct("id", "hash"))
    least = classed.groupBy("group").agg(F.min("doc").alias("first"))
    own_id, own_hash, gone_id, gone_hash = (K.fresh(docs.columns, c) for c in ("__id", "__hash", "__gone_id", "__gone_hash"))
    gone = classed.join(least, "group").filter("doc <> first").select(F.col("id").alias(gone_id), F.col("hash").alias(gone_hash))
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_hash: F.xxhash64(F.col(text_col))})
    left = marked.join(gone.hint("shuffle_hash"), (F.col(own_id) == F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash)), "left_anti")
    return left.dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
