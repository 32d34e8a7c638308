"""Token ids as a content-addressed store: chunks by rolling hash, recipes by document, Merkle manifests."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K

#: Bytes of text that are tokenized at once.
BLOCK_BYTES = 2_000_000
#: Ids that the rolling hash looks at, mean and bounds of a chunk's length in ids.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 2048

#: Documents of a shard of the manifest.
SHARD_DOCS = 20_000

_MADE = "kind string, row long, id long, digest binary, n_tokens long, payload binary"
_ADDRESSES = "transform(sequence(0, int(length(payload) / 32) - 1), i -> substring(payload, i * 32 + 1, 32))"


def sha(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; the root of none is the hash of nothing. Leaves and nodes are hashed apart; an odd one goes up as it is."""
    level = [sha(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [sha(b"\1" + level[k] + level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else sha(b"")


def cuts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks: content alone decides, within a document, so that equal passages give equal chunks.

    A chunk ends where the hash of the last ``WINDOW`` ids is 0 modulo ``MEAN``, not
    before ``LEAST`` ids, and after ``MOST`` ids in any case. Every document of at
    least one id ends a chunk.
    """
    hits = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        ends = np.arange(WINDOW, len(ids) + 1)
        hashed = K.span_hash(K.prefix_sums(ids), ends - WINDOW, ends)
        hits = ends[hashed & np.uint64(MEAN - 1) == 0]
    out = []
    at, hits = 0, [*hits.tolist(), 1 << 62]
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        begun = first
        while begun < last:
            while hits[at] < begun + LEAST:
                at += 1
            begun = min(hits[at], begun + MOST, last)
            out.append(begun)
    return np.array(out, np.int64)


@dataclass
class Store:
    """chunks(digest, n_tokens, payload), recipes(row, id, digest, n_tokens, n_chunks, payload), manifest(shard, shards, digest, n_docs, n_tokens, payload), and bytes of an id."""

    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    width: int = 2


def token_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = bpe.RANKS, shards: int | None = None, path: str | None = None) -> Store:
    """Tokenize the documents into a store whose chunks are kept once, written to ``path`` (a fresh shared folder, if none is named).

    ``payload`` of a chunk is its ids as little-endian integers of 2 bytes (4 if the
    vocabulary is larger); its address is their SHA-256. A recipe is the addresses
    of a document's chunks in order, with their Merkle root. The manifest has a root
    for each shard of documents (about ``SHARD_DOCS``, by hash of the id) over ``sha(id, n_tokens, root)``, and for shard -1 one over the
    shards. What is stored is read again by ``verify``, which tells for each chunk, recipe and shard whether it is whole, and by
    ``reconstruct``, which gives the ids back.

    Cases: a null or empty text has a recipe of no chunks; a null id stays null;
    repeated rows and ids have a recipe each and share all chunks; an empty table
    gives an empty store with the root of nothing; other columns are left out; a
    text of any length is cut the same way.
    """
    spark = docs.sparkSession
    bpe.ship(spark, ranks)
    wide = np.dtype("<u4") if bpe.encoding(ranks).n_vocab > 65536 else np.dtype("<u2")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def make(batches):
        row = K.task_key()
        for part in K.slices(batches, "text", BLOCK_BYTES):
            ids, offsets = token_ids(K.strings(part.column("text")), ranks)
            stops = cuts(ids, offsets)
            begins = np.concatenate([[0], stops[:-1]])
            raw, size = ids.astype(wide).tobytes(), wide.itemsize
            addresses, seen, rows = [], set(), []
            for a, b in zip(begins.tolist(), stops.tolist()):
                payload = raw[a * size : b * size]
                address = sha(payload)
                addresses.append(address)
                if address not in seen:
                    seen.add(address)
                    rows.append(("chunk", None, None, address, b - a, payload))
            held = np.searchsorted(stops, offsets, "right")
            for k, one in enumerate(part.column("id").to_pylist()):
                own = addresses[held[k] : held[k + 1]]
                rows.append(("recipe", row, one, merkle(own), int(offsets[k + 1] - offsets[k]), b"".join(own)))
                row += 1
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], ["kind", "row", "id", "digest", "n_tokens", "payload"])

    # Chunks meet by their address, after each task has dropped its own copies; a recipe is alone by its row.
    folder = path or K.shared_path(spark, "store")
    once = source.mapInArrow(make, _MADE).groupBy("kind", "digest", "row").agg(*(F.first(c).alias(c) for c in ("id", "n_tokens", "payload")))
    once.write.partitionBy("kind").parquet(f"{folder}/blobs")
    written = spark.read.schema(_MADE).option("basePath", f"{folder}/blobs").parquet(f"{folder}/blobs")
    recipes = written.filter("kind = 'recipe'").select("row", "id", "digest", "n_tokens", (F.length("payload") / 32).cast("long").alias("n_chunks"), "payload")
    manifest(recipes, shards or max(1, -(-recipes.count() // SHARD_DOCS))).write.parquet(f"{folder}/manifest")
    return Store(written.filter("kind = 'chunk'").select("digest", "n_tokens", "payload"), recipes, spark.read.parquet(f"{folder}/manifest"), wide.itemsize)


def manifest(recipes: DataFrame, shards: int) -> DataFrame:
    """A Merkle root for each shard of recipes, and one over the shards' roots."""

    def one(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["id"].to_pylist(), group["n_tokens"].to_pylist(), group["digest"].to_pylist()), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        leaves = [sha(repr((i, n)).encode() + d) for i, n, d in rows]
        return pa.table({"shard": group["shard"][:1], "shards": pa.array([shards], pa.int32()), "digest": pa.array([merkle(leaves)], pa.binary()), "n_docs": [len(rows)], "n_tokens": [sum(n for _, n, _ in rows)], "payload": pa.array([b"".join(leaves)], pa.binary())})

    schema = "shard int, shards int, digest binary, n_docs long, n_tokens long, payload binary"
    by_shard = recipes.select("id", "n_tokens", "digest", F.pmod(F.xxhash64("id", "digest"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInArrow(one, schema)

    def top(roots: pa.Array) -> pa.Array:
        return pa.array([merkle(x) for x in roots.to_pylist()], pa.binary())

    # A row for each shard, without its leaves.
    whole = by_shard.agg(
        F.sort_array(F.collect_list(F.struct("shard", "digest")))["digest"].alias("roots"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")
    ).select(F.lit(-1).alias("shard"), F.lit(shards).alias("shards"), F.arrow_udf(top, "binary")("roots").alias("digest"), "n_docs", "n_tokens", F.array_join(F.transform("roots", F.hex), "").alias("hexed"))
    return by_shard.unionByName(whole.withColumn("payload", F.unhex("hexed")).drop("hexed"))


def _root_follows(roots: pa.Array, payloads: pa.Array) -> pa.Array:
    return pa.array([merkle([p[k : k + 32] for k in range(0, len(p), 32)]) == r for r, p in zip(roots.to_pylist(), payloads.to_pylist())], pa.bool_())


def verify(store: Store) -> Store:
    """The store's tables, each with a column ``verified``, by what is stored.

    A chunk is whole if it hashes to its address and has as many ids as it says. A recipe is, if all of its chunks are there and
    whole, their ids are as many as it says, and its root follows from its addresses. A shard of the manifest is, if its root follows from its leaves, and
    these and its counts from the recipes that are there; a shard of recipes that the manifest lacks is added as not verified.
    """
    good = (F.sha2("payload", 256) == F.lower(F.hex("digest"))) & (F.length("payload") == F.col("n_tokens") * store.width)
    chunks = store.chunks.withColumn("verified", F.coalesce(good, F.lit(False)))
    # Should an address be there twice, both must be whole.
    known = chunks.groupBy("digest").agg(F.min("verified").alias("good"), F.min("n_tokens").alias("n")).filter("good").select("digest", "n")
    found = store.recipes.filter("n_chunks > 0").select("row", F.explode(F.expr(_ADDRESSES)).alias("digest")).join(known, "digest").groupBy("row").agg(F.count("n").alias("n_good"), F.sum("n").alias("sum_good"))
    recipes = store.recipes.join(found, "row", "left").withColumn(
        "verified", (F.coalesce("n_good", F.lit(0)) * 32 == F.length("payload")) & (F.coalesce("sum_good", F.lit(0)) == F.col("n_tokens")) & F.arrow_udf(_root_follows, "boolean")("digest", "payload")
    )
    of = store.manifest.agg(F.max("shards")).first()[0] or 1
    again = manifest(store.recipes, of)
    fields = ["shards", "digest", "n_docs", "n_tokens", "payload"]
    same = store.manifest.join(again.select("shard", *(F.col(c).alias(f"{c}_") for c in fields)), "shard", "full")
    told = F.lit(True)
    for c in fields:
        told = told & F.coalesce(F.col(c) == F.col(f"{c}_"), F.lit(False))
    return Store(chunks, recipes.drop("n_good", "sum_good"), same.withColumn("verified", told).select("shard", *fields, "verified"), store.width)


def token_ids(texts: pa.Array, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the texts' offsets in them; each distinct pre-token is encoded once."""
    vocabulary, codes, offsets = bpe.local_vocabulary(texts)
    lists = bpe.pieces(ranks).ids(vocabulary.to_pylist())
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for ids in lists for x in ids), np.uint32, int(lengths.sum()))
    begins = np.cumsum(lengths) - lengths
    count = lengths[codes]
    return flat[K.expand(begins[codes], count)], np.concatenate([[0], np.cumsum(count)])[offsets]


def reconstruct(store: Store) -> DataFrame:
    """``(row, id, ids, intact)``: the ids of each document, out of its recipe and the stored chunks.

    Each chunk is hashed again. Where one is missing or isn't what its address says, or the recipe's root or
    count don't follow from its addresses, ``intact`` is false and ids is null: a damaged document never passes for a shorter one.
    """
    listed = store.recipes.select("row", "id", F.col("digest").alias("root"), "n_tokens", F.expr(f"CASE WHEN length(payload) >= 32 THEN {_ADDRESSES} ELSE array() END").alias("chunks"))
    each = listed.select("row", "id", "root", "n_tokens", F.posexplode_outer("chunks").alias("at", "digest"))
    joined = each.join(store.chunks.select("digest", F.col("payload").alias("piece")).dropDuplicates(["digest"]), "digest", "left")
    fields = F.sort_array(F.collect_list(F.struct("at", "digest", "piece")))
    whole = joined.groupBy("row").agg(F.first("id").alias("id"), F.first("root").alias("root"), F.first("n_tokens").alias("n_tokens"), fields.alias("parts"))

    def ids(roots: pa.Array, counts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for root, n, one in zip(roots.to_pylist(), counts.to_pylist(), parts.to_pylist()):
            own = [x for x in one if x["digest"] is not None]
            good = all(x["piece"] is not None and sha(x["piece"]) == x["digest"] for x in own) and merkle([x["digest"] for x in own]) == root
            got = np.frombuffer(b"".join(x["piece"] for x in own), f"<u{store.width}").tolist() if good else None
            out.append(got if got is not None and len(got) == n else None)
        return pa.array(out, pa.list_(pa.int64()))

    store = Store(*([None] * 3), store.width)  # the tasks need the width alone
    back = whole.select("row", "id", F.arrow_udf(ids, "array<bigint>")("root", "n_tokens", "parts").alias("ids"))
    return back.withColumn("intact", F.col("ids").isNotNull())
