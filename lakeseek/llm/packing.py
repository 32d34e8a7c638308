"""Lexical retrieval packing: a sharded BM25 inverted index gives each seed document its neighbours, which fill its windows."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .token_counts import _ids, _join, _read_ids, _split

#: Words of a window; a document is a seed if its id is divisible by this; BM25's constants.
WINDOW, EVERY, K1, B = 2048, 20, 1.2, 0.75
#: Documents of a shard of the index, seeds that are scored at once, their terms and cells of their scores at most, and bytes of packed seeds that are sent to the tasks at once.
SHARD, QUERIES, QUERY_TERMS, SCORES, ROUND_BYTES = 24_576, 1024, 1 << 18, 1 << 23, 40_000_000
#: A term that more than one document of so many in a shard has is kept as a row of a matrix, too; the row is used by queries of which enough have the
#: term: a cell of it times a query costs this share of a posting.
COMMON, CELL = 40, 0.0025
#: Groups of texts with words in common, terms and seeds from which they are found, rounds of that, and documents that make a group of a shard.
SUBJECTS, TERMS, SAMPLE, TURNS, LEAST = 8, 512, 4096, 8, 1024
#: Postings from which a term's are taken as a slice.
LONG = 40
#: Postings from which a shard takes no further block, cells of its matrix at most, and documents whose best seeds are sought at once.
POSTINGS, CELLS, STEP = 1 << 23, 1 << 24, 1024
#: Documents of one seed that are packed in one go; of more, parts are packed by themselves.
GROUP = 8192
#: Relative difference up to which two float32 scores are the same.
NEAR = 1e-5

_ROWS = "block long, bucket int, part int, payload binary"
_BLOCKS = "block long, kind int, n_docs long, n_words long, payload binary"
_NEAREST = "block long, row int, id long, n long, seed_id long, seed_block long, seed_row int, score double"


class Seeds:
    """The queries: each seed's distinct terms that some other document has, in the order of (id, place)."""

    def __init__(self, payloads: list[tuple[int, bytes]], n_docs: int, mean: float):
        ids, blocks, rows, begins, sizes, scales, alike, dictionaries, codes, n = [], [], [], [], [], [], [], [], [], 0
        for block, payload in payloads:
            own, row, lengths, bounds, code, tf, seen, df = _split(payload)
            bounds, code, seen = K.unpack(bounds, np.uint32).astype(np.int64), K.unpack(code, np.uint32), _running(seen)
            ids.append(K.unpack(own, np.int64))
            rows.append(K.unpack(row, np.uint32).astype(np.int64))
            blocks.append(np.full(len(ids[-1]), block))
            begins.append(bounds[:-1] + n)
            sizes.append(np.diff(bounds))
            each = np.repeat(K.unpack(lengths, np.uint32).astype(np.int64), sizes[-1])
            weight = _weights(_idf(K.unpack(df, np.uint32), n_docs)[code], K.unpack(tf, np.uint32), each, mean)
            scales.append(1 / np.sqrt(np.maximum(K.sums(weight, bounds), 1e-9)))
            alike.append(np.stack([K.sums(K.mix(seen)[code], bounds), K.sums(K.mix(~seen)[code], bounds), scales[-1].view(np.uint64)], 1))
            dictionaries.append(seen)
            codes.append(code)
            n += len(code)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.id, self.block, self.row, self.begin, self.size = (join(x, np.int64) for x in (ids, blocks, rows, begins, sizes))
        self.scale, alike = join(scales, float), np.concatenate([np.zeros((0, 3), np.uint64), *alike])
        order = np.lexsort((self.row, self.block, self.id))
        # Of seeds of the same terms and scale, the first is as near to any document as the others.
        once = order[np.sort(np.unique(alike[order], axis=0, return_index=True)[1])]
        self.id, self.block, self.row, self.begin, self.size, self.scale = (x[once] for x in (self.id, self.block, self.row, self.begin, self.size, self.scale))
        # The terms are kept once, in the order of the payloads: a seed's are ``size`` codes from ``begin`` on.
        self.seen, self.code, at = np.unique(join(dictionaries, np.uint64)), np.empty(n, np.int32), 0
        for seen, code in zip(dictionaries, codes):
            self.code[at : at + len(code)] = np.searchsorted(self.seen, seen).astype(np.int32)[code]
            at += len(code)

    @cached_property
    def subjects(self) -> Subjects:
        return Subjects(self)

    @cached_property
    def order(self) -> np.ndarray:
        """The seeds of a subject and of like size together."""
        return np.lexsort((self.size, self.subjects.of(self.seen, self.code, self.begin, self.size)))

    def batches(self, n: int) -> Iterator[np.ndarray]:
        """All seeds, as many at once as are scored for n documents, each batch in the order of (id, place)."""
        step, total, at = max(1, min(QUERIES, SCORES // max(1, n))), np.cumsum(self.size[self.order]), 0
        while at < len(self.order):
            to = max(at + 1, min(at + step, int(np.searchsorted(total, (total[at - 1] if at else 0) + QUERY_TERMS, "right"))))
            yield np.sort(self.order[at:to])
            at = to


class Subjects:
    """Groups of texts that have words in common, found among some of the seeds.

    They decide which seeds and documents are scored together, so that fewer terms are met there by many of both; every
    document is scored for every seed all the same.
    """

    def __init__(self, seeds: Seeds):
        held = np.bincount(seeds.code, minlength=len(seeds.seen))
        top = np.sort(np.argsort(-held, kind="stable")[:TERMS])
        self.terms, self.weight, n = seeds.seen[top], np.log1p(len(seeds.id) / held[top]).astype(np.float32), len(seeds.id)
        rng = np.random.default_rng(0)
        some = np.sort(rng.permutation(n)[:SAMPLE])
        x = self._unit(self._vectors(self._columns(seeds.seen), seeds.code, seeds.begin[some], seeds.size[some]))
        self.centres = x[rng.permutation(len(x))[: max(1, min(SUBJECTS, n // 256))]]
        for _ in range(TURNS):
            group = (x @ self.centres.T).argmax(1) if len(x) else some
            self.centres = self._unit(np.stack([x[group == k].sum(0) if (group == k).any() else c for k, c in enumerate(self.centres)])) if len(x) else self.centres

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _columns(self, seen: np.ndarray) -> np.ndarray:
        """Place of each term among those of the groups, or -1."""
        if not len(self.terms):
            return np.full(len(seen), -1)
        place = np.minimum(np.searchsorted(self.terms, seen), len(self.terms) - 1)
        return np.where(self.terms[place] == seen, place, -1)

    def _vectors(self, columns: np.ndarray, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros((len(size), len(self.terms)), np.float32)
        column, text = columns[code[K.expand(begin, size)]], np.repeat(np.arange(len(size)), size)
        known = column >= 0
        out[text[known], column[known]] = self.weight[column[known]]
        return out

    def of(self, seen: np.ndarray, code: np.ndarray, begin: np.ndarray, size: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        """Group of each text, whose terms are ``size`` codes of ``seen`` from ``begin`` on."""
        out, columns = np.zeros(len(size), np.int64), self._columns(seen)
        among = np.arange(len(self.centres)) if among is None else among
        if len(among) > 1:
            for k in range(0, len(size), STEP):
                out[k : k + STEP] = (self._vectors(columns, code, begin[k : k + STEP], size[k : k + STEP]) @ self.centres[among].T).argmax(1)
        return among[out] if len(among) else out

    def split(self, blocks: list[Block]) -> Iterator[list[Block]]:
        """The documents of these blocks by group; those without terms are one, and groups of few documents go to others."""
        of = lambda among=None: [np.where(b.count > 0, self.of(b.seen, b.code, np.cumsum(b.count) - b.count, b.count, among), -1) for b in blocks]
        groups = of()
        count = np.bincount(np.concatenate(groups) + 1, minlength=len(self.centres) + 1)[1:]
        if (count[count > 0] < LEAST).any():
            groups = of(np.flatnonzero(count >= LEAST) if (count >= LEAST).any() else count.argmax(keepdims=True))
        for k in np.unique(np.concatenate(groups)):
            yield [b.part(np.flatnonzero(g == k)) for b, g in zip(blocks, groups) if (g == k).any()]


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log((n_docs - df.astype(float) + 0.5) / (df + 0.5) + 1)


def _weights(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term of that frequency adds to the BM25 score of a document of that length."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Block:
    """Documents of a block: their terms that other documents have too (without those of seeds), as codes of a dictionary of its own."""

    def __init__(self, block: int, payload: bytes, every: int):
        own, size, bounds, code, tf, seen, df = _split(payload)
        code, tf, seen, df = K.unpack(code, np.uint32, "zstd"), K.unpack(tf, np.uint32, "zstd"), _running(seen), K.unpack(df, np.uint32)
        self.block, self.ids, self.length, bounds = block, _read_ids(own), K.unpack(size, np.uint32), K.unpack(bounds, np.uint32).astype(np.int64)
        number = self.ids.fill_null(1).to_numpy(zero_copy_only=False)
        seed = (number % every == 0) & self.ids.is_valid().to_numpy(zero_copy_only=False)
        shared = df > 1  # a term of one document alone retrieves nothing, and a seed is its own neighbour
        keep = shared[code] & np.repeat(~seed, np.diff(bounds))
        self.count = K.sums(keep.astype(np.int64), bounds)
        self.seen, self.df = seen[shared], df[shared]
        self.code = (np.cumsum(shared) - 1).astype(np.int32)[code[keep]]
        self.tf, self.row = tf[keep].astype(np.min_scalar_type(int(tf.max(initial=0)))), np.arange(len(self.length))

    def part(self, rows: np.ndarray) -> Block:
        """Some of the documents, with the terms that they have."""
        out, at, used = copy(self), K.expand((np.cumsum(self.count) - self.count)[rows], self.count[rows]), np.zeros(len(self.seen), bool)
        code = self.code[at]
        used[code] = True
        out.ids, out.length, out.row, out.count = self.ids.take(pa.array(rows)), self.length[rows], self.row[rows], self.count[rows]
        out.seen, out.df, out.code, out.tf = self.seen[used], self.df[used], (np.cumsum(used) - 1).astype(np.int32)[code], self.tf[at]
        return out


class Shard:
    """An inverted index of some documents, with the corpus's own term statistics.

    Memory follows the postings: a document's terms are kept as codes and frequencies, of which weights are made where they are needed. Postings
    stand in the list of their term, and those of common terms in a matrix, too. The blocks are let go as they are read.
    """

    def __init__(self, blocks: list[Block], n_docs: int, mean: float):
        size = [len(b.length) for b in blocks]
        starts = [0, *np.cumsum(size).tolist()]
        n = self.n = starts[-1]
        self.mean, self.ids = mean, pa.concat_arrays([b.ids for b in blocks])
        self.length, self.block, self.row = np.concatenate([b.length for b in blocks]).astype(np.int64), np.repeat([b.block for b in blocks], size), np.concatenate([b.row for b in blocks])
        self.seen = np.unique(np.concatenate([b.seen for b in blocks]))
        # Documents come one after the other, each with its terms in order.
        self.own_bounds = np.concatenate([[0], np.cumsum(np.concatenate([b.count for b in blocks]))])
        self.own_code, self.own_tf = np.empty(self.own_bounds[-1], np.int32), np.empty(self.own_bounds[-1], np.result_type(*(b.tf for b in blocks)))
        df, held, at = np.ones(len(self.seen), np.int64), np.zeros(len(self.seen), np.int64), 0
        blocks.reverse()
        while blocks:
            b = blocks.pop()
            place, to = np.searchsorted(self.seen, b.seen).astype(np.int32), at + len(b.code)
            df[place] = b.df
            self.own_code[at:to], self.own_tf[at:to] = place[b.code], b.tf
            held += np.bincount(self.own_code[at:to], minlength=len(held))
            at = to
        self.idf = _idf(df, n_docs)
        # Terms that many documents hold are rows of a matrix, those of the most documents if there are too many.
        common = np.flatnonzero(held > max(8, n // COMMON))
        common = np.sort(common[np.argsort(-held[common], kind="stable")[: CELLS // max(1, n)]])
        self.common = np.full(len(self.seen), -1, np.int32)
        self.common[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), n), np.float32)
        self.bounds = np.concatenate([[0], np.cumsum(held)])
        # A posting is one number, so that one slice takes its document and its weight.
        self.posting = np.empty(self.bounds[-1], np.int64)
        both, free = self.posting.view(np.int32).reshape(-1, 2), self.bounds[:-1].copy()
        for first, last in zip(starts, starts[1:]):
            bounds = self.own_bounds[first : last + 1]
            code, doc = self.own_code[bounds[0] : bounds[-1]], np.repeat(np.arange(first, last, dtype=np.int32), np.diff(bounds))
            weight = self.weights(slice(bounds[0], bounds[-1]), doc).astype(np.float32)
            row = self.common[code]
            dense = row >= 0
            self.matrix[row[dense], doc[dense]] = weight[dense]
            rest = np.argsort(code, kind="stable")
            begin = np.flatnonzero(np.diff(code[rest], prepend=-1))
            count, term = np.diff(begin, append=len(rest)), code[rest[begin]]
            place = K.expand(free[term], count)
            both[place, 0], both[place, 1] = doc[rest], weight[rest].view(np.int32)
            free[term] += count

    def weights(self, at, doc: np.ndarray) -> np.ndarray:
        """Weights of the documents' own terms at these places."""
        return _weights(self.idf[self.own_code[at]], self.own_tf[at], self.length[doc], self.mean)

    @staticmethod
    def split(postings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and weights of postings."""
        both = postings.view(np.int32).reshape(-1, 2)
        return both[:, 0], both[:, 1].view(np.float32)

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """The shard's code of each term, -1 for those that it lacks."""
        if not len(self.seen):
            return np.full(len(terms), -1)
        place = np.minimum(np.searchsorted(self.seen, terms), len(self.seen) - 1)
        return np.where(self.seen[place] == terms, place, -1)

    def scores(self, distinct: np.ndarray, query: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """BM25 of all documents for n queries, whose terms are (query, place in ``distinct``) in the order of queries."""
        return self.sums(query, self.codes(distinct)[term], n)

    def sums(self, query: np.ndarray, code: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
        """BM25 of all documents for n queries, whose terms are (query, the shard's code or -1) in the order of queries; in ``out`` if there is one."""
        query, code = query[code >= 0], code[code >= 0]
        row = self.common[code]
        rows = row[row >= 0]
        use = np.bincount(rows, minlength=len(self.matrix))
        # Rows are worth their cells where the queries that have them would read many postings.
        term = np.zeros(len(use), np.int64)
        term[rows] = code[row >= 0]
        worth = use * (self.bounds[term + 1] - self.bounds[term]) > CELL * n * self.n if len(use) else np.zeros(0, bool)
        used = np.flatnonzero(worth)
        dense = np.append(worth, False)[row]
        wanted = np.zeros((n, len(used)), np.float32)
        wanted[query[dense], (np.cumsum(worth) - 1)[row[dense]]] = 1
        out = np.empty((n, self.n), np.float32) if out is None else out
        for k in range(0, self.n, STEP):  # only a strip of the rows is copied at once
            np.matmul(wanted, self.matrix[:, k : k + STEP][used], out=out[:, k : k + STEP])
        query, code = query[~dense], code[~dense]
        # Long postings are cheaper as slices, short ones by an index of their places.
        begin, count = self.bounds[code], self.bounds[code + 1] - self.bounds[code]
        long = count > LONG
        places = np.searchsorted(query[~long], np.arange(n + 1))
        short = self.posting.take(K.expand(begin[~long], count[~long]))
        ends = np.concatenate([[0], np.cumsum(count[~long])])[places].tolist()
        cuts = np.searchsorted(query[long], np.arange(n + 1)).tolist()
        low, high = begin[long].tolist(), (begin[long] + count[long]).tolist()
        posting = self.posting
        # Arrays that are kept between queries are cheaper than new ones, whose pages the system clears each time.
        sizes = np.diff(ends, prepend=0)[1:] + np.bincount(query[long], count[long], n).astype(np.int64)
        most = int(sizes.max()) if n else 0
        both, docs, weights = np.empty(most, np.int64), np.empty(most, np.intp), np.empty(most)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            spans = [posting[x:y] for x, y in zip(low[a:b], high[a:b])]
            spans.append(short[ends[k] : ends[k + 1]])
            m = sizes[k]
            if m:
                np.concatenate(spans, out=both[:m])
                docs[:m], weights[:m] = self.split(both[:m])
                out[k] += np.bincount(docs[:m], weights[:m], self.n).astype(np.float32)  # its own casts and those of += are slow
        return out

    def nearest(self, seeds: Seeds) -> tuple[np.ndarray, np.ndarray]:
        """The seed for whose terms each document scores most, by the root of what the seed itself scores, or -1; and that score."""
        best, which = np.zeros(self.n, np.float32), np.full(self.n, -1)
        if not len(self.own_code):
            return which, np.zeros(self.n)
        place, kept = self.codes(seeds.seen).astype(np.int32), None
        for batch in seeds.batches(self.n):
            size = seeds.size[batch]
            if kept is None or len(kept) < len(batch):
                kept = np.empty((len(batch), self.n), np.float32)
            scores = self.sums(np.repeat(np.arange(len(batch), dtype=np.int32), size), place[seeds.code[K.expand(seeds.begin[batch], size)]], len(batch), kept[: len(batch)])
            scores *= seeds.scale[batch, None].astype(np.float32)
            most = scores.max(0)
            near = np.flatnonzero((most > 0) & (most >= best * np.float32(1 - NEAR)))
            for some in (near[k : k + STEP] for k in range(0, len(near), STEP)):
                first = batch[(scores[:, some] >= most[some] * np.float32(1 - NEAR)).argmax(0)]
                # Batches aren't in the order of ids: of scores that are the same, the first seed's counts.
                same = most[some] <= best[some] * np.float32(1 + NEAR)
                which[some] = np.where(same, np.minimum(which[some], first), first)
                best[some] = np.maximum(best[some], most[some])
        # The score is summed again in the order of terms, so that it doesn't depend on how documents are cut into shards.
        score, wanted = np.zeros(self.n), np.zeros(len(self.seen) + 1, bool)
        order = np.argsort(which, kind="stable")
        cuts = np.flatnonzero(np.diff(which[order], prepend=-2))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), self.n]):
            seed = which[order[a]]
            if seed < 0:
                continue
            code = place[seeds.code[seeds.begin[seed] : seeds.begin[seed] + seeds.size[seed]]]
            wanted[code] = True
            wanted[-1] = False
            for docs in (order[k : min(b, k + STEP)] for k in range(a, b, STEP)):
                count = self.own_bounds[docs + 1] - self.own_bounds[docs]
                at = K.expand(self.own_bounds[docs], count)
                hit = wanted[self.own_code[at]]
                weight = np.zeros(len(at))
                weight[hit] = self.weights(at[hit], np.repeat(docs, count)[hit])
                score[docs] = K.sums(weight, np.concatenate([[0], np.cumsum(count)]))
            wanted[code] = False
        return which, score


def _index(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """Blocks of documents with their dictionaries and the terms' document frequencies (kind 0), and the seeds among them (kind 1)."""
    parts = K.partitions(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def split(batches):
        block = K.task_key()
        edges = np.array([(k << 48) // parts for k in range(parts + 1)], np.uint64)
        for part in K.slices(batches, "text", 4_000_000):
            words, _, _, offsets = K.words(K.strings(part.column("text")))
            words >>= np.uint64(16)
            seen, code = np.unique(words, return_inverse=True)
            pairs, tf = np.unique(K.owner(offsets) * max(1, len(seen)) + code, return_counts=True)
            doc, code = np.divmod(pairs, max(1, len(seen)))
            bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
            df = np.bincount(code, minlength=len(seen)).astype(np.uint32)
            head = [_ids(part.column("id")), K.pack(np.diff(offsets).astype(np.uint32)), K.pack(bounds.astype(np.uint32)), K.pack(code.astype(np.uint32), "zstd"), K.pack(tf.astype(np.uint32), "zstd")]
            rows = [(block, block % parts, -1, _join(head))]
            cut = np.searchsorted(seen, edges)
            for k in range(parts):
                a, b = cut[k], cut[k + 1]
                if a < b:
                    rows.append((block, k, k, _join([_deltas(seen[a:b]), K.pack(df[a:b])])))
            yield _batch(rows)
            block += 1

    def frequencies(group: pa.Table) -> pa.Table:
        blocks, marks, payloads = (group[c].to_pylist() for c in ("block", "part", "payload"))
        own = [(k, *_split(payloads[k])) for k in range(len(blocks)) if marks[k] >= 0]
        rows = [(blocks[k], 0, -1, payloads[k]) for k in range(len(blocks)) if marks[k] < 0]
        if own:
            terms = [_running(x) for _, x, _ in own]
            seen, code = np.unique(np.concatenate(terms), return_inverse=True)
            total = np.bincount(code, np.concatenate([K.unpack(x, np.uint32) for _, _, x in own])).astype(np.uint32)
            at = 0
            for (k, packed, _), mine in zip(own, terms):
                rows.append((blocks[k], 0, marks[k], _join([packed, K.pack(total[code[at : at + len(mine)]])])))
                at += len(mine)
        return pa.Table.from_batches([_batch(rows)])

    def assemble(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["part"].to_pylist(), group["payload"].to_pylist()), key=lambda x: x[0])
        ids, lengths, bounds, code, tf = _split(rows[0][1])
        lists = [_split(x) for _, x in rows[1:]]
        seen = np.concatenate([_running(x) for x, _ in lists]) if lists else np.zeros(0, np.uint64)
        df = np.concatenate([K.unpack(x, np.uint32) for _, x in lists]) if lists else np.zeros(0, np.uint32)
        size = K.unpack(lengths, np.uint32).astype(np.int64)
        block, made = group["block"][0].as_py(), [(0, len(size), int(size.sum()), _join([ids, lengths, bounds, code, tf, _deltas(seen), K.pack(df, "lz4")]))]
        at, own = K.unpack(bounds, np.uint32).astype(np.int64), _read_ids(ids)
        number = own.fill_null(1).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False) & (number % every == 0) & (size > 0))
        if len(some):
            count = at[some + 1] - at[some]
            where = K.expand(at[some], count)
            own_code, own_tf = K.unpack(code, np.uint32, "zstd")[where], K.unpack(tf, np.uint32, "zstd")[where]
            keep = df[own_code] > 1
            used, own_code = np.unique(own_code[keep], return_inverse=True)
            places = np.concatenate([[0], np.cumsum(K.sums(keep.astype(np.int64), np.concatenate([[0], np.cumsum(count)])))])
            pieces = [K.pack(x) for x in (number[some], some.astype(np.uint32), size[some].astype(np.uint32), places.astype(np.uint32), own_code.astype(np.uint32), own_tf[keep])]
            made.append((1, 0, 0, _join([*pieces, _deltas(seen[used]), K.pack(df[used])])))
        kinds, n_docs, n_words, payloads = map(list, zip(*made))
        return pa.table({"block": [block] * len(made), "kind": pa.array(kinds, pa.int32()), "n_docs": pa.array(n_docs, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "payload": pa.array(payloads, pa.binary())})

    return K.materialise(source.mapInArrow(split, _ROWS).groupBy("bucket").applyInArrow(frequencies, _ROWS).groupBy("block").applyInArrow(assemble, _BLOCKS))


def nearest_seeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, shard: int = SHARD, round_bytes: int = ROUND_BYTES, postings: int = POSTINGS) -> DataFrame:
    """``(block, row, id, n, seed_id, seed_block, seed_row, score)`` of each document with words: its n words, and the seed whose neighbour it is.

    The seeds (each document whose id is divisible by ``every``) are the queries: all distinct terms of their whole texts. Every
    shard of the index scores all of its documents for all seeds by BM25, exactly and with the statistics of the whole
    corpus. A document is the neighbour of the seed for which its score, divided by the root of the seed's own
    score, is the highest (of scores that are equal up to ``NEAR``, the first in the order of ids); a seed is its own. One that shares no term
    with a seed has none. Seeds go to the tasks in rounds of about ``round_bytes``. A shard is closed with the block that brings it to ``postings``, so that what a
    task holds follows neither the number nor the length of its documents.
    """
    spark = docs.sparkSession
    made = _index(docs, id_col, text_col, every)
    zero = F.lit(0).cast("long")
    n_docs, n_words, seed_bytes = made.agg(*(F.coalesce(F.sum(x), zero) for x in (F.col("n_docs"), F.col("n_words"), F.when(F.col("kind") == 1, F.length("payload"))))).first()
    mean, rounds = max(1.0, n_words / max(1, n_docs)), max(1, -(-seed_bytes // round_bytes))
    number = F.pmod(F.xxhash64("block"), F.lit(rounds))
    folder = K.shared_path(spark, "nearest")
    for k in range(rounds):
        sent = spark.sparkContext.broadcast([(r.block, bytes(r.payload)) for r in made.filter("kind = 1").filter(number == k).select("block", "payload").collect()])

        def score(batches, sent=sent):
            seeds, some, n, held = None, [], 0, 0

            def found(some):
                index = Shard(some, n_docs, mean)
                which, score = index.nearest(seeds)
                alive = np.flatnonzero(index.length > 0)
                seed = which[alive]
                of = lambda x, kind: pa.array((x[seed] if len(x) else seed).astype(kind), mask=seed < 0)
                columns = [pa.array(index.block[alive]), pa.array(index.row[alive].astype(np.int32)), index.ids.take(pa.array(alive)), pa.array(index.length[alive]), of(seeds.id, np.int64), of(seeds.block, np.int64), of(seeds.row, np.int32)]
                scaled = score[alive] * (seeds.scale[seed] if len(seeds.scale) else 0)
                return pa.RecordBatch.from_arrays([*columns, pa.array(np.where(seed < 0, 0.0, np.round(scaled, 6)))], ["block", "row", "id", "n", "seed_id", "seed_block", "seed_row", "score"])

            for batch in batches:
                for k in range(batch.num_rows):
                    if seeds is None:  # kept with what was sent, for the worker's next tasks
                        seeds = sent.seeds = getattr(sent, "seeds", None) or Seeds(sent.value, n_docs, mean)
                    some.append(Block(batch.column("block")[k].as_py(), batch.column("payload")[k].as_py(), every))
                    n, held = n + len(some[-1].length), held + len(some[-1].code)
                    if n >= 2 * shard or held >= postings:
                        yield from map(found, seeds.subjects.split(some))
                        some, n, held = [], 0, 0
                del batch  # it isn't kept while its documents are scored
            if some:
                yield from map(found, seeds.subjects.split(some))

        # A task holds a shard or, as partitions vary, up to two.
        made.filter("kind = 0").select("block", "payload").coalesce(max(1, -(-n_docs // shard))).mapInArrow(score, _NEAREST).write.mode("append").parquet(folder)
        sent.destroy()
    each = spark.read.schema(_NEAREST).parquet(folder)
    if rounds > 1:
        order = F.struct("score", -F.col("seed_id"), -F.col("seed_block"), -F.col("seed_row"))
        each = each.groupBy("block", "row").agg(*(F.max_by(c, order).alias(c) for c in ("id", "n", "seed_id", "seed_block", "seed_row", "score"))).select("block", "row", "id", "n", "seed_id", "seed_block", "seed_row", "score")
    own = F.col("id").isNotNull() & (F.pmod("id", F.lit(every)) == 0)
    return each.withColumns({"score": F.when(own, float("inf")).otherwise(F.col("score")), "seed_id": F.when(own, F.col("id")).otherwise(F.col("seed_id")), "seed_block": F.when(own, F.col("block")).otherwise(F.col("seed_block")), "seed_row": F.when(own, F.col("row")).otherwise(F.col("seed_row"))})


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, every: int = EVERY, group: int = GROUP, **options) -> DataFrame:
    """``(pack_id, position, id_col, first_word, n_words, seed_id)``: what each window holds, in order.

    Words are [\\p{L}\\p{N}]+ of the lower-cased text. Document frequencies and the mean length are
    counted over all documents. Each document whose id is divisible by ``every`` is a seed. A sharded inverted index scores every document of the
    corpus for all seeds, and each goes to the seed that it is nearest to (``nearest_seeds``); so each is used once. The seed opens
    its first window, and its neighbours, nearest first, are added greedily: each to that window of the seed with the least room that
    is enough for it (of equal ones the last added to), or to a new one. Documents without a seed are packed by themselves in the order of ids.
    Of a seed with more than ``group`` neighbours, and of the documents without one, parts by hash are packed apart, so that no task holds them all.
    A document of more words than a window fills windows of its own; what is left over is packed with others.

    The work of scoring grows with the documents times the seeds.

    Cases: a null or empty text, or one without words, is in no window; a null id stays
    null and is no seed; rows of one id, and repeated rows, are packed each; of equal scores the least id goes first; an empty table gives an
    empty result; other columns are left out; texts of any length are scored and packed whole, each word once.
    """
    seed = ["seed_block", "seed_row"]
    near = nearest_seeds(docs, id_col, text_col, every, **options).withColumns({c: F.coalesce(c, F.lit(-1)) for c in seed})
    big = near.groupBy(*seed).agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") > group)
    salted = near.join(big, seed, "left").withColumn("salt", F.when(F.col("all").isNull(), 0).otherwise(F.pmod(F.xxhash64("block", "row"), F.ceil(F.col("all") / group)).cast("int")))
    keys = [*seed, "salt"]
    ordered = salted.repartition(K.partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys, F.desc("score"), F.asc_nulls_first("id"), "n", "block", "row")

    def fill(batches):
        pack, now, rooms, mask = K.task_key(), None, {}, 0
        for batch in batches:
            out = []
            for key, i, n, of in zip(zip(*(batch.column(c).to_pylist() for c in keys)), *(batch.column(c).to_pylist() for c in ("id", "n", "seed_id"))):
                if key != now:
                    now, rooms, mask = key, {}, 0  # room -> windows that have it, and a bit for each such room
                for w in range(n // window):
                    out.append((pack, 0, i, w * window, window, of))
                    pack += 1
                rest = n % window
                if not rest:
                    continue
                fits = mask >> rest
                if fits:
                    room = rest + (fits & -fits).bit_length() - 1
                    one, position = rooms[room].pop()
                    if not rooms[room]:
                        mask ^= 1 << room
                else:
                    room, one, position = window, pack, 0
                    pack += 1
                out.append((one, position, i, n - rest, rest, of))
                if room > rest:
                    rooms.setdefault(room - rest, []).append((one, position + 1))
                    mask |= 1 << (room - rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["pack_id", "position", "id", "first_word", "n_words", "seed_id"])

    out = ordered.select(*keys, "id", "n", "seed_id").mapInArrow(fill, "pack_id long, position int, id long, first_word long, n_words long, seed_id long")
    return out.select("pack_id", "position", F.col("id").alias(id_col), "first_word", "n_words", F.col("seed_id").alias("seed_id" if id_col != "seed_id" else "seed_id_"))


def _deltas(ascending: np.ndarray) -> bytes:
    return K.pack(np.diff(ascending, prepend=np.uint64(0)))


def _running(packed: bytes) -> np.ndarray:
    return np.cumsum(K.unpack(packed, np.uint64), dtype=np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["block", "bucket", "part", "payload"])
