"""Exact BM25 top-k: an inverted index per shard, searched for hundreds of queries at a time, merged with global statistics.

1. One pass over the documents counts, per task, the documents of every term; the sums over all tasks, the number of
   documents and their mean length are global, so scores of shards compare.
2. A query is all distinct words of its text, each weighted by its frequency there times its global inverse document
   frequency.
3. Queries that speak alike travel together, packed by term: a term's hash stands there once, with the queries that hold it.
4. Documents are dealt to shards of about ``shard_bytes`` of text, the packed queries go to every shard. A task reads
   the documents of its shard first, indexes them in memory, and then takes the queries as they stream by.
5. Within a shard, documents that speak alike lie together in blocks. For a block and a pack of queries, every term takes
   the cheaper of two ways: where many of these queries meet it in many of these documents it is a row of a matrix
   product, else its list is added up for each query that holds it. Terms that are not in the block cost nothing.
6. These sums are 32-bit and only tell which documents can be among the best k, by the bound on their error; those are
   scored in full, in 64 bits.
7. The best k of every shard meet by query.

Terms travel as 64-bit hashes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.llm.common import cut_clean, share, texts

K1, B = 1.2, 0.75
TOP = 10
#: Bytes of text per shard, and documents at most: what one task holds as an index.
SHARD_BYTES, SHARD_DOCS = 64_000_000, 100_000
#: Bytes of a text split at once, and terms a task of the first pass holds before it hands them on.
SPLIT_BYTES, HOLD_TERMS = 4_000_000, 1_000_000
#: Scores are rounded to so many places; equal ones go by id.
PLACES = 6
#: Documents scored in full at a time, and what rounding may move a score by.
STEP, SLACK = 256, 2.0 * 10.0**-PLACES
#: Queries of a pack, and their terms; queries and terms a task gathers before it packs them.
PACK, PACK_TERMS = 400, 400_000
GATHER, GATHER_TERMS = 4096, 2_000_000
#: Documents of a block: as many are wished for, and so many there are at least (but in the last) and at most.
BLOCK, BLOCK_LEAST, BLOCK_MOST = 2500, 1000, 8000
#: Cells of a task's table of sums and of a factor of a product; entries added up at once.
CELLS, FACTOR_CELLS, ENTRIES = 8_000_000, 4_000_000, 100_000
#: Time of an entry that is added up over that of a cell of a product; documents of a group whose best sum is taken.
ENTRY_COST, GROUP = 700, 64
#: Most common terms that tell which rows speak alike, rows that are compared at a time, rounds.
COMMON, ROWS, ROUNDS = 256, 4096, 8

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def count_words(text: bytes) -> Counter:
    """Words of a UTF-8 text, A-Z lowered, with their frequencies; split in parts of bounded size."""
    if len(text) <= SPLIT_BYTES:
        return Counter(text.lower().split())
    counted: Counter = Counter()
    start = 0
    while start < len(text):
        gap = _BLANK.search(text, start + SPLIT_BYTES)
        end = gap.start() if gap else len(text)
        counted.update(text[start:end].lower().split())
        start = end
    return counted


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n).view(np.int64)


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, term, n) of a task: documents per term; kinds 1 to 3 are documents, words and bytes."""

    def rows(kind: np.ndarray, term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(term), pa.array(n)], ["kind", "term", "n"])

    def flush() -> pa.RecordBatch:
        size = len(held)
        return rows(np.zeros(size, np.int32), _hashes(held, size), np.fromiter(held.values(), np.int64, size))

    held: Counter = Counter()
    totals = np.zeros(3, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            raw = bytes(text.as_buffer())
            counted = count_words(raw)
            held.update(counted.keys())
            totals += (1, sum(counted.values()), len(raw))
            if len(held) >= HOLD_TERMS:
                yield flush()
                held.clear()
    yield flush()
    yield rows(np.arange(1, 4, dtype=np.int32), np.zeros(3, np.int64), totals)


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, term, times) of the queries' words."""
    for batch in batches:
        for query, text in zip(batch.column("query_id").to_pylist(), batch.column("text"), strict=True):
            counted = count_words(bytes(text.as_buffer()))
            size = len(counted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, query, np.int64)), pa.array(_hashes(counted, size)),
                 pa.array(np.fromiter(counted.values(), np.int64, size))], ["query_id", "term", "times"])


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the spans one after the other, and how many each has."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes), sizes


def _alike(at: np.ndarray, terms: np.ndarray, n_terms: int, groups: int) -> np.ndarray:
    """Group numbers of rows (row i has ``terms[at[i]:at[i + 1]]``): means over the most common terms. They decide the
    order of work only."""
    n = len(at) - 1
    if groups < 2 or not len(terms):
        return np.zeros(n, np.int64)
    common = np.argsort(-np.bincount(terms, minlength=n_terms), kind="stable")[:COMMON]
    place = np.full(n_terms, -1, np.int32)
    place[common] = np.arange(len(common))

    def vectors(rows: np.ndarray) -> np.ndarray:
        where, sizes = _spans(at[rows], at[rows + 1])
        column, row = place[terms[where]], np.repeat(np.arange(len(rows)), sizes)
        x = np.zeros((len(rows), len(common)), np.float32)
        x[row[column >= 0], column[column >= 0]] = 1
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    some = vectors(np.unique(np.linspace(0, n - 1, ROWS).astype(np.int64)))
    means = some[np.linspace(0, len(some) - 1, groups).astype(np.int64)]
    for _ in range(ROUNDS):
        nearest = (some @ means.T).argmax(1)
        means = np.stack([some[nearest == g].sum(0) if (nearest == g).any() else means[g] for g in range(groups)])
        means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    return np.concatenate([
        (vectors(np.arange(start, min(n, start + ROWS))) @ means.T).argmax(1) for start in range(0, n, ROWS)])


class Pack(NamedTuple):
    """Queries by term: hash and number of documents of each term, how many queries hold it; who they are, how often."""

    query_ids: np.ndarray
    terms: np.ndarray
    dfs: np.ndarray
    heads: np.ndarray
    who: np.ndarray
    times: np.ndarray


def _packs(ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, dfs: np.ndarray) -> Iterator[Pack]:
    """Queries with ``sizes`` terms each, those that speak alike together, by number of terms."""
    hashes, first, no = np.unique(terms, return_index=True, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    order = np.lexsort((sizes, _alike(at, no, len(hashes), len(ids) // PACK)))
    start = 0
    while start < len(order):
        run = order[start : start + PACK]
        run = run[: max(1, int(np.searchsorted(np.cumsum(sizes[run]), PACK_TERMS, side="right")))]
        where, n = _spans(at[run], at[run + 1])
        by = np.argsort(no[where], kind="stable")
        held, heads = np.unique(no[where], return_counts=True)
        yield Pack(ids[run], hashes[held], dfs[first[held]], heads, np.repeat(np.arange(len(run)), n)[by], times[where][by])
        start += len(run)


_PACK_TYPES = {"query_ids": np.int64, "terms": np.int64, "dfs": np.int64, "heads": np.int32, "who": np.int16, "times": np.int32}


def _shrunk(values: np.ndarray, kind: type) -> bytes:
    """Compressed, first bytes first: every shard gets a copy."""
    return zlib.compress(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), 1)


def _grown(shrunk: pa.BinaryScalar, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(shrunk.as_buffer()), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of a task's queries, a row each."""

    def flush() -> Iterator[pa.RecordBatch]:
        for pack in _packs(*map(np.concatenate, zip(*held, strict=True))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([_shrunk(v, kind)]) for v, kind in zip(pack, _PACK_TYPES.values(), strict=True)], list(_PACK_TYPES))

    held: list[tuple[np.ndarray, ...]] = []
    for whole in batches:
        for start in range(0, whole.num_rows, GATHER):
            batch = whole.slice(start, GATHER)
            lists = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "times", "dfs")]
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((batch.column("query_id").to_numpy(zero_copy_only=False), sizes, *lists))
            if sum(len(h[0]) for h in held) >= GATHER or sum(len(h[2]) for h in held) >= GATHER_TERMS:
                yield from flush()
                held = []
    if held:
        yield from flush()


class _Block(NamedTuple):
    """Lists of a block's terms, one after the other: documents, counted from the block's first, and what they add."""

    start: int
    end: int
    terms: np.ndarray
    at: np.ndarray
    docs: np.ndarray
    part: np.ndarray


class ShardIndex:
    """The documents of one shard: by document, and by term in blocks of documents that speak alike."""

    def __init__(self, mean_length: float):
        self.mean = mean_length
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list = []
        # of all documents one after the other: as arrays of their own they would leave holes in the memory
        self._lengths, self._sizes, self._terms, self._freqs = array("q"), array("q"), array("i"), array("i")

    def add(self, doc_id, text: bytes) -> None:
        counted = count_words(text)
        if not counted:  # never found
            return
        self.ids.append(doc_id)
        self._lengths.append(sum(counted.values()))
        self._sizes.append(len(counted))
        self._terms.extend(map(self.numbers.__getitem__, counted))
        self._freqs.extend(counted.values())

    def close(self) -> ShardIndex:
        """Turn what was added into the index."""
        n, n_terms = len(self.ids), len(self.numbers)
        hashed = _hashes(self.numbers, n_terms)
        self.numbers = None
        self.by_hash = np.argsort(hashed)
        self.hashes = hashed[self.by_hash]
        sizes, lengths = np.array(self._sizes, np.int64), np.array(self._lengths, np.float64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(self._terms, np.int32) if n else np.zeros(0, np.int32)
        kind = _alike(at, flat, n_terms, n // BLOCK)
        order = np.lexsort((lengths, kind))
        spans = list(zip(at[order].tolist(), at[order + 1].tolist(), strict=True))
        self.doc_term = np.concatenate([flat[:0], *(flat[a:b] for a, b in spans)])
        self._terms = None
        flat = np.frombuffer(self._freqs, np.int32) if n else np.zeros(0, np.int32)
        flat = flat.astype(np.min_scalar_type(flat.max(initial=0)))
        self.doc_freq = np.concatenate([flat[:0], *(flat[a:b] for a, b in spans)])
        self._freqs = flat = None
        self.ids = [self.ids[i] for i in order]
        self.norm = K1 * (1 - B + B * lengths[order] / self.mean)
        self.doc_at = np.concatenate([[0], np.cumsum(sizes[order])])
        edges = [0]
        for end in [*np.flatnonzero(np.diff(kind[order])) + 1, n]:
            if end - edges[-1] >= BLOCK_LEAST or end == n:
                pieces = -(-(end - edges[-1]) // BLOCK_MOST)
                edges += [edges[-1] + (end - edges[-1]) * (i + 1) // pieces for i in range(pieces)]
        self.blocks = [self._block(start, end) for start, end in zip(edges, edges[1:])]
        self.weights, self.asked = np.zeros(n_terms), np.zeros(n_terms, bool)
        self.slot = np.full(n_terms, -1, np.int32)
        self.scored = self.entries = 0
        return self

    def _block(self, start: int, end: int) -> _Block:
        held = slice(self.doc_at[start], self.doc_at[end])
        by = np.argsort(self.doc_term[held], kind="stable")
        listed = self.doc_term[held][by]
        first = np.flatnonzero(np.diff(listed, prepend=-1))
        docs = np.repeat(np.arange(end - start, dtype=np.min_scalar_type(BLOCK_MOST)), np.diff(self.doc_at[start : end + 1]))[by]
        freqs = self.doc_freq[held][by]
        part = (freqs * (K1 + 1) / (freqs + self.norm[start:end][docs])).astype(np.float32)
        return _Block(start, end, listed[first], np.append(first, len(listed)), docs, part)

    def full(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents for the terms that are asked, under their weights."""
        self.scored += len(docs)
        scores = np.zeros(len(docs))
        for start in range(0, len(docs), STEP):
            step = docs[start : start + STEP]
            spans = list(zip(self.doc_at[step].tolist(), self.doc_at[step + 1].tolist(), strict=True))
            terms = np.concatenate([self.doc_term[a:b] for a, b in spans])
            held = np.flatnonzero(self.asked[terms])
            freqs = np.concatenate([self.doc_freq[a:b] for a, b in spans])[held]
            no = np.repeat(np.arange(len(step)), self.doc_at[step + 1] - self.doc_at[step])[held]
            value = self.weights[terms[held]] * (freqs * (K1 + 1) / (freqs + self.norm[step][no]))
            scores[start : start + STEP] = np.bincount(no, value, len(step))
        return scores

    def _add_product(self, sums: np.ndarray, block: _Block, starts: np.ndarray, ends: np.ndarray, some: np.ndarray, of: np.ndarray,
                     who: np.ndarray, weights: np.ndarray) -> None:
        """Add the terms ``some`` to the sums of all queries in the block: a product of two dense matrices."""
        n_docs = block.end - block.start
        most = max(1, FACTOR_CELLS // max(n_docs, len(sums)))
        for k in range(0, len(some), most):
            rows = some[k : k + most]
            place = np.full(len(starts), -1, np.int32)
            place[rows] = np.arange(len(rows))
            column = place[of]
            asked = np.zeros((len(sums), len(rows)), np.float32)
            asked[who[column >= 0], column[column >= 0]] = weights[column >= 0]
            at, sizes = _spans(starts[rows], ends[rows])
            lists = np.zeros((len(rows), n_docs), np.float32)
            lists[np.repeat(np.arange(len(rows)), sizes), block.docs[at]] = block.part[at]
            sums[:, block.start : block.end] += asked @ lists

    def _add_lists(self, sums: np.ndarray, block: _Block, starts: np.ndarray, ends: np.ndarray, who: np.ndarray,
                   weights: np.ndarray) -> None:
        """Add a list of the block to the sums of each of the queries ``who``."""
        flat = sums.reshape(-1)
        first = who * sums.shape[1] + block.start
        before = np.append(0, np.cumsum(ends - starts))
        self.entries += int(before[-1])
        k = 0
        while k < len(who):
            end = max(k + 1, int(np.searchsorted(before, before[k] + ENTRIES, side="right")) - 1)
            at, sizes = _spans(starts[k:end], ends[k:end])
            np.add.at(flat, np.repeat(first[k:end], sizes) + block.docs[at], np.repeat(weights[k:end], sizes) * block.part[at])
            k = end

    def _sums(self, n: int, width: int, terms: np.ndarray, of: np.ndarray, who: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores in 32 bits: a row for each of ``n`` queries; query ``who`` has term ``terms[of]`` with such a weight."""
        sums = np.zeros((n, width), np.float32)
        weights = weights.astype(np.float32)
        heads = np.bincount(of, minlength=len(terms))
        for block in self.blocks:
            self.slot[block.terms] = np.arange(len(block.terms), dtype=np.int32)
            slot = self.slot[terms]
            self.slot[block.terms] = -1
            starts, ends = block.at[slot], np.where(slot >= 0, block.at[slot + 1], block.at[slot])
            dense = (ends - starts) * heads * ENTRY_COST > n * (block.end - block.start)
            self._add_product(sums, block, starts, ends, np.flatnonzero(dense), of, who, weights)
            rest = np.flatnonzero(((ends > starts) & ~dense)[of])
            self._add_lists(sums, block, starts[of[rest]], ends[of[rest]], who[rest], weights[rest])
        return sums

    def search_pack(self, n: int, hashes: np.ndarray, idf: np.ndarray, heads: np.ndarray, who: np.ndarray, times: np.ndarray,
                    top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` queries the documents of the shard that may be among its ``top`` best, with their scores; all
        that tie for the last place. Query and term occur together once."""
        place = np.searchsorted(self.hashes, hashes)
        here = place < len(self.hashes)
        here[here] = self.hashes[place[here]] == hashes[here]
        terms = self.by_hash[place[here]]
        kept = np.repeat(here, heads)
        of = np.repeat(np.cumsum(here) - 1, heads)[kept]
        who, weights = who[kept].astype(np.int64), times[kept] * np.repeat(idf, heads)[kept]
        by = np.argsort(who, kind="stable")
        of, who, weights = of[by], who[by], weights[by]
        of_query = np.searchsorted(who, np.arange(n + 1))
        n_docs = len(self.ids)
        group = max(1, min(GROUP, n_docs // (4 * top)))
        width = max(1, -(-n_docs // group)) * group  # documents past the last one have sums of 0
        rows = max(1, CELLS // width)
        for start in range(0, n, rows):
            end = min(n, start + rows)
            own = slice(of_query[start], of_query[end])
            sums = self._sums(end - start, width, terms, of[own], who[own] - start, weights[own])
            best = sums.reshape(end - start, group, -1).max(1)
            floor = np.zeros(end - start)
            if best.shape[1] > top:  # the best of as many groups of documents: so much the last place has at least
                floor = np.partition(best, best.shape[1] - top, axis=1)[:, best.shape[1] - top].astype(np.float64)
            # sums of positive numbers are off by at most so much of themselves
            off = np.minimum(1.0, (np.diff(of_query[start : end + 1]) + 8) * 2.0**-23)
            floor = np.maximum((floor * (1 - off) - SLACK) * (1 - off), 0.0).astype(np.float32)
            for i in range(end - start):
                mine = slice(of_query[start + i], of_query[start + i + 1])
                docs = np.flatnonzero((sums[i] >= floor[i]) & (sums[i] > 0))
                self.weights[terms[of[mine]]], self.asked[terms[of[mine]]] = weights[mine], True
                scores = self.full(docs)
                self.asked[terms[of[mine]]] = False
                yield docs, scores

    def search(self, hashes: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """``search_pack`` of one query with the weights of its terms."""
        one, none = np.ones(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        return list(self.search_pack(1, hashes, weights, one, none, one, top))[0]


def _best(found: Iterable[tuple[float, object]], top: int) -> list[tuple[float, object]]:
    """By rounded score, then id; a missing id comes last."""
    return sorted(found, key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:top]


def _search_shards(n_docs: int, mean_length: float, top: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, shard, closed = ShardIndex(mean_length), None, False
        for batch in batches:
            packed = batch.column("query_ids").is_valid().to_pylist()
            for i, to in enumerate(batch.column("shard").to_pylist()):
                if to != shard:
                    index, shard, closed = ShardIndex(mean_length), to, False
                if not packed[i]:
                    index.add(batch.column("doc_id")[i].as_py(), bytes(batch.column("text")[i].as_buffer()))
                    continue
                if not closed:
                    index.close()
                    closed = True
                pack = Pack(*(_grown(batch.column(c)[i], kind) for c, kind in _PACK_TYPES.items()))
                out: tuple[list, list, list] = ([], [], [])
                idf = np.log(1 + (n_docs - pack.dfs + 0.5) / (pack.dfs + 0.5))
                found = index.search_pack(len(pack.query_ids), pack.terms, idf, pack.heads, pack.who, pack.times, top)
                for query, (docs, scores) in zip(pack.query_ids.tolist(), found, strict=True):
                    for score, doc in _best(((round(s, PLACES), index.ids[d]) for s, d in zip(scores.tolist(), docs.tolist(), strict=True)), top):
                        for column, value in zip(out, (query, doc, score), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], id_type), pa.array(out[2], pa.float64())],
                    ["query_id", "doc_id", "score"])

    return run


def similar_documents(docs: DataFrame, queries: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``top`` documents for every row of ``queries``, itself among them.

    All words of a query count, as often as they stand in it. Scores are rounded to six places; equal ones go by id, a
    document without id last. A query without words finds nothing; documents without a word of the query are never
    found. Rows of ``queries`` with the same id are one query of all their words; a null id asks nothing, but a
    document without id may be found, and a document that is there twice is found twice. Null texts are empty. Empty
    tables give an empty table. Query ids are whole numbers; only ids and texts are read, whatever other columns are
    called.
    """
    rows = texts(docs)
    counted = rows.select("text").mapInArrow(_tally, "kind int, term long, n long")
    counted = cut_clean(counted.groupBy("kind", "term").agg(F.sum("n").alias("n")), "bm25_terms")
    totals = dict(map(tuple, counted.where(F.col("kind") > 0).select("kind", "n").collect()))  # three rows
    n_docs, mean = totals.get(1, 0), totals.get(2, 0) / max(1, totals.get(1, 0)) or 1.0
    shards = max(share(totals.get(3, 0), shard_bytes), share(n_docs, SHARD_DOCS))

    asked = texts(queries).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("query_id"), "text")
    asked = asked.mapInArrow(_asked, "query_id long, term long, times long")
    asked = asked.groupBy("query_id", "term").agg(F.sum("times").cast("int").alias("times"))
    asked = asked.join(counted.where(F.col("kind") == 0).select("term", F.col("n").alias("df")), "term")
    asked = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "times", "df"))).alias("t"))
    asked = cut_clean(asked.select(
        "query_id", F.col("t.term").alias("terms"), F.col("t.times").alias("times"), F.col("t.df").alias("dfs")), "bm25_queries")

    packed = asked.coalesce(share(asked.count(), GATHER)).mapInArrow(_pack, ", ".join(f"{c} binary" for c in _PACK_TYPES))

    # dealt by place in the table, as one id or text may hold many rows
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    sent = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = dealt.unionByName(sent, allowMissingColumns=True)
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("query_ids").isNotNull())
    id_type = docs.schema["doc_id"].dataType
    found = both.select("shard", "doc_id", "text", *_PACK_TYPES).mapInArrow(
        _search_shards(n_docs, mean, top, to_arrow_type(id_type)), f"query_id long, doc_id {id_type.simpleString()}, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).select(
        "query_id", "rank", "doc_id", "score")
