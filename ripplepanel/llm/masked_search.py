"""Exact ranked lexical search: documents grouped by the mask of the item terms they hold.

1. One pass counts, for the terms of a block of items, the documents that hold them, and all documents and terms.
   Each task brings one row per term.
2. A second pass searches. A task holds some documents at a time: which term stands in which document as bits, and
   what each occurrence is worth. For an item the bits of its terms are turned into one mask per document; documents
   with equal masks are one group, whose score cannot exceed the sum of the best worths of the mask's terms. Groups
   are scored from the highest such bound down, until the bound falls below the item's k-th score. That score is
   carried from one load of documents to the next.
3. The best k of every task meet by item.

Items go through in blocks of bounded text, so that what a task gets does not grow with their number.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.llm.common import share, texts

#: Bytes of item text that one pass searches for.
BLOCK_BYTES = 4_000_000
#: Documents a task holds at once, and the cells of its table of terms by documents.
LOAD_ROWS, LOAD_CELLS = 8192, 32_000_000
#: Occurrences of item terms a task holds before they are searched, and bytes of text split at once.
LOAD_TERMS, SPLIT_BYTES = 4_000_000, 4_000_000
#: Documents scored at a time.
STEP = 64
# Fixed values of the score: scale of a worth, length share in percent, saturation.
UNIT, LENGTH, SATURATION = 1000, 25, 12

_BREAKS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_BREAKS + _UPPER, b" " * len(_BREAKS) + _UPPER.lower())


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded size: ASCII letters (A-Z lowered), digits, all beyond ASCII."""
    folded = text.translate(_FOLD)
    start = 0
    while start < len(folded):
        end = len(folded)
        if end - start > SPLIT_BYTES:
            end = folded.find(b" ", start + SPLIT_BYTES)
            end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def term_weight(docs: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holders + 1)))


class _Load:
    """Documents of a task, as counts of the terms that are asked for."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known
        self.most = max(64, min(LOAD_ROWS, LOAD_CELLS // max(1, len(known))))
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, text: bytes) -> None:
        found, n = [], 0
        for part in terms(text):
            n += len(part)
            at = np.fromiter(map(self.known.get, part, repeat(-1)), np.int64, len(part))
            found.append(np.unique(at[at >= 0], return_counts=True))
        if len(found) > 1:
            at, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            found = [(at, np.bincount(back, np.concatenate([f[1] for f in found]), len(at)).astype(np.int64))]
        if found and len(found[0][0]):
            self.keys.append(found[0][0] + len(self.ids) * len(self.known))
            self.counts.append(found[0][1])
            self.held += len(found[0][0])
        self.ids.append(doc_id)
        self.lengths.append(n)

    @property
    def full(self) -> bool:
        return len(self.ids) >= self.most or self.held >= LOAD_TERMS

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (document x terms + term), and how often each occurs."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(self.keys), np.concatenate(self.counts)


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column("doc_id").to_pylist(), (bytes(t.as_buffer()) for t in batch.column("text")), strict=True)


def _tally(known: dict[bytes, int]):
    """Rows (term, holders) of a task; term -1 stands for documents with a term, -2 for all terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders, docs, total = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text"):
                n, held = 0, []
                for part in terms(bytes(text.as_buffer())):
                    n += len(part)
                    at = np.fromiter(map(known.get, part, repeat(-1)), np.int64, len(part))
                    held.append(at[at >= 0])
                docs += n > 0
                total += n
                if held:
                    holders[np.unique(np.concatenate(held))] += 1
        at = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [-1, -2]]).astype(np.int32)),
             pa.array(np.concatenate([holders[at], [docs, total]]).astype(np.int64))], ["term", "holders"])

    return run


def masks(holds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in order of their mask, where each mask starts, and the masks as rows of 0 and 1.

    ``holds`` has a row per term and a column per document. Documents without a term are left out.
    """
    packed = np.packbits(holds, axis=0)
    words = np.zeros((-(-len(packed) // 8) * 8, packed.shape[1]), np.uint8)
    words[: len(packed)] = packed
    words = np.ascontiguousarray(words.T).view(np.uint64)
    some = np.flatnonzero(words.any(axis=1))
    words = words[some]
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T)
    words, some = words[order], some[order]
    new = np.ones(len(some), bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return some, starts, np.unpackbits(words[starts].view(np.uint8), axis=1)[:, : len(holds)]


class _Search:
    """All items of a block over the documents of one task."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], size: int, docs: int, total: int, top: int):
        self.items, self.size, self.docs, self.total, self.top = items, size, docs, total, top
        self.best: list[list[tuple]] = [[] for _ in items]
        self.scored = 0

    def load(self, held: _Load) -> None:
        keys, counts = held.arrays()
        if not len(keys):
            return
        doc, term = np.divmod(keys, self.size)
        n = np.array(held.lengths, np.int64)
        m = 100 - LENGTH + LENGTH * n * self.docs // max(1, self.total)
        worth = UNIT**3 * counts // (UNIT * counts + SATURATION * m[doc])
        highest = np.zeros(self.size, np.int64)
        np.maximum.at(highest, term, worth)
        holds = np.zeros((self.size, len(n)), bool)
        holds[term, doc] = True
        for i, (asked, weight) in enumerate(self.items):
            if len(asked):
                self.one(i, asked, weight, held.ids, keys, worth, highest, holds)

    def one(self, i: int, asked, weight, ids: list, keys, worth, highest, holds) -> None:
        floor = -self.best[i][-1][0] if len(self.best[i]) == self.top else 0
        limit = weight * highest[asked]
        if limit.sum() < max(floor, 1):
            return
        order, starts, bits = masks(holds[asked])
        bound = bits @ limit
        ends = np.append(starts[1:], len(order))
        first = np.argsort(-bound, kind="stable")
        first = first[: np.searchsorted(-bound[first], -max(floor, 1), side="right")]
        found_doc, found_score, at = [], [], 0
        sizes = np.cumsum(ends[first] - starts[first])
        while at < len(first) and bound[first[at]] >= floor:
            done = sizes[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(sizes, done + STEP, side="right")))
            docs = np.concatenate([order[starts[g] : ends[g]] for g in first[at:upto]])
            here = holds[asked[:, None], docs]
            place = np.searchsorted(keys, docs * self.size + asked[:, None])
            value = np.where(here, worth[np.minimum(place, len(keys) - 1)], 0)
            found_doc.append(docs)
            found_score.append(weight @ value)
            self.scored += len(docs)
            at = upto
            scores = np.concatenate(found_score)
            if len(scores) >= self.top:
                floor = max(floor, int(np.partition(scores, len(scores) - self.top)[len(scores) - self.top]))
        if found_doc:
            docs, scores = np.concatenate(found_doc), np.concatenate(found_score)
            keep = scores >= max(floor, 1)
            fresh = [(-int(s), ids[d] is None, ids[d]) for s, d in zip(scores[keep], docs[keep], strict=True)]
            # ids are compared only where one is there
            self.best[i] = sorted(self.best[i] + fresh, key=lambda r: r[:2] if r[1] else r)[: self.top]

    def rows(self, id_type: pa.DataType) -> pa.RecordBatch:
        flat = [(i, r[2], -r[0]) for i, found in enumerate(self.best) for r in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], id_type),
             pa.array([r[2] for r in flat], pa.int64())], ["item", "doc_id", "score"])


def _searched(block, docs: int, total: int, top: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items = block.value
        held, search = _Load(known), _Search(items, len(known), docs, total, top)
        for doc_id, text in _documents(batches):
            held.add(doc_id, text)
            if held.full:
                search.load(held)
                held.clear()
        search.load(held)
        yield search.rows(id_type)

    return run


def _search_block(docs: DataFrame, asked: list[Counter], top: int) -> DataFrame:
    """``item, doc_id, score``: the best of every task for each item of a block, given by its place."""
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    counted = docs.select("text").mapInArrow(_tally(known), "term int, holders long")
    # a row for each term of the block, whatever the number of documents
    got = counted.groupBy("term").agg(F.sum("holders").alias("holders")).toArrow()
    holders = dict(zip(got.column("term").to_pylist(), got.column("holders").to_pylist(), strict=True))
    n, total = holders.get(-1, 0), holders.get(-2, 0)
    items = []
    for counts in asked:
        weighed = [(known[t], q * term_weight(n, holders[known[t]])) for t, q in sorted(counts.items()) if known[t] in holders]
        weighed = [w for w in weighed if w[1] > 0]
        items.append((np.array([w[0] for w in weighed], np.int64), np.array([w[1] for w in weighed], np.int64)))
    block = spark.sparkContext.broadcast((known, items))
    id_type = docs.schema["doc_id"].dataType
    return docs.mapInArrow(
        _searched(block, n, total, top, to_arrow_type(id_type)), f"item int, doc_id {id_type.simpleString()}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents with a score above 0 for every row of ``items``.

    Equal scores come by ascending id, a document without id last. A null, empty or signs-only text has no term: as
    a document it counts nowhere, as an item it finds nothing. Every row stands for itself: a document that is there
    twice is found twice, an item that is there twice is answered twice. Texts are read whole, however long; columns
    other than ids and texts are ignored, whatever their names. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    rows, wanted = texts(docs), texts(items, keys=("item_id",))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = share(size, BLOCK_BYTES)
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    id_kind = wanted.schema["item_id"].dataType.simpleString()
    best = None
    for b in range(blocks):
        held = wanted.where(number == b).toArrow()  # about BLOCK_BYTES of text
        asked = [Counter(t for part in terms(bytes(x.as_buffer())) for t in part)
                 for x in pc.fill_null(held.column("text"), "").combine_chunks()]
        named = spark.createDataFrame(list(enumerate(held.column("item_id").to_pylist())), f"item int, item_id {id_kind}")
        found = _search_block(rows, asked, top)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        found = found.join(named, "item").select("item_id", "rank", "doc_id", "score")
        best = found if best is None else best.unionByName(found)
    return best
