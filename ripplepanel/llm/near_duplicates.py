"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the groups that its links form.

A document's set holds a 64-bit hash of each distinct run of five words. Documents with equal sets are one class
and never expanded into pairs. For the classes:

1. A sketch of fixed size counts, over all texts, in how many sets a shingle occurs. Shingles are ordered by that
   count, then by hash: rare ones first, passages that many documents share last.
2. A class with n shingles that is the larger of a pair shares its first overlap within n - ceil(t n) + l of its
   ordered shingles, the smaller within n - ceil(2t/(1+t) n) + l; in such prefixes similar classes share at least
   l. Each class takes the l that makes the estimated cost least: entries to scan, plus the candidates that the
   counts let expect, which must share l times as much. A pair has to share the smaller of its two l.
3. Entries go to their shingle; those that meet no other class end there. Each shingle has a pivot, the class with
   the largest share of entries that met others. A class is verified with the pivot it shares most with; such
   pairs come first and join most copies of a large group.
4. Then classes of different groups meet. A pair that can be a link meets at the first shingle it shares, at which
   both have as many shingles left as the link needs; in rare-first order what edited copies of one text hold alone
   comes before that. Shingles with the same holders have the same pairs, so the first of them in the order stands for
   all. Of these pairs the parities of both sets, whose differing bits are at most the shingles that one of them lacks,
   rule out most; whole sets decide on the rest. No pair of different groups that can be a link is left out.
5. All links lie within groups. They are counted there, block of classes against block, as products of incidence
   matrices; a pair is never a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.llm.common import cut_clean as cut
from ripplepanel.llm.common import texts

WORDS = 5
#: Similarity as a fraction: intersection / union >= OVER / UNDER.
OVER, UNDER = 75, 100
SKETCH_BITS, BLOCK = 20, 1 << 14
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: What verifying one candidate costs, in prefix entries scanned.
VERIFY_COST = 40.0
FILTER_BITS = 25
#: Bits of a set's parities.
MARK_BITS = 1_024
ENTRIES = 150_000
#: Classes and shingles in a block of a group, and shingles in one product of two blocks.
BLOCK_CLASSES, BLOCK_SHINGLES, AT_ONCE = 1_000, 1 << 18, 4_096

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, known: _WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run, an empty one has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    runs = len(h) - n + 1
    total = np.full(runs, n, np.uint64)
    for k in range(n):
        total += _mix(h[k : k + runs] * _ODD[k % 5] + np.uint64(k))
    return np.unique(_mix(total))


def class_of(found: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def _marks(found: np.ndarray) -> bytes:
    """One bit per residue of the hashes: whether the set holds an odd number of that residue."""
    spots = ((found >> np.uint64(13)) & np.uint64(MARK_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(spots, minlength=MARK_BITS) & 1).astype(np.uint8)).tobytes()


def _prints(size: int, id_type: pa.DataType):
    """Rows of documents (id, n, class, and parities with the first of a class), and of sketch blocks (block, counts) per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        sketch, held, waiting = np.zeros(1 << SKETCH_BITS, np.int32), [], 0

        def add() -> None:  # one pass over the sketch for many documents
            if held:
                at = np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)
                np.add(sketch, np.bincount(at.astype(np.int64), minlength=len(sketch)), out=sketch, casting="unsafe")
                held.clear()

        for batch in batches:
            n, cls, marks = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), known, size)
                n.append(len(found))
                cls.append(class_of(found))
                marks.append(None)
                if len(found) and cls[-1] not in seen:
                    marks[-1] = _marks(found)
                    seen.add(cls[-1])
                    held.append(found)
                    waiting += len(found)
                    if waiting > 4 * len(sketch):
                        add()
                        waiting = 0
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(marks, pa.binary()),
                 none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "n", "cls", "marks", "block", "counts"])
        add()
        blocks = [b for b in range(len(sketch) // BLOCK) if sketch[b * BLOCK : (b + 1) * BLOCK].any()]
        none = pa.nulls(len(blocks))
        yield pa.RecordBatch.from_arrays(
            [none.cast(id_type), none.cast(pa.int64()),
             none.cast(pa.int64()), none.cast(pa.binary()), pa.array(blocks, pa.int32()),
             pa.array([sketch[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())],
            ["doc_id", "n", "cls", "marks", "block", "counts"])

    return run


def _add_blocks(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, np.int64)
    for batch in blocks:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int32)
    yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "counts": [total.astype(np.float32).tobytes()]})


def choose_matches(counts: np.ndarray, n: int, need: int) -> int:
    """The number of shared entries to ask for: least entries scanned plus expected candidates to verify.

    ``counts`` are the estimated numbers of other classes that hold each shingle, in order.
    """
    spent = np.concatenate([[0.0], np.cumsum(counts)])
    best, least = 1, np.inf
    for m in MATCHES:
        size = n - need + m
        if size > n:
            break
        cost = size + spent[size] + VERIFY_COST * spent[size] / m
        if cost < least:
            best, least = m, cost
    return best


def _entries(size: int, sketch, mean: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        counted = np.maximum(sketch.value - mean, 0)
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(5)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], ["token", "cls", "n", "matches", "pos"])

        for batch in batches:
            for text in batch.column("text"):
                found = shingles(text.as_py(), known, size)
                n = len(found)
                if not n:
                    continue
                cls = class_of(found)
                if cls in seen:
                    continue
                seen.add(cls)
                need = -(-OVER * n // UNDER)
                other = counted[found >> np.uint64(64 - SKETCH_BITS)]
                most = min(n, n - need + MATCHES[-1])
                order = np.lexsort((found, other))[:most]
                m = choose_matches(other[order], n, need)
                size_all = n - need + m
                held.append((
                    found[order[:size_all]].view(np.int64), np.full(size_all, cls, np.int64),
                    np.full(size_all, n, np.int32), np.full(size_all, m, np.int32),
                    np.arange(size_all, dtype=np.int32)))
                count += size_all
                if count > ENTRIES:
                    count = 0
                    yield flush()
        if held:
            yield flush()

    return run


def _sets(size: int, wanted):
    """Whole sets of the documents whose id the filter holds; it may hold a few more than asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            at = batch.column("at").to_numpy()
            keep = np.flatnonzero((wanted.value[at >> 3] >> (at & 7)) & 1)
            for start in range(0, len(keep), 500):
                rows = keep[start : start + 500]
                sets = [shingles(batch.column("text")[int(i)].as_py(), known, size) for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array([class_of(s) for s in sets], pa.int64()),
                     pa.array([_packed(s) for s in sets], pa.binary())], ["doc_id", "cls", "shingles"])

    return run


def _packed(found: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes. Two of a pair's shingles fall together once in 10**9 pairs of 500."""
    return np.ascontiguousarray(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(raw: memoryview) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _overlap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = _unpacked(a.as_buffer()), _unpacked(b.as_buffer())
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            keep.append(UNDER * both >= OVER * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``cls, comp`` for every end of an edge ``a, b``: the least class that links reach. Empty in, empty out.

    Each round takes the least label among neighbours, then the label of that label, until nothing changes.
    Labels and edges stay in tables; only the number of changes reaches the driver.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{tag}_edges")
    labels = cut(both.groupBy(F.col("a").alias("cls")).agg(F.min(F.least("a", "b")).alias("comp")), tag)
    while True:
        near = both.join(labels, both.b == labels.cls).groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "cls").select("cls", F.least("comp", "near").alias("low"), "comp")
        jump = labels.select(F.col("cls").alias("low"), F.col("comp").alias("jumped"))
        fresh = cut(lower.join(jump, "low").select("cls", F.least("low", "jumped").alias("comp"),
                                                   (F.least("low", "jumped") < F.col("comp")).alias("moved")), tag)
        changes = fresh.where("moved").count()
        labels = fresh.select("cls", "comp")
        if not changes:
            return labels


class _Verifier:
    """Checks candidate pairs of classes on the whole sets of their documents with the least id."""

    def __init__(self, rows: DataFrame, lead: DataFrame, size: int):
        self.rows, self.lead, self.size = rows, lead, size
        self.seen: list[DataFrame] = []

    def links(self, pairs: DataFrame, tag: str) -> DataFrame:
        pairs = cut(pairs.select("a", "b"), f"{tag}_pairs")
        ends = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(self.lead, "cls"), f"{tag}_ends")
        spark = ends.sparkSession
        # one bit per hashed id, 4 MB whatever the input; collisions let a few more documents through
        place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
        words = ends.select(place.alias("at")).distinct().mapInArrow(_filter_words, "word long, bits long")
        wanted = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        at, bits = got.column("word").to_numpy(), got.column("bits").to_numpy()
        wanted.view(np.int64)[at] = bits
        filled = spark.sparkContext.broadcast(wanted)
        kind = self.rows.schema["doc_id"].dataType.simpleString()
        sets = self.rows.select("doc_id", "text", place.alias("at")).mapInArrow(
            _sets(self.size, filled), f"doc_id {kind}, cls long, shingles binary")
        # by class alone, so that the join leaves equal rows of a document together; a class may have no id at all
        sets = sets.join(ends.withColumnRenamed("doc_id", "lead"), "cls").where(F.col("doc_id").eqNullSafe(F.col("lead")))
        sets = sets.dropDuplicates(["cls"]).select("cls", "shingles")
        sets = cut(sets, f"{tag}_sets")
        self.seen.append(sets)
        left = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
        whole = left.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
        return cut(whole.select("a", "b", "set_a", "set_b").mapInArrow(_overlap, "a long, b long"), f"{tag}_links")


def _filter_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column("at").to_numpy()
        words, where = np.unique(at >> 6, return_inverse=True)
        bits = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(bits, where, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(bits.view(np.int64))], ["word", "bits"])


def _linked_within(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of the other side each set is linked with; without ``right``, how many others of its own side."""
    sides = [left, left if right is None else right]
    tokens, at = np.unique(np.concatenate([np.concatenate(x) for x in sides]), return_inverse=True)
    cut_at = sum(map(len, left))
    spots = [at[:cut_at], at[cut_at:]]
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in sides]
    sizes = [np.array([len(s) for s in x], np.int64) for x in sides]
    both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    for start in range(0, len(tokens), AT_ONCE):
        parts = []
        for spot, owner, x in zip(spots, owners, sides, strict=True):
            here = (spot >= start) & (spot < start + AT_ONCE)
            part = np.zeros((len(x), min(AT_ONCE, len(tokens) - start)), np.float32)
            part[owner[here], spot[here] - start] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    shared = both.astype(np.int64)
    linked = UNDER * shared >= OVER * (sizes[0][:, None] + sizes[1][None, :] - shared)
    if right is None:
        np.fill_diagonal(linked, False)
    return linked.sum(axis=1), linked.sum(axis=0)


def _count_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, links) from rows that are sorted by pair of blocks: one pair of blocks is held at a time."""
    key, held = None, []

    def counted() -> pa.RecordBatch:
        sides = [[(c, s) for c, side, s in held if side == k] for k in (0, 1)]
        left, right = ([s for _, s in side] for side in sides)
        found = []
        if key[1] == key[2]:
            found = [(sides[0], _linked_within(left, None)[0])]
        elif left and right:
            found = list(zip(sides, _linked_within(left, right), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([c for side, _ in found for c, _ in side], pa.int64()),
             pa.array([int(n) for _, counts in found for n in counts], pa.int64())], ["cls", "links"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("comp", "low", "high", "side", "cls")]
        for *at, side, cls, packed in zip(*columns, batch.column("shingles"), strict=True):
            if at != key and held:
                yield counted()
                held.clear()
            key = at
            held.append((cls, side, _unpacked(packed.as_buffer())))
    if held:
        yield counted()


def links_within(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``cls, n_links``: with how many other classes of its group (``cls, comp``) each class is linked.

    A large group is dealt to blocks, and every pair of its blocks is counted on its own, so that a task holds two
    blocks whatever the group's size. The time is that of all pairs of a group.
    """
    members = cut(groups.join(sets, "cls").withColumn("n", F.length("shingles") / 6), "members")
    sizes = members.groupBy("comp").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK_CLASSES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "shingles")
    keys = ("comp", "low", "high")
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = placed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_count_links, "cls long, links long")
    return counted.groupBy("cls").agg(F.sum("links").alias("n_links"))


def _promising(pairs: DataFrame) -> DataFrame:
    """Pairs that share enough prefix entries and can still reach the overlap after the last one they share."""
    rest = F.least(F.col("n_a") - 1 - F.col("pos_a"), F.col("n_b") - 1 - F.col("pos_b"))
    return pairs.where(
        (F.col("shared") >= F.least("m_a", "m_b"))
        & ((F.col("shared") + rest) * (OVER + UNDER) >= OVER * (F.col("n_a") + F.col("n_b"))))


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities differ in no more bits than a link may have shingles in one set only."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, MARK_BITS // 64) for c in ("marks_a", "marks_b"))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        n = batch.column("n").to_numpy()
        # intersection >= OVER / (OVER + UNDER) * n, and n - 2 * intersection shingles are in one set only
        yield batch.select(["a", "b"]).filter(pa.array((OVER + UNDER) * apart <= (UNDER - OVER) * n))


def _across(met: DataFrame, groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Every pair ``a, b`` of classes of different groups that can be a link, from entries of shingles that several hold.

    A link shares its first shingle where both sides have at least OVER / (OVER + UNDER) of their sizes' sum left.
    """
    n, pos = F.col("n").cast("long"), F.col("pos").cast("long")
    placed = met.where(UNDER * (n - pos) >= OVER * n).select("token", "cls", n.alias("n"), (n - pos).alias("left"))
    placed = cut(placed.join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "placed")
    # entries are distinct by shingle and class, so equal holders have equal hashes; the order of shingles is the same
    # in all sets, so the first of several with equal holders is the one that leaves their least class most
    held = placed.groupBy("token").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("holders"),
        F.bit_xor(F.xxhash64("cls")).alias("one"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("two"),
        F.min("cls").alias("least"), F.min_by("left", "cls").alias("at"))
    first = held.where("low < high").groupBy("holders", "one", "two", "least").agg(F.max_by("token", "at").alias("token"))
    mixed = cut(placed.join(first.select("token"), "token", "left_semi"), "mixed")
    a, b = mixed.alias("a"), mixed.alias("b")
    pairs = a.join(b, F.col("a.token") == F.col("b.token")).where(
        (F.col("a.comp") != F.col("b.comp"))
        & ((F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.cls") > F.col("b.cls"))))
        & (UNDER * F.col("b.n") >= OVER * F.col("a.n"))
        & ((OVER + UNDER) * F.least("a.left", "b.left") >= OVER * (F.col("a.n") + F.col("b.n"))))
    pairs = pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), (F.col("a.n") + F.col("b.n")).alias("n")).distinct()
    for side in "ab":
        pairs = pairs.join(marks.select(F.col("cls").alias(side), F.col("marks").alias(f"marks_{side}")), side)
    return pairs.select("a", "b", "n", "marks_a", "marks_b").mapInArrow(_alike, "a long, b long")


def jaccard_groups(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``.

    ``component_id`` is the least id that links reach, the own included; ``n_links`` counts the other sets that the
    document's set is linked with; copies with its own set are not counted. A null, empty or blank text has an empty
    set and its own id. A null id takes the least id of its group, or null. Rows that repeat an id keep a row each.
    Only id and text are read; an empty table gives an empty table.
    """
    rows = texts(docs)
    id_type = rows.schema["doc_id"].dataType
    kind = id_type.simpleString()
    prints = cut(rows.mapInArrow(
        _prints(size, to_arrow_type(id_type)), f"doc_id {kind}, n long, cls long, marks binary, block int, counts binary"), "prints")
    documents = prints.where(F.col("block").isNull()).select("doc_id", "n", "cls")
    sketch = np.zeros(1 << SKETCH_BITS, np.float32)  # 4 MB whatever the input
    for r in prints.where(F.col("block").isNotNull()).select("block", "counts").groupBy("block").applyInArrow(
        _add_blocks, "block int, counts binary").toLocalIterator():
        sketch[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.float32)
    mean = float(sketch.mean()) + 2 * float(sketch.mean()) ** 0.5
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    entries = rows.select("text").mapInArrow(
        _entries(size, shared, mean), "token long, cls long, n int, matches int, pos int")
    by_token = Window.partitionBy("token")
    met = entries.withColumn("least", F.min("cls").over(by_token)).withColumn("most", F.max("cls").over(by_token))
    met = cut(met.where(F.col("least") < F.col("most")).drop("most").dropDuplicates(["token", "cls"]), "entries")

    lead = documents.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    verifier = _Verifier(rows, lead, size)

    # the pivot of a token is the class whose entries met others most: the text that others were made from, as a
    # changed copy has entries of its own
    held = F.col("n") - F.ceil(F.col("n") * OVER / UNDER) + F.col("matches")
    degree = met.groupBy("cls").agg((F.count(F.lit(1)) / F.max(held)).alias("known"))
    ranked = met.select("token", "cls", "n", "matches", "pos").join(degree, "cls")
    top = F.max(F.struct("known", "cls", F.col("n").alias("n_b"), F.col("matches").alias("m_b"), F.col("pos").alias("pos_b"))).over(by_token)
    star = ranked.withColumn("top", top).select("token", "cls", "n", "matches", "pos", F.col("top.cls").alias("b"), "top.n_b", "top.m_b", "top.pos_b")
    star = star.where((F.col("cls") != F.col("b")) & (UNDER * F.least("n", "n_b") >= OVER * F.greatest("n", "n_b")))
    star = star.groupBy(F.col("cls").alias("a"), "b").agg(
        F.count(F.lit(1)).alias("shared"), F.max("pos").alias("pos_a"), F.max("pos_b").alias("pos_b"),
        F.first("n").alias("n_a"), F.first("n_b").alias("n_b"), F.first("matches").alias("m_a"), F.first("m_b").alias("m_b"))
    star = _promising(star).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # two pivots of each other
    links = verifier.links(star, "star")
    joined = components(links, "star_groups")

    marks = prints.where(F.col("marks").isNotNull()).select("cls", "marks").dropDuplicates(["cls"])
    links = links.unionByName(verifier.links(_across(met, joined, marks), "rest"))

    groups = components(links, "groups")
    members = groups.join(lead, "cls").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    # a linked class was verified in one of the two steps, so its set is there
    degree = links_within(groups, verifier.seen[0].union(verifier.seen[1]).dropDuplicates(["cls"]))
    of_class = lead.withColumnRenamed("doc_id", "own").join(groups, "cls", "left").join(members, "comp", "left").join(
        degree, "cls", "left").select("cls", F.coalesce("component_id", "own").alias("component_id"),
                                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    full = documents.where("n > 0").join(of_class, "cls").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    blank = documents.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(blank)


def keep_one_of_each(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """One row of each group of linked documents, with all columns: the least id's.

    Of equal rows of that id one stays. Rows with an empty text are in no group and stay, and so do rows without
    id whose group has no id at all.
    """
    groups = jaccard_groups(docs, size)
    leads = cut(groups.where(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id").agg(
        F.max("n_shingles").alias("_n"), F.count(F.lit(1)).alias("_rows")), "leads")
    # ids that stand once need no look at their rows
    once = docs.join(leads.where("_rows = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(leads.where("_rows > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    lost = groups.where(F.col("doc_id").isNull() & F.col("component_id").isNull()).limit(1).count()
    kept = once.unionByName(again).select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull())) if lost else kept
