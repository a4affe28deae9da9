"""MinHash near duplicates with fast similarity sketches, banding, and links confirmed on whole sets.

1. A sketch has a fixed number t of coordinates. In round i every shingle of a text is hashed anew to a coordinate and
   a value; a coordinate keeps its least value of its earliest round. From round t on all shingles go to coordinate
   i - t, so that after 2t rounds at most every coordinate is filled, whatever the number of shingles; a text whose
   sketch is full goes no further. Coordinates of two sketches agree as often as the sets are similar, with the
   concentration of draws without replacement, for t log t + n hashes instead of t n.
2. Bands of coordinates are hashed to buckets. Texts with equal sets are one class. With 72 bands of 7 a pair of
   similarity 0.8 shares no bucket with probability 5e-8, one of similarity 0.16 shares one with probability 2e-4.
3. Each bucket has a pivot, the class that shares most buckets with others. A class is confirmed with the pivot it
   meets most often: one pair per class, which joins most copies of a large group.
4. What is left are buckets that hold classes of several groups. Pairs of these that share a shingle which few hold
   are found by it. All other pairs overlap in common shingles only; most edited copies hold too few of them for any
   link and end there. Of the rest, groups are paired as one row per bucket and group; only pairs of different groups
   that sizes and common shingles allow are spread into pairs of classes. No pair that can be a link is left out, and
   no pair within a group is made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.llm.common import cut_clean as cut
from ripplepanel.llm.common import texts
from ripplepanel.llm.near_duplicates import _mix, _WordHashes, class_of, components, shingles

WORDS = 4
#: Similarity as a fraction: intersection / union >= OVER / UNDER.
OVER, UNDER = 80, 100
BANDS, IN_BAND = 72, 7
#: Shingles sketched at once in a task, and classes a task remembers.
CHUNK, REMEMBERED = 200_000, 500_000
#: Bits of the filter that picks the documents whose sets are needed.
FILTER_BITS = 25
SALTS = 16
#: A shingle that more classes hold is common.
RARE = 8
_EMPTY = np.uint64(np.iinfo(np.uint64).max)


def sketches(found: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` coordinates per non-empty set of shingle hashes."""
    lengths = np.array([len(f) for f in found], np.int64)
    out = np.full((len(found), size), _EMPTY, np.uint64)
    flat, owner = np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int64), lengths)
    i, spots = 0, np.uint64(size)
    while i < 2 * size and len(flat):
        # many rounds at once where few shingles are left: earlier rounds have smaller values, so the order is kept
        rounds = np.arange(i, min(i + max(1, CHUNK // len(flat) // 8), 2 * size if i >= size else size), dtype=np.uint64)
        h = _mix(flat[None, :] ^ _mix(rounds + np.uint64(1))[:, None])
        if i < size:
            spot = (((h >> np.uint64(32)) * spots) >> np.uint64(32)).astype(np.int64)
        else:
            spot = np.broadcast_to((rounds.astype(np.int64) - size)[:, None], h.shape)
        value = (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out.ravel(), (owner * size + spot).ravel(), value.ravel())
        i += len(rounds)
        left = np.zeros(len(found), bool)
        open_ = np.unique(owner)
        left[open_] = (out[open_] == _EMPTY).any(axis=1)
        stay = left[owner]
        flat, owner = flat[stay], owner[stay]
    return out


def buckets(sketch: np.ndarray, bands: int, in_band: int) -> np.ndarray:
    """The bucket of each band as a 64-bit number."""
    parts = sketch.reshape(len(sketch), bands, in_band)
    total = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for k in range(in_band):
        total = _mix(total ^ _mix(parts[:, :, k] + np.uint64(k)))
    return total.view(np.int64)


def _prints(size: int, bands: int, in_band: int):
    """Rows (id, n, class, buckets); buckets only where the task meets a class for the first time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _WordHashes(), set()
        ids, n, cls, sets, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = np.array([i for i, s in enumerate(sets) if s is not None], np.int64)
            offsets = np.zeros(len(sets) + 1, np.int32)
            offsets[rows + 1] = bands
            values = np.zeros(0, np.int64)
            if len(rows):
                values = buckets(sketches([sets[i] for i in rows], bands * in_band), bands, in_band).ravel()
            lists = pa.ListArray.from_arrays(np.cumsum(offsets, dtype=np.int32), pa.array(values))
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(ids), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), lists], ["doc_id", "n", "cls", "buckets"])
            for part in (ids, n, cls, sets):
                part.clear()
            return out

        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column("text")):
                found = shingles(text.as_py(), known, size)
                n.append(len(found))
                cls.append(class_of(found))
                fresh = len(found) > 0 and cls[-1] not in seen
                sets.append(found if fresh else None)
                if fresh:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(cls[-1])
                    held += len(found)
                if held > CHUNK or len(n) >= 20_000:
                    ids.append(batch.column("doc_id").slice(begun, i + 1 - begun))
                    begun, held = i + 1, 0
                    yield flush()
            if begun < batch.num_rows:
                ids.append(batch.column("doc_id").slice(begun))
        if n:
            yield flush()

    return run


def _packed(found: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes."""
    return np.ascontiguousarray(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(raw: memoryview) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _sets(size: int, wanted):
    """Whole sets of the documents whose place the filter holds; it may hold a few more than asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            at = batch.column("at").to_numpy()
            keep = np.flatnonzero((wanted.value[at >> 3] >> (at & 7)) & 1)
            for start in range(0, len(keep), 500):
                sets = [shingles(batch.column("text")[int(i)].as_py(), known, size) for i in keep[start : start + 500]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([_packed(s) for s in sets], pa.binary())],
                    ["cls", "shingles"])

    return run


def _filter_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.column("at").to_numpy()
        words, where = np.unique(at >> 6, return_inverse=True)
        bits = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(bits, where, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(bits.view(np.int64))], ["word", "bits"])


def _linked(over: int, under: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = _unpacked(a.as_buffer()), _unpacked(b.as_buffer())
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep.append(under * both >= over * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _whole_sets(rows: DataFrame, lead: DataFrame, size: int) -> DataFrame:
    """``cls, shingles`` of the classes in ``lead`` (cls, doc_id of one holder)."""
    # one bit per hashed id, 4 MB whatever the input; collisions let a few more documents through, a full filter all
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    words = lead.select(place.alias("at")).mapInArrow(_filter_words, "word long, bits long")
    wanted = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    wanted.view(np.int64)[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    filled = rows.sparkSession.sparkContext.broadcast(wanted)
    sets = rows.select("text", place.alias("at")).mapInArrow(_sets(size, filled), "cls long, shingles binary")
    return cut(sets.join(lead.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, over: int, under: int, tag: str) -> DataFrame:
    """The pairs of classes ``a, b`` whose whole sets are similar enough."""
    left = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
    whole = left.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
    return cut(whole.select("a", "b", "set_a", "set_b").mapInArrow(_linked(over, under), "a long, b long"), tag)


def _star(met: DataFrame, over: int, under: int) -> DataFrame:
    """One pair per class: with the pivot that it shares most buckets with."""
    members = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    known = met.join(members, "bucket").groupBy("cls").agg(F.sum("members").alias("known"))
    ranked = cut(met.join(known, "cls"), "ranked")
    pivot = ranked.groupBy("bucket").agg(F.max(F.struct("known", "cls", "n")).alias("top"))
    pivot = pivot.select("bucket", F.col("top.cls").alias("b"), F.col("top.n").alias("n_b"),
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = ranked.withColumn("salt", F.pmod("cls", F.lit(SALTS)).cast("int")).join(pivot, ["bucket", "salt"]).where(
        (F.col("cls") != F.col("b")) & (under * F.least("n", "n_b") >= over * F.greatest("n", "n_b")))
    pairs = pairs.groupBy(F.col("cls").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"))
    pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, shingle) of packed sets."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [_unpacked(s.as_buffer()) for s in part.column("shingles")]
            owner = np.repeat(part.column("cls").to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets).view(np.int64))], ["cls", "shingle"])


def _several(placed: DataFrame) -> DataFrame:
    """One row per bucket and group, of the buckets that hold several groups."""
    cells = placed.groupBy("bucket", "comp").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("held").alias("held"), F.count(F.lit(1)).alias("members"))
    groups = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")
    return cells.join(groups, "bucket", "left_semi")


def _across(met: DataFrame, groups: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Every pair of classes of different groups that share a bucket and can still be similar enough.

    Shingles that few of the classes in question hold are told from common ones. A pair that shares a rare shingle is
    found by it, at most RARE classes each. Any other pair overlaps in common shingles only, so in min(held) at most
    with ``held`` a class's common shingles, which rules out most edited copies without pairing them with their family.
    """
    placed = met.join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).withColumn("held", F.col("n"))
    mixed = _several(placed).select("bucket", "comp")
    placed = cut(placed.drop("held").join(mixed, ["bucket", "comp"], "left_semi"), "mixed")
    classes = placed.groupBy("cls").agg(F.first("n").alias("n"), F.first("comp").alias("comp"))
    asked = sets.join(classes.select("cls"), "cls", "left_semi").mapInArrow(_spread, "cls long, shingle long")
    few = asked.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE)
    rare = cut(asked.join(few, "shingle"), "rare")
    known = rare.groupBy("cls").agg(F.count(F.lit(1)).alias("rare"))
    placed = placed.join(known, "cls", "left").withColumn("held", F.col("n") - F.coalesce("rare", F.lit(0))).drop("rare")
    placed = cut(placed.where(under * F.col("held") >= over * F.col("n")), "placed")

    ends = rare.where("df > 1").join(classes, "cls")
    left, right = (ends.select("shingle", F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    by_rare = left.join(right, "shingle").where(
        (F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b"))
        & (under * F.least("n_a", "n_b") >= over * F.greatest("n_a", "n_b"))).select("a", "b").distinct()

    def possible(x: str, y: str) -> Column:
        """Whether sizes and held shingles of two sides, given at their best, allow a link."""
        both = F.least(f"held_{x}", f"held_{y}") * (over + under) >= over * (F.col(f"low_{x}") + F.col(f"low_{y}"))
        return both & (under * F.col(f"high_{x}") >= over * F.col(f"low_{y}")) & (under * F.col(f"high_{y}") >= over * F.col(f"low_{x}"))

    cells = cut(_several(placed), "cells")
    names = ("comp", "low", "high", "held", "members")
    a = cells.select("bucket", *[F.col(c).alias(f"{c}_a") for c in names])
    b = cells.select("bucket", *[F.col(c).alias(f"{c}_b") for c in names])
    # a pair is taken in the least of the buckets it shares; a class has as many as there are bands
    own = cut(placed.groupBy("cls").agg(F.collect_set("bucket").alias("own")), "own")
    placed = placed.join(own, "cls")
    # the side with fewer members is spread first
    fewer = F.struct("members_a", "comp_a") < F.struct("members_b", "comp_b")
    met_groups = a.join(b, "bucket").where(fewer & possible("a", "b"))
    for side, other in (("a", "b"), ("b", "a")):
        row = placed.select("bucket", F.col("comp").alias(f"comp_{side}"), F.col("cls").alias(side), F.col("own").alias(f"own_{side}"),
                            *[F.col(c).alias(f"{d}_{side}") for c, d in (("n", "low"), ("n", "high"), ("held", "held"))])
        met_groups = met_groups.drop(*[f"{c}_{side}" for c in ("low", "high", "held")]).join(
            row, ["bucket", f"comp_{side}"]).where(possible(side, other))
    by_common = met_groups.where(F.col("bucket") == F.array_min(F.array_intersect("own_a", "own_b")))
    by_common = by_common.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut(by_common.union(by_rare).distinct(), "across")


def sketch_groups(
    docs: DataFrame, size: int = WORDS, over: int = OVER, under: int = UNDER, bands: int = BANDS, in_band: int = IN_BAND,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked if their sets of ``size``-word shingles have a similarity of ``over`` / ``under`` or more;
    ``component_id`` is the least id that links reach, ``kept`` whether it is the row's own. A null, empty or blank
    text has an empty set, no links and its own id. A null id takes the least id of its group; where no row of the
    group has an id, all of it is kept. Rows that repeat an id keep a row each. Only id and text are read; an empty
    table gives an empty table. Bands are to be chosen for the similarity: a pair at it is missed with probability
    (1 - s ** in_band) ** bands.
    """
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    to_arrow_type(rows.schema["doc_id"].dataType)  # refuses what Arrow cannot carry before any work
    prints = cut(rows.mapInArrow(_prints(size, bands, in_band), f"doc_id {kind}, n long, cls long, buckets array<long>"), "prints")
    entries = prints.select("cls", "n", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most")
    met = cut(entries.join(shared.select("bucket"), "bucket", "left_semi").dropDuplicates(["bucket", "cls"]), "met")

    lead = prints.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    sets = _whole_sets(rows, met.select("cls").distinct().join(lead, "cls"), size)
    links = _confirmed(_star(met, over, under), sets, over, under, "star_links")
    groups = components(links, "star_groups")
    links = links.unionByName(_confirmed(_across(met, groups, sets, over, under), sets, over, under, "across_links"))
    groups = components(links, "sketch_groups")

    least = groups.join(lead, "cls").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = lead.withColumnRenamed("doc_id", "own").join(groups, "cls", "left").join(least, "comp", "left").select(
        "cls", F.coalesce("component_id", "own").alias("component_id"))
    placed = prints.where("n > 0").join(of_class, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(blank).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
