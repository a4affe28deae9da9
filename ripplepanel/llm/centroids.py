"""Exact k-means over integer vectors, with the search of Shallot.

Every vector keeps its nearest and second-nearest centroid, an upper bound of the distance to the first and a lower
bound of the distance to all others. Bounds follow the drift of the centroids. Where they no longer tell the nearest
centroid:

1. The distances to the two remembered centroids are taken anew; the closer one is where the search starts.
2. Its neighbours, sorted by their distance to it, are looked at in turn. A centroid further from the start than
   the vector's distance to the start plus that to its second-nearest so far can be neither first nor second; this
   ball shrinks whenever a nearer second is found, and the search ends with the first neighbour outside it.
3. Whatever is inside is compared in integers, equal distances by the smaller number.

Bounds are doubles with a margin far above their rounding, so they only ever say less than they could. Sums per
centroid follow from the vectors that moved. A round is one job over the written table of the round before, which
goes as soon as the next one is there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.session import cut, scratch_path

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components beyond this are refused: squared distances have to fit 64 bits.
LARGEST = 1 << 27
_MORE, _LESS, _FAR = 1 + 1e-9, 1 - 1e-9, np.iinfo(np.int64).max


def _integers(size: int, scale: int):
    """Rows (vec_id, x) of the vectors that have ``size`` finite components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            right = pc.fill_null(pc.equal(pc.list_value_length(column), size), False)
            ids, column = batch.column("vec_id").filter(right), column.filter(right)
            v = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = np.isfinite(v).all(axis=1)
            x = np.floor(v[whole] * scale)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST}: its squared distances do not fit 64 bits")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(whole)), _lists(x.astype(np.int32))], ["vec_id", "x"])

    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


class Guide:
    """What a round knows of its centroids: their distances, sorted neighbours, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.at = centroids
        k = len(centroids)
        gaps = centroids[:, None, :] - centroids[None, :, :]
        self.apart = np.sqrt((gaps * gaps).sum(axis=2).astype(float))
        self.neighbours = np.array([[c for c in np.argsort(self.apart[g], kind="stable") if c != g] for g in range(k)],
                                   np.int64).reshape(k, k - 1)
        self.half = np.full(k, np.inf)
        if k > 1:
            self.half = np.array([self.apart[g, self.neighbours[g, 0]] for g in range(k)]) / 2 * _LESS
        drift = np.zeros((k, 1)) if before is None else centroids - before
        self.drift = np.sqrt((drift * drift).sum(axis=1).astype(float)) * _MORE
        most = np.argsort(-self.drift, kind="stable")
        # the furthest move among all others
        self.others = np.full(k, self.drift[most[0]])
        self.others[most[0]] = self.drift[most[1]] if k > 1 else 0.0


def _squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x - centroid
    return np.einsum("...i,...i->...", gap, gap)


def assign(x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray, guide: Guide) -> int:
    """Bring the nearest (a), the second (b) and the bounds of integer vectors up to date, in place.

    A vector with a < 0 is new. Gives back the number of distances taken.
    """
    new = a < 0
    upper += np.where(new, np.inf, guide.drift[a])
    upper *= _MORE
    lower -= np.where(new, 0.0, guide.others[a])
    lower -= np.abs(lower) * (1 - _LESS)
    a[new] = 0
    left = np.flatnonzero(new | (upper >= np.maximum(lower, guide.half[a])))
    d = _squared(x[left], guide.at[a[left]])
    taken = len(left)
    upper[left] = np.sqrt(d) * _MORE
    still = new[left] | (upper[left] >= np.maximum(lower[left], guide.half[a[left]]))
    left, d = left[still], d[still]
    if not len(left) or len(guide.at) == 1:
        return taken
    first, second, far = a[left], b[left], np.full(len(left), _FAR)
    known = second >= 0
    far[known] = _squared(x[left[known]], guide.at[second[known]])
    taken += int(known.sum())
    swap = (far < d) | ((far == d) & known & (second < first))
    first[swap], second[swap] = second[swap], first[swap]
    d[swap], far[swap] = far[swap], d[swap]
    for start in np.unique(first):
        rows = np.flatnonzero(first == start)
        taken += _scan(x[left], rows, int(start), d, far, first, second, guide)
    a[left], b[left] = first, second
    upper[left], lower[left] = np.sqrt(d) * _MORE, np.sqrt(far) * _LESS
    return taken


def _scan(x, rows, start: int, d, far, first, second, guide: Guide) -> int:
    """Search the neighbours of ``start`` for the rows that start there."""
    reach, other, taken = np.sqrt(d[rows]) * _MORE, second[rows].copy(), 0
    for c in guide.neighbours[start]:
        ball = reach + np.where(far[rows] == _FAR, np.inf, np.sqrt(far[rows])) * _MORE
        inside = ball >= guide.apart[start, c] * _LESS
        if not inside.all():
            rows, reach, other = rows[inside], reach[inside], other[inside]
            if not len(rows):
                break
        ask = other != c
        at = rows[ask]
        new = _squared(x[at], guide.at[c])
        taken += len(at)
        nearer = (new < d[at]) | ((new == d[at]) & (c < first[at]))
        win = at[nearer]
        far[win], second[win] = d[win], first[win]
        d[win], first[win] = new[nearer], c
        next_best = ~nearer & ((new < far[at]) | ((new == far[at]) & (c < second[at])))
        far[at[next_best]], second[at[next_best]] = new[next_best], c
    return taken


_STATE = "x array<int>, a int, b int, upper double, lower double, part int, total array<long>, n long"


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _state(batch: pa.RecordBatch):
    return [batch.column(c).to_numpy().astype(t) for c, t in (("a", np.int64), ("b", np.int64), ("upper", float), ("lower", float))]


def _round(guide: Guide, id_type: pa.DataType):
    """Rows of vectors with their new state, then a row per centroid with what joined less what left it."""
    k, size = guide.at.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x, (a, b, upper, lower) = _vectors(batch, size), _state(batch)
            was = a.copy()
            assign(x, a, b, upper, lower, guide)
            moved = np.flatnonzero(was != a)
            for c in range(k):
                came, went = moved[a[moved] == c], moved[was[moved] == c]
                total[c] += x[came].sum(axis=0) - x[went].sum(axis=0)
                n[c] += len(came) - len(went)
            none = pa.nulls(len(a))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                 pa.array(upper), pa.array(lower), none.cast(pa.int32()), none.cast(pa.list_(pa.int64())), none.cast(pa.int64())],
                ["vec_id", "x", "a", "b", "upper", "lower", "part", "total", "n"])
        none, real = pa.nulls(k), pa.nulls(k).cast(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [none.cast(id_type), none.cast(pa.list_(pa.int32())), none.cast(pa.int32()), none.cast(pa.int32()), real, real,
             pa.array(np.arange(k, dtype=np.int32)), _lists(total), pa.array(n)],
            ["vec_id", "x", "a", "b", "upper", "lower", "part", "total", "n"])

    return run


def _last(guide: Guide):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, (a, b, upper, lower) = _vectors(batch, guide.at.shape[1]), _state(batch)
            assign(x, a, b, upper, lower, guide)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(a.astype(np.int32)), pa.array(_squared(x, guide.at[a]))],
                ["vec_id", "cluster", "distance"])

    return run


class _Tables:
    """Written tables of which the one before the last may go."""

    def __init__(self, spark):
        self.spark, self.path = spark, None

    def write(self, df: DataFrame, schema: str) -> DataFrame:
        path = scratch_path(self.spark, "centroids")
        df.write.parquet(path)
        if self.path:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
        self.path = path
        return self.spark.read.schema(schema).parquet(path)


def cluster_vectors(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` (squared) of every usable vector, and the final centroids.

    A vector is usable if it has exactly ``size`` components, none of them null or non-finite; component x counts as
    floor(scale * x). The first centroids are the vectors with the least sha256 of ``<seed>:<vec_id>``, equal ones by
    components; with fewer vectors there are fewer centroids. Rows that repeat an id are vectors of their own; a row
    without id is clustered, but no first centroid unless there are too few others. Other columns are ignored.
    Without usable vectors the result is empty. A component beyond 2**27 raises ValueError. Each task holds all
    distances between centroids: meant for up to a few thousand of them.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema["vec_id"].dataType
    arrow, kind = to_arrow_type(id_type), id_type.simpleString()
    kept = cut(vectors.select("vec_id", "embedding").mapInArrow(_integers(size, scale), f"vec_id {kind}, x array<int>"), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.select("x").orderBy(key.asc_nulls_last(), "x").limit(centroids).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), []
    at, before = np.array([r["x"] for r in first], np.int64), None
    total, n = np.zeros(at.shape, object), np.zeros(len(at), object)
    state = kept.select(
        "vec_id", "x", F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    tables, schema = _Tables(spark), f"vec_id {kind}, {_STATE}"
    for _ in range(rounds):
        done = tables.write(state.mapInArrow(_round(Guide(at, before), arrow), schema), schema)
        state = done.where(F.col("part").isNull()).select("vec_id", "x", "a", "b", "upper", "lower")
        change = done.where(F.col("part").isNotNull()).select("part", "n", F.posexplode("total").alias("i", "v")).groupBy("part", "i").agg(
            F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
        for r in change.collect():  # centroids x size rows
            total[r["part"], r["i"]] += int(r["v"])
            n[r["part"]] += int(r["n"]) if r["i"] == 0 else 0
        before, at = at, at.copy()
        for c in np.flatnonzero(n > 0):
            at[c] = [s // n[c] for s in total[c]]
    found = cut(state.mapInArrow(_last(Guide(at, before)), f"vec_id {kind}, cluster int, distance long"), "clusters")
    return found, at.tolist()


def report(vectors: DataFrame, **kw) -> DataFrame:
    """``cluster_vectors`` with the summed distances of a vector's cluster and of all, and its centroid's sha256."""
    found, at = cluster_vectors(vectors, **kw)
    spark = vectors.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
            for c, v in enumerate(at) if c in sums]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid, a number the caller sets
    return found.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
