"""Weighted sums for many replicates at once: a row carries one array of weights and is never copied."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.functions.columns import poisson_one, portable_hash


def poisson_weights(keys: Sequence[str], replicates: int, seed: int | str, whole: bool = True) -> Column:
    """Poisson(1) weights of replicates 1 to ``replicates`` as an array; with ``whole`` a leading 1 for the data as is."""
    # two steps: the weight asks for its hash several times
    hashed = F.transform(F.sequence(F.lit(1), F.lit(replicates)), lambda b: portable_hash(*keys, b, seed=seed))
    drawn = F.transform(hashed, poisson_one)
    return F.concat(F.array(F.lit(1.0)), drawn) if whole else drawn


def replicate_sums(df: DataFrame, weights: Column, values: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """``by, rep, s``: for every replicate the sums of weight x value, as an array in the order of ``values``.

    Each task multiplies its weights by its values, so what is shuffled is one row per task, key and replicate. Keys
    are meant to be few. Rows with a null weight or value count as zero there.
    """
    schema = df.select(*by).schema
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    shaped = df.select(*by, weights.alias("_w"), F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]).alias("_v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = np.nan_to_num(batch.column("_w").flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(n, -1)
            v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            names: dict[tuple, int] = {}
            place = np.zeros(n, np.int64)
            if by:
                place[:] = [names.setdefault(k, len(names)) for k in zip(*[batch.column(c).to_pylist() for c in by], strict=True)]
            else:
                names[()] = 0
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=len(names)))
            for key, end, start in zip(names, ends, np.append(0, ends[:-1]), strict=True):
                rows = order[start:end]
                total[key] = total.get(key, 0.0) + w[rows].T @ v[rows]
        for key, sums in total.items():
            reps = len(sums)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([value] * reps, kind) for value, kind in zip(key, kinds, strict=True)],
                 pa.array(np.arange(reps, dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], [*by, "rep", "s"])

    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in schema.fields], "rep int", "s array<double>"])
    parts = shaped.mapInArrow(run, fields)
    summed = parts.groupBy(*by, "rep").agg(*[F.sum(F.col("s")[i]).alias(f"_{i}") for i in range(len(values))])
    return summed.select(*by, "rep", F.array(*[f"_{i}" for i in range(len(values))]).alias("s"))
