"""Exact global ranks and quantiles without pulling a column into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.session import cut


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank0") -> DataFrame:
    """0-based row number in ``order`` over the whole frame.

    Rows are range-partitioned, numbered inside each partition, and shifted by
    the sizes of the partitions before. Only one count per partition reaches
    the driver. Put a unique key last in ``order`` so ties split across tasks.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "rank"
    )
    sizes = dict(placed.groupBy("_part").count().collect())
    offset, shifts = 0, []
    for p in sorted(sizes):
        shifts.append((p, offset))
        offset += sizes[p]
    shift_table = spark.createDataFrame(shifts, "_part int, _shift long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        placed.join(F.broadcast(shift_table), "_part")
        .withColumn(name, (F.col("_shift") + inside).cast("long"))
        .drop("_part", "_shift")
    )


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], ties: Sequence[str] = ()
) -> list[float]:
    """Linear-interpolation quantiles; the driver sees two values per level."""
    rows = df.where(F.col(column).isNotNull()).select(column, *ties)
    ranked = global_rank(rows, [F.col(column), *[F.col(t) for t in ties]]).select(column, "rank0")
    n = ranked.count()
    if n == 0:
        return []
    spots = [p * (n - 1) for p in probs]
    wanted = sorted({int(s) for s in spots} | {min(int(s) + 1, n - 1) for s in spots})
    found = {r["rank0"]: r[column] for r in ranked.where(F.col("rank0").isin(wanted)).collect()}
    out = []
    for s in spots:
        low = int(s)
        high = min(low + 1, n - 1)
        out.append(found[low] + (found[high] - found[low]) * (s - low))
    return out


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
) -> DataFrame:
    """``<column>_upto``: sums within ``keys`` up to and with each row of ``order``, and ``next``, the following
    value of the first order column (null for the last row).

    Rows are range-partitioned by keys and order; what a key holds in earlier partitions comes from one row per
    (partition, key), and the value after a partition's last row from the first row of its next one. A key may
    spread over many tasks. ``order`` has to be unique within a key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = order[0]
    placed = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    # one row per partition and key that stands in it: keys in the middle of a partition stand in one only
    held = placed.groupBy("_part", *keys).agg(
        *[F.sum(c).alias(f"_held_{c}") for c in columns], F.min(first).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(
        "_part", *keys, *[F.coalesce(F.sum(f"_held_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in columns],
        F.lead("_first").over(along).alias("_after"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(held, ["_part", *keys])
    return out.select(
        *df.columns, *[(F.sum(c).over(upto) + F.col(f"_before_{c}")).alias(f"{c}_upto") for c in columns],
        F.coalesce(F.lead(first).over(inside), F.col("_after")).alias("next"))
