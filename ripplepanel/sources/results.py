"""Panels and named result tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def save_panel(panel: DataFrame, path: str, sort: Sequence[str] = ("zone_id", "date")) -> None:
    """Write a panel with rows ordered inside each file, for tight statistics."""
    panel.sortWithinPartitions(*sort).write.mode("overwrite").parquet(path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_result(df: DataFrame, name: str, root: str) -> str:
    """One parquet table per result name; saving again replaces it."""
    path = f"{root}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_result(spark: SparkSession, name: str, root: str) -> DataFrame | None:
    """The saved result, or None when no run has saved it."""
    path = f"{root}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(jpath) else None


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header. For result tables: a few hundred rows at most."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
