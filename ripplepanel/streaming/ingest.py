"""New raw files in, clean partitions out, each file exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplepanel.operators.clean import QualityLimits, clean_trips
from ripplepanel.policy import Policy
from ripplepanel.sources import manifest
from ripplepanel.sources.feeds import unify_feed


def feed_schema(spark: SparkSession, raw_root: str, trip_type: str) -> T.StructType:
    """Schema of the files there now, with the month kept as text."""
    found = spark.read.option("mergeSchema", "true").parquet(f"{raw_root}/{trip_type}").schema
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "year_month" else f.dataType)
        for f in found])


def ingest_new_files(
    spark: SparkSession, raw_root: str, trip_type: str, clean_root: str, state_dir: str,
    policy: Policy, limits: QualityLimits = QualityLimits(), schema: T.StructType | str | None = None,
    max_files: int = 1000,
) -> int:
    """Clean every file not seen before and append it; the number of files taken.

    The stream's file log in ``state_dir`` says what it has been offered, the manifest that batch and stream share
    what the table holds: a file that stands there is not written again, whoever wrote it. A micro-batch has one
    name, so a call that dies half way is finished by the next one, which replaces its rows. Cleaning is narrow: no
    state, no shuffle. ``schema`` declares the feed's columns with the month; without it footers are merged.
    """
    raw = (
        spark.readStream.schema(schema or feed_schema(spark, raw_root, trip_type))
        .option("maxFilesPerTrigger", max_files).option("ignoreMissingFiles", "true")
        .parquet(f"{raw_root}/{trip_type}").withColumn("_source", manifest.file_name(F.col("_metadata.file_path"))))
    taken = []

    def take(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        batch = f"stream-{trip_type}-{number}"
        files = rows.select(F.col("_source").alias("source")).distinct().join(
            manifest.pending_files(session, raw_root, clean_root, trip_type), "source")
        listed = files.collect()  # at most max_files names
        if not listed:
            return
        files = session.createDataFrame(listed, files.schema)
        # a batch reads max_files names, so the list is as short
        fresh = rows.where(F.col("_source").isin([r["source"] for r in listed])).drop("_source")
        manifest.write_batch(clean_trips(unify_feed(fresh, trip_type), policy, limits), clean_root, batch)
        manifest.commit(files, clean_root, batch)
        taken.append(len(listed))

    query = raw.writeStream.foreachBatch(take).option(
        "checkpointLocation", f"{state_dir}/{trip_type}").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(taken)


def read_ingested(spark: SparkSession, clean_root: str, trip_type: str) -> DataFrame:
    return manifest.read_trips(spark, clean_root, [trip_type])
