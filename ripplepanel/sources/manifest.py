"""Which raw files a clean table holds: one table of files, shared by batch and stream.

Clean rows lie in ``<root>/trips/trip_type=/year_month=/batch=/``. A batch counts once its files stand in
``<root>/manifest`` (trip_type, year_month, source, bytes, modified, batch), which is one append after its rows are
written: readers take the batches that stand there, so a run that dies half way leaves rows that nobody reads and files
that the next run takes again. What is to do are the files that do not stand there, late files of old months included.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplepanel.operators.clean import QualityLimits, clean_trips
from ripplepanel.policy import Policy
from ripplepanel.sources.feeds import FEED_LAYOUTS, unify_feed

MANIFEST = "trip_type string, year_month string, source string, bytes long, modified timestamp, batch string"


def file_name(path: Column) -> Column:
    """A path without its scheme's slashes, the same from a listing and from a scan."""
    return F.regexp_replace(path, "^file:/+", "/")


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def raw_files(spark: SparkSession, raw_root: str, trip_type: str) -> DataFrame:
    """``trip_type, year_month, source, bytes, modified`` of a feed's files, from the listing alone."""
    if not exists(spark, f"{raw_root}/{trip_type}"):
        return spark.createDataFrame([], MANIFEST).drop("batch")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(f"{raw_root}/{trip_type}")
    month = F.nullif(F.regexp_extract("path", r"year_month=([^/]+)/", 1), F.lit(""))
    return found.select(
        F.lit(trip_type).alias("trip_type"), month.alias("year_month"), file_name(F.col("path")).alias("source"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_manifest(spark: SparkSession, clean_root: str) -> DataFrame:
    path = f"{clean_root}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def pending_files(spark: SparkSession, raw_root: str, clean_root: str, trip_type: str) -> DataFrame:
    """Files that no batch holds yet. A file that was read and has changed since raises: its rows are already in."""
    there, done = raw_files(spark, raw_root, trip_type), read_manifest(spark, clean_root)
    changed = there.join(done.select("source", F.col("bytes").alias("_b"), F.col("modified").alias("_m")), "source").where(
        (F.col("bytes") != F.col("_b")) | (F.col("modified") != F.col("_m"))).select("source").limit(3).collect()
    if changed:
        raise ValueError(f"changed after they were read: {', '.join(r['source'] for r in changed)}")
    return there.join(done.select("source"), "source", "left_anti")


def commit(files: DataFrame, clean_root: str, batch: str) -> None:
    """Enter files into the manifest. One file in one append: either all of a batch is in, or nothing."""
    kept = files.withColumn("batch", F.lit(batch)).select(
        "trip_type", "year_month", "source", "bytes", "modified", "batch")
    kept.repartition(1).write.mode("append").parquet(f"{clean_root}/manifest")


def write_batch(trips: DataFrame, clean_root: str, batch: str) -> None:
    """Rows of a batch; written again under the same name, they replace what a dead run left."""
    (
        trips.withColumn("batch", F.lit(batch)).hint("rebalance", "trip_type", "year_month").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        .partitionBy("trip_type", "year_month", "batch").parquet(f"{clean_root}/trips")
    )


def ingest_files(
    spark: SparkSession, raw_root: str, clean_root: str, policy: Policy, limits: QualityLimits = QualityLimits(),
    trip_types: Sequence[str] = tuple(FEED_LAYOUTS), schemas: Mapping[str, str] | None = None,
) -> int:
    """Clean all files not yet in the manifest as one batch per feed; the number of files taken.

    ``schemas`` declares a feed's columns with the month; without it the footers of the pending files are merged.
    The driver sees file names only, as any file scan does.
    """
    taken = 0
    for kind in trip_types:
        files = pending_files(spark, raw_root, clean_root, kind)
        listed = files.collect()
        if not listed:
            continue
        files = spark.createDataFrame(listed, files.schema)
        declared = (schemas or {}).get(kind)
        reader = spark.read.option("basePath", f"{raw_root}/{kind}")
        reader = reader.schema(declared) if declared else reader.option("mergeSchema", "true")
        raw = reader.parquet(*[r["source"] for r in listed])
        if "year_month" in raw.columns:
            raw = raw.withColumn("year_month", F.col("year_month").cast("string"))
        batch = uuid.uuid4().hex
        write_batch(clean_trips(unify_feed(raw, kind), policy, limits), clean_root, batch)
        commit(files, clean_root, batch)
        taken += len(listed)
    return taken


def read_trips(spark: SparkSession, clean_root: str, trip_types: Sequence[str] | None = None) -> DataFrame:
    """Clean rows of committed batches; feed, month and batch prune folders."""
    batches = read_manifest(spark, clean_root).select("batch").distinct()
    df = spark.read.parquet(f"{clean_root}/trips").withColumn("year_month", F.col("year_month").cast("string"))
    if trip_types is not None:
        df = df.where(F.col("trip_type").isin(list(trip_types)))
    return df.join(batches, "batch", "left_semi").drop("batch")


def drop_uncommitted(spark: SparkSession, clean_root: str) -> int:
    """Delete the folders of batches that never came into the manifest; how many there were.

    For maintenance: not while a batch is being written.
    """
    kept = {r["batch"] for r in read_manifest(spark, clean_root).select("batch").distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(clean_root).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.globStatus(path(f"{clean_root}/trips/trip_type=*/year_month=*/batch=*")) or []:
        if status.getPath().getName().split("=", 1)[1] not in kept:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


_FOOTERS = "trip_type string, path string, bytes long, row_groups int, rows long, bad_row_groups int, error string"


def probe_files(spark: SparkSession, raw_root: str, trip_types: Sequence[str] = tuple(FEED_LAYOUTS)) -> DataFrame:
    """One row per raw file: its row groups and rows by the footer, and how many row groups cannot be read.

    Every file is opened in the task that holds its content, so a file of which a lenient scan still gets some row
    groups is found too. ``error`` is the first failure, null for a sound file.
    """
    parts = []
    for kind in trip_types:
        if exists(spark, f"{raw_root}/{kind}"):
            parts.append(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
                "pathGlobFilter", "*.parquet").load(f"{raw_root}/{kind}").select(
                F.lit(kind).alias("trip_type"), file_name(F.col("path")).alias("path"), F.col("length").alias("bytes"), "content"))
    if not parts:
        return spark.createDataFrame([], _FOOTERS)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.mapInArrow(_probe, _FOOTERS)


def _probe(batches):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        for i in range(batch.num_rows):
            groups, rows, bad, error = 0, 0, 0, None
            try:
                file = pq.ParquetFile(pa.BufferReader(batch.column("content")[i].as_buffer()))
                groups, rows = file.metadata.num_row_groups, file.metadata.num_rows
            except (pa.ArrowException, OSError) as e:
                file, error = None, str(e)
            for g in range(groups):
                try:
                    file.read_row_group(g)
                except (pa.ArrowException, OSError) as e:
                    bad, error = bad + 1, error or str(e)
            yield pa.RecordBatch.from_pydict({
                "trip_type": [batch.column("trip_type")[i].as_py()], "path": [batch.column("path")[i].as_py()],
                "bytes": pa.array([batch.column("bytes")[i].as_py()], pa.int64()), "row_groups": pa.array([groups], pa.int32()),
                "rows": pa.array([rows], pa.int64()), "bad_row_groups": pa.array([bad], pa.int32()),
                "error": pa.array([None if error is None else error[:200]], pa.string())})
