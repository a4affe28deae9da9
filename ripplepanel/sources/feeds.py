"""Raw trip feeds: three file layouts read into one schema."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplepanel.functions.columns import clip_low, nan_to_null

# column -> type of the unified trip, before cleaning
UNIFIED_TYPES = {
    "pickup_datetime": "timestamp_ntz",
    "dropoff_datetime": "timestamp_ntz",
    "pickup_zone": "int",
    "dropoff_zone": "int",
    "trip_distance": "double",
    "fare_amount": "double",
    "tolls_amount": "double",
    "passenger_count": "double",
    "cbd_congestion_fee": "double",
}

# range predicates reject NaN by their upper bound, so these columns stay bare
# and the predicates reach the parquet reader
_RANGE_CHECKED = {"trip_distance", "fare_amount"}


@dataclass(frozen=True)
class FeedLayout:
    """Candidate source names per unified column, first present one wins."""

    candidates: Mapping[str, Sequence[str]]
    surcharges: Sequence[str]


# The published column names of the three feeds.
_TAXI_SURCHARGES = (
    "improvement_surcharge", "extra", "mta_tax", "congestion_surcharge", "airport_fee",
)
_ROAD_FEE = ("cbd_congestion_fee", "cbd_congestion_surcharge")

FEED_LAYOUTS: dict[str, FeedLayout] = {
    "yellow": FeedLayout(
        {
            "pickup_datetime": ("tpep_pickup_datetime",),
            "dropoff_datetime": ("tpep_dropoff_datetime",),
            "pickup_zone": ("PULocationID",),
            "dropoff_zone": ("DOLocationID",),
            "trip_distance": ("trip_distance",),
            "fare_amount": ("fare_amount",),
            "tolls_amount": ("tolls_amount",),
            "passenger_count": ("passenger_count",),
            "cbd_congestion_fee": _ROAD_FEE,
        },
        _TAXI_SURCHARGES,
    ),
    "green": FeedLayout(
        {
            "pickup_datetime": ("lpep_pickup_datetime",),
            "dropoff_datetime": ("lpep_dropoff_datetime",),
            "pickup_zone": ("PULocationID",),
            "dropoff_zone": ("DOLocationID",),
            "trip_distance": ("trip_distance",),
            "fare_amount": ("fare_amount",),
            "tolls_amount": ("tolls_amount",),
            "passenger_count": ("passenger_count",),
            "cbd_congestion_fee": _ROAD_FEE,
        },
        _TAXI_SURCHARGES,
    ),
    "fhvhv": FeedLayout(
        {
            "pickup_datetime": ("pickup_datetime",),
            "dropoff_datetime": ("dropoff_datetime",),
            "pickup_zone": ("PULocationID",),
            "dropoff_zone": ("DOLocationID",),
            "trip_distance": ("trip_miles",),
            "fare_amount": ("base_passenger_fare",),
            "tolls_amount": ("tolls",),
            "passenger_count": (),
            "cbd_congestion_fee": (*_ROAD_FEE, "congestion_surcharge"),
        },
        ("bcf", "sales_tax", "congestion_surcharge", "airport_fee"),
    ),
}


def _present(df: DataFrame, names: Iterable[str]) -> list[str]:
    lowered = {c.lower(): c for c in df.columns}
    return [lowered[n.lower()] for n in names if n.lower() in lowered]


def surcharge_total(df: DataFrame, layout: FeedLayout) -> Column:
    """Row sum of the feed's surcharge fields, each at least 0, nulls as 0.

    The field that serves as the road fee is left out, so it is never counted
    twice, and missing fields count nothing.
    """
    fee = _present(df, layout.candidates["cbd_congestion_fee"])[:1]
    total = F.lit(0.0)
    for name in _present(df, layout.surcharges):
        if name not in fee:
            total = total + clip_low(nan_to_null(F.col(name).cast("double")))
    return total


def parse_timestamp(df: DataFrame, name: str) -> Column:
    """Bad text becomes null instead of failing the job."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.col(name).try_cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def unify_feed(df: DataFrame, trip_type: str, layout: FeedLayout | None = None) -> DataFrame:
    """One feed in the unified schema; columns the feed lacks are null.

    Keeps ``year_month`` (the declared month of the file) when present.
    """
    layout = layout or FEED_LAYOUTS[trip_type]
    out = []
    for target, kind in UNIFIED_TYPES.items():
        found = _present(df, layout.candidates[target])
        if not found:
            c = F.lit(None).cast(kind)
        elif kind == "timestamp_ntz":
            c = parse_timestamp(df, found[0])
        elif kind == "double" and target not in _RANGE_CHECKED:
            c = nan_to_null(F.col(found[0]).cast(kind))
        else:
            c = F.col(found[0]).cast(kind)
        out.append(c.alias(target))
    out.append(surcharge_total(df, layout).alias("surcharge_total"))
    out.append(F.lit(trip_type).alias("trip_type"))
    if "year_month" in df.columns:
        out.append(F.col("year_month").cast("string").alias("year_month"))
    return df.select(*out)


def unify_feeds(feeds: Mapping[str, DataFrame]) -> DataFrame:
    """Union of all feeds in the unified schema."""
    parts = [unify_feed(df, name) for name, df in feeds.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def scan_raw(
    spark: SparkSession, root: str, trip_types: Sequence[str] = tuple(FEED_LAYOUTS),
    months: Sequence[str] | None = None, schemas: Mapping[str, str] | None = None,
    lenient: bool = False,
) -> dict[str, DataFrame]:
    """Raw feeds below ``root/<trip_type>/year_month=<month>/``.

    A feed folder that does not exist is skipped and a month list prunes
    partitions. ``schemas`` declares a feed's columns (DDL, the month included):
    then no file is opened before the scan; without it all footers are merged. A
    damaged file fails the scan; ``lenient`` goes on without it, and
    ``unreadable_files`` lists what was left out.
    """
    feeds = {}
    for name in trip_types:
        path = f"{root}/{name}"
        if not _exists(spark, path):
            continue
        reader = spark.read.option("ignoreCorruptFiles", str(lenient).lower())
        declared = (schemas or {}).get(name)
        reader = reader.schema(declared) if declared else reader.option("mergeSchema", "true")
        df = reader.parquet(path)
        df = df.withColumn("year_month", F.col("year_month").cast("string"))
        if months is not None:
            df = df.where(F.col("year_month").isin(list(months)))
        feeds[name] = df
    return feeds


def unreadable_files(
    spark: SparkSession, root: str, trip_types: Sequence[str] = tuple(FEED_LAYOUTS),
    schemas: Mapping[str, str] | None = None,
) -> DataFrame:
    """``trip_type, path, bytes`` of files from which a lenient scan gets no row.

    Compares the listing (names and sizes, no content) with the files that rows
    came from; a file that truly has no rows is listed too.
    """
    parts = []
    for name, df in scan_raw(spark, root, trip_types, schemas=schemas, lenient=True).items():
        there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet").load(f"{root}/{name}").select(
            F.lit(name).alias("trip_type"), "path", F.col("length").alias("bytes"))
        read = df.select(F.col("_metadata.file_path").alias("path")).distinct()
        local = F.regexp_replace("path", "^file:/+", "/")
        parts.append(there.withColumn("path", local).join(read.withColumn("path", local), "path", "left_anti"))
    if not parts:
        return spark.createDataFrame([], "trip_type string, path string, bytes long")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("trip_type", "path", "bytes")


def write_clean(trips: DataFrame, root: str) -> int:
    """Append only the (trip_type, year_month) partitions not yet on disk.

    Returns how many partitions were new. Existing partitions are never
    rewritten, so a second run over the same input writes nothing. Partitions are
    written to a staging folder and moved into place whole, one rename each: a
    run that dies leaves no half partition that a later one would take for done.
    """
    spark = trips.sparkSession
    done = _written_partitions(spark, root)
    todo = trips
    if done is not None:
        todo = trips.join(F.broadcast(done), ["trip_type", "year_month"], "left_anti")
    staging = f"{root}/_staging-{uuid.uuid4().hex[:12]}"
    # rebalance: few files per small partition, several tasks for a big one
    (
        todo.hint("rebalance", "trip_type", "year_month").write.mode("append").partitionBy("trip_type", "year_month")
        .option("compression", "snappy").parquet(staging)
    )
    return _publish(spark, staging, root)


def _publish(spark: SparkSession, staging: str, root: str) -> int:
    """Moves each staged partition folder below ``root``; returns how many there were."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = 0
    for status in fs.globStatus(path(f"{staging}/trip_type=*/year_month=*")) or []:
        source = status.getPath()
        kind = source.getParent().getName()
        fs.mkdirs(path(f"{root}/{kind}"))
        if not fs.rename(source, path(f"{root}/{kind}/{source.getName()}")):
            raise OSError(f"cannot move {source} below {root}")
        moved += 1
    fs.delete(path(staging), True)
    return moved


def read_clean(
    spark: SparkSession, root: str, trip_types: Sequence[str] | None = None
) -> DataFrame:
    """Cleaned trips of some feeds; the filter prunes partition folders."""
    df = spark.read.parquet(root)
    df = df.withColumn("year_month", F.col("year_month").cast("string"))
    if trip_types is not None:
        df = df.where(F.col("trip_type").isin(list(trip_types)))
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _written_partitions(spark: SparkSession, root: str) -> DataFrame | None:
    """Partition values on disk, from folder names alone: no data is read."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return None
    found = []
    for status in fs.globStatus(
        spark._jvm.org.apache.hadoop.fs.Path(f"{root}/trip_type=*/year_month=*")
    ):
        month = status.getPath().getName().split("=", 1)[1]
        kind = status.getPath().getParent().getName().split("=", 1)[1]
        found.append((kind, month))
    if not found:
        return None
    return spark.createDataFrame(found, "trip_type string, year_month string")
