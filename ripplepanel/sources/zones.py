"""Zone dimension (CSV) and zone boundaries (a vertices table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplepanel.policy import Policy

LOOKUP_SCHEMA = T.StructType([
    T.StructField("LocationID", T.IntegerType()),
    T.StructField("Borough", T.StringType()),
    T.StructField("Zone", T.StringType()),
    T.StructField("service_zone", T.StringType()),
])

VERTEX_SCHEMA = T.StructType([
    T.StructField("zone_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("ring", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])


def borough_code(borough: Column, policy: Policy) -> Column:
    """Number of a borough by the policy's code list; unknown or null is 0."""
    code = F.lit(0)
    for name, number in policy.borough_codes.items():
        code = F.when(borough == name, F.lit(number)).otherwise(code)
    return code


def load_zone_lookup(spark: SparkSession, path: str, policy: Policy) -> DataFrame:
    """Zone lookup CSV with a declared schema: no inference pass over the file."""
    raw = spark.read.csv(path, header=True, schema=LOOKUP_SCHEMA)
    return raw.withColumnsRenamed(
        {"LocationID": "zone_id", "Borough": "borough", "Zone": "zone_name"}
    ).withColumn("borough_code", borough_code(F.col("borough"), policy))


def load_zone_vertices(spark: SparkSession, path: str) -> DataFrame:
    """Polygon vertices in WGS84; ring 0 is the outline, others are holes."""
    return spark.read.schema(VERTEX_SCHEMA).parquet(path)
