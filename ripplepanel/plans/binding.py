"""The star-schema tables read as trips, zones and a policy."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplepanel.operators.clean import clean_trips, month_label
from ripplepanel.operators.panel import build_panel, panel_from_cells, roll_up
from ripplepanel.operators.treatment import assign_dose, assign_treatment, enrich_zones
from ripplepanel.policy import Policy
from ripplepanel.session import cut
from ripplepanel.sources.zones import borough_code

SHOCK = date(1998, 7, 5)

STAR_POLICY = Policy(
    shock=SHOCK,
    announcement=date(1998, 5, 1),
    core=tuple(range(1, 9)),
    buffer=tuple(range(9, 13)),
    airports=(1, 14, 20),
    home_borough="AFRICA",
    center_lat=40.65,
    center_lon=-73.80,
    borough_codes={"AFRICA": 1, "AMERICA": 2, "ASIA": 3, "EUROPE": 4},
    holidays=(date(1998, 7, 1), date(1998, 12, 1), date(1999, 1, 1), date(1999, 7, 1)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what a trip takes from the other tables, and both months: few and narrow columns."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # orders find their customer first: however large the two get, the line items move once for both
    homes = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    joined = (
        line.join(homes, line.l_orderkey == homes.o_orderkey)
        .join(supplier, line.l_suppkey == supplier.s_suppkey)
    )
    day = F.col("l_shipdate").cast("timestamp_ntz")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
        "c_nationkey", "s_nationkey", F.expr("cast(l_orderkey % 24 as int)").alias("_hour"),
        F.when(F.col("l_returnflag") == "A", "yellow")
        .when(F.col("l_returnflag") == "N", "green").otherwise("fhvhv").alias("trip_type"),
        month_label(
            F.when(F.col("l_linenumber") == 7, F.date_add(F.to_date(day), 1))
            .otherwise(F.to_date(day))).alias("leaky_month"),
        month_label(day).alias("year_month"))


def _as_trips(rows: DataFrame) -> DataFrame:
    """Bound rows as raw trips in the unified schema."""
    zone = F.col("c_nationkey") + 1
    day = F.col("l_shipdate").cast("timestamp_ntz")
    dropoff = F.col("pickup_datetime") + F.expr(
        "make_dt_interval(0, 0, cast(l_quantity * 8 - 10 as int))")
    fee = F.when(
        (day >= F.lit(SHOCK).cast("timestamp_ntz")) & (zone <= 8),
        F.col("l_tax") * 25 * zone / 4)
    return rows.select(
        "l_orderkey", "l_linenumber",
        (day + F.expr("make_dt_interval(0, _hour)")).alias("pickup_datetime"),
        zone.cast("int").alias("pickup_zone"),
        (F.col("s_nationkey") + 1).cast("int").alias("dropoff_zone"),
        (F.col("l_quantity") * 7 - 10).alias("trip_distance"),
        (F.col("l_extendedprice") / 100 - 20).alias("fare_amount"),
        (F.col("l_tax") * 10).alias("tolls_amount"),
        F.col("l_linenumber").cast("double").alias("passenger_count"),
        fee.alias("cbd_congestion_fee"),
        (F.col("l_discount") * 10 - 0.2).alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        "trip_type", "leaky_month", "year_month", "l_quantity",
    ).withColumn("dropoff_datetime", dropoff).drop("l_quantity")


def bound_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw trips in the unified schema, declared month included."""
    return _as_trips(_bound_rows(spark, sf_dir))


def raw_feeds(
    spark: SparkSession, sf_dir: str, leaky: bool = False, gathered: bool = False
) -> dict[str, DataFrame]:
    """The same trips under the column names of the three raw feeds.

    ``gathered`` brings the rows of a month together for a write by month, while they still are bound rows: a trip
    holds most of their values twice.
    """
    name = "leaky_month" if leaky else "year_month"
    month = F.col(name).alias("year_month")
    rows = _bound_rows(spark, sf_dir)

    def trips(kind: str) -> DataFrame:
        mine = rows.where(F.col("trip_type") == kind)
        return _as_trips(mine.hint("rebalance", name) if gathered else mine)

    def taxi(prefix: str, kind: str) -> DataFrame:
        return trips(kind).select(
            F.col("pickup_datetime").alias(f"{prefix}_pickup_datetime"),
            F.col("dropoff_datetime").alias(f"{prefix}_dropoff_datetime"),
            F.col("pickup_zone").alias("PULocationID"), F.col("dropoff_zone").alias("DOLocationID"),
            "trip_distance", "fare_amount", "tolls_amount", "passenger_count",
            F.col("cbd_congestion_fee").alias("cbd_congestion_surcharge"),
            "extra", "mta_tax", F.lit(None).cast("double").alias("airport_fee"), month)

    ride = trips("fhvhv").select(
        "pickup_datetime", "dropoff_datetime",
        F.col("pickup_zone").alias("PULocationID"), F.col("dropoff_zone").alias("DOLocationID"),
        F.col("trip_distance").alias("trip_miles"),
        F.col("fare_amount").alias("base_passenger_fare"), F.col("tolls_amount").alias("tolls"),
        F.col("cbd_congestion_fee").alias("congestion_surcharge"),
        F.col("extra").alias("bcf"), F.col("mta_tax").alias("sales_tax"),
        F.lit(0.0).alias("tips"), month)
    return {"yellow": taxi("tpep", "yellow"), "green": taxi("lpep", "green"), "fhvhv": ride}


def star_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clean trips."""
    trips = bound_trips(spark, sf_dir).withColumn(
        "surcharge_total", F.greatest(F.col("extra"), F.lit(0.0)) + F.col("mta_tax"))
    return clean_trips(trips, STAR_POLICY)


def zone_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        (F.col("n_nationkey") + 1).cast("int").alias("zone_id"),
        F.col("r_name").alias("borough"), F.col("n_name").alias("zone_name"),
        borough_code(F.col("r_name"), STAR_POLICY).alias("borough_code"))


def star_panel(
    spark: SparkSession, sf_dir: str, unit: str, min_trips: int, days: DataFrame | None = None
) -> DataFrame:
    """Panel with zone facts and treatment attached, dose still missing. ``days`` are cells of days, if made."""
    if days is None:
        panel = build_panel(star_clean(spark, sf_dir), STAR_POLICY, unit, min_trips)
    else:
        panel = panel_from_cells(days if unit == "day" else roll_up(days, unit), STAR_POLICY, min_trips)
    return assign_treatment(
        enrich_zones(panel, zone_dimension(spark, sf_dir)), STAR_POLICY)


def star_panel_with_dose(
    spark: SparkSession, sf_dir: str, unit: str, min_trips: int, days: DataFrame | None = None
) -> DataFrame:
    # the dose needs quantiles of the panel: aggregate once, not per pass
    return assign_dose(cut(star_panel(spark, sf_dir, unit, min_trips, days), "panel"))


def parcel_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per customer: a square lot, every third one with a hole.

    Grows with the customer table, unlike the 25 nations.
    """
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    lon = F.lit(-74.0) + (key % 100) * F.lit(0.02)
    lat = F.lit(40.6) + (key % 7) * F.lit(0.01)
    rings = customer.select(
        key.alias("zone_id"), lon.alias("_lon"), lat.alias("_lat"),
        F.explode(F.expr(
            "CASE WHEN c_custkey % 3 = 0 THEN array(0, 1) ELSE array(0) END")).alias("ring"))
    corner = rings.select(
        "*", F.explode(F.array([F.lit(i) for i in range(4)])).alias("seq"))
    half = F.when(F.col("ring") == 0, F.lit(0.005)).otherwise(F.lit(0.001))
    # the hole sits off the middle, so it moves the centroid
    middle = F.when(F.col("ring") == 0, F.lit(0.0)).otherwise(F.lit(0.002))
    dx = F.when(F.col("seq").isin(0, 3), -half).otherwise(half)
    dy = F.when(F.col("seq").isin(0, 1), -half).otherwise(half)
    return corner.select(
        "zone_id", F.lit(0).alias("part"), "ring", "seq",
        (F.col("_lon") + middle + dx).alias("lon"), (F.col("_lat") + middle + dy).alias("lat"))
