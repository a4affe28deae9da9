"""Sources, sinks and trip cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.sqltext import MONTH, compose, day, real, whole
from ripplepanel.functions.columns import clip_low
from ripplepanel.operators import clean, explore
from ripplepanel.plans import binding
from ripplepanel.sources import feeds, manifest, results, zones
from ripplepanel.streaming import ingest

_DONE: set[tuple[str, str]] = set()


def once(ctx: Context, path: str, write) -> str:
    """Write a folder the first time a session asks for it."""
    key = (ctx.spark.sparkContext.applicationId, path)
    if key not in _DONE:
        write(path)
        _DONE.add(key)
    return path


def raw_root(ctx: Context) -> str:
    def write(root: str) -> None:
        for name, df in binding.raw_feeds(ctx.spark, ctx.sf_dir, leaky=True, gathered=True).items():
            df.write.mode("overwrite").partitionBy("year_month").parquet(f"{root}/{name}")

    return once(ctx, ctx.folder("raw"), write)


def clean_root(ctx: Context) -> str:
    def write(root: str) -> None:
        trips = clean.clean_trips(binding.bound_trips(ctx.spark, ctx.sf_dir).withColumn(
            "surcharge_total", clip_low(F.col("extra")) + F.col("mta_tax")), ctx.policy)
        feeds.write_clean(trips, root)

    return once(ctx, ctx.folder("clean"), write)


def raw_schemas(ctx: Context) -> dict[str, str]:
    """Columns of the raw feeds as declared by their binding: no footer is opened for them."""
    out = {}
    for name, df in binding.raw_feeds(ctx.spark, ctx.sf_dir, leaky=True).items():
        out[name] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return out


@query("S1_scan_raw_feeds", compose(f"""
  SELECT trip_type, leaky_month AS year_month, {whole('count(*)', 'trips')},
    {real('sum(trip_distance)', 'distance')}
  FROM bound GROUP BY 1, 2""", "bound"))
def scan_raw(ctx: Context) -> DataFrame:
    raw = feeds.scan_raw(ctx.spark, raw_root(ctx), schemas=raw_schemas(ctx))
    return (
        feeds.unify_feeds(raw).groupBy("trip_type", "year_month")
        .agg(F.count(F.lit(1)).alias("trips"), F.sum("trip_distance").alias("distance")))


@query("S2_incremental_clean_write", compose(f"""
  SELECT trip_type, year_month, {whole('count(*)', 'trips')}, {whole('0', 'new_on_second_run')}
  FROM kept GROUP BY 1, 2""", "kept"))
def incremental_write(ctx: Context) -> DataFrame:
    root = clean_root(ctx)
    again = clean.clean_trips(binding.bound_trips(ctx.spark, ctx.sf_dir).withColumn(
        "surcharge_total", clip_low(F.col("extra")) + F.col("mta_tax")), ctx.policy)
    added = feeds.write_clean(again, root)
    return feeds.read_clean(ctx.spark, root).groupBy("trip_type", "year_month").agg(
        F.count(F.lit(1)).alias("trips"), F.lit(added).alias("new_on_second_run"))


@query("S1_probed_files", compose(f"""
  SELECT trip_type, {whole('count(*)', 'rows')}, {whole('0', 'bad_row_groups')}
  FROM bound GROUP BY 1""", "bound"))
def probed(ctx: Context) -> DataFrame:
    return manifest.probe_files(ctx.spark, raw_root(ctx)).groupBy("trip_type").agg(
        F.sum("rows").alias("rows"), F.sum("bad_row_groups").alias("bad_row_groups"))


_DECLARED_MONTH = "FROM kept WHERE leaky_month = year_month"


@query("S2_manifest_ingest", compose(f"""
  SELECT trip_type, year_month, {whole('count(*)', 'trips')}, {whole('0', 'taken_on_second_run')}
  {_DECLARED_MONTH} GROUP BY 1, 2""", "kept"))
def manifest_ingest(ctx: Context) -> DataFrame:
    """Batch ingest of the raw files, file by file; a second run finds nothing to do."""
    raw, root = raw_root(ctx), ctx.folder("by_file")
    manifest.ingest_files(ctx.spark, raw, root, ctx.policy, schemas=raw_schemas(ctx))
    again = manifest.ingest_files(ctx.spark, raw, root, ctx.policy, schemas=raw_schemas(ctx))
    return manifest.read_trips(ctx.spark, root).groupBy("trip_type", "year_month").agg(
        F.count(F.lit(1)).alias("trips"), F.lit(again).alias("taken_on_second_run"))


@query("S2_stream_ingest", compose(f"""
  SELECT trip_type, year_month, {whole('count(*)', 'trips')}, {whole('0', 'read_on_second_run')}
  {_DECLARED_MONTH} AND trip_type = 'green' GROUP BY 1, 2""", "kept"))
def stream_ingest(ctx: Context) -> DataFrame:
    raw, root, state = raw_root(ctx), ctx.folder("ingested"), ctx.folder("ingest_state")
    schema = raw_schemas(ctx)["green"]
    ingest.ingest_new_files(ctx.spark, raw, "green", root, state, ctx.policy, schema=schema)
    again = ingest.ingest_new_files(ctx.spark, raw, "green", root, state, ctx.policy, schema=schema)
    return ingest.read_ingested(ctx.spark, root, "green").groupBy("trip_type", "year_month").agg(
        F.count(F.lit(1)).alias("trips"), F.lit(again).alias("read_on_second_run"))


@query("S3_read_clean_types", compose(f"""
  SELECT year_month, {whole('count(*)', 'trips')}, {real('avg(fare_amount)', 'avg_fare')}
  FROM kept WHERE trip_type IN ('yellow', 'fhvhv') GROUP BY 1""", "kept"))
def read_types(ctx: Context) -> DataFrame:
    df = feeds.read_clean(ctx.spark, clean_root(ctx), ["yellow", "fhvhv"])
    return df.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("trips"), F.avg("fare_amount").alias("avg_fare"))


@query("S4_zone_lookup_csv", compose(f"""
  SELECT {whole('zone_id')}, borough, zone_name, {whole('borough_code')}, 'land' AS service_zone,
    {whole('count(*)', 'trips')}
  FROM trips JOIN zones ON pickup_zone = zone_id GROUP BY ALL""", "trips", "zones"))
def zone_csv(ctx: Context) -> DataFrame:
    def write(path: str) -> None:
        binding.zone_dimension(ctx.spark, ctx.sf_dir).select(
            F.col("zone_id").alias("LocationID"), F.col("borough").alias("Borough"),
            F.col("zone_name").alias("Zone"), F.lit("land").alias("service_zone"),
        ).coalesce(1).write.mode("overwrite").csv(path, header=True)

    lookup = zones.load_zone_lookup(ctx.spark, once(ctx, ctx.folder("lookup"), write), ctx.policy)
    counts = ctx.trips().groupBy(F.col("pickup_zone").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("trips"))
    return counts.join(lookup, "zone_id")


_PARCELS = """
  SELECT c_custkey AS zone_id, ring, seq,
    -74.0 + (c_custkey % 100)*0.02::DOUBLE + (CASE ring WHEN 0 THEN 0 ELSE 0.002 END)
      + (CASE WHEN seq IN (0,3) THEN -1 ELSE 1 END)*(CASE ring WHEN 0 THEN 0.005 ELSE 0.001 END) AS lon,
    40.6 + (c_custkey % 7)*0.01::DOUBLE + (CASE ring WHEN 0 THEN 0 ELSE 0.002 END)
      + (CASE WHEN seq IN (0,1) THEN -1 ELSE 1 END)*(CASE ring WHEN 0 THEN 0.005 ELSE 0.001 END) AS lat
  FROM customer, (SELECT unnest([0, 1]) AS ring), (SELECT unnest([0, 1, 2, 3]) AS seq)
  WHERE ring = 0 OR c_custkey % 3 = 0"""


@query("S5_zone_vertices", compose(f"""
  SELECT {whole('zone_id')}, {whole('count(*)', 'vertices')}, {whole('max(ring)', 'holes')},
    {real('min(lon)', 'west')}, {real('max(lat)', 'north')}
  FROM parcels GROUP BY zone_id""", extra={"parcels": _PARCELS}))
def zone_vertices(ctx: Context) -> DataFrame:
    path = once(ctx, ctx.folder("vertices"), lambda p: binding.parcel_vertices(
        ctx.spark, ctx.sf_dir).write.mode("overwrite").parquet(p))
    return zones.load_zone_vertices(ctx.spark, path).groupBy("zone_id").agg(
        F.count(F.lit(1)).alias("vertices"), F.max("ring").alias("holes"),
        F.min("lon").alias("west"), F.max("lat").alias("north"))


@query("S6_panel_round_trip", compose(f"""
  SELECT {day('date')}, {whole('count(*)', 'zones')}, {whole('sum(trip_count)', 'trips')},
    {real('avg(avg_fare)', 'avg_fare')}
  FROM {MONTH} GROUP BY date""", MONTH))
def panel_round_trip(ctx: Context) -> DataFrame:
    path = once(ctx, ctx.folder("panel"), lambda p: results.save_panel(ctx.panel(), p))
    return results.load_panel(ctx.spark, path).groupBy("date").agg(
        F.count(F.lit(1)).alias("zones"), F.sum("trip_count").alias("trips"),
        F.avg("avg_fare").alias("avg_fare"))


_SUBSTITUTION = f"""
  SELECT borough, {whole('pre', 'pre_trips')}, {whole('post', 'post_trips')},
    {real('(post/pre-1)*100', 'pct_change')}
  FROM (SELECT borough, sum(trip_count) FILTER (date < DATE '1998-07-05') AS pre,
          sum(trip_count) FILTER (date >= DATE '1998-07-05') AS post
        FROM {MONTH} WHERE borough IS NOT NULL GROUP BY 1)"""


@query("S7_result_store", compose(_SUBSTITUTION, MONTH))
def result_store(ctx: Context) -> DataFrame:
    root = ctx.folder("results")
    results.save_result(explore.borough_substitution(ctx.panel(), ctx.policy), "boroughs", root)
    return results.load_result(ctx.spark, "boroughs", root)


@query("S8_csv_export", compose(f"""
  SELECT period, grp AS "group", {real('avg(avg_fare)', 'avg_fare')},
    {real('avg(avg_cbd_fee)', 'avg_cbd_fee')}, {real('avg(surcharge_sum)', 'surcharge_sum')}
  FROM (SELECT *, CASE WHEN date < DATE '1998-07-05' THEN 'pre' ELSE 'post' END AS period,
          CASE treat_binary WHEN 1 THEN 'treated' ELSE 'control' END AS grp FROM {MONTH})
  GROUP BY 1, 2""", MONTH))
def csv_export(ctx: Context) -> DataFrame:
    path = ctx.folder("fares_csv")
    table = explore.fare_composition(ctx.panel(), ctx.policy)
    results.export_csv(table, path)
    return ctx.spark.read.csv(path, header=True, schema=table.schema)


@query("P1_unify_feeds", compose(f"""
  SELECT trip_type, {whole('count(*)', 'trips')},
    {whole("count(*) FILTER (trip_type <> 'fhvhv')", 'with_passengers')},
    {whole('count(raw_fee)', 'with_fee')}, {real('sum(trip_distance)', 'distance')},
    {real('sum(fare_amount)', 'fares')}, {real('sum(tolls_amount)', 'tolls')},
    {day('min(pickup_datetime)', 'first_day')}, {whole('sum(pickup_zone*dropoff_zone)', 'zones')}
  FROM bound GROUP BY 1""", "bound"))
def unify(ctx: Context) -> DataFrame:
    unified = feeds.unify_feeds(binding.raw_feeds(ctx.spark, ctx.sf_dir))
    return unified.groupBy("trip_type").agg(
        F.count(F.lit(1)).alias("trips"), F.count("passenger_count").alias("with_passengers"),
        F.count("cbd_congestion_fee").alias("with_fee"), F.sum("trip_distance").alias("distance"),
        F.sum("fare_amount").alias("fares"), F.sum("tolls_amount").alias("tolls"),
        F.min(F.to_date("pickup_datetime")).alias("first_day"),
        F.sum(F.col("pickup_zone").cast("long") * F.col("dropoff_zone")).alias("zones"))


@query("P2_surcharge_total", compose(f"""
  SELECT trip_type, year_month, {real('sum(surcharge_total)', 'surcharge')},
    {whole('count(*) FILTER (surcharge_total = 0.5)', 'at_base')}
  FROM timed GROUP BY 1, 2""", "timed"))
def surcharges(ctx: Context) -> DataFrame:
    unified = feeds.unify_feeds(binding.raw_feeds(ctx.spark, ctx.sf_dir))
    return unified.groupBy("trip_type", "year_month").agg(
        F.sum("surcharge_total").alias("surcharge"),
        F.count_if(F.col("surcharge_total") == 0.5).alias("at_base"))


@query("P3_parse_datetimes", compose(f"""
  SELECT trip_type, {whole('count(*)', 'kept')}, {day('max(dropoff_datetime)', 'last_day')}
  FROM bound WHERE l_orderkey % 97 <> 0 AND NOT (l_orderkey % 89 = 0 AND l_linenumber = 1)
  GROUP BY 1""", "bound"))
def parse_times(ctx: Context) -> DataFrame:
    trips = binding.bound_trips(ctx.spark, ctx.sf_dir)
    bad, gone = F.col("l_orderkey") % 97 == 0, F.col("l_orderkey") % 89 == 0
    text = trips.select(
        "trip_type",
        F.when(bad, F.lit("not a time")).otherwise(F.col("pickup_datetime").cast("string"))
        .alias("pickup_text"),
        F.when(~(gone & (F.col("l_linenumber") == 1)), F.col("dropoff_datetime").cast("string"))
        .alias("dropoff_text"))
    parsed = text.select(
        "trip_type", feeds.parse_timestamp(text, "pickup_text").alias("pickup_datetime"),
        feeds.parse_timestamp(text, "dropoff_text").alias("dropoff_datetime"))
    return clean.drop_null_times(parsed).groupBy("trip_type").agg(
        F.count(F.lit(1)).alias("kept"),
        F.max(F.to_date("dropoff_datetime")).alias("last_day"))


@query("P4_declared_month", compose(f"""
  SELECT leaky_month AS year_month, {whole('count(*)', 'raw')},
    {whole("count(*) FILTER (strftime(pickup_datetime, '%Y-%m') = leaky_month)", 'kept')}
  FROM bound GROUP BY 1""", "bound"))
def declared_month(ctx: Context) -> DataFrame:
    trips = binding.bound_trips(ctx.spark, ctx.sf_dir).drop("year_month").withColumnRenamed(
        "leaky_month", "year_month")
    return trips.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(clean.in_declared_month()).alias("kept"))


@query("P5_trip_duration", compose(f"""
  SELECT {real('trip_duration_min')}, {whole('count(*)', 'trips')} FROM timed
  GROUP BY trip_duration_min""", "timed"))
def duration(ctx: Context) -> DataFrame:
    trips = binding.bound_trips(ctx.spark, ctx.sf_dir)
    return trips.groupBy(clean.duration_minutes().alias("trip_duration_min")).agg(
        F.count(F.lit(1)).alias("trips"))


@query("P6_quality_filter", compose(f"""
  SELECT {whole('pickup_zone')}, {whole('count(*)', 'trips')},
    {real('max(trip_distance)', 'max_distance')}, {real('min(fare_amount)', 'min_fare')},
    {real('max(trip_duration_min)', 'max_minutes')}
  FROM kept GROUP BY pickup_zone""", "kept"))
def quality(ctx: Context) -> DataFrame:
    trips = binding.bound_trips(ctx.spark, ctx.sf_dir).withColumn(
        "trip_duration_min", clean.duration_minutes())
    return clean.quality_filter(trips, ctx.policy).groupBy("pickup_zone").agg(
        F.count(F.lit(1)).alias("trips"), F.max("trip_distance").alias("max_distance"),
        F.min("fare_amount").alias("min_fare"), F.max("trip_duration_min").alias("max_minutes"))


@query("P7_quality_report", compose(f"""
  SELECT trip_type, year_month, {whole('count(*)', 'rows_in')},
    {whole('''count(*) FILTER (trip_distance > 0 AND trip_distance < 300 AND trip_duration_min > 0.5
      AND trip_duration_min < 360 AND fare_amount > 0 AND fare_amount < 1000
      AND pickup_zone BETWEEN 1 AND 265 AND dropoff_zone BETWEEN 1 AND 265)''', 'rows_kept')},
    {whole('count(*) FILTER (NOT (trip_distance > 0 AND trip_distance < 300))', 'reject_distance')},
    {whole('count(*) FILTER (NOT (trip_duration_min > 0.5 AND trip_duration_min < 360))',
           'reject_duration')},
    {whole('count(*) FILTER (NOT (fare_amount > 0 AND fare_amount < 1000))', 'reject_fare')},
    {whole('count(*) FILTER (NOT (pickup_zone BETWEEN 1 AND 265))', 'reject_pickup_zone')},
    {whole('count(*) FILTER (NOT (dropoff_zone BETWEEN 1 AND 265))', 'reject_dropoff_zone')}
  FROM timed GROUP BY 1, 2""", "timed"))
def report(ctx: Context) -> DataFrame:
    return clean.quality_report(binding.bound_trips(ctx.spark, ctx.sf_dir), ctx.policy)


@query("P8_clean_fee", compose(f"""
  SELECT {whole('pickup_zone')}, year_month, {whole('count(raw_fee)', 'had_fee')},
    {real('sum(cbd_congestion_fee)', 'fees')}, {whole('count(cbd_congestion_fee)', 'trips')}
  FROM timed GROUP BY pickup_zone, year_month""", "timed"))
def fee(ctx: Context) -> DataFrame:
    trips = binding.bound_trips(ctx.spark, ctx.sf_dir).select(
        "pickup_zone", "year_month", F.col("cbd_congestion_fee").alias("raw_fee"),
        clean.clean_fee().alias("cbd_congestion_fee"))
    return trips.groupBy("pickup_zone", "year_month").agg(
        F.count("raw_fee").alias("had_fee"), F.sum("cbd_congestion_fee").alias("fees"),
        F.count("cbd_congestion_fee").alias("trips"))


@query("P9_calendar_flags", compose(f"""
  SELECT {whole('hour')}, {whole('dow')}, {whole('is_weekend')}, {whole('is_peak')},
    {whole('count(*)', 'trips')}, {day('min(pickup_date)', 'first_day')}
  FROM kept GROUP BY hour, dow, is_weekend, is_peak""", "kept"))
def flags(ctx: Context) -> DataFrame:
    return binding.star_clean(ctx.spark, ctx.sf_dir).groupBy(
        "hour", "dow", "is_weekend", "is_peak").agg(
        F.count(F.lit(1)).alias("trips"), F.min("pickup_date").alias("first_day"))


@query("P10_airport_flag", compose(f"""
  SELECT {whole('pickup_zone')}, {whole('dropoff_zone')}, {whole('is_airport_trip')},
    {whole('count(*)', 'trips')}
  FROM kept GROUP BY pickup_zone, dropoff_zone, is_airport_trip""", "kept"))
def airport(ctx: Context) -> DataFrame:
    return binding.star_clean(ctx.spark, ctx.sf_dir).groupBy(
        "pickup_zone", "dropoff_zone", "is_airport_trip").agg(F.count(F.lit(1)).alias("trips"))


@query("P11_clean_trips", compose(f"""
  SELECT strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') AS pickup_datetime,
    strftime(dropoff_datetime, '%Y-%m-%d %H:%M:%S') AS dropoff_datetime, {day('pickup_date')},
    {whole('pickup_zone')}, {whole('dropoff_zone')}, {real('trip_distance')},
    {real('trip_duration_min')}, {real('fare_amount')}, {real('tolls_amount')},
    {real('surcharge_total')}, {real('cbd_congestion_fee')}, {real('passenger_count')},
    {whole('hour')}, {whole('dow')}, {whole('is_weekend')}, {whole('is_peak')},
    {whole('is_airport_trip')}, trip_type, year_month
  FROM kept""", "kept"))
def clean_table(ctx: Context) -> DataFrame:
    return binding.star_clean(ctx.spark, ctx.sf_dir)
