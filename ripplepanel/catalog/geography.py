"""Zone facts, treatment and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog.panels import PRE_STATS
from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.sqltext import SHOCK, WEEK, compose, day, real, whole
from ripplepanel.catalog.trips import _PARCELS
from ripplepanel.operators import dose, features, geometry, treatment
from ripplepanel.plans import binding

# centroids checked by another route: whole square minus its hole
_CENTROIDS = """
  SELECT zone_id,
    CASE WHEN holes = 0 THEN x0 ELSE (x0*1e-4 - x1*4e-6)/(1e-4-4e-6) END AS centroid_lon,
    CASE WHEN holes = 0 THEN y0 ELSE (y0*1e-4 - y1*4e-6)/(1e-4-4e-6) END AS centroid_lat
  FROM (SELECT zone_id, max(ring) AS holes, avg(lon) FILTER (ring=0) AS x0,
          avg(lat) FILTER (ring=0) AS y0, avg(lon) FILTER (ring=1) AS x1,
          avg(lat) FILTER (ring=1) AS y1 FROM parcels GROUP BY 1)"""
_DISTANCE = """2*6371.0*asin(sqrt(pow(sin(radians(40.65-centroid_lat)/2), 2)
  + cos(radians(centroid_lat))*cos(radians(40.65::DOUBLE))*pow(sin(radians(-73.80-centroid_lon)/2), 2)))"""


@query("G1_borough_codes", compose(f"""
  SELECT {whole('zone_id')}, borough, {whole('borough_code')}, zone_name,
    {whole('count(*)', 'trips')}
  FROM trips LEFT JOIN zones ON zone_id = pickup_zone GROUP BY ALL""", "trips", "zones"))
def codes(ctx: Context) -> DataFrame:
    counts = ctx.trips().groupBy(F.col("pickup_zone").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("trips"))
    return treatment.enrich_zones(counts, binding.zone_dimension(ctx.spark, ctx.sf_dir))


@query("G2_polygon_centroids", compose(f"""
  SELECT {whole('zone_id')}, {real('centroid_lat*1000', 'lat_milli')},
    {real('centroid_lon*1000', 'lon_milli')} FROM centroids""",
    extra={"parcels": _PARCELS, "centroids": _CENTROIDS}))
def centroids(ctx: Context) -> DataFrame:
    found = geometry.polygon_centroids(binding.parcel_vertices(ctx.spark, ctx.sf_dir))
    return found.select(
        "zone_id", (F.col("centroid_lat") * 1000).alias("lat_milli"),
        (F.col("centroid_lon") * 1000).alias("lon_milli"))


@query("G3_center_distance", compose(f"""
  SELECT {whole('zone_id')}, {real(_DISTANCE, 'distance_to_cbd_km')} FROM centroids""",
    extra={"parcels": _PARCELS, "centroids": _CENTROIDS}))
def distance(ctx: Context) -> DataFrame:
    found = geometry.polygon_centroids(binding.parcel_vertices(ctx.spark, ctx.sf_dir))
    return geometry.add_center_distance(found, ctx.policy).select("zone_id", "distance_to_cbd_km")


@query("G4_assign_treatment", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {whole('treat_binary')}, {whole('is_airport_zone')},
    {whole('treat_ring')} FROM {WEEK}""", WEEK))
def rings(ctx: Context) -> DataFrame:
    bare = ctx.panel("week", 5).select("zone_id", "date")
    return treatment.assign_treatment(bare, ctx.policy)


@query("G5_treated_share", compose(f"""
  SELECT {whole('count(DISTINCT treat_binary)', 'levels')},
    {real('avg(treat_binary)*100', 'pct_treated')} FROM {WEEK}""", WEEK))
def share(ctx: Context) -> DataFrame:
    return treatment.treated_share(ctx.panel("week", 5))


@query("G6_dose", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {real('dose_raw')}, {real('dose_std')} FROM {WEEK}""",
    WEEK))
def dose_columns(ctx: Context) -> DataFrame:
    bare = ctx.panel("week", 5).drop("dose_raw", "dose_std", "dose_quantile")
    return treatment.assign_dose(bare).select("zone_id", "date", "dose_raw", "dose_std")


@query("G7_dose_quantile", compose(f"""
  SELECT {whole('dose_quantile')}, {whole('count(*)', 'cells')}, {real('min(dose_raw)', 'low')},
    {real('max(dose_raw)', 'high')} FROM {WEEK} GROUP BY dose_quantile""", WEEK))
def quintiles(ctx: Context) -> DataFrame:
    return ctx.panel("week", 5).groupBy("dose_quantile").agg(
        F.count(F.lit(1)).alias("cells"), F.min("dose_raw").alias("low"),
        F.max("dose_raw").alias("high"))


@query("G8_never_treated", compose(f"""
  SELECT {whole('zone_id')} FROM {WEEK} GROUP BY zone_id HAVING max(treat_binary) = 0""", WEEK))
def never(ctx: Context) -> DataFrame:
    return treatment.never_treated(ctx.panel("week", 5))


@query("G9_boundary_crossing_share", compose(f"""
  SELECT {whole('pickup_zone', 'zone_id')}, {whole('count(*)', 'trips')},
    {real('avg(((pickup_zone <= 8) <> (dropoff_zone <= 8))::INTEGER)', 'treat_intensity')}
  FROM trips GROUP BY pickup_zone""", "trips"))
def crossing(ctx: Context) -> DataFrame:
    return treatment.crossing_share(ctx.trips(), ctx.policy)


@query("J1_panel_zone_lookup", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {whole('trip_count')}, borough, {whole('borough_code')},
    zone_name FROM {WEEK}""", WEEK))
def with_lookup(ctx: Context) -> DataFrame:
    bare = ctx.panel("week", 5).select("zone_id", "date", "trip_count")
    return treatment.enrich_zones(bare, binding.zone_dimension(ctx.spark, ctx.sf_dir))


@query("J2_panel_zone_geometry", compose(f"""
  SELECT {whole('p.zone_id', 'zone_id')}, {day('date')}, borough, {real('centroid_lat')},
    {real('centroid_lon')}, {real(_DISTANCE, 'distance_to_cbd_km')}
  FROM {WEEK} p LEFT JOIN centroids c ON c.zone_id = p.zone_id""",
    WEEK, extra={"parcels": _PARCELS, "centroids": _CENTROIDS}))
def with_geometry(ctx: Context) -> DataFrame:
    geo = geometry.add_center_distance(
        geometry.polygon_centroids(binding.parcel_vertices(ctx.spark, ctx.sf_dir)), ctx.policy)
    bare = ctx.panel("week", 5).select("zone_id", "date")
    return treatment.enrich_zones(
        bare, binding.zone_dimension(ctx.spark, ctx.sf_dir), geo
    ).drop("borough_code", "zone_name")


@query("J3_panel_pre_stats", compose(f"""
  SELECT {whole('p.zone_id', 'zone_id')}, {day('date')}, {real('pre_mean_trips')},
    {real('pre_cv_trips')}
  FROM {WEEK} p LEFT JOIN ({PRE_STATS.format(WEEK)}) s ON s.zone_id = p.zone_id""", WEEK))
def with_stats(ctx: Context) -> DataFrame:
    return features.add_zone_statics(ctx.panel("week", 5), ctx.policy).select(
        "zone_id", "date", "pre_mean_trips", "pre_cv_trips")


@query("J4_panel_zone_dose", compose(f"""
  SELECT {whole('p.zone_id', 'zone_id')}, {day('date')}, {real('coalesce(d, 0)', 'zone_dose')}
  FROM {WEEK} p LEFT JOIN (SELECT zone_id, avg(avg_cbd_fee) AS d FROM {WEEK}
                           WHERE date >= {SHOCK} GROUP BY 1) z ON z.zone_id = p.zone_id""", WEEK))
def with_dose(ctx: Context) -> DataFrame:
    return dose.join_dose(ctx.panel("week", 5), ctx.policy).select("zone_id", "date", "zone_dose")


@query("J6_code_maps", compose(f"""
  SELECT borough, {whole('borough_code')}, {whole('treat_ring')}, {whole('dose_quantile')},
    {whole('count(*)', 'cells')} FROM {WEEK} GROUP BY borough, borough_code, treat_ring,
    dose_quantile""", WEEK))
def maps(ctx: Context) -> DataFrame:
    return ctx.panel("week", 5).groupBy(
        "borough", "borough_code", "treat_ring", "dose_quantile").agg(
        F.count(F.lit(1)).alias("cells"))


@query("J7_semi_anti_joins", compose(f"""
  SELECT side, {whole('count(*)', 'cells')}, {whole('count(DISTINCT zone_id)', 'zones')},
    {whole('sum(trip_count)', 'trips')}
  FROM (SELECT *, CASE WHEN zone_id IN (SELECT zone_id FROM {WEEK} WHERE treat_binary = 1)
               THEN 'ever treated' ELSE 'never treated' END AS side FROM {WEEK})
  GROUP BY side""", WEEK))
def sides(ctx: Context) -> DataFrame:
    panel = ctx.panel("week", 5)
    ever = panel.where(F.col("treat_binary") == 1).select("zone_id").distinct()

    def count(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.lit(side).alias("side")).agg(
            F.count(F.lit(1)).alias("cells"), F.count_distinct("zone_id").alias("zones"),
            F.sum("trip_count").alias("trips"))

    return count(panel.join(ever, "zone_id", "left_semi"), "ever treated").unionByName(
        count(panel.join(ever, "zone_id", "left_anti"), "never treated"))
