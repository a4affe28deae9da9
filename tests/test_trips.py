from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ripplepanel.operators import clean, geometry, panel as panels, treatment
from ripplepanel.plans import binding
from ripplepanel.policy import CITY_POLICY
from ripplepanel.sources import feeds, manifest, results, zones
from ripplepanel.streaming import ingest

START = datetime(2025, 1, 6, 8, 0)
TRIP = "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, pickup_zone int, " \
       "dropoff_zone int, trip_distance double, fare_amount double, tolls_amount double, " \
       "passenger_count double, cbd_congestion_fee double, surcharge_total double, " \
       "trip_type string, year_month string"


def trip(minutes=10.0, distance=2.0, fare=10.0, pickup=5, dropoff=6, fee=None, month="2025-01"):
    end = datetime.fromtimestamp(START.timestamp() + minutes * 60)
    return (START, end, pickup, dropoff, distance, fare, 0.0, 1.0, fee, 0.5, "yellow", month)


def test_city_policy_sizes():
    assert (len(CITY_POLICY.core), len(CITY_POLICY.buffer), len(CITY_POLICY.airports)) == (63, 12, 3)


@pytest.mark.parametrize("kw,kept", [
    ({}, 1), ({"distance": 0.0}, 0), ({"distance": 300.0}, 0), ({"distance": float("nan")}, 0),
    ({"distance": None}, 0), ({"minutes": 0.5}, 0), ({"minutes": 360.0}, 0), ({"minutes": 0.52}, 1),
    ({"fare": 0.0}, 0), ({"fare": 1000.0}, 0), ({"fare": float("nan")}, 0), ({"pickup": 0}, 0),
    ({"pickup": 1}, 1), ({"pickup": 265}, 1), ({"dropoff": 266}, 0), ({"month": "2024-12"}, 0)])
def test_quality_boundaries(spark, policy, kw, kept):
    df = spark.createDataFrame([trip(**kw)], TRIP)
    assert clean.clean_trips(df, policy).count() == kept


def test_flags_and_fee(spark, policy):
    rows = clean.clean_trips(spark.createDataFrame(
        [trip(fee=-1.0), trip(fee=2.5, pickup=1)], TRIP), policy).orderBy("pickup_zone").collect()
    assert list(rows[0].asDict()) == list(clean.CLEAN_COLUMNS)
    assert [r["cbd_congestion_fee"] for r in rows] == [2.5, 0.0]
    assert [r["is_airport_trip"] for r in rows] == [1, 1]  # zone 6 is a dropoff airport
    assert (rows[0]["dow"], rows[0]["is_weekend"], rows[0]["is_peak"], rows[0]["hour"]) == (0, 0, 1, 8)
    assert rows[0]["trip_duration_min"] == 10.0


def test_report_counts_each_rule(spark, policy):
    df = spark.createDataFrame([trip(), trip(distance=0.0), trip(distance=0.0, fare=0.0)], TRIP)
    r = clean.quality_report(df, policy).first()
    assert (r["rows_in"], r["rows_kept"], r["reject_distance"], r["reject_fare"]) == (3, 1, 2, 1)


def test_feeds_with_missing_columns_and_bad_times(spark):
    green = spark.createDataFrame(
        [("2025-01-06 08:00:00", "junk", 1, 2, 3.0, 4.0, float("nan"))],
        "lpep_pickup_datetime string, lpep_dropoff_datetime string, PULocationID int, "
        "DOLocationID int, trip_distance double, fare_amount double, extra double")
    row = feeds.unify_feed(green, "green").first()
    assert row["dropoff_datetime"] is None and row["pickup_datetime"] == datetime(2025, 1, 6, 8)
    assert row["cbd_congestion_fee"] is None and row["passenger_count"] is None
    assert row["surcharge_total"] == 0.0
    ride = spark.createDataFrame(
        [(START, START, 1, 2, 3.0, 4.0, 2.75, -1.0, 0.5)],
        "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, "
        "DOLocationID int, trip_miles double, base_passenger_fare double, "
        "congestion_surcharge double, bcf double, sales_tax double")
    row = feeds.unify_feed(ride, "fhvhv").first()
    # the field that is the fee is not also a surcharge; a negative field counts 0
    assert (row["cbd_congestion_fee"], row["surcharge_total"]) == (2.75, 0.5)
    both = feeds.unify_feeds({"green": green, "fhvhv": ride})
    assert both.count() == 2


def test_incremental_write_is_idempotent(spark, policy, tmp_path):
    root = str(tmp_path / "clean")
    cleaned = clean.clean_trips(spark.createDataFrame([trip(), trip(fee=1.0)], TRIP), policy)
    assert feeds.write_clean(cleaned, root) == 1
    assert feeds.write_clean(cleaned, root) == 0
    assert feeds.read_clean(spark, root).count() == 2
    assert feeds.read_clean(spark, root, ["green"]).count() == 0


def test_half_written_partition_is_not_taken_for_done(spark, policy, tmp_path):
    root = str(tmp_path / "clean")
    rows = spark.createDataFrame([(1, "yellow", "2025-01"), (2, "yellow", "2025-02")], "x int, trip_type string, year_month string")
    # what a run leaves that died before its partitions were moved
    rows.where("x = 1").write.partitionBy("trip_type", "year_month").parquet(f"{root}/_staging-dead")
    assert feeds.write_clean(rows, root) == 2 and feeds.write_clean(rows, root) == 0
    assert feeds.read_clean(spark, root).count() == 2


def test_damaged_file_fails_or_is_listed(spark, tmp_path):
    good = spark.createDataFrame([(1.5,), (2.5,)], "trip_distance double")
    good.coalesce(1).write.parquet(f"{tmp_path}/yellow/year_month=2025-01")
    bad = tmp_path / "yellow" / "year_month=2025-02"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"PAR1 not a file PAR1")
    declared = {"yellow": "trip_distance double, year_month string"}
    with pytest.raises(Exception):
        feeds.scan_raw(spark, str(tmp_path), schemas=declared)["yellow"].collect()
    kept = feeds.scan_raw(spark, str(tmp_path), schemas=declared, lenient=True)["yellow"]
    assert kept.count() == 2
    found = feeds.unreadable_files(spark, str(tmp_path), schemas=declared).collect()
    assert [(r.trip_type, r.path.endswith("year_month=2025-02/part-0.parquet")) for r in found] == [("yellow", True)]


def test_probe_finds_a_damaged_row_group(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = tmp_path / "yellow" / "year_month=2025-01"
    folder.mkdir(parents=True)
    rng = range(4000)
    pq.write_table(pa.table({"trip_distance": [float(i * 7919 % 4001) for i in rng]}), folder / "a.parquet", row_group_size=2000)
    whole = (folder / "a.parquet").read_bytes()
    at = pq.ParquetFile(folder / "a.parquet").metadata.row_group(1).column(0).data_page_offset
    (folder / "b.parquet").write_bytes(whole[:at] + b"\xff" * 64 + whole[at + 64 :])
    (folder / "c.parquet").write_bytes(whole[: len(whole) // 2])
    got = {r["path"][-9:]: r for r in manifest.probe_files(spark, str(tmp_path)).collect()}
    assert (got["a.parquet"]["row_groups"], got["a.parquet"]["rows"], got["a.parquet"]["bad_row_groups"], got["a.parquet"]["error"]) == (2, 4000, 0, None)
    assert got["b.parquet"]["bad_row_groups"] == 1 and got["b.parquet"]["error"]
    assert got["c.parquet"]["row_groups"] == 0 and got["c.parquet"]["error"]
    assert manifest.probe_files(spark, str(tmp_path / "none")).collect() == []


@pytest.fixture
def raw_trips(spark):
    return spark.createDataFrame([trip(), trip(distance=0.0)], TRIP).select(
        F.col("pickup_datetime").alias("tpep_pickup_datetime"),
        F.col("dropoff_datetime").alias("tpep_dropoff_datetime"),
        F.col("pickup_zone").alias("PULocationID"), F.col("dropoff_zone").alias("DOLocationID"),
        "trip_distance", "fare_amount", "tolls_amount", "passenger_count", "year_month")


def test_stream_reads_each_file_once(spark, policy, tmp_path, raw_trips):
    raw, out, state = (str(tmp_path / n) for n in ("raw", "out", "state"))
    raw_trips.coalesce(1).write.partitionBy("year_month").parquet(f"{raw}/yellow")
    assert ingest.ingest_new_files(spark, raw, "yellow", out, state, policy) == 1
    assert ingest.ingest_new_files(spark, raw, "yellow", out, state, policy) == 0
    raw_trips.coalesce(1).write.mode("append").partitionBy("year_month").parquet(f"{raw}/yellow")
    assert ingest.ingest_new_files(spark, raw, "yellow", out, state, policy) == 1
    assert ingest.read_ingested(spark, out, "yellow").count() == 2


def test_batch_takes_late_files_and_shares_with_the_stream(spark, policy, tmp_path, raw_trips):
    raw, out, state = (str(tmp_path / n) for n in ("raw", "out", "state"))

    def add():
        raw_trips.coalesce(1).write.mode("append").partitionBy("year_month").parquet(f"{raw}/yellow")

    assert manifest.ingest_files(spark, raw, out, policy) == 0
    add()
    assert manifest.ingest_files(spark, raw, out, policy) == 1
    add()  # a late file of a month that is written
    assert manifest.pending_files(spark, raw, out, "yellow").count() == 1
    assert manifest.ingest_files(spark, raw, out, policy) == 1
    assert manifest.ingest_files(spark, raw, out, policy) == 0
    assert manifest.read_trips(spark, out).count() == 2
    assert ingest.ingest_new_files(spark, raw, "yellow", out, state, policy) == 0  # a stream after the batches
    add()
    assert ingest.ingest_new_files(spark, raw, "yellow", out, state, policy) == 1
    assert manifest.ingest_files(spark, raw, out, policy) == 0
    rows = manifest.read_trips(spark, out)
    assert rows.count() == 3 and set(rows.columns) == set(clean.CLEAN_COLUMNS)
    assert manifest.read_trips(spark, out, ["green"]).count() == 0


def test_half_a_commit_is_not_read_and_done_again(spark, policy, tmp_path, raw_trips):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    raw_trips.coalesce(1).write.partitionBy("year_month").parquet(f"{raw}/yellow")
    cleaned = clean.clean_trips(feeds.unify_feeds(feeds.scan_raw(spark, raw)), policy)
    manifest.write_batch(cleaned, out, "dead")  # a run that died before its commit
    assert manifest.read_trips(spark, out).count() == 0
    assert manifest.ingest_files(spark, raw, out, policy) == 1
    assert manifest.read_trips(spark, out).count() == 1
    assert manifest.drop_uncommitted(spark, out) == 1 and manifest.drop_uncommitted(spark, out) == 0
    assert manifest.read_trips(spark, out).count() == 1


def test_changed_file_raises(spark, policy, tmp_path, raw_trips):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    raw_trips.coalesce(1).write.partitionBy("year_month").parquet(f"{raw}/yellow")
    manifest.ingest_files(spark, raw, out, policy)
    file = next((tmp_path / "raw" / "yellow").rglob("*.parquet"))
    file.write_bytes(file.read_bytes() + b" ")
    with pytest.raises(ValueError, match="changed"):
        manifest.ingest_files(spark, raw, out, policy)


def test_missing_feed_is_skipped(spark, tmp_path):
    assert feeds.scan_raw(spark, str(tmp_path)) == {}


def test_week_floor_around_a_sunday_shock(spark, policy):
    days = [(date(2024, 12, 29),), (date(2024, 12, 30),), (date(2025, 1, 5),), (date(2025, 1, 6),)]
    rows = panels.add_time_columns(spark.createDataFrame(days, "date date"), policy).collect()
    assert [r["rel_week"] for r in rows] == [-2, -1, -1, 0]
    assert [r["post"] for r in rows] == [0, 0, 1, 1]
    monday = type(policy)(shock=date(2025, 1, 6), core=())
    rows = panels.add_time_columns(spark.createDataFrame(days, "date date"), monday).collect()
    assert [r["rel_week"] for r in rows] == [-2, -1, -1, 0]


def test_panel_mode_and_sparse_cells(spark, policy):
    rows = [trip(pickup=5) for _ in range(3)] + [trip(pickup=7)]
    df = spark.createDataFrame(rows, TRIP).withColumn(
        "trip_type", F.when(F.rand(1) < 2, F.element_at(
            F.array(F.lit("green"), F.lit("yellow")), F.col("pickup_zone") % 2 + 1)))
    built = panels.build_panel(clean.clean_trips(df, policy), policy, "day", 2).collect()
    assert [(r["zone_id"], r["trip_count"], r["trip_type_agg"]) for r in built] == [(5, 3, "yellow")]


def test_treatment_rings_and_no_dose(spark, policy):
    df = spark.createDataFrame(
        [(z, date(2025, 1, 6), 1, 0.0) for z in (1, 4, 6, 9)],
        "zone_id int, date date, post int, avg_cbd_fee double")
    out = treatment.assign_treatment(df, policy)
    assert [r["treat_ring"] for r in out.orderBy("zone_id").collect()] == [2, 1, 0, 0]
    dosed = treatment.assign_dose(out).collect()
    assert {r["dose_quantile"] for r in dosed} == {0} and {r["dose_raw"] for r in dosed} == {0.0}


def test_dose_ties_merge_edges(spark, policy):
    fees = [1.0] * 8 + [2.0, 3.0]
    df = treatment.assign_treatment(spark.createDataFrame(
        [(i + 1, date(2025, 1, 6), 1, f) for i, f in enumerate(fees)],
        "zone_id int, date date, post int, avg_cbd_fee double"), policy)
    got = {r["zone_id"]: r["dose_quantile"] for r in treatment.assign_dose(df).collect()}
    assert got[1] == 1 and got[10] == max(got.values()) and min(got.values()) >= 1


def test_centroids_and_distance(spark, policy):
    def ring(zone, part, number, cx, cy, h, back=False):
        pts = [(-h, -h), (h, -h), (h, h), (-h, h)]
        pts = pts[::-1] if back else pts
        return [(zone, part, number, i, cx + x, cy + y) for i, (x, y) in enumerate(pts)]

    rows = (ring(1, 0, 0, -73.9, 40.7, 0.01) + ring(2, 0, 0, 0.0, 0.0, 1.0, True)
            + ring(2, 0, 1, 0.5, 0.0, 0.25) + ring(3, 0, 0, 0.0, 0.0, 1.0) + ring(3, 1, 0, 4.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, zones.VERTEX_SCHEMA)
    got = {r["zone_id"]: r for r in geometry.add_center_distance(
        geometry.polygon_centroids(df), policy).collect()}
    assert (got[1]["centroid_lon"], got[1]["centroid_lat"]) == pytest.approx((-73.9, 40.7))
    assert got[2]["centroid_lon"] == pytest.approx((0 * 4 - 0.5 * 0.25) / (4 - 0.25))
    assert got[3]["centroid_lon"] == pytest.approx(2.0)
    assert got[1]["distance_to_cbd_km"] == pytest.approx(9.28, abs=0.05)


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert results.load_result(spark, "none", str(tmp_path)) is None
    results.save_result(df, "one", str(tmp_path))
    results.save_result(df, "one", str(tmp_path))
    assert results.load_result(spark, "one", str(tmp_path)).collect() == df.collect()


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_reach_the_reader_and_cleaning_never_shuffles(spark, policy, tmp_path):
    source = spark.createDataFrame([trip()], TRIP).select(
        F.col("pickup_datetime").alias("tpep_pickup_datetime"),
        F.col("dropoff_datetime").alias("tpep_dropoff_datetime"),
        F.col("pickup_zone").alias("PULocationID"), F.col("dropoff_zone").alias("DOLocationID"),
        "trip_distance", "fare_amount", "tolls_amount", "passenger_count", "year_month",
        F.lit(1.0).alias("unused"))
    source.write.partitionBy("year_month").parquet(f"{tmp_path}/yellow")
    cleaned = clean.clean_trips(
        feeds.unify_feeds(feeds.scan_raw(spark, str(tmp_path), months=["2025-01"])), policy)
    plan = plan_of(cleaned)
    for wanted in ("GreaterThan(trip_distance,0.0)", "LessThan(fare_amount,1000.0)"):
        assert wanted in plan
    assert "Exchange" not in plan and "unused" not in plan


def test_panel_is_one_hash_aggregate_and_one_exchange(spark, policy):
    trips = clean.clean_trips(spark.createDataFrame([trip()], TRIP), policy)
    plan = plan_of(panels.build_panel(trips, policy, "day", 1))
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan and "partial_sum" in plan
    days = panels.cells_of(trips, "day")
    plan = plan_of(panels.panel_from_cells(panels.roll_up(days, "month"), policy, 1))
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("unit", ["week", "month"])
def test_rolled_up_days_equal_the_direct_panel(spark, policy, unit):
    rows = [trip(pickup=5, fee=1.5), trip(pickup=5, minutes=20.0, distance=3.0), trip(pickup=7)] * 3
    df = spark.createDataFrame(rows, TRIP).withColumn(
        "pickup_datetime", F.expr("pickup_datetime + make_dt_interval(cast(fare_amount as int) % 3)"))
    df = df.withColumn("_i", F.monotonically_increasing_id()).withColumn(
        "trip_type", F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("rickshaw")), (F.col("_i") % 3 + 1).cast("int")))
    shift = F.make_dt_interval((F.col("_i") % 9).cast("int"))
    df = df.withColumn("pickup_datetime", F.col("pickup_datetime") + shift).withColumn(
        "dropoff_datetime", F.col("dropoff_datetime") + F.expr("make_dt_interval(1)") + shift).drop("_i")
    trips = clean.clean_trips(df, policy, clean.QualityLimits(minutes=(0.0, 1e6))).cache()
    direct = panels.build_panel(trips, policy, unit, 1)
    rolled = panels.panel_from_cells(panels.roll_up(panels.cells_of(trips, "day"), unit), policy, 1)
    key = lambda r: (r["zone_id"], r["date"])
    a, b = (sorted(d.collect(), key=key) for d in (direct, rolled))
    assert a == b and len(a) > 1
    general = panels.aggregate_cells(
        trips, unit, "pickup_zone", "pickup_date", {"avg_fare": "fare_amount"}, {}, {}, "trip_type")
    assert sorted((r["zone_id"], r["date"], r["trip_count"], r["avg_fare"]) for r in general.collect()) == [
        (r["zone_id"], r["date"], r["trip_count"], r["avg_fare"]) for r in a]


def test_commonest_feed_takes_the_smallest_name(spark, policy):
    def named(kind, pickup):
        return (*trip(pickup=pickup)[:-2], kind, "2025-01")

    rows = [named("yellow", 5), named("green", 5), named("rickshaw", 7), named("tram", 7), named("yellow", 7), named(None, 9)]
    got = {r["zone_id"]: (r["trip_type_agg"], r["trip_count"]) for r in panels.build_panel(
        clean.clean_trips(spark.createDataFrame(rows, TRIP), policy), policy, "day", 1).collect()}
    assert got == {5: ("green", 2), 7: ("other", 3), 9: (None, 1)}


def star_tables(spark, root):
    """Line items with a repeated order, a repeated customer, and keys that are null or stand nowhere."""
    spark.createDataFrame(
        [(1, 1, 1, 10.0, 3000.0, 0.05, 0.02, "A", datetime(1998, 7, 31)), (1, 1, 7, 20.0, 4000.0, 0.0, 0.04, "A", datetime(1998, 7, 31)),
         (2, 2, 2, 30.0, 5000.0, 0.1, 0.06, "N", datetime(1998, 1, 1)), (3, 1, 3, None, 6000.0, 0.1, 0.06, "R", datetime(1997, 1, 1)),
         (None, 1, 1, 1.0, 1.0, 0.0, 0.0, "R", datetime(1997, 1, 1)), (9, 1, 1, 1.0, 1.0, 0.0, 0.0, None, None)],
        "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{root}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 2), (2, 2), (3, None), (9, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 4), (2, None), (None, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{root}/customer.parquet")
    spark.createDataFrame([(1, 5), (2, 6)], "s_suppkey long, s_nationkey int").write.parquet(f"{root}/supplier.parquet")
    return str(root)


def test_line_items_do_not_move_for_the_customers(spark, tmp_path):
    root = star_tables(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trips = binding.bound_trips(spark, root)
        plan = trips._jdf.queryExecution().executedPlan().toString()
        moved = plan.split("hashpartitioning(o_custkey")[1].split("\n")[1]
        assert "o_orderkey" in moved and "l_quantity" not in moved
        got = sorted((r["l_orderkey"], r["l_linenumber"], r["pickup_zone"], r["leaky_month"]) for r in trips.where("pickup_zone > 0").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(1, 1, 4, "1998-07"), (1, 7, 4, "1998-08"), (2, 2, 5, "1998-01"), (2, 2, 5, "1998-01"), (9, 1, 5, None)]


def test_gathered_feeds_have_the_same_rows(spark, tmp_path):
    root = star_tables(spark, tmp_path)
    plain, gathered = (binding.raw_feeds(spark, root, leaky=True, gathered=g) for g in (False, True))
    for name, df in plain.items():
        assert gathered[name].dtypes == df.dtypes
        assert sorted(map(str, gathered[name].collect())) == sorted(map(str, df.collect())) and df.count() > 0
    shuffled = gathered["yellow"]._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in shuffled and "dropoff" not in shuffled.split("RebalancePartitions")[1]
