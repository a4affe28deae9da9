"""Panel building, descriptive queries, features, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.sqltext import (
    DAY1, DAY5, MONTH, PANEL_COLUMNS, SHOCK, WEEK, WEEK1, compose, day, real, whole,
)
from ripplepanel.catalog.trips import _SUBSTITUTION
from ripplepanel.operators import explore, features, panel as panels
from ripplepanel.plans import binding

PANEL_KEEP = [
    "zone_id", "date", "trip_count", "avg_distance", "avg_duration", "avg_fare", "avg_cbd_fee",
    "airport_share", "peak_share", "surcharge_sum", "cbd_fee_total", "weekend_flag",
    "trip_type_agg", "log_trip_count", "week", "rel_week", "post", "year_month",
]
LABELLED = f"""(SELECT *, CASE WHEN date < {SHOCK} THEN 'pre' ELSE 'post' END AS period,
    CASE treat_binary WHEN 1 THEN 'treated' ELSE 'control' END AS grp FROM {{0}})"""
BY_WEEK, BY_MONTH = LABELLED.format(WEEK), LABELLED.format(MONTH)


@query("A1_panel_day", compose(f"SELECT {PANEL_COLUMNS} FROM {DAY1}", DAY1))
def panel_day(ctx: Context) -> DataFrame:
    return panels.build_panel(ctx.trips(), ctx.policy, "day", 1).select(PANEL_KEEP)


@query("A1_panel_month", compose(f"SELECT {PANEL_COLUMNS} FROM {MONTH}", MONTH))
def panel_month(ctx: Context) -> DataFrame:
    return panels.build_panel(ctx.trips(), ctx.policy, "month", 5).select(PANEL_KEEP)


@query("A1_panel_hour", compose(f"""
  SELECT {whole('user_id % 20', 'zone_id')}, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')
    AS date, {whole('count(*)', 'trip_count')}, {real('avg(value)', 'avg_value')},
    {real('sum(value)', 'value_total')}, {real('max(value)', 'value_max')},
    mode_type AS trip_type_agg
  FROM events JOIN (
    SELECT user_id % 20 AS z, date_trunc('hour', ts) AS h, event_type AS mode_type FROM events
    GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY user_id % 20, date_trunc('hour', ts)
                               ORDER BY count(*) DESC, event_type) = 1)
    ON z = user_id % 20 AND h = date_trunc('hour', ts)
  GROUP BY user_id % 20, date_trunc('hour', ts), mode_type"""))
def panel_hour(ctx: Context) -> DataFrame:
    rows = ctx.table("events").withColumn("zone", (F.col("user_id") % 20).cast("int"))
    return panels.aggregate_cells(
        rows, "hour", "zone", "ts", means={"avg_value": "value"}, sums={"value_total": "value"},
        maxima={"value_max": "value"}, kind_col="event_type")


@query("A1_panel_one_feed", compose(f"""
  SELECT {whole('pickup_zone', 'zone_id')}, {day("date_trunc('month', pickup_date)", 'date')},
    {whole('count(*)', 'trip_count')}, {real('avg(fare_amount)', 'avg_fare')}
  FROM trips WHERE trip_type = 'green' GROUP BY pickup_zone, date_trunc('month', pickup_date)
  HAVING count(*) >= 5""", "trips"))
def panel_one_feed(ctx: Context) -> DataFrame:
    return panels.build_panel(ctx.trips(), ctx.policy, "month", 5, ["green"]).select(
        "zone_id", "date", "trip_count", "avg_fare")


@query("A2_drop_sparse_cells", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {whole('trip_count')} FROM {DAY5}""", DAY5))
def sparse(ctx: Context) -> DataFrame:
    return panels.drop_sparse(
        panels.build_panel(ctx.trips(), ctx.policy, "day", 1), 5
    ).select("zone_id", "date", "trip_count")


@query("A3_log_outcome", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {real('log_trip_count')} FROM {WEEK}""", WEEK))
def log_outcome(ctx: Context) -> DataFrame:
    return ctx.panel("week", 5).select("zone_id", "date", "log_trip_count")


@query("A4_time_columns", compose(f"""
  SELECT DISTINCT {day('date')}, {day('week')}, {whole('rel_week')}, {whole('post')}, year_month
  FROM {DAY1}""", DAY1))
def time_columns(ctx: Context) -> DataFrame:
    days = ctx.trips().select(F.col("pickup_date").alias("date")).distinct()
    return panels.add_time_columns(days, ctx.policy)


@query("A5_completeness", compose(f"""
  SELECT {whole('count(DISTINCT date)', 'n_dates')}, {whole('count(DISTINCT zone_id)', 'n_zones')},
    {whole('count(*)', 'rows')},
    {whole('count(DISTINCT date)*count(DISTINCT zone_id)', 'max_cells')},
    {real('count(*)*100.0/(count(DISTINCT date)*count(DISTINCT zone_id))', 'pct_complete')}
  FROM {WEEK}""", WEEK))
def completeness(ctx: Context) -> DataFrame:
    return explore.completeness(ctx.panel("week", 5))


_TOP = f"""SELECT zone_id, count(*) AS n FROM {WEEK} GROUP BY 1 ORDER BY n DESC, zone_id LIMIT 30"""


@query("A6_missing_cells", compose(f"""
  SELECT {whole('zone_id')}, {day('week_end')}, {whole('trips')},
    {whole('(trips IS NULL)::INTEGER', 'missing')}
  FROM (SELECT zone_id, unnest(generate_series(a, b, INTERVAL 7 DAY))::DATE AS week_end
        FROM top, (SELECT min(week)+6 AS a, max(week)+6 AS b FROM {WEEK}))
  LEFT JOIN (SELECT zone_id, week+6 AS week_end, sum(trip_count) AS trips FROM {WEEK} GROUP BY 1, 2)
  USING (zone_id, week_end)""", WEEK, extra={"top": _TOP}))
def missing(ctx: Context) -> DataFrame:
    return explore.missing_grid(ctx.panel("week", 5))


@query("A7_daily_totals", compose(f"""
  SELECT {day('date')}, grp AS "group", {whole('trips')},
    {real('''CASE WHEN count(trips) OVER w >= 3 THEN avg(trips) OVER w END''', 'rolling7')}
  FROM (SELECT date, grp, sum(trip_count) AS trips FROM {LABELLED.format(DAY1)} GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY grp ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", DAY1))
def daily(ctx: Context) -> DataFrame:
    return explore.daily_totals(ctx.panel("day", 1))


@query("A8_indexed_weeks", compose(f"""
  SELECT {day('week_end')}, grp AS "group", {whole('trips')},
    {real('trips*100.0/(SELECT r.trips FROM weekly r WHERE r.grp = w.grp AND r.week_end = ('
          'SELECT max(week_end) FROM weekly WHERE week_end < ' + SHOCK + '))', 'indexed')}
  FROM weekly w""", WEEK1, extra={"weekly": f"""
    SELECT week+6 AS week_end, grp, sum(trip_count) AS trips
    FROM {LABELLED.format(WEEK1)} GROUP BY 1, 2"""}))
def indexed(ctx: Context) -> DataFrame:
    return explore.indexed_weeks(ctx.panel("week", 1), ctx.policy)


@query("A9_fare_composition", compose(f"""
  SELECT period, grp AS "group", {real('avg(avg_fare)', 'avg_fare')},
    {real('avg(avg_cbd_fee)', 'avg_cbd_fee')}, {real('avg(surcharge_sum)', 'surcharge_sum')}
  FROM {BY_WEEK} GROUP BY 1, 2""", WEEK))
def fares(ctx: Context) -> DataFrame:
    return explore.fare_composition(ctx.panel("week", 5), ctx.policy)


@query("A10_borough_substitution", compose(_SUBSTITUTION, MONTH))
def boroughs(ctx: Context) -> DataFrame:
    return explore.borough_substitution(ctx.panel(), ctx.policy)


@query("A11_peak_bins", compose(f"""
  SELECT period, peak_bin, {real('avg(trip_count)', 'mean_trips')}
  FROM (SELECT *, CASE WHEN peak_share > 0 AND peak_share <= 0.33 THEN 'low'
                       WHEN peak_share > 0.33 AND peak_share <= 0.66 THEN 'mid'
                       WHEN peak_share > 0.66 AND peak_share <= 1 THEN 'high' END AS peak_bin
        FROM {BY_WEEK} WHERE treat_binary = 1)
  WHERE peak_bin IS NOT NULL GROUP BY 1, 2""", WEEK))
def peaks(ctx: Context) -> DataFrame:
    return explore.peak_bins(ctx.panel("week", 5), ctx.policy)


def histogram_sql(
    rows: str, column: str, bins: int, reads: str, extra: dict[str, str] | None = None
) -> str:
    return compose(f"""
  SELECT {whole('bin')}, {whole('count(*)', 'n')},
    {real(f'any_value(lo)+bin*(any_value(hi)-any_value(lo))/{bins}.0', 'bin_low')},
    {real('any_value(m)', 'mean_value')}
  FROM (SELECT CASE WHEN hi = lo THEN 0
               ELSE least(floor(({column}-lo)/((hi-lo)/{bins}.0::DOUBLE)), {bins - 1}) END AS bin, lo, hi, m
        FROM ({rows}), (SELECT min({column}) AS lo, max({column}) AS hi, avg({column}) AS m
                        FROM ({rows})))
  GROUP BY bin""", reads, extra=extra)


@query("A12_fee_histogram", histogram_sql(
    f"SELECT * FROM {WEEK} WHERE date >= {SHOCK} AND treat_binary = 1 AND avg_cbd_fee > 0",
    "avg_cbd_fee", 40, WEEK))
def fee_bins(ctx: Context) -> DataFrame:
    return explore.fee_histogram(ctx.panel("week", 5), ctx.policy)


@query("A13_summary_table", compose(f"""
  SELECT period || ' / ' || grp AS cell, {', '.join(
      real(f'floor(avg({c})*1000+0.5)/1000', c) for c in explore.SUMMARY_COLUMNS)}
  FROM {BY_WEEK} GROUP BY 1""", WEEK))
def summary(ctx: Context) -> DataFrame:
    return explore.summary_table(ctx.panel("week", 5), ctx.policy)


@query("A14_kpis", compose(f"""
  SELECT {real('CASE WHEN a = 0 THEN 0 ELSE (b/a-1)*100 END', 'total_pct_change')},
    {real('CASE WHEN c = 0 THEN 0 ELSE (d/c-1)*100 END', 'treated_pct_change')},
    {real('coalesce(fee, 0)', 'fee_total')}, {whole('z', 'n_zones')}
  FROM (SELECT coalesce(sum(trip_count) FILTER (period='pre'), 0) AS a,
          coalesce(sum(trip_count) FILTER (period='post'), 0) AS b,
          avg(trip_count) FILTER (period='pre' AND treat_binary=1) AS c,
          avg(trip_count) FILTER (period='post' AND treat_binary=1) AS d,
          sum(cbd_fee_total) FILTER (period='post') AS fee, count(DISTINCT zone_id) AS z
        FROM {BY_WEEK})""", WEEK))
def cards(ctx: Context) -> DataFrame:
    return explore.kpis(ctx.panel("week", 5), ctx.policy)


def surge_ctes(unit: str) -> dict[str, str]:
    """CTEs that end in ``surge`` (zone_id, date, surge_share)."""
    return {
        "priced": f"""SELECT pickup_zone AS zone_id, pickup_date, date_trunc('{unit}', pickup_date)::DATE AS date,
      floor(fare_amount/trip_distance*100+0.5) AS cents FROM trips""",
        "surge": f"""SELECT p.zone_id, date, avg((cents > lim)::INTEGER) AS surge_share
      FROM priced p LEFT JOIN (
        SELECT zone_id, min(cents) AS lim FROM (
          SELECT zone_id, cents, sum(n) OVER (PARTITION BY zone_id ORDER BY cents) AS cum,
            sum(n) OVER (PARTITION BY zone_id) AS tot
          FROM (SELECT zone_id, cents, count(*) AS n FROM priced WHERE pickup_date < {SHOCK} GROUP BY 1, 2))
        WHERE cum >= 0.9*tot GROUP BY 1) l ON l.zone_id = p.zone_id
      GROUP BY p.zone_id, date""",
    }


@query("A15_surge_share", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {real('surge_share')} FROM surge""", "trips", extra=surge_ctes("week")))
def surge(ctx: Context) -> DataFrame:
    return panels.surge_share(ctx.trips(), ctx.policy, "week")


@query("F1_row_lags", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {whole('lag(trip_count, 1) OVER w', 'lag1_trip_count')},
    {whole('lag(trip_count, 7) OVER w', 'lag7_trip_count')}
  FROM {WEEK} WINDOW w AS (PARTITION BY zone_id ORDER BY date)""", WEEK))
def lags(ctx: Context) -> DataFrame:
    return features.add_lags(ctx.panel("week", 5)).select(
        "zone_id", "date", "lag1_trip_count", "lag7_trip_count")


@query("F1_calendar_lags", compose(f"""
  SELECT {whole('p.zone_id', 'zone_id')}, {day('p.date', 'date')},
    {whole('a.trip_count', 'callag7_trip_count')}, {whole('b.trip_count', 'callag28_trip_count')}
  FROM {WEEK} p LEFT JOIN {WEEK} a ON a.zone_id = p.zone_id AND a.date = p.date - 7
  LEFT JOIN {WEEK} b ON b.zone_id = p.zone_id AND b.date = p.date - 28""", WEEK))
def calendar_lags(ctx: Context) -> DataFrame:
    return features.add_calendar_lags(ctx.panel("week", 5), days=(7, 28)).select(
        "zone_id", "date", "callag7_trip_count", "callag28_trip_count")


_ROLL = "(PARTITION BY zone_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query("F2_rolling_moments", compose(f"""
  SELECT {whole('zone_id')}, {day('date')},
    {real(f'CASE WHEN count(trip_count) OVER w >= 3 THEN avg(trip_count) OVER w END',
          'roll7_mean_trip_count')},
    {real(f'CASE WHEN count(trip_count) OVER w >= 3 THEN stddev_samp(trip_count) OVER w END',
          'roll7_std_trip_count')}
  FROM {WEEK} WINDOW w AS {_ROLL}""", WEEK))
def rolling(ctx: Context) -> DataFrame:
    return features.add_rolling(ctx.panel("week", 5)).select(
        "zone_id", "date", "roll7_mean_trip_count", "roll7_std_trip_count")


PRE_STATS = f"""
  SELECT zone_id, avg(trip_count) AS pre_mean_trips, stddev_samp(trip_count) AS pre_std_trips,
    count(trip_count) AS pre_n_days,
    stddev_samp(trip_count)/(avg(trip_count)+1e-6) AS pre_cv_trips
  FROM {{0}} WHERE date < {SHOCK} GROUP BY 1"""


@query("F3_pre_period_stats", compose(f"""
  SELECT {whole('zone_id')}, {real('pre_mean_trips')}, {real('pre_std_trips')},
    {whole('pre_n_days')}, {real('pre_cv_trips')}
  FROM ({PRE_STATS.format(WEEK)})""", WEEK))
def pre_stats(ctx: Context) -> DataFrame:
    return features.pre_period_stats(ctx.panel("week", 5), ctx.policy)


_CALENDAR = f"""
  SELECT *, month(date) AS month, isodow(date)-1 AS dow, weekofyear(date) AS week_of_year,
    (date IN (DATE '1998-07-01', DATE '1998-12-01', DATE '1999-01-01', DATE '1999-07-01'))::INTEGER
      AS is_holiday
  FROM {{0}}"""


@query("F4_calendar_features", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {whole('month')}, {whole('dow')},
    {whole('week_of_year')}, {whole('is_holiday')}
  FROM ({_CALENDAR.format(DAY1)})""", DAY1))
def calendar(ctx: Context) -> DataFrame:
    return features.add_calendar(ctx.panel("day", 1), ctx.policy).select(
        "zone_id", "date", "month", "dow", "week_of_year", "is_holiday")


# the feature table of the month panel as one SQL body
FEATURES = f"""
  SELECT p.*, s.* EXCLUDE (zone_id),
    lag(trip_count, 1) OVER z AS lag1_trip_count, lag(trip_count, 7) OVER z AS lag7_trip_count,
    CASE WHEN count(trip_count) OVER w >= 3 THEN avg(trip_count) OVER w END AS roll7_mean_trip_count,
    CASE WHEN count(trip_count) OVER w >= 3 THEN stddev_samp(trip_count) OVER w END
      AS roll7_std_trip_count
  FROM ({_CALENDAR.format(MONTH)}) p LEFT JOIN ({PRE_STATS.format(MONTH)}) s ON s.zone_id = p.zone_id
  WINDOW z AS (PARTITION BY p.zone_id ORDER BY date),
    w AS (PARTITION BY p.zone_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""
FEATURE_NAMES = [
    "borough_code", "is_airport_zone", "pre_mean_trips", "pre_cv_trips", "dow", "month",
    "is_holiday", "week_of_year", "weekend_flag", "peak_share", "lag1_trip_count",
    "lag7_trip_count", "roll7_mean_trip_count", "roll7_std_trip_count",
]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_NAMES)


@query("F5_feature_drop_report", compose(f"""
  SELECT {whole('count(*)', 'rows_in')}, {whole(f'count(*) FILTER ({_COMPLETE})', 'rows_kept')},
    {whole(f'count(*) FILTER (NOT ({_COMPLETE}))', 'rows_dropped')},
    {whole(str(len(FEATURE_NAMES)), 'n_features')}
  FROM features""", MONTH, extra={"features": FEATURES}))
def drop_report(ctx: Context) -> DataFrame:
    return features.drop_report(ctx.panel(), ctx.policy)


def _scaled_sql(reference: str) -> str:
    moments = ", ".join(
        f"avg({c}) FILTER ({reference}) AS m_{c}, stddev_pop({c}) FILTER ({reference}) AS s_{c}"
        for c in FEATURE_NAMES)
    scaled = ", ".join(
        real(f"({c}-m_{c})/(CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)", f"z_{c}")
        for c in FEATURE_NAMES)
    return compose(
        f"SELECT {whole('zone_id')}, {day('date')}, {scaled} FROM f, (SELECT {moments} FROM f)",
        MONTH, extra={"features": FEATURES, "f": f"SELECT * FROM features WHERE {_COMPLETE}"})


@query("F6_standardize", _scaled_sql("TRUE"))
def scaled(ctx: Context) -> DataFrame:
    made = features.feature_matrix(ctx.panel(), ctx.policy)
    return made.panel.select("zone_id", "date", *made.scaled)


@query("F6_standardize_pre_only", _scaled_sql(f"date < {SHOCK}"))
def scaled_pre(ctx: Context) -> DataFrame:
    made = features.feature_matrix(ctx.panel(), ctx.policy, pre_only=True)
    return made.panel.select("zone_id", "date", *made.scaled)


@query("O1_sorted_panel", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {whole('trip_count')} FROM {WEEK}
  ORDER BY zone_id, date""", WEEK))
def sorted_panel(ctx: Context) -> DataFrame:
    return ctx.panel("week", 5).orderBy("zone_id", "date").select("zone_id", "date", "trip_count")


@query("O2_sort_by_magnitude", compose(f"""
  SELECT {whole('zone_id')}, {real('gap')} FROM (
    SELECT zone_id, avg(trip_count) FILTER (period='post') - avg(trip_count) FILTER (period='pre')
      AS gap FROM {BY_WEEK} GROUP BY 1) ORDER BY abs(gap) DESC""", WEEK))
def by_magnitude(ctx: Context) -> DataFrame:
    pre = F.col("date") < ctx.policy.shock_lit()
    gap = F.avg(F.when(~pre, F.col("trip_count"))) - F.avg(F.when(pre, F.col("trip_count")))
    return ctx.panel("week", 5).groupBy("zone_id").agg(gap.alias("gap")).orderBy(
        F.abs("gap").desc(), "zone_id")


@query("O3_top_zones", compose(f"""
  SELECT {whole('zone_id')}, {whole('count(*)', 'rows')} FROM {WEEK} GROUP BY zone_id
  ORDER BY count(*) DESC, zone_id LIMIT 12""", WEEK))
def top(ctx: Context) -> DataFrame:
    return explore.top_zones(ctx.panel("week", 5), 12)


@query("O4_union_results", compose(f"""
  SELECT 'zone' AS kind, {whole('zone_id', 'zone_id')}, NULL::VARCHAR AS borough,
    {whole('sum(trip_count)', 'trips')} FROM {WEEK} GROUP BY zone_id
  UNION ALL BY NAME
  SELECT 'borough' AS kind, NULL::BIGINT AS zone_id, borough, {whole('sum(trip_count)', 'trips')}
  FROM {WEEK} GROUP BY borough""", WEEK))
def union(ctx: Context) -> DataFrame:
    panel = ctx.panel("week", 5)
    by_zone = panel.groupBy(F.lit("zone").alias("kind"), "zone_id").agg(
        F.sum("trip_count").alias("trips"))
    by_borough = panel.groupBy(F.lit("borough").alias("kind"), "borough").agg(
        F.sum("trip_count").alias("trips"))
    return by_zone.unionByName(by_borough, allowMissingColumns=True)


@query("O6_distinct_units_weeks", compose(f"""
  SELECT DISTINCT 'unit' AS kind, {whole('zone_id', 'id')}, {whole('treat_binary')},
    NULL::VARCHAR AS week FROM {WEEK}
  UNION ALL BY NAME
  SELECT DISTINCT 'week' AS kind, NULL::BIGINT AS id, NULL::BIGINT AS treat_binary, {day('week')}
  FROM {WEEK}""", WEEK))
def distinct(ctx: Context) -> DataFrame:
    panel = ctx.panel("week", 5)
    units = panel.select(F.lit("unit").alias("kind"), F.col("zone_id").alias("id"),
                         "treat_binary").distinct()
    weeks = panel.select(F.lit("week").alias("kind"), "week").distinct()
    return units.unionByName(weeks, allowMissingColumns=True)


@query("O7_pivot_borough_period", compose(f"""
  SELECT borough, {whole("sum(trip_count) FILTER (period='pre')", 'pre')},
    {whole("sum(trip_count) FILTER (period='post')", 'post')}
  FROM {BY_WEEK} GROUP BY borough""", WEEK))
def pivot(ctx: Context) -> DataFrame:
    labelled = ctx.panel("week", 5).withColumn("period", explore.period_label(ctx.policy))
    return labelled.groupBy("borough").pivot("period", ["pre", "post"]).sum("trip_count")
