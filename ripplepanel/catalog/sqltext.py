"""DuckDB SQL for the same binding, as named CTEs that queries build on."""

from __future__ import annotations

import math

from ripplepanel.functions.columns import POISSON_ONE_CDF
from ripplepanel.functions.tails import ERFC_COEFFICIENTS

SHOCK = "DATE '1998-07-05'"


def real(expr: str, name: str | None = None) -> str:
    """Four decimals, ties nudged up: the counterpart of ``round4``."""
    return f"floor((({expr})::DOUBLE)*1e4+0.5+1e-6)/1e4+0.0 AS {name or expr}"


def whole(expr: str, name: str | None = None) -> str:
    return f"CAST(({expr}) AS BIGINT) AS {name or expr}"


def day(expr: str, name: str | None = None) -> str:
    return f"strftime(({expr})::DATE, '%Y-%m-%d') AS {name or expr}"


def erfc(x: str) -> str:
    t = f"(1.0/(1.0+abs({x})*0.5))"
    poly = f"({ERFC_COEFFICIENTS[-1]})"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"(({c})+{t}*{poly})"
    upper = f"({t}*exp(-({x})*({x})+{poly}))"
    return f"(CASE WHEN ({x})>=0 THEN {upper} ELSE 2.0-{upper} END)"


def normal_p(z: str) -> str:
    return erfc(f"(abs({z})/{math.sqrt(2.0)!r})")


def hash32(*parts: str, seed: int | str) -> str:
    text = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x'||substr(md5(concat_ws('|', {text}, '{seed}')),1,8))::BIGINT"


def poisson(h: str) -> str:
    whens = " ".join(
        f"WHEN ({h})/4294967296.0 < {p!r} THEN {k}.0" for k, p in enumerate(POISSON_ONE_CDF))
    return f"(CASE {whens} ELSE {len(POISSON_ONE_CDF)}.0 END)"


def stars(p: str) -> str:
    return (f"(CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' "
            f"WHEN {p} < 0.05 THEN '*' ELSE '' END)")


def fixed(x: str, digits: int = 4) -> str:
    s = f"1e{digits}"
    return (f"coalesce(printf('%.{digits}f', floor((({x})::DOUBLE)*{s}+0.5+1e-6)/{s}), '—')")


# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}

CTES["bound"] = ((), """
  SELECT l_orderkey, l_linenumber, c_nationkey+1 AS pickup_zone, s_nationkey+1 AS dropoff_zone,
    l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS pickup_datetime,
    l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER))
      + to_minutes(CAST(l_quantity*8-10 AS BIGINT)) AS dropoff_datetime,
    l_quantity*7-10 AS trip_distance, l_extendedprice/100-20 AS fare_amount,
    l_tax*10 AS tolls_amount, l_linenumber::DOUBLE AS passenger_count,
    CASE WHEN l_shipdate >= DATE '1998-07-05' AND c_nationkey+1 <= 8
         THEN l_tax*25*(c_nationkey+1)/4 END AS raw_fee,
    l_discount*10-0.2::DOUBLE AS extra,
    CASE l_returnflag WHEN 'A' THEN 'yellow' WHEN 'N' THEN 'green' ELSE 'fhvhv' END AS trip_type,
    strftime(CASE WHEN l_linenumber=7 THEN l_shipdate + INTERVAL 1 DAY ELSE l_shipdate END,
             '%Y-%m') AS leaky_month,
    strftime(l_shipdate, '%Y-%m') AS year_month
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
  JOIN supplier ON l_suppkey=s_suppkey""")

CTES["timed"] = (("bound",), """
  SELECT *, date_diff('second', pickup_datetime, dropoff_datetime)/60.0::DOUBLE AS trip_duration_min,
    greatest(extra, 0.0)+0.5::DOUBLE AS surcharge_total,
    greatest(coalesce(raw_fee, 0.0), 0.0) AS cbd_congestion_fee
  FROM bound""")

CTES["kept"] = (("timed",), """
  SELECT *, pickup_datetime::DATE AS pickup_date, hour(pickup_datetime) AS hour,
    isodow(pickup_datetime)-1 AS dow,
    (isodow(pickup_datetime) >= 6)::INTEGER AS is_weekend,
    (hour(pickup_datetime) BETWEEN 7 AND 9 OR hour(pickup_datetime) BETWEEN 16 AND 19)::INTEGER
      AS is_peak,
    (pickup_zone IN (1,14,20) OR dropoff_zone IN (1,14,20))::INTEGER AS is_airport_trip
  FROM timed
  WHERE trip_distance > 0 AND trip_distance < 300 AND trip_duration_min > 0.5
    AND trip_duration_min < 360 AND fare_amount > 0 AND fare_amount < 1000
    AND pickup_zone BETWEEN 1 AND 265 AND dropoff_zone BETWEEN 1 AND 265""")

CTES["trips"] = (("kept",), "SELECT * FROM kept")

CTES["zones"] = ((), """
  SELECT n_nationkey+1 AS zone_id, r_name AS borough, n_name AS zone_name,
    CASE r_name WHEN 'AFRICA' THEN 1 WHEN 'AMERICA' THEN 2 WHEN 'ASIA' THEN 3 WHEN 'EUROPE' THEN 4
      ELSE 0 END AS borough_code
  FROM nation JOIN region ON n_regionkey=r_regionkey""")


def _panel(unit: str, min_trips: int) -> str:
    """Registers the CTEs of one panel and returns its name."""
    name = f"panel_{unit}_{min_trips}"
    cells = f"cells_{unit}_{min_trips}"
    CTES[cells] = (("trips",), f"""
  SELECT c.*, k.trip_type AS trip_type_agg FROM (
    SELECT pickup_zone AS zone_id, date_trunc('{unit}', pickup_date)::DATE AS date,
      count(*) AS trip_count, avg(trip_distance) AS avg_distance,
      avg(trip_duration_min) AS avg_duration, avg(fare_amount) AS avg_fare,
      sum(surcharge_total) AS surcharge_sum, avg(cbd_congestion_fee) AS avg_cbd_fee,
      sum(cbd_congestion_fee) AS cbd_fee_total, avg(is_airport_trip) AS airport_share,
      avg(is_peak) AS peak_share, max(is_weekend) AS weekend_flag
    FROM trips GROUP BY 1, 2 HAVING count(*) >= {min_trips}) c
  JOIN (SELECT zone_id, date, trip_type FROM (
          SELECT pickup_zone AS zone_id, date_trunc('{unit}', pickup_date)::DATE AS date, trip_type,
            count(*) AS n FROM trips GROUP BY 1, 2, 3)
        QUALIFY row_number() OVER (PARTITION BY zone_id, date ORDER BY n DESC, trip_type) = 1) k
  USING (zone_id, date)""")
    CTES[name + "_t"] = ((cells, "zones"), f"""
  SELECT c.*, ln(1+trip_count) AS log_trip_count, date_trunc('week', date)::DATE AS week,
    CAST(floor(date_diff('day', {SHOCK}, date_trunc('week', date)::DATE)/7.0) AS INTEGER) AS rel_week,
    (date >= {SHOCK})::INTEGER AS post, strftime(date, '%Y-%m') AS year_month,
    borough, borough_code, zone_name,
    (zone_id <= 8)::INTEGER AS treat_binary, (zone_id IN (1,14,20))::INTEGER AS is_airport_zone,
    CASE WHEN zone_id <= 8 THEN 2 WHEN zone_id <= 12 THEN 1 ELSE 0 END AS treat_ring,
    greatest(coalesce(avg_cbd_fee, 0), 0) AS dose_raw
  FROM {cells} c LEFT JOIN zones USING (zone_id)""")
    CTES[name + "_e"] = ((name + "_t",), f"""
  SELECT avg(dose_raw) FILTER (post=1 AND treat_binary=1) AS mu,
    stddev_samp(dose_raw) FILTER (post=1 AND treat_binary=1) AS sigma,
    list_sort(list_distinct(coalesce(
      quantile_cont(dose_raw, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) FILTER (dose_raw > 0),
      []::DOUBLE[]))) AS edges
  FROM {name}_t""")
    CTES[name] = ((name + "_t", name + "_e"), f"""
  SELECT t.*, (dose_raw-mu)/(sigma+1e-8) AS dose_std,
    CASE WHEN dose_raw > 0 THEN 1+len(list_filter(edges[2:], lambda e: e < dose_raw)) ELSE 0 END
      AS dose_quantile
  FROM {name}_t t, {name}_e""")
    return name


MONTH = _panel("month", 5)
MONTH1 = _panel("month", 1)
WEEK = _panel("week", 5)
WEEK1 = _panel("week", 1)
DAY1 = _panel("day", 1)
DAY5 = _panel("day", 5)


def compose(final: str, *reads: str, extra: dict[str, str] | None = None) -> str:
    """``final`` with every CTE it needs in front, in order, plus ``extra`` ones."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in reads:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1].strip()})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({body.strip()})" for n, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final.strip()


PANEL_COLUMNS = ", ".join([
    whole("zone_id"), day("date"), whole("trip_count"), real("avg_distance"), real("avg_duration"),
    real("avg_fare"), real("avg_cbd_fee"), real("airport_share"), real("peak_share"),
    real("surcharge_sum"), real("cbd_fee_total"), whole("weekend_flag"), "trip_type_agg",
    real("log_trip_count"), day("week"), whole("rel_week"), whole("post"), "year_month",
])
