"""Trip cleaning: narrow projections and filters only, so it never shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import clip_low
from ripplepanel.policy import Policy

CLEAN_COLUMNS = (
    "pickup_datetime", "dropoff_datetime", "pickup_date", "pickup_zone", "dropoff_zone",
    "trip_distance", "trip_duration_min", "fare_amount", "tolls_amount", "surcharge_total",
    "cbd_congestion_fee", "passenger_count", "hour", "dow", "is_weekend", "is_peak",
    "is_airport_trip", "trip_type", "year_month",
)


@dataclass(frozen=True)
class QualityLimits:
    """Open intervals a trip must fall into."""

    distance: tuple[float, float] = (0.0, 300.0)
    minutes: tuple[float, float] = (0.5, 360.0)
    fare: tuple[float, float] = (0.0, 1000.0)


def drop_null_times(trips: DataFrame) -> DataFrame:
    return trips.dropna(subset=["pickup_datetime", "dropoff_datetime"])


def month_label(c: Column) -> Column:
    """yyyy-MM, cut from the ISO date text: no formatter call per row."""
    return F.substring(c.cast("date").cast("string"), 1, 7)


def in_declared_month() -> Column:
    """True when a pickup falls in the month its file was declared for."""
    return month_label(F.col("pickup_datetime")) == F.col("year_month")


def duration_minutes(start: str = "pickup_datetime", end: str = "dropoff_datetime") -> Column:
    """Minutes between two wall-clock times, independent of the session zone."""
    gap = (F.col(end) - F.col(start)).cast("interval second")
    return gap.cast("decimal(20,6)").cast("double") / F.lit(60.0)


def quality_rules(policy: Policy, limits: QualityLimits = QualityLimits()) -> dict[str, Column]:
    """Named pass conditions. Each upper bound also rejects NaN."""
    def inside(name: str, bounds: tuple[float, float]) -> Column:
        return (F.col(name) > bounds[0]) & (F.col(name) < bounds[1])

    return {
        "distance": inside("trip_distance", limits.distance),
        "duration": inside("trip_duration_min", limits.minutes),
        "fare": inside("fare_amount", limits.fare),
        "pickup_zone": F.col("pickup_zone").between(1, policy.max_zone),
        "dropoff_zone": F.col("dropoff_zone").between(1, policy.max_zone),
    }


def quality_filter(
    trips: DataFrame, policy: Policy, limits: QualityLimits = QualityLimits()
) -> DataFrame:
    keep = F.lit(True)
    for rule in quality_rules(policy, limits).values():
        keep = keep & rule
    return trips.where(keep)


def quality_report(
    trips: DataFrame, policy: Policy, keys: Sequence[str] = ("trip_type", "year_month"),
    limits: QualityLimits = QualityLimits(),
) -> DataFrame:
    """Rows in, rows kept and rejects per rule, in one pass over the trips."""
    rules = quality_rules(policy, limits)
    passed = {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}
    every = F.lit(True)
    for ok in passed.values():
        every = every & ok
    timed = trips.withColumn("trip_duration_min", duration_minutes())
    return timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(every).alias("rows_kept"),
        *[F.count_if(~ok).alias(f"reject_{name}") for name, ok in passed.items()],
    )


def clean_fee() -> Column:
    return clip_low(F.col("cbd_congestion_fee"))


def calendar_flags(trips: DataFrame) -> DataFrame:
    """Date, hour, weekday (0 = Monday), weekend and rush-hour flags."""
    start = F.col("pickup_datetime")
    hour, dow = F.hour(start), F.weekday(start)
    return trips.withColumns({
        "pickup_date": F.to_date(start),
        "hour": hour,
        "dow": dow,
        "is_weekend": (dow >= 5).cast("int"),
        "is_peak": (hour.between(7, 9) | hour.between(16, 19)).cast("int"),
    })


def airport_flag(policy: Policy) -> Column:
    ids = list(policy.airports)
    return (F.col("pickup_zone").isin(ids) | F.col("dropoff_zone").isin(ids)).cast("int")


def clean_trips(
    trips: DataFrame, policy: Policy, limits: QualityLimits = QualityLimits()
) -> DataFrame:
    """Unified trips to clean trips: one filter, one projection, no shuffle."""
    timed = drop_null_times(trips)
    if "year_month" in trips.columns:
        timed = timed.where(in_declared_month())
    else:
        timed = timed.withColumn("year_month", month_label(F.col("pickup_datetime")))
    kept = quality_filter(timed.withColumn("trip_duration_min", duration_minutes()), policy, limits)
    flagged = calendar_flags(kept.withColumn("cbd_congestion_fee", clean_fee()))
    flagged = flagged.withColumn("is_airport_trip", airport_flag(policy))
    return flagged.select(*[c for c in CLEAN_COLUMNS if c in flagged.columns])
