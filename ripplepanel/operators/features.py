"""Covariates of a panel: lags, rolling moments, zone statics, calendar, scaling.

Windows run per zone over one row per period, so a window group is as long as
the time axis whatever the number of trips behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.policy import Policy


def add_lags(
    panel: DataFrame, outcome: str = "trip_count", steps: Sequence[int] = (1, 7)
) -> DataFrame:
    """Row lags per zone: the k-th earlier observed period."""
    past = Window.partitionBy("zone_id").orderBy("date")
    return panel.withColumns({f"lag{k}_{outcome}": F.lag(outcome, k).over(past) for k in steps})


def add_calendar_lags(
    panel: DataFrame, outcome: str = "trip_count", days: Sequence[int] = (1, 7)
) -> DataFrame:
    """Calendar lags per zone: the value exactly k days before, else null."""
    out = panel
    for k in days:
        earlier = panel.select(
            "zone_id", F.date_add("date", k).alias("date"),
            F.col(outcome).alias(f"callag{k}_{outcome}"),
        )
        out = out.join(earlier, ["zone_id", "date"], "left")
    return out


def add_rolling(
    panel: DataFrame, outcome: str = "trip_count", width: int = 7, min_obs: int = 3
) -> DataFrame:
    """Mean and sample deviation of the ``width`` observations before each row."""
    frame = Window.partitionBy("zone_id").orderBy("date").rowsBetween(-width, -1)
    enough = F.count(outcome).over(frame) >= min_obs
    return panel.withColumns({
        f"roll{width}_mean_{outcome}": F.when(enough, F.avg(outcome).over(frame)),
        f"roll{width}_std_{outcome}": F.when(enough, F.stddev_samp(outcome).over(frame)),
    })


def pre_period_stats(panel: DataFrame, policy: Policy, outcome: str = "trip_count") -> DataFrame:
    """Per zone: mean, deviation, count and variation before the shock."""
    stats = panel.where(F.col("date") < policy.shock_lit()).groupBy("zone_id").agg(
        F.avg(outcome).alias("pre_mean_trips"),
        F.stddev_samp(outcome).alias("pre_std_trips"),
        F.count(outcome).alias("pre_n_days"),
    )
    return stats.withColumn(
        "pre_cv_trips", F.col("pre_std_trips") / (F.col("pre_mean_trips") + F.lit(1e-6))
    )


def add_zone_statics(panel: DataFrame, policy: Policy, outcome: str = "trip_count") -> DataFrame:
    return panel.join(pre_period_stats(panel, policy, outcome), "zone_id", "left")


def add_calendar(panel: DataFrame, policy: Policy) -> DataFrame:
    """Month, weekday (0 = Monday), ISO week and public-holiday flag."""
    day = F.col("date").cast("date")
    return panel.withColumns({
        "month": F.month(day),
        "dow": F.weekday(day),
        "week_of_year": F.weekofyear(day),
        "is_holiday": day.isin([F.lit(h) for h in policy.holidays]).cast("int")
        if policy.holidays else F.lit(0),
    })


# Candidate covariates, in order. The second list defines the
# treatment itself, so it is only used on request.
BASE_FEATURES = (
    "distance_to_cbd_km", "borough_code", "is_airport_zone", "pre_mean_trips", "pre_cv_trips",
    "dow", "month", "is_holiday", "week_of_year", "weekend_flag", "peak_share",
)
TREATMENT_FEATURES = ("treat_ring", "dose_raw", "dose_std")


@dataclass(frozen=True)
class FeatureSet:
    panel: DataFrame
    columns: list[str]

    @property
    def scaled(self) -> list[str]:
        return [f"z_{c}" for c in self.columns]


def add_features(panel: DataFrame, policy: Policy, outcome: str = "trip_count") -> DataFrame:
    out = add_rolling(add_lags(panel, outcome), outcome)
    return add_calendar(add_zone_statics(out, policy), policy)


def feature_names(
    panel: DataFrame, outcome: str = "trip_count", with_treatment: bool = False
) -> list[str]:
    """The candidates that exist in ``panel``."""
    wanted = list(BASE_FEATURES) + [
        f"lag1_{outcome}", f"lag7_{outcome}", f"roll7_mean_{outcome}", f"roll7_std_{outcome}",
    ]
    if with_treatment:
        wanted += TREATMENT_FEATURES
    return [c for c in wanted if c in panel.columns]


def feature_matrix(
    panel: DataFrame, policy: Policy, outcome: str = "trip_count", pre_only: bool = False,
    with_treatment: bool = False, columns: Sequence[str] | None = None,
) -> FeatureSet:
    """Features built, rows with a missing feature dropped, z_ columns added."""
    built = add_features(panel, policy, outcome)
    names = list(columns) if columns else feature_names(built, outcome, with_treatment)
    kept = built.dropna(subset=names)
    return FeatureSet(standardize(kept, names, policy, pre_only), names)


def drop_report(panel: DataFrame, policy: Policy, outcome: str = "trip_count") -> DataFrame:
    """Rows in, rows kept, rows dropped and features used by ``feature_matrix``."""
    built = add_features(panel, policy, outcome)
    names = feature_names(built, outcome)
    missing = F.lit(False)
    for c in names:
        missing = missing | F.col(c).isNull()
    return built.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~missing).alias("rows_kept"),
        F.count_if(missing).alias("rows_dropped"),
        F.lit(len(names)).alias("n_features"),
    )


def standardize(
    panel: DataFrame, names: Sequence[str], policy: Policy, pre_only: bool = False
) -> DataFrame:
    """Adds z_<name> with population deviation; a constant column divides by 1.

    ``pre_only`` takes the moments from rows before the shock. All moments come
    from one aggregate; originals stay untouched.
    """
    use = F.col("date") < policy.shock_lit() if pre_only else F.lit(True)
    moments = panel.agg(F.struct(*[
        e for c in names for e in (
            F.avg(F.when(use, F.col(c))).alias(f"m_{c}"),
            F.stddev_pop(F.when(use, F.col(c))).alias(f"s_{c}"),
        )
    ]).alias("m")).scalar()
    held = panel.withColumn("_moments", moments)
    scaled = held.withColumns({
        f"z_{c}": (F.col(c) - F.col(f"_moments.m_{c}"))
        / F.when(F.col(f"_moments.s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_moments.s_{c}"))
        for c in names
    })
    return scaled.drop("_moments")
