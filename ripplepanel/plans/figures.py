"""The data behind each figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.ranking import exact_quantiles
from ripplepanel.operators.explore import histogram
from ripplepanel.operators.within import Z95


def phase() -> Column:
    return F.when(F.col("rel_week") < 0, "pre").otherwise("post")


def event_series(
    coefficients: DataFrame, pretrend: DataFrame, window: tuple[int, int] | None = None
) -> DataFrame:
    """Event-study points by phase with the verdict of the lead test."""
    rows = coefficients if window is None else coefficients.where(
        F.col("rel_week").between(*window))
    p = pretrend.select("p_value").scalar()
    return rows.select(
        "rel_week", "coef", "ci_low", "ci_high", phase().alias("phase"),
        (p > 0.05).cast("int").alias("pretrend_holds"))


def att_series(att: DataFrame) -> DataFrame:
    return att.select(
        "rel_week", "att", "ci_low", "ci_high",
        F.when(F.col("is_pre"), "pre").otherwise("post").alias("phase"))


def dose_bars(bins: DataFrame) -> DataFrame:
    half = F.col("se") * Z95
    return bins.select("bin", "mean_dose", "att", (F.col("att") - half).alias("low"),
                       (F.col("att") + half).alias("high"))


def effect_bars(effects: DataFrame) -> DataFrame:
    half = F.col("se") * Z95
    return effects.select(
        "outcome", "theta", (F.col("theta") - half).alias("low"),
        (F.col("theta") + half).alias("high"),
        F.coalesce((F.col("p_value") < 0.05).cast("int"), F.lit(0)).alias("significant"))


def cate_map(zones: DataFrame, zone_cate: DataFrame) -> DataFrame:
    """Zones with their effect, its ratio to the error and symmetric colour limits."""
    sized = zone_cate.withColumn("_abs", F.abs("cate"))
    limits = exact_quantiles(sized, "_abs", [0.95], ["zone_id"])
    limit = limits[0] if limits else None
    ratio = F.abs(F.col("cate") / (F.col("cate_se") + F.lit(1e-8)))
    return zones.join(zone_cate, "zone_id", "left").select(
        *zones.columns, "cate", "cate_se", ratio.alias("t_stat"),
        F.coalesce((ratio > Z95).cast("int"), F.lit(0)).alias("significant"),
        F.lit(limit).cast("double").alias("colour_limit"))


def cate_histogram(rows: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(rows, "cate", bins)


def top_features(importance: DataFrame, k: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def targeting_series(curve: DataFrame) -> DataFrame:
    """The curve, its last value as the uniform line, and its mean as the score."""
    uniform = curve.agg(F.max_by("ate_top_q", "fraction")).scalar()
    score = curve.agg(F.avg("ate_top_q")).scalar()
    return curve.select("fraction", "ate_top_q", uniform.alias("uniform_ate"),
                        score.alias("rate_score"))


def robustness_bars(checks: DataFrame, main: DataFrame) -> DataFrame:
    """Checks with their intervals next to the main estimate's band (one row)."""
    ate, se = main.select("ate").scalar(), main.select("se").scalar()
    half = F.col("se") * Z95
    return checks.select(
        "group", "check", "theta", (F.col("theta") - half).alias("low"),
        (F.col("theta") + half).alias("high"),
        F.coalesce((F.col("p") < 0.05).cast("int"), F.lit(0)).alias("significant"),
        ate.alias("main"), (ate - se * Z95).alias("main_low"), (ate + se * Z95).alias("main_high"))
