"""Descriptive queries over a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.functions.columns import equal_width_bin, right_closed_bin
from ripplepanel.policy import Policy

TREATED, CONTROL = "treated", "control"


def group_label() -> Column:
    return F.when(F.col("treat_binary") == 1, TREATED).otherwise(CONTROL)


def period_label(policy: Policy) -> Column:
    return F.when(F.col("date") < policy.shock_lit(), "pre").otherwise("post")


def completeness(panel: DataFrame) -> DataFrame:
    out = panel.agg(
        F.count_distinct("date").alias("n_dates"),
        F.count_distinct("zone_id").alias("n_zones"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("max_cells", F.col("n_dates") * F.col("n_zones"))
    return out.withColumn("pct_complete", F.col("rows") / F.col("max_cells") * 100)


def top_zones(panel: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` zones with most panel rows; the smaller id wins ties."""
    rows = panel.groupBy("zone_id").agg(F.count(F.lit(1)).alias("rows"))
    return rows.orderBy(F.desc("rows"), "zone_id").limit(k)


def missing_grid(panel: DataFrame, k: int = 30) -> DataFrame:
    """Top zones x all weeks (labelled by the Sunday that ends them).

    The grid is each zone exploded over a week sequence, so nothing is crossed.
    """
    label = F.date_add(F.col("week"), 6)
    span = panel.agg(F.struct(
        F.min(label).alias("a"), F.max(label).alias("b")
    ).alias("s")).scalar()
    zones = top_zones(panel, k).select("zone_id", span.alias("s"))
    grid = zones.select(
        "zone_id", F.explode(F.expr("sequence(s.a, s.b, interval 7 days)")).alias("week_end")
    )
    cells = panel.groupBy("zone_id", label.alias("week_end")).agg(
        F.sum("trip_count").alias("trips"))
    return grid.join(cells, ["zone_id", "week_end"], "left").withColumn(
        "missing", F.col("trips").isNull().cast("int"))


def daily_totals(panel: DataFrame, width: int = 7, min_obs: int = 3) -> DataFrame:
    """Total per period and group with a trailing mean that includes the row."""
    daily = panel.groupBy("date", group_label().alias("group")).agg(
        F.sum("trip_count").alias("trips"))
    frame = Window.partitionBy("group").orderBy("date").rowsBetween(-(width - 1), 0)
    return daily.withColumn(
        f"rolling{width}",
        F.when(F.count("trips").over(frame) >= min_obs, F.avg("trips").over(frame)),
    )


def indexed_weeks(panel: DataFrame, policy: Policy) -> DataFrame:
    """Weekly totals per group, 100 = last week label before the shock."""
    weekly = panel.groupBy(
        F.date_add(F.col("week"), 6).alias("week_end"), group_label().alias("group")
    ).agg(F.sum("trip_count").alias("trips"))
    before = F.when(F.col("week_end") < policy.shock_lit(), F.col("week_end"))
    ref_week = weekly.agg(F.max(before)).scalar()
    ref = weekly.where(F.col("week_end") == ref_week).select(
        "group", F.col("trips").alias("ref_trips"))
    return weekly.join(ref, "group", "left").select(
        "week_end", "group", "trips",
        (F.col("trips") / F.col("ref_trips") * 100).alias("indexed"),
    )


def fare_composition(
    panel: DataFrame, policy: Policy,
    columns: Sequence[str] = ("avg_fare", "avg_cbd_fee", "surcharge_sum"),
) -> DataFrame:
    return panel.groupBy(
        period_label(policy).alias("period"), group_label().alias("group")
    ).agg(*[F.avg(c).alias(c) for c in columns])


def borough_substitution(panel: DataFrame, policy: Policy) -> DataFrame:
    """Trips per borough before and after, with the change in percent, sorted."""
    pre = F.col("date") < policy.shock_lit()
    out = panel.where(F.col("borough").isNotNull()).groupBy("borough").agg(
        F.sum(F.when(pre, F.col("trip_count"))).alias("pre_trips"),
        F.sum(F.when(~pre, F.col("trip_count"))).alias("post_trips"),
    )
    return out.withColumn(
        "pct_change", (F.col("post_trips") / F.col("pre_trips") - 1) * 100
    ).orderBy("pct_change", "borough")


def peak_bins(panel: DataFrame, policy: Policy) -> DataFrame:
    """Mean trips of treated cells by rush-hour share; a share of 0 has no bin."""
    number = right_closed_bin(F.col("peak_share"), (0.0, 0.33, 0.66, 1.0), include_lowest=False)
    label = F.when(number == 1, "low").when(number == 2, "mid").when(number == 3, "high")
    return (
        panel.where(F.col("treat_binary") == 1)
        .select(period_label(policy).alias("period"), label.alias("peak_bin"), "trip_count")
        .where(F.col("peak_bin").isNotNull())
        .groupBy("period", "peak_bin").agg(F.avg("trip_count").alias("mean_trips"))
    )


def histogram(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts between the minimum and the maximum, with the mean."""
    span = rows.agg(F.struct(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"),
    ).alias("s")).scalar()
    held = rows.where(F.col(column).isNotNull()).select(column, span.alias("_s"))
    binned = held.withColumn(
        "bin", equal_width_bin(F.col(column), F.col("_s.lo"), F.col("_s.hi"), bins))
    counted = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_s").alias("_s"))
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(float(bins))
    return counted.select(
        "bin", "n", (F.col("_s.lo") + F.col("bin") * width).alias("bin_low"),
        F.col("_s.mean").alias("mean_value"),
    )


def fee_histogram(panel: DataFrame, policy: Policy, bins: int = 40) -> DataFrame:
    paying = panel.where(
        (F.col("date") >= policy.shock_lit()) & (F.col("treat_binary") == 1)
        & (F.col("avg_cbd_fee") > 0))
    return histogram(paying, "avg_cbd_fee", bins)


# Columns of the summary table.
SUMMARY_COLUMNS = (
    "trip_count", "avg_distance", "avg_duration", "avg_fare", "avg_cbd_fee", "peak_share",
)


def summary_table(panel: DataFrame, policy: Policy) -> DataFrame:
    present = [c for c in SUMMARY_COLUMNS if c in panel.columns]
    label = F.concat_ws(" / ", period_label(policy), group_label())
    return panel.groupBy(label.alias("cell")).agg(
        *[F.round(F.avg(c), 3).alias(c) for c in present])


def kpis(panel: DataFrame, policy: Policy) -> DataFrame:
    """Headline numbers in one aggregate; a zero base gives 0 percent, no base null."""
    pre = F.col("date") < policy.shock_lit()
    treated = F.col("treat_binary") == 1
    n = F.col("trip_count")

    def change(before: str, after: str) -> Column:
        return F.when(F.col(before) == 0, F.lit(0.0)).otherwise(
            (F.try_divide(after, before) - 1) * 100)

    sums = panel.agg(
        F.coalesce(F.sum(F.when(pre, n)), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(~pre, n)), F.lit(0)).alias("b"),
        F.avg(F.when(pre & treated, n)).alias("c"), F.avg(F.when(~pre & treated, n)).alias("d"),
        F.coalesce(F.sum(F.when(~pre, F.col("cbd_fee_total"))), F.lit(0.0)).alias("fee_total"),
        F.count_distinct("zone_id").alias("n_zones"),
    )
    return sums.select(
        change("a", "b").alias("total_pct_change"),
        change("c", "d").alias("treated_pct_change"), "fee_total", "n_zones",
    )
