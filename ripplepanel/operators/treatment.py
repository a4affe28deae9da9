"""Who is treated, how strongly, and the joins that attach zone facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import clip_low, right_closed_bin
from ripplepanel.functions.ranking import exact_quantiles
from ripplepanel.policy import Policy


def enrich_zones(panel: DataFrame, lookup: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Left joins to the zone dimension and, when given, to zone geometry facts.

    No broadcast is forced: the optimizer broadcasts a side it has measured to
    be small, and adaptive execution splits a hot zone otherwise.
    """
    out = panel.join(lookup.select("zone_id", "borough", "borough_code", "zone_name"),
                     "zone_id", "left")
    if geo is not None:
        out = out.join(
            geo.select("zone_id", "centroid_lat", "centroid_lon", "distance_to_cbd_km"),
            "zone_id", "left",
        )
    return out


def assign_treatment(panel: DataFrame, policy: Policy) -> DataFrame:
    """Binary treatment, airport flag and ring (2 core, 1 buffer, 0 control)."""
    zone = F.col("zone_id")
    core, buffer = zone.isin(list(policy.core)), zone.isin(list(policy.buffer))
    return panel.withColumns({
        "treat_binary": core.cast("int"),
        "is_airport_zone": zone.isin(list(policy.airports)).cast("int"),
        "treat_ring": F.when(core, 2).when(buffer, 1).otherwise(0),
    })


def treated_share(panel: DataFrame) -> DataFrame:
    """Share of panel cells in treated zones, in percent."""
    return panel.agg(
        F.countDistinct("treat_binary").alias("levels"),
        (F.avg("treat_binary") * 100).alias("pct_treated"),
    )


def dose_reference(panel: DataFrame, fee_col: str = "avg_cbd_fee") -> DataFrame:
    """One row: mean and sample deviation of the dose over post treated cells."""
    dose = clip_low(F.col(fee_col))
    ref = F.when((F.col("post") == 1) & (F.col("treat_binary") == 1), dose)
    return panel.agg(F.avg(ref).alias("mu"), F.stddev_samp(ref).alias("sigma"))


def assign_dose(
    panel: DataFrame, fee_col: str = "avg_cbd_fee", bins: int = 5,
    keys: Sequence[str] = ("zone_id", "date"),
) -> DataFrame:
    """Raw, standardised and quantile-binned dose.

    The reference moments come in as scalar subqueries and the bin edges as
    literals, so the panel itself is only projected. Duplicate edges merge.
    """
    ref = dose_reference(panel, fee_col)
    raw = panel.withColumn("dose_raw", clip_low(F.col(fee_col)))
    out = raw.withColumn(
        "dose_std",
        (F.col("dose_raw") - ref.select("mu").scalar())
        / (ref.select("sigma").scalar() + F.lit(1e-8)),
    )
    return out.withColumn("dose_quantile", dose_quantile(raw, bins, keys))


def dose_quantile(raw: DataFrame, bins: int, keys: Sequence[str]):
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(raw.where(F.col("dose_raw") > 0), "dose_raw", probs, keys)
    edges = list(dict.fromkeys(edges))
    if len(edges) < 2:
        return F.lit(0)
    bin_ = right_closed_bin(F.col("dose_raw"), edges)
    return F.when(F.col("dose_raw") > 0, F.coalesce(bin_, F.lit(0))).otherwise(F.lit(0))


def never_treated(panel: DataFrame) -> DataFrame:
    """Zones that no cell of the panel marks as treated."""
    return (
        panel.groupBy("zone_id").agg(F.max("treat_binary").alias("ever"))
        .where(F.col("ever") == 0).select("zone_id")
    )


def crossing_share(trips: DataFrame, policy: Policy) -> DataFrame:
    """Per pickup zone: share of trips that cross the treated boundary."""
    core = list(policy.core)
    crosses = F.col("pickup_zone").isin(core) != F.col("dropoff_zone").isin(core)
    return trips.groupBy(F.col("pickup_zone").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("trips"),
        F.avg(crosses.cast("int")).alias("treat_intensity"),
    )
