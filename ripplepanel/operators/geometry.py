"""Zone centroids and distances from a vertices table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.functions.columns import haversine_km
from ripplepanel.policy import Policy


def polygon_centroids(vertices: DataFrame) -> DataFrame:
    """Area-weighted centroid per zone by the shoelace sums.

    Vertices pair up inside one ring (a ring is one polygon's outline), sums
    combine before the shuffle on zone. Ring 0 adds area, other rings are holes
    and subtract it, whatever direction they are drawn in. Coordinates are
    taken relative to the ring's first vertex to keep the sums accurate.
    """
    ring = Window.partitionBy("zone_id", "part", "ring")
    along = ring.orderBy("seq")
    origin = {
        "_lon0": F.first("lon").over(along),
        "_lat0": F.first("lat").over(along),
    }
    shifted = vertices.withColumns(origin).withColumns({
        "_x": F.col("lon") - F.col("_lon0"), "_y": F.col("lat") - F.col("_lat0"),
    })
    paired = shifted.withColumns({
        "_xn": F.coalesce(F.lead("_x").over(along), F.lit(0.0)),
        "_yn": F.coalesce(F.lead("_y").over(along), F.lit(0.0)),
    })
    cross = F.col("_x") * F.col("_yn") - F.col("_xn") * F.col("_y")
    rings = paired.groupBy("zone_id", "part", "ring").agg(
        F.sum(cross).alias("_a2"),
        F.sum((F.col("_x") + F.col("_xn")) * cross).alias("_mx"),
        F.sum((F.col("_y") + F.col("_yn")) * cross).alias("_my"),
        F.min("_lon0").alias("_lon0"), F.min("_lat0").alias("_lat0"),
    )
    flip = F.signum("_a2") * F.when(F.col("ring") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    area = F.abs("_a2") * F.when(F.col("ring") == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return rings.groupBy("zone_id").agg(
        (F.sum(flip * F.col("_my") / 3 + F.col("_lat0") * area) / F.sum(area)).alias("centroid_lat"),
        (F.sum(flip * F.col("_mx") / 3 + F.col("_lon0") * area) / F.sum(area)).alias("centroid_lon"),
    )


def add_center_distance(zones: DataFrame, policy: Policy) -> DataFrame:
    """Kilometres from each centroid to the policy's centre."""
    return zones.withColumn(
        "distance_to_cbd_km",
        haversine_km(
            F.col("centroid_lat"), F.col("centroid_lon"),
            F.lit(policy.center_lat), F.lit(policy.center_lon),
        ),
    )
