"""Unit x time panels from event-grain rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.ranking import running_sums
from ripplepanel.policy import Policy
from ripplepanel.session import cut

UNITS = ("hour", "day", "week", "month")


def period_start(c: Column, unit: str) -> Column:
    """Start of the period holding ``c``: a timestamp for hours, else a date."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    start = F.date_trunc(unit, c)
    return start.cast("timestamp_ntz") if unit == "hour" else start.cast("date")


def aggregate_cells(
    rows: DataFrame, unit: str, zone_col: str, time_col: str, means: dict[str, str],
    sums: dict[str, str], maxima: dict[str, str], kind_col: str | None,
) -> DataFrame:
    """One row per (zone_id, date) cell with counts, means, sums and maxima.

    For any kind column; trips of known feeds go through ``cells_of``. Two-level:
    the event rows collapse to (zone, period, kind) by a
    hash aggregate over fixed-width buffers, combined before the shuffle, so a
    zone with a third of all events costs one row per task. Picking the
    commonest kind (smallest name on ties) happens on those few rows.
    """
    keys = [F.col(zone_col).alias("zone_id"), period_start(F.col(time_col), unit).alias("date")]
    kind = F.col(kind_col) if kind_col else F.lit(None).cast("string")
    base = rows.select(
        *keys, kind.alias("_kind"),
        *[F.col(c) for c in dict.fromkeys([*means.values(), *sums.values(), *maxima.values()])],
    )
    first = base.groupBy("zone_id", "date", "_kind").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(src).cast("double").alias(f"_s_{out}") for out, src in means.items()],
        *[F.count(src).alias(f"_c_{out}") for out, src in means.items()],
        *[F.sum(src).alias(out) for out, src in sums.items()],
        *[F.max(src).alias(out) for out, src in maxima.items()],
    )
    commonest = F.min_by("_kind", F.struct(-F.col("_n"), F.col("_kind")))
    out = [F.sum("_n").alias("trip_count")]
    out += [(F.sum(f"_s_{o}") / F.sum(f"_c_{o}")).alias(o) for o in means]
    out += [F.sum(o).alias(o) for o in sums] + [F.max(o).alias(o) for o in maxima]
    if kind_col:
        out.append(commonest.alias("trip_type_agg"))
    return first.groupBy("zone_id", "date").agg(*out)


# output -> trip column it averages, sums or takes the maximum of
MEANS = {
    "avg_distance": "trip_distance", "avg_duration": "trip_duration_min", "avg_fare": "fare_amount",
    "avg_cbd_fee": "cbd_congestion_fee", "airport_share": "is_airport_trip", "peak_share": "is_peak",
}
SUMS = {"surcharge_sum": "surcharge_total", "cbd_fee_total": "cbd_congestion_fee"}
MAXIMA = {"weekend_flag": "is_weekend"}
#: Feeds that are counted one by one; trips of any other are counted together.
KINDS = ("fhvhv", "green", "yellow")
OTHER = "other"


def _parts() -> dict[str, Column]:
    """What a cell holds of its trips: counts per feed, sums and counts of what is averaged, sums, maxima.

    All of fixed width and all mergeable, so cells add up to cells of longer periods.
    """
    kind = F.col("trip_type")
    known = kind.isin(list(KINDS))
    out = {"trip_count": F.count(F.lit(1))}
    out |= {f"_n_{k}": F.count_if(kind == k) for k in KINDS}
    out[f"_n_{OTHER}"] = F.count_if(F.coalesce(~known, F.lit(False)))
    out |= {f"_s_{o}": F.sum(c) for o, c in MEANS.items()} | {f"_c_{o}": F.count(c) for o, c in MEANS.items()}
    out |= {o: F.sum(c) for o, c in SUMS.items()} | {o: F.max(c) for o, c in MAXIMA.items()}
    return out


def cells_of(
    trips: DataFrame, unit: str, zone_col: str = "pickup_zone", time_col: str | None = None
) -> DataFrame:
    """One row per (zone_id, date) with everything a panel needs, in one exchange.

    Trips collapse by a hash aggregate over fixed-width buffers, combined before
    the shuffle: a zone with a third of all trips costs one row per task.
    """
    time_col = time_col or ("pickup_datetime" if unit == "hour" else "pickup_date")
    return trips.groupBy(
        F.col(zone_col).alias("zone_id"), period_start(F.col(time_col), unit).alias("date")
    ).agg(*[c.alias(o) for o, c in _parts().items()])


def roll_up(cells: DataFrame, unit: str) -> DataFrame:
    """Cells of days as cells of weeks or months; trips are not read again."""
    merged = [F.max(o).alias(o) if o in MAXIMA else F.sum(o).alias(o) for o in _parts()]
    return cells.groupBy("zone_id", period_start(F.col("date"), unit).alias("date")).agg(*merged)


def finish_cells(cells: DataFrame) -> DataFrame:
    """Means, and the commonest feed of a cell (the smallest name on ties), from its counts and sums."""
    counts = {k: F.col(f"_n_{k}") for k in sorted((*KINDS, OTHER))}
    most = F.greatest(*counts.values())
    commonest = F.lit(None).cast("string")
    for k in sorted(counts, reverse=True):
        commonest = F.when((counts[k] == most) & (most > 0), F.lit(k)).otherwise(commonest)
    return cells.select(
        "zone_id", "date", "trip_count",
        *[F.try_divide(F.col(f"_s_{o}").cast("double"), F.col(f"_c_{o}")).alias(o) for o in MEANS],
        *SUMS, *MAXIMA, commonest.alias("trip_type_agg"))


def build_panel(
    trips: DataFrame, policy: Policy, unit: str = "day", min_trips: int = 5,
    trip_types: Sequence[str] | None = None, surge_level: float | None = None,
) -> DataFrame:
    """Clean trips to a zone x period panel with outcome and time columns.

    With ``surge_level`` it gets the column ``surge_share`` of that quantile.
    For several periods make ``cells_of(trips, "day")`` once and take
    ``panel_from_cells`` of its ``roll_up``.
    """
    if trip_types is not None:
        trips = trips.where(F.col("trip_type").isin(list(trip_types)))
    panel = panel_from_cells(cells_of(trips, unit), policy, min_trips)
    if surge_level is not None:
        panel = panel.join(surge_share(trips, policy, unit, surge_level), ["zone_id", "date"], "left")
    return panel


def panel_from_cells(cells: DataFrame, policy: Policy, min_trips: int = 5) -> DataFrame:
    dense = drop_sparse(finish_cells(cells), min_trips)
    return add_time_columns(dense.withColumn("log_trip_count", F.log1p("trip_count")), policy)


def drop_sparse(cells: DataFrame, min_trips: int) -> DataFrame:
    return cells.where(F.col("trip_count") >= min_trips)


def add_time_columns(panel: DataFrame, policy: Policy) -> DataFrame:
    """Week start (Monday), week relative to the shock, post flag, month label."""
    day = F.col("date").cast("date")
    week = F.date_trunc("week", day).cast("date")
    return panel.withColumns({
        "week": week,
        "rel_week": policy.rel_week(week),
        "post": policy.is_post(day).cast("int"),
        "year_month": F.date_format(day, "yyyy-MM"),
    })


#: Cents in a coarse price bucket.
COARSE = 100


def surge_share(
    trips: DataFrame, policy: Policy, unit: str = "day", level: float = 0.9
) -> DataFrame:
    """Share of trips per cell whose fare per mile tops the zone's usual level.

    The level is the zone's discrete quantile before the shock, in whole cents.
    Trips collapse to one count per zone, cell and cent, and all else reads that
    table: counts per dollar find the dollar that holds the level (running sums
    over range partitions, so a zone may spread over tasks), and only the cents
    of that dollar, ``COARSE`` rows per zone at most, are looked at one by one.
    A zone without trips before the shock has no level and a null share.
    """
    cents = F.floor(F.col("fare_amount") / F.col("trip_distance") * 100 + 0.5)
    cells = cut(trips.select(
        F.col("pickup_zone").alias("zone_id"), period_start(F.col("pickup_date"), unit).alias("date"),
        cents.alias("_cents"), (F.col("pickup_date") < policy.shock_lit()).alias("_before"),
    ).groupBy("zone_id", "date", "_cents", "_before").agg(F.count(F.lit(1)).alias("_n")), "priced")
    before = cells.where("_before").withColumn("_coarse", F.floor(F.col("_cents") / COARSE))
    total = before.groupBy("zone_id").agg((F.sum("_n") * F.lit(level)).alias("_want"))
    coarse = before.groupBy("zone_id", "_coarse").agg(F.sum("_n").alias("_n"))
    reached = running_sums(coarse, ["zone_id"], ["_coarse"], ["_n"]).join(total, "zone_id").where(
        F.col("_n_upto") >= F.col("_want"))
    dollar = reached.groupBy("zone_id", "_want").agg(
        F.min(F.struct("_coarse", (F.col("_n_upto") - F.col("_n")).alias("_below"))).alias("_at")).select(
        "zone_id", "_want", "_at.*")
    fine = before.join(dollar, ["zone_id", "_coarse"]).groupBy("zone_id", "_want", "_below", "_cents").agg(
        F.sum("_n").alias("_n"))
    steps = F.array_sort(F.collect_list(F.struct("_cents", "_n")))
    upto = F.transform(steps, lambda x, i: F.struct(x["_cents"].alias("c"), F.aggregate(
        F.slice(steps, 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["_n"]).alias("n")))
    limit = fine.groupBy("zone_id", "_want", "_below").agg(upto.alias("_upto")).select(
        "zone_id", F.filter("_upto", lambda x: F.col("_below") + x["n"] >= F.col("_want"))[0]["c"].alias("_limit"))
    above = F.when(F.col("_cents") > F.col("_limit"), F.col("_n")).otherwise(0)
    return cells.join(limit, "zone_id", "left").groupBy("zone_id", "date").agg(
        F.when(F.max("_limit").isNotNull(), F.sum(above) / F.sum("_n")).alias("surge_share"))
