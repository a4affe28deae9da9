"""Difference-in-differences: two-way fixed effects, event study, group-time effects."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.tails import chi2_sf, student_two_sided
from ripplepanel.operators.replicates import poisson_weights, replicate_sums
from ripplepanel.operators.within import Z95, fit_two_way
from ripplepanel.policy import Policy
from ripplepanel.session import cut

DID_SCHEMA = (
    "outcome string, ate double, se double, t_stat double, p_value double, ci_low double, "
    "ci_high double, n_obs long, r_squared double, pct_change double"
)


def twfe_did(
    panel: DataFrame, outcomes: Sequence[str] = ("log_trip_count",),
    treatment: str = "treat_binary", cluster: str = "zone_id", dof: str = "cr1",
) -> DataFrame:
    """One row per outcome for y = unit + time + b * treatment * post.

    All outcomes are swept together. ``pct_change`` is exp(b) - 1 in percent,
    for log outcomes only.
    """
    spark = panel.sparkSession
    crossed = panel.withColumn("treat_post", F.col(treatment) * F.col("post"))
    rows = []
    for fit in fit_two_way(crossed, list(outcomes), ["treat_post"], cluster=cluster, dof=dof):
        s = fit.summary("treat_post")
        is_log = fit.outcome.startswith("log") and s["coef"] is not None
        rows.append((
            fit.outcome, s["coef"], s["se"], s["t_stat"], s["p_value"], s["ci_low"], s["ci_high"],
            fit.n_obs, fit.r_squared, math.expm1(s["coef"]) * 100 if is_log else None))
    return spark.createDataFrame(rows, DID_SCHEMA)


@dataclass(frozen=True)
class EventStudy:
    coefficients: DataFrame
    pretrend: DataFrame


EVENT_SCHEMA = (
    "rel_week int, coef double, se double, ci_low double, ci_high double, p_value double"
)


def event_study(
    panel: DataFrame, outcome: str = "log_trip_count", treatment: str = "treat_binary",
    window: int | None = 16, reference: int = -1,
) -> EventStudy:
    """Effect by week relative to the shock, and a joint test of the leads.

    At most 2 * window + 1 interactions exist whatever the data size; without a
    window one per week of the panel. The joint test is a Wald chi-square over
    all coefficients before the reference.
    """
    spark = panel.sparkSession
    inside = panel if window is None else panel.where(F.col("rel_week").between(-window, window))
    weeks = sorted(r[0] for r in inside.select("rel_week").distinct().collect())
    weeks = [w for w in weeks if w != reference]
    name = {w: f"w_{'m' if w < 0 else 'p'}{abs(w)}" for w in weeks}
    crossed = inside.selectExpr("zone_id", "date", outcome, *[
        f"if(rel_week = {w}, {treatment}, 0) as {name[w]}" for w in weeks])
    fit = fit_two_way(crossed, [outcome], [name[w] for w in weeks])[0]
    rows = [(reference, 0.0, 0.0, 0.0, 0.0, 1.0)]
    for w in weeks:
        s = fit.summary(name[w])
        if s["coef"] is not None:
            rows.append((w, s["coef"], s["se"], s["ci_low"], s["ci_high"], s["p_value"]))
    leads = [i for i, w in enumerate(weeks) if w < reference and not np.isnan(fit.beta[i])]
    stat = p = None
    rank = 0
    if leads:
        b, v = fit.beta[leads], fit.cov[np.ix_(leads, leads)]
        # with fewer clusters than leads the covariance is singular: test its rank only
        rank = int(np.linalg.matrix_rank(v))
        stat = float(b @ np.linalg.pinv(v) @ b)
        p = chi2_sf(stat, rank)
    pre = spark.createDataFrame(
        [("event study leads", stat, rank, p)], "test string, stat double, df int, p_value double")
    return EventStudy(spark.createDataFrame(sorted(rows), EVENT_SCHEMA), pre)


def cohort_column(policy: Policy) -> Column:
    """First treated date: the shock for treated zones, null for the others."""
    return F.when(F.col("treat_binary") == 1, policy.shock_lit())


def _with_reference(cells: DataFrame, anticipation: int, clean_pre: bool) -> DataFrame:
    """The last usable week before each cohort's start."""
    edge = F.date_add(F.col("cohort"), -7 * anticipation)
    usable = F.date_add("week", 7) <= edge if clean_pre else F.col("week") < edge
    return cells.groupBy("cohort").agg(F.max(F.when(usable, F.col("week"))).alias("ref_week"))


def group_time_att(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count", anticipation: int = 0,
    cohort: Column | None = None, clean_pre: bool = False, min_rows: int = 10,
) -> DataFrame:
    """ATT(g, t) against the never treated, with analytic standard errors.

    One aggregate to (cohort, week) cells; everything after works on cells. A
    cohort column with several dates gives a staggered design. The reference
    week itself is kept as 0 and flagged. A period with fewer than ``min_rows``
    observations keeps its row, without estimate and with status ``too_few_rows``.
    """
    tagged = panel.withColumn("cohort", cohort_column(policy) if cohort is None else cohort)
    cells = tagged.groupBy("cohort", "week").agg(
        F.avg(outcome).alias("m"), F.coalesce(F.var_samp(outcome), F.lit(0.0)).alias("v"),
        F.count(outcome).alias("n"))
    treated = cells.where(F.col("cohort").isNotNull())
    control = cells.where(F.col("cohort").isNull()).drop("cohort")
    refs = _with_reference(treated, anticipation, clean_pre)

    def renamed(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumnsRenamed({"m": f"m_{tag}", "v": f"v_{tag}", "n": f"n_{tag}"})

    base_t = renamed(treated, "tr").withColumnRenamed("week", "ref_week")
    base_c = renamed(control, "cr").withColumnRenamed("week", "ref_week")
    joined = (
        renamed(treated, "t").join(refs, "cohort")
        .join(renamed(control, "c"), "week")
        .join(base_t, ["cohort", "ref_week"]).join(base_c, "ref_week"))
    is_ref = F.col("week") == F.col("ref_week")
    size = F.when(is_ref, F.col("n_t") + F.col("n_c")).otherwise(
        F.col("n_t") + F.col("n_c") + F.col("n_tr") + F.col("n_cr"))
    att = (F.col("m_t") - F.col("m_tr")) - (F.col("m_c") - F.col("m_cr"))
    spread = F.sqrt(sum((F.col(f"v_{k}") / F.col(f"n_{k}") for k in ("t", "tr", "c", "cr")),
                        F.lit(0.0)))
    enough = size >= min_rows
    return joined.select(
        F.col("cohort"), F.col("week").alias("period"),
        policy_rel(F.col("week"), F.col("cohort")).alias("rel_week"),
        F.when(enough, F.when(is_ref, F.lit(0.0)).otherwise(att)).alias("att"),
        F.when(enough, F.when(is_ref, F.lit(0.0)).otherwise(spread)).alias("se"),
        (F.col("week") < F.col("cohort")).alias("is_pre"), is_ref.alias("is_ref"),
        F.when(enough, "ok").otherwise("too_few_rows").alias("status"),
    ).withColumns({
        "ci_low": F.col("att") - Z95 * F.col("se"), "ci_high": F.col("att") + Z95 * F.col("se")})


def policy_rel(week: Column, start: Column) -> Column:
    return F.floor(F.datediff(week, start) / F.lit(7)).cast("int")


def group_time_bootstrap(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count", reps: int = 199,
    seed: int = 42, anticipation: int = 0,
) -> DataFrame:
    """Standard errors of ATT(t) from a zone bootstrap with Poisson(1) weights.

    A zone has one array with its weights in all replicates, from a hash of
    (zone, replicate, seed), so any engine draws the same numbers. Tasks multiply
    arrays by zone-week sums; no row is copied per replicate.
    """
    tagged = panel.withColumn("cohort", cohort_column(policy))
    ref = _with_reference(
        tagged.where(F.col("cohort").isNotNull()).select("cohort", "week").distinct(),
        anticipation, False).agg(F.max("ref_week")).scalar()
    zone_week = tagged.groupBy("zone_id", "treat_binary", "week").agg(
        F.sum(outcome).alias("s"), F.count(outcome).alias("n"))
    weights = cut(zone_week.select("zone_id").distinct().withColumn(
        "w", poisson_weights(["zone_id"], reps, seed, whole=False)), "weights")
    sums = replicate_sums(
        zone_week.join(weights, "zone_id"), F.col("w"), [F.col("s"), F.col("n")], ["treat_binary", "week"])
    mean = F.try_divide(F.col("s")[0], F.col("s")[1])
    gaps = sums.groupBy("rep", "week").agg(
        (F.max(F.when(F.col("treat_binary") == 1, mean)) - F.max(F.when(F.col("treat_binary") == 0, mean))).alias("gap"))
    gaps = cut(gaps, "gaps")
    # the reference row of each replicate joins back on rep: reps rows in all
    base = gaps.where(F.col("week") == ref).select("rep", F.col("gap").alias("gap_ref"))
    return gaps.join(base, "rep").groupBy(F.col("week").alias("period")).agg(
        F.stddev_samp(F.col("gap") - F.col("gap_ref")).alias("se_boot"),
        F.count(F.col("gap") - F.col("gap_ref")).alias("n_reps"))


def aggregate_att(att: DataFrame) -> DataFrame:
    """Simple mean of the effects after the start."""
    return att.agg(
        F.avg(F.when(~F.col("is_pre"), F.col("att"))).alias("agg_att"),
        F.count_if(~F.col("is_pre") & F.col("att").isNotNull()).alias("n_post"))


def att_pretrend(att: DataFrame) -> DataFrame:
    """One-sample t-test of the lead t-ratios against 0, reference week left out."""
    ratio = F.col("att") / (F.col("se") + F.lit(1e-8))
    row = att.where(F.col("is_pre") & ~F.col("is_ref")).agg(
        F.avg(ratio).alias("m"), F.stddev_samp(ratio).alias("s"), F.count(ratio).alias("n")).first()
    stat = p = None
    if row["n"] and row["n"] > 1 and row["s"]:
        stat = row["m"] / (row["s"] / math.sqrt(row["n"]))
        p = student_two_sided(stat, row["n"] - 1)
    return att.sparkSession.createDataFrame(
        [("group-time leads", stat, max(int(row["n"]) - 1, 0), p)],
        "test string, stat double, df int, p_value double")
