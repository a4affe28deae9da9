"""Robustness checks: one table of specifications, one batched regression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import stars
from ripplepanel.operators.within import fit_two_way
from ripplepanel.policy import Policy

CHECK_SCHEMA = (
    "check string, group string, theta double, se double, p double, n_obs long, note string, "
    "status string"
)


@dataclass(frozen=True)
class Spec:
    """One re-estimation: the rows it keeps and the start date it pretends."""

    check: str
    group: str
    keep: Column
    start: date
    min_rows: int = 0
    note: str = ""


def _weeks(day: date, n: int) -> date:
    return day + timedelta(weeks=n)


def placebo_dates(policy: Policy, shifts: Sequence[int] = (-8, -4, 4, 8)) -> list[Spec]:
    """False shock dates on data from before the shock, 8 weeks either side."""
    day, out = F.col("date"), []
    for k in shifts:
        fake = _weeks(policy.shock, k)
        keep = (day < policy.shock_lit()) & day.between(
            F.lit(_weeks(fake, -8)), F.lit(_weeks(fake, 8)))
        out.append(Spec(f"Placebo shift {k:+d}w", "Placebo Date", keep, fake, 100,
                        "Should be near 0"))
    return out


def anticipation(policy: Policy, drop_weeks: int = 4) -> list[Spec]:
    """Leave out the first weeks after the shock; leave out the announced period."""
    day, shock = F.col("date"), policy.shock
    late = day >= F.lit(_weeks(shock, drop_weeks))
    out = [Spec(f"Drop first {drop_weeks}w post", "Anticipation",
                (day < policy.shock_lit()) | late, shock)]
    if policy.announcement:
        out.append(Spec("Drop announcement to shock", "Anticipation",
                        (day < F.lit(policy.announcement)) | (day >= policy.shock_lit()), shock))
    return out


def control_groups(policy: Policy) -> list[Spec]:
    treated = F.col("treat_binary") == 1
    # null-safe: a row without a borough is not in the home borough
    home = F.col("borough").eqNullSafe(policy.home_borough)
    group = "Control Sensitivity"
    return [
        Spec("Exclude buffer zones", group, F.col("treat_ring") != 1, policy.shock, 100),
        Spec("Home-borough control only", group, treated | home, policy.shock, 100),
        Spec("Outer-borough control only", group, treated | ~home, policy.shock, 100),
    ]


def bandwidths(policy: Policy, weeks: Sequence[int] = (4, 8, 12, 16, 26)) -> list[Spec]:
    return [
        Spec(f"±{k}w window", "Bandwidth", F.col("date").between(
            F.lit(_weeks(policy.shock, -k)), F.lit(_weeks(policy.shock, k))), policy.shock, 100)
        for k in weeks
    ]


def leave_one_borough(panel: DataFrame, policy: Policy) -> list[Spec]:
    """Each borough but the home one left out in turn; rows without one stay."""
    names = [r[0] for r in panel.where(F.col("borough").isNotNull()).select(
        "borough").distinct().collect()]
    return [
        Spec(f"Drop {b}", "Leave-One-Borough", ~F.col("borough").eqNullSafe(b), policy.shock)
        for b in sorted(names) if b != policy.home_borough
    ]


def run_specs(
    panel: DataFrame, specs: Sequence[Spec], outcome: str = "log_trip_count",
    treatment: str = "treat_binary",
) -> DataFrame:
    """All specifications in one set of sweeps; every spec keeps a row.

    A row of the panel repeats once per spec that keeps it, which makes the
    spec a batch key. A spec short of rows, or whose regressor vanishes, is
    reported by its status.
    """
    spark = panel.sparkSession
    held = F.array([
        F.when(s.keep, F.struct(F.lit(i).alias("spec"), (
            F.col("date") >= F.lit(s.start)).cast("int").alias("post")))
        for i, s in enumerate(specs)])
    spread = panel.select(
        "zone_id", "date", outcome, F.col(treatment).alias("_t"),
        F.explode(F.filter(held, lambda x: x.isNotNull())).alias("_s"),
    ).select("zone_id", "date", outcome, "_s.spec",
             (F.col("_t") * F.col("_s.post")).alias("treat_post"))
    sizes = dict(spread.groupBy("spec").count().collect())
    enough = [i for i, s in enumerate(specs) if sizes.get(i, 0) >= max(s.min_rows, 1)]
    fits = {}
    if enough:
        fits = {f.key[0]: f for f in fit_two_way(
            spread.where(F.col("spec").isin(enough)), [outcome], ["treat_post"], by=["spec"])}
    rows = []
    for i, s in enumerate(specs):
        n = int(sizes.get(i, 0))
        if i not in fits:
            rows.append((s.check, s.group, None, None, None, n, s.note, "too_few_rows"))
            continue
        r = fits[i].summary("treat_post")
        status = "ok" if r["coef"] is not None else "not_identified"
        rows.append((s.check, s.group, r["coef"], r["se"], r["p_value"], n, s.note, status))
    return spark.createDataFrame(rows, CHECK_SCHEMA)


def alternative_outcomes(
    panel: DataFrame, outcomes: Sequence[str] = ("log_trip_count", "trip_count")
) -> DataFrame:
    """The main regression on the log and on the level, swept together."""
    crossed = panel.withColumn("treat_post", F.col("treat_binary") * F.col("post"))
    rows = []
    for fit in fit_two_way(crossed, list(outcomes), ["treat_post"]):
        r = fit.summary("treat_post")
        rows.append((f"Outcome {fit.outcome}", "Alternative Outcome", r["coef"], r["se"],
                     r["p_value"], fit.n_obs, "", "ok"))
    return panel.sparkSession.createDataFrame(rows, CHECK_SCHEMA)


def all_specs(panel: DataFrame, policy: Policy) -> list[Spec]:
    return [
        *placebo_dates(policy), *anticipation(policy), *control_groups(policy),
        *bandwidths(policy), *leave_one_borough(panel, policy),
    ]


def run_all(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count",
    more: Sequence[DataFrame] = (),
) -> DataFrame:
    """One table of every check; ``more`` adds rows of the same contract."""
    table = run_specs(panel, all_specs(panel, policy), outcome)
    for extra in more:
        table = table.unionByName(extra, allowMissingColumns=True)
    return table.withColumn("sig", stars(F.col("p")))
