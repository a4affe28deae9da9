"""The whole ladder of estimators on one panel, saved as named result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ripplepanel.operators import cate, did, dml, dose, features, robustness, synth
from ripplepanel.plans import reports
from ripplepanel.policy import Policy
from ripplepanel.sources.results import load_result, save_result

# The outcomes each step runs on.
OUTCOMES = ("log_trip_count", "trip_count", "avg_distance", "avg_duration", "avg_fare",
            "airport_share", "cbd_fee_total", "surge_share")


def measure(
    panel: DataFrame, policy: Policy, root: str, covariates: Sequence[str],
    outcome: str = "log_trip_count", window: int = 16, placebo_reps: int = 200,
    learner: str = "random_forest", trees: int | None = None, heterogeneity: str = "residual",
) -> dict[str, DataFrame]:
    """Run every estimator on an enriched panel and save what it finds.

    Each result is written below ``root`` under its name and returned as read
    back, so later steps and readers share one copy.
    """
    spark = panel.sparkSession
    saved: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        save_result(df, name, root)
        saved[name] = load_result(spark, name, root)
        return saved[name]

    present = [o for o in OUTCOMES if o in panel.columns]
    main = keep("twfe", did.twfe_did(panel, present))
    study = did.event_study(panel, outcome, window=window)
    keep("event_study", study.coefficients)
    lead = keep("event_study_leads", study.pretrend)
    att = keep("group_time_att", did.group_time_att(panel, policy, outcome))
    pooled = keep("group_time_mean", did.aggregate_att(att))
    test = keep("group_time_leads", did.att_pretrend(att))
    response = dose.continuous_did(panel, policy, outcome)
    keep("dose_coefficients", response.coefficients())
    keep("dose_curve", response.curve())
    keep("dose_bins", dose.dose_bin_did(panel, policy, outcome))
    placebo = keep("sdid", synth.sdid(panel, policy, outcome, reps=placebo_reps))
    featured = keep("features", features.add_features(panel, policy))
    effects = keep("dml", dml.dml_effects(
        featured, covariates, [o for o in present if o != "cbd_fee_total"], learner=learner,
        trees=trees))
    found = cate.causal_forest(featured, covariates, heterogeneity, outcome=outcome)
    rows = keep("cate", found.rows)
    keep("zone_cate", cate.zone_cate(rows))
    if found.importance is not None:
        keep("feature_importance", found.importance)
    keep("targeting_curve", cate.targeting_curve(rows))
    flagged = cate.add_peak_flag(panel)
    groups = {g: keep(f"cate_by_{g}", cate.cate_by_group(rows, flagged, g))
              for g in ("borough", "weekend_flag", "is_peak") if g in flagged.columns}
    checks = keep("robustness", robustness.run_all(
        panel, policy, outcome, [robustness.alternative_outcomes(panel),
                                 dml.learner_checks(featured, covariates, outcome, trees=trees)]))
    keep("table_estimators", reports.estimator_table(main, pooled, test, placebo, effects, outcome))
    keep("table_dml", reports.dml_table(effects))
    keep("table_robustness", reports.robustness_table(
        checks, main.where(main.outcome == outcome)))
    keep("table_leads", reports.pretrend_table(lead, test))
    if "borough" in groups:
        keep("table_cate", reports.cate_table(groups["borough"], groups.get("is_peak")))
    return saved
