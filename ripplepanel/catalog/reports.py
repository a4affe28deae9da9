"""Result tables and figure data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog import effects as fx
from ripplepanel.catalog import learned as ml
from ripplepanel.catalog import weights as sd
from ripplepanel.catalog.panels import histogram_sql
from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.regression_sql import one_regressor, sweeps
from ripplepanel.catalog.sqltext import (
    MONTH, WEEK1, compose, fixed, normal_p, real, stars, whole,
)
from ripplepanel.operators import cate, did, dose, panel, synth
from ripplepanel.plans import binding, figures, ladder, reports
from ripplepanel.sources import results

_MAIN = {
    **sweeps("(SELECT *, treat_binary*post AS treat_post FROM panel_week_1)",
             ["log_trip_count", "treat_post"], rounds=25, tag="m_"),
    **one_regressor(["log_trip_count"], "treat_post", tag="m_"),
    "main": "SELECT coef AS ate, se, p_value AS p, n FROM m_fits",
}


def main_fit(ctx: Context) -> DataFrame:
    return ctx.shared("twfe_weeks", lambda: did.twfe_did(ctx.weeks()))


def _estimates(ctx: Context, sdid: DataFrame) -> DataFrame:
    att = did.group_time_att(ctx.weeks(), ctx.policy)
    return reports.estimator_table(
        main_fit(ctx), did.aggregate_att(att), did.att_pretrend(att), sdid, ml.dml_table(ctx))


def signed_pct(x: str) -> str:
    return f"coalesce(printf('%+.1f%%', floor((exp({x})-1)*1000+0.5+1e-6)/10.0::DOUBLE), '—')"


def _stack(*groups: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for g in groups:
        for k, v in g.items():
            if k in out and out[k] != v:
                raise ValueError(f"two bodies for {k}")
            out[k] = v
    return out


# the attachment CTEs call their cells "cells" too: rename the group-time ones
_ATT = {**fx.STUDENT, **{
    ("att_cells" if k == "cells" else k): v.replace("FROM cells", "FROM att_cells").replace(
        "JOIN cells", "JOIN att_cells") for k, v in fx.att_ctes(fx.SINGLE).items()}}
_LEAD_TEST = """SELECT avg(z)/(stddev_samp(z)/sqrt(count(z))) AS stat, count(z)-1 AS df
  FROM (SELECT att/(se+1e-8) AS z FROM att WHERE is_pre AND NOT is_ref)"""


@query("T1_estimator_comparison")
def comparison(ctx: Context) -> DataFrame:
    return _estimates(ctx, ctx.shared(
        "sdid", lambda: synth.sdid(ctx.weeks(), ctx.policy, reps=sd.REPS)))


@query("T1_estimator_comparison_uniform", compose(f"""
  SELECT estimator, {real('att')}, {real('se')}, {real('ci_low')}, {real('ci_high')},
    {whole('n_obs')}, {real('p_value')}, {real('pretrend_p')}, note,
    {fixed('att')} || {stars('p_value')} AS att_display, {signed_pct('att')} AS pct_change
  FROM (
    SELECT 'TWFE DiD' AS estimator, ate AS att, se, ate-1.96*se AS ci_low, ate+1.96*se AS ci_high,
      n AS n_obs, p AS p_value, NULL::DOUBLE AS pretrend_p, 'Two-way fixed effects' AS note FROM main
    UNION ALL BY NAME
    SELECT 'Group-time DiD' AS estimator, (SELECT avg(att) FROM att WHERE NOT is_pre) AS att,
      {fx.student_p('stat', 'df')} AS pretrend_p, 'Mean of post effects' AS note FROM ({_LEAD_TEST})
    UNION ALL BY NAME
    SELECT 'Synthetic DiD' AS estimator, t AS att, s AS se, t-1.96*s AS ci_low, t+1.96*s AS ci_high,
      'Placebo standard error' AS note
    FROM (SELECT max(tau) FILTER (rep=0) AS t, stddev_samp(tau) FILTER (rep>0) AS s FROM tau)
    UNION ALL BY NAME
    SELECT 'Double ML' AS estimator, theta AS att, se, theta-1.96*se AS ci_low,
      theta+1.96*se AS ci_high, n_obs, p_value, 'Cross-fitted nuisances' AS note
    FROM eff WHERE outcome = 'log_trip_count')""",
    "panel_week_1", MONTH, extra=_stack(_MAIN, _ATT, sd._UNIFORM, ml.dml_ctes(outcomes=ml.DML_OUTCOMES))))
def comparison_uniform(ctx: Context) -> DataFrame:
    return _estimates(ctx, synth.sdid(ctx.weeks(), ctx.policy, reps=sd.REPS, uniform=True))


@query("T2_dml_table", compose(f"""
  SELECT outcome, {fixed('theta')} || {stars('p_value')} AS theta_text,
    '(' || {fixed('se')} || ')' AS se_text,
    '[' || {fixed('theta-1.96*se')} || ', ' || {fixed('theta+1.96*se')} || ']' AS ci_text,
    {whole('n_obs')}, {stars('p_value')} AS sig FROM eff""", MONTH, extra=ml.dml_ctes(outcomes=ml.DML_OUTCOMES)))
def dml_table(ctx: Context) -> DataFrame:
    return reports.dml_table(ml.dml_table(ctx))


_GROUPS = f"""
  SELECT 'Borough' AS dimension, borough AS level, mean_cate, std_cate, n, se_cate
  FROM ({ml.group_sql('borough', 'borough')})
  UNION ALL
  SELECT 'Time of Day', (is_peak)::VARCHAR, mean_cate, std_cate, n, se_cate
  FROM ({ml.group_sql('(peak_share >= 0.5)::INTEGER', 'is_peak')})"""


@query("T3_cate_groups", compose(f"""
  SELECT dimension, level, {ml.GROUP_COLUMNS}, {stars('p')} AS sig,
    {fixed('mean_cate')} || {stars('p')} AS cate_text
  FROM (SELECT *, {normal_p('mean_cate/(se_cate+1e-8)')} AS p FROM ({_GROUPS}))""",
    MONTH, extra=ml.CATE))
def cate_table(ctx: Context) -> DataFrame:
    rows = ml.cate_rows(ctx)
    return reports.cate_table(
        cate.cate_by_group(rows, ctx.panel(), "borough"),
        cate.cate_by_group(rows, cate.add_peak_flag(ctx.panel()), "is_peak"))


_CHECKS = {**_MAIN, **fx.CHECK_CTES}


@query("T4_robustness_table", compose(f"""
  SELECT "group", "check", {fixed('theta')} || {stars('c.p')} AS theta_text,
    CASE WHEN c.se IS NULL THEN '—' ELSE '(' || {fixed('c.se')} || ')' END AS se_text,
    {real('theta-ate', 'vs_main')}, status FROM all_rows c, main""", "panel_week_1", MONTH, extra=_CHECKS))
def robustness_table(ctx: Context) -> DataFrame:
    return reports.robustness_table(fx.robustness_table(ctx), main_fit(ctx))


@query("T5_pretrend_tests", compose(f"""
  SELECT test, {real('stat')}, {whole('df')}, {real('p', 'p_value')},
    CASE WHEN p > 0.05 THEN 'holds' ELSE 'may be violated' END AS verdict
  FROM (SELECT 'event study leads' AS test, stat, 3 AS df, {fx.WALD_P} AS p FROM wald
        UNION ALL
        SELECT 'group-time leads', stat, df, {fx.student_p('stat', 'df')} FROM ({_LEAD_TEST}))""",
    MONTH, "panel_week_1", extra=_stack(fx.WALD, _ATT)))
def pretrends(ctx: Context) -> DataFrame:
    return reports.pretrend_table(
        did.event_study(ctx.panel()).pretrend,
        did.att_pretrend(did.group_time_att(ctx.weeks(), ctx.policy)))


@query("T6_executive_summary", compose(f"""
  SELECT metric, {real('value')}, text FROM (
    SELECT 'DiD effect' AS metric, ate AS value, {stars('p')} AS text FROM main
    UNION ALL SELECT 'DiD percent change', (exp(ate)-1)*100, {signed_pct('ate')} FROM main
    UNION ALL SELECT 'DiD standard error', se, '' FROM main
    UNION ALL SELECT 'DiD p-value', p, '' FROM main
    UNION ALL SELECT 'DML effect ' || outcome, theta, {stars('p_value')} FROM eff
    UNION ALL SELECT 'Mean CATE', avg(cate), '' FROM cate
    UNION ALL SELECT 'Std CATE', stddev_pop(cate), '' FROM cate
    UNION ALL (SELECT 'Top driver', c, f FROM (
      SELECT 'lag1_trip_count' AS f, b1_cate AS c FROM proj
      UNION ALL SELECT 'peak_share', b2_cate FROM proj) ORDER BY abs(c) DESC LIMIT 1))""",
    "panel_week_1", MONTH, extra={
        **_MAIN, **ml.dml_ctes(outcomes=ml.DML_OUTCOMES),
        **{("c_" + k if k == "planes" else k): v.replace("planes", "c_planes")
           for k, v in ml.CATE.items()},
        "proj": f"SELECT {ml.plane('cate')} FROM cate"}))
def executive(ctx: Context) -> DataFrame:
    return reports.executive_summary(
        main_fit(ctx), ml.dml_table(ctx), cate.cate_summary(ml.cate_rows(ctx)),
        cate.best_linear_projection(ml.linear_cate(ctx)).select("feature", "coefficient"))


@query("T7_significant_share", compose(f"""
  SELECT {real('avg((coalesce(p, 1) < 0.05)::INTEGER)*100', 'pct_significant')},
    {whole('count(*)', 'checks')} FROM all_rows""", WEEK1, MONTH, extra=fx.CHECK_CTES))
def share(ctx: Context) -> DataFrame:
    return reports.significant_share(fx.robustness_table(ctx))


@query("V1_event_series", compose(f"""
  SELECT {whole('rel_week')}, {real('c', 'coef')}, {real('c-1.96*se', 'ci_low')},
    {real('c+1.96*se', 'ci_high')}, CASE WHEN rel_week < 0 THEN 'pre' ELSE 'post' END AS phase,
    {whole(f'(SELECT {fx.WALD_P} > 0.05 FROM wald)::INTEGER', 'pretrend_holds')}
  FROM (SELECT rel_week, c, se FROM coef JOIN (
          SELECT rel_week, sqrt(sum(f*f)*any_value(g)/(any_value(g)-1)) AS se FROM inf, units
          GROUP BY 1) USING (rel_week)
        UNION ALL SELECT -1, 0.0, 0.0)
  WHERE rel_week BETWEEN -12 AND 12""", MONTH, extra=fx.WALD))
def event_series(ctx: Context) -> DataFrame:
    study = did.event_study(ctx.panel())
    return figures.event_series(study.coefficients, study.pretrend, (-12, 12))


@query("V1_att_series", compose(f"""
  SELECT {whole('rel_week')}, {real('att')}, {real('ci_low')}, {real('ci_high')},
    CASE WHEN is_pre THEN 'pre' ELSE 'post' END AS phase FROM att""",
    "panel_week_1", extra=fx.att_ctes(fx.SINGLE)))
def att_series(ctx: Context) -> DataFrame:
    return figures.att_series(did.group_time_att(ctx.weeks(), ctx.policy))


@query("V2_dose_bars", compose(f"""
  SELECT {whole('bin')}, {real('mean_dose')}, {real('coef', 'att')},
    {real('coef-1.96*se', 'low')}, {real('coef+1.96*se', 'high')}
  FROM fits JOIN (SELECT bin, avg(zone_dose) AS mean_dose FROM binned WHERE treat_binary = 1
                  GROUP BY 1) USING (bin)""", fx.WEEK, extra=fx.BIN_CTES))
def dose_bars(ctx: Context) -> DataFrame:
    return figures.dose_bars(dose.dose_bin_did(ctx.panel("week", 5), ctx.policy))


@query("V2_dose_curve", fx.CURVE)
def dose_curve(ctx: Context) -> DataFrame:
    return dose.continuous_did(ctx.panel("week", 5), ctx.policy).curve()


@query("V3_effect_bars", compose(f"""
  SELECT outcome, {real('theta')}, {real('theta-1.96*se', 'low')}, {real('theta+1.96*se', 'high')},
    {whole('(p_value < 0.05)::INTEGER', 'significant')} FROM eff""", MONTH, extra=ml.dml_ctes(outcomes=ml.DML_OUTCOMES)))
def effect_bars(ctx: Context) -> DataFrame:
    return figures.effect_bars(ml.dml_table(ctx))


@query("V4_cate_map", compose(f"""
  SELECT {whole('z.zone_id', 'zone_id')}, borough, zone_name, {real('cate')}, {real('cate_se')},
    {real('abs(cate/(cate_se+1e-8))', 't_stat')},
    {whole('coalesce((abs(cate/(cate_se+1e-8)) > 1.96)::INTEGER, 0)', 'significant')},
    {real('(SELECT quantile_cont(abs(cate), 0.95) FROM zc)', 'colour_limit')}
  FROM zones z LEFT JOIN zc ON zc.zone_id = z.zone_id""",
    "zones", MONTH, extra={**ml.CATE, "zc": ml.ZONE_CATE}))
def cate_map(ctx: Context) -> DataFrame:
    zones = binding.zone_dimension(ctx.spark, ctx.sf_dir).drop("borough_code")
    return figures.cate_map(zones, cate.zone_cate(ml.cate_rows(ctx)))


@query("V5_cate_histogram", histogram_sql("SELECT * FROM cate", "cate", 50, MONTH, ml.CATE))
def cate_bins(ctx: Context) -> DataFrame:
    return figures.cate_histogram(ml.cate_rows(ctx), 50)


@query("V5_top_features")
def top_features(ctx: Context) -> DataFrame:
    return figures.top_features(ml.forest(ctx).importance, 5)


@query("V6_targeting_series", compose(f"""
  SELECT {real('fraction')}, {real('ate_top_q')},
    {real('(SELECT ate_top_q FROM toc ORDER BY fraction DESC LIMIT 1)', 'uniform_ate')},
    {real('(SELECT avg(ate_top_q) FROM toc)', 'rate_score')} FROM toc""", MONTH, extra=ml.TOC))
def targeting_series(ctx: Context) -> DataFrame:
    return figures.targeting_series(cate.targeting_curve(ml.cate_rows(ctx)))


@query("V7_robustness_bars", compose(f"""
  SELECT "group", "check", {real('theta')}, {real('theta-1.96*c.se', 'low')},
    {real('theta+1.96*c.se', 'high')}, {whole('(coalesce(c.p, 1) < 0.05)::INTEGER', 'significant')},
    {real('ate', 'main')}, {real('ate-1.96*main.se', 'main_low')},
    {real('ate+1.96*main.se', 'main_high')} FROM all_rows c, main""", "panel_week_1", MONTH, extra=_CHECKS))
def robustness_bars(ctx: Context) -> DataFrame:
    return figures.robustness_bars(fx.robustness_table(ctx), main_fit(ctx))


# --- the whole ladder on one panel ------------------------------------------


def climbed(ctx: Context, name: str) -> DataFrame:
    """A result table of the ladder on the week panel with its price outcome, run once per session."""
    root = ctx.folder("ladder")
    found = results.load_result(ctx.spark, name, root)
    if found is None:
        weeks = ctx.weeks().join(
            panel.surge_share(ctx.trips(), ctx.policy, "week"), ["zone_id", "date"], "left")
        ladder.measure(ctx.shared("ladder_panel", lambda: weeks), ctx.policy, root, ml.LEARNED)
        found = results.load_result(ctx.spark, name, root)
    return found


@query("T1_ladder_estimators")
def ladder_estimators(ctx: Context) -> DataFrame:
    return climbed(ctx, "table_estimators")


@query("T4_ladder_robustness")
def ladder_robustness(ctx: Context) -> DataFrame:
    return climbed(ctx, "table_robustness")


@query("T6_ladder_summary")
def ladder_summary(ctx: Context) -> DataFrame:
    return reports.executive_summary(
        climbed(ctx, "twfe").where(F.col("outcome") == "log_trip_count"), climbed(ctx, "dml"),
        cate.cate_summary(climbed(ctx, "cate")),
        climbed(ctx, "feature_importance").select("feature", F.col("importance").alias("coefficient")))


@query("V7_ladder_bars")
def ladder_bars(ctx: Context) -> DataFrame:
    return figures.robustness_bars(
        climbed(ctx, "robustness"), climbed(ctx, "twfe").where(F.col("outcome") == "log_trip_count"))


_LADDER_OUTCOMES = ("log_trip_count", "trip_count", "avg_distance", "avg_duration", "avg_fare", "airport_share",
                    "cbd_fee_total")


@query("C2_ladder_twfe", fx.twfe_sql(WEEK1, _LADDER_OUTCOMES))
def ladder_twfe(ctx: Context) -> DataFrame:
    return climbed(ctx, "twfe").where(F.col("outcome").isin(list(_LADDER_OUTCOMES)))
