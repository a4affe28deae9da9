"""Difference-in-differences, event study, group-time effects, dose, robustness."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.regression_sql import one_regressor, sweeps
from ripplepanel.catalog.sqltext import (
    MONTH, SHOCK, WEEK, WEEK1, compose, day, erfc, hash32, normal_p, poisson, real, stars, whole,
)
from ripplepanel.operators import did, dose, robustness

OUTCOMES = ("log_trip_count", "trip_count", "avg_distance", "avg_duration", "avg_fare",
            "airport_share", "cbd_fee_total")


def twfe_sql(panel: str, outcomes: tuple[str, ...]) -> str:
    src = f"(SELECT *, treat_binary*post AS treat_post FROM {panel})"
    extra = {**sweeps(src, [*outcomes, "treat_post"]), **one_regressor(outcomes, "treat_post")}
    return compose(f"""
  SELECT outcome, {real('coef', 'ate')}, {real('se')}, {real('coef/se', 't_stat')},
    {real('p_value')}, {real('coef-1.96*se', 'ci_low')}, {real('coef+1.96*se', 'ci_high')},
    {whole('n', 'n_obs')}, {real('r2', 'r_squared')},
    {real("CASE WHEN outcome LIKE 'log%' THEN (exp(coef)-1)*100 END", 'pct_change')}
  FROM fits""", panel, extra=extra)


@query("C1_twfe_did", twfe_sql(WEEK, ("log_trip_count",)))
def twfe(ctx: Context) -> DataFrame:
    return did.twfe_did(ctx.panel("week", 5))


# zones with a row in every month: there the fit is a difference of four means
_BALANCED = f"""(SELECT * FROM {MONTH} WHERE zone_id IN (
    SELECT zone_id FROM {MONTH} GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT date) FROM {MONTH})))"""


@query("C1_twfe_did_balanced", compose(f"""
  SELECT 'log_trip_count' AS outcome, {real('(t1-t0)-(c1-c0)', 'ate')}, {whole('n', 'n_obs')}
  FROM (SELECT avg(log_trip_count) FILTER (treat_binary=1 AND post=1) AS t1,
          avg(log_trip_count) FILTER (treat_binary=1 AND post=0) AS t0,
          avg(log_trip_count) FILTER (treat_binary=0 AND post=1) AS c1,
          avg(log_trip_count) FILTER (treat_binary=0 AND post=0) AS c0, count(*) AS n
        FROM {_BALANCED}) WHERE n > 0""", MONTH))
def twfe_balanced(ctx: Context) -> DataFrame:
    panel = ctx.panel()
    months = panel.select("date").distinct().count()
    whole_zones = panel.groupBy("zone_id").count().where(F.col("count") == months).select("zone_id")
    return did.twfe_did(panel.join(whole_zones, "zone_id")).select("outcome", "ate", "n_obs")


@query("C2_twfe_outcome_sweep", twfe_sql(MONTH, OUTCOMES))
def twfe_sweep(ctx: Context) -> DataFrame:
    return ctx.shared("twfe_month", lambda: did.twfe_did(ctx.panel(), OUTCOMES))


# balanced panel: each coefficient is a difference of group means against the
# reference period, and its clustered variance a sum over zones
_LEADS = {
    "p": f"SELECT * FROM {MONTH} WHERE rel_week BETWEEN -16 AND 16",
    "d": """SELECT p.zone_id, p.treat_binary, p.rel_week, p.log_trip_count - r.log_trip_count AS dy
      FROM p JOIN p r ON r.zone_id = p.zone_id AND r.rel_week = -1 WHERE p.rel_week <> -1""",
    "arm": """SELECT treat_binary, rel_week, avg(dy) AS m, count(*)::DOUBLE AS n FROM d
      GROUP BY ALL""",
    "inf": """SELECT d.zone_id, d.rel_week, (dy - m)/n*(CASE treat_binary WHEN 1 THEN 1 ELSE -1 END)
        AS f FROM d JOIN arm USING (treat_binary, rel_week)""",
    "coef": """SELECT rel_week, max(m) FILTER (treat_binary=1) - max(m) FILTER (treat_binary=0) AS c
      FROM arm GROUP BY 1""",
    "units": "SELECT count(DISTINCT zone_id)::DOUBLE AS g FROM p",
}


@query("C3_event_study", compose(f"""
  SELECT {whole('rel_week')}, {real('c', 'coef')}, {real('se')}, {real('c-1.96*se', 'ci_low')},
    {real('c+1.96*se', 'ci_high')}, {real(normal_p('c/se'), 'p_value')}
  FROM coef JOIN (SELECT rel_week, sqrt(sum(f*f)*any_value(g)/(any_value(g)-1)) AS se
                  FROM inf, units GROUP BY 1) USING (rel_week)
  UNION ALL SELECT -1, 0.0, 0.0, 0.0, 0.0, 1.0""", MONTH, extra=_LEADS))
def event_study(ctx: Context) -> DataFrame:
    return did.event_study(ctx.panel()).coefficients


_GROUPS = sweeps("panel_week_1", ["log_trip_count"], by=["treat_binary"], rounds=25)


@query("C3_event_study_weeks", compose(f"""
  SELECT {whole('rel_week')}, {real('t-c', 'coef')} FROM (
    SELECT rel_week,
      max(g_log_trip_count - r) FILTER (treat_binary=1) AS t,
      max(g_log_trip_count - r) FILTER (treat_binary=0) AS c
    FROM g25 JOIN (SELECT DISTINCT date, rel_week FROM panel_week_1) USING (date)
    JOIN (SELECT treat_binary, g_log_trip_count AS r FROM g25
          JOIN (SELECT DISTINCT date, rel_week FROM panel_week_1) USING (date) WHERE rel_week = -1)
      USING (treat_binary)
    GROUP BY 1)""", "panel_week_1", extra=_GROUPS))
def event_study_weeks(ctx: Context) -> DataFrame:
    """All weeks; one whose effect is not identified keeps its row."""
    study = ctx.shared("event_weeks", lambda: did.event_study(ctx.weeks(), window=None).coefficients)
    return ctx.weeks().select("rel_week").distinct().join(study.select("rel_week", "coef"), "rel_week", "left")


def _lead(i: int, j: int) -> str:
    a, b = (-14, -10, -5)[i], (-14, -10, -5)[j]
    return (f"(SELECT sum(x.f*y.f)*any_value(g)/(any_value(g)-1) FROM inf x JOIN inf y "
            f"USING (zone_id), units WHERE x.rel_week = {a} AND y.rel_week = {b})")


# b' V^-1 b of three leads by the adjugate of V
WALD = {**_LEADS, "wald": f"""
  SELECT (b1*(b1*(d*f-e*e) + b2*(c*e-b*f) + b3*(b*e-c*d))
        + b2*(b1*(c*e-b*f) + b2*(a*f-c*c) + b3*(b*c-a*e))
        + b3*(b1*(b*e-c*d) + b2*(b*c-a*e) + b3*(a*d-b*b)))
        / (a*(d*f-e*e) - b*(b*f-c*e) + c*(b*e-c*d)) AS stat
  FROM (SELECT {_lead(0, 0)} AS a, {_lead(0, 1)} AS b, {_lead(0, 2)} AS c,
          {_lead(1, 1)} AS d, {_lead(1, 2)} AS e, {_lead(2, 2)} AS f,
          (SELECT c FROM coef WHERE rel_week = -14) AS b1,
          (SELECT c FROM coef WHERE rel_week = -10) AS b2,
          (SELECT c FROM coef WHERE rel_week = -5) AS b3)"""}
WALD_P = erfc("sqrt(stat/2)") + "+sqrt(2*stat/pi())*exp(-stat/2)"


@query("C4_pretrend_wald", compose(f"""
  SELECT 'event study leads' AS test, {real('stat')}, {whole('3', 'df')},
    {real(WALD_P, 'p_value')} FROM wald""", MONTH, extra=WALD))
def pretrend(ctx: Context) -> DataFrame:
    return did.event_study(ctx.panel()).pretrend


def att_ctes(cohort: str, anticipation: int = 0, clean_pre: bool = False) -> dict[str, str]:
    edge = f"cohort - {7 * anticipation}"
    usable = f"week + 7 <= {edge}" if clean_pre else f"week < {edge}"
    few = "(t.n + c.n + CASE WHEN t.week = ref_week THEN 0 ELSE tr.n + cr.n END < 10)"
    return {
        "cells": f"""SELECT {cohort} AS cohort, week, avg(log_trip_count) AS m,
            coalesce(var_samp(log_trip_count), 0) AS v, count(*) AS n FROM panel_week_1 GROUP BY ALL""",
        "refs": f"""SELECT cohort, max(week) FILTER ({usable}) AS ref_week FROM cells
            WHERE cohort IS NOT NULL GROUP BY 1""",
        "att": f"""SELECT *, att-1.96*se AS ci_low, att+1.96*se AS ci_high FROM (
          SELECT t.cohort, t.week AS period,
            CAST(floor(date_diff('day', t.cohort, t.week)/7.0) AS INTEGER) AS rel_week,
            CASE WHEN {few} THEN NULL WHEN t.week = ref_week THEN 0 ELSE (t.m-tr.m)-(c.m-cr.m) END AS att,
            CASE WHEN {few} THEN NULL WHEN t.week = ref_week THEN 0
                 ELSE sqrt(t.v/t.n + tr.v/tr.n + c.v/c.n + cr.v/cr.n) END AS se,
            t.week < t.cohort AS is_pre, t.week = ref_week AS is_ref,
            CASE WHEN {few} THEN 'too_few_rows' ELSE 'ok' END AS status
          FROM cells t JOIN refs USING (cohort)
          JOIN cells c ON c.cohort IS NULL AND c.week = t.week
          JOIN cells tr ON tr.cohort = t.cohort AND tr.week = ref_week
          JOIN cells cr ON cr.cohort IS NULL AND cr.week = ref_week)""",
    }


_ATT = f"""
  SELECT {day('cohort')}, {day('period')}, {whole('rel_week')}, {real('att')}, {real('se')},
    {whole('is_pre')}, {whole('is_ref')}, {real('ci_low')}, {real('ci_high')}, status FROM att"""
SINGLE = f"CASE treat_binary WHEN 1 THEN {SHOCK} END"
_STAGGERED = f"CASE WHEN zone_id <= 4 THEN {SHOCK} WHEN zone_id <= 8 THEN {SHOCK} + 28 END"


@query("C5_group_time_att", compose(_ATT, "panel_week_1", extra=att_ctes(SINGLE)))
def group_time(ctx: Context) -> DataFrame:
    return did.group_time_att(ctx.weeks(), ctx.policy)


@query("C5_clean_reference_week", compose(_ATT, "panel_week_1", extra=att_ctes(SINGLE, 1, True)))
def group_time_clean(ctx: Context) -> DataFrame:
    return did.group_time_att(ctx.weeks(), ctx.policy, anticipation=1, clean_pre=True)


@query("C5_staggered_cohorts", compose(_ATT, "panel_week_1", extra=att_ctes(_STAGGERED)))
def staggered(ctx: Context) -> DataFrame:
    zone, start = F.col("zone_id"), ctx.policy.shock_lit()
    cohort = F.when(zone <= 4, start).when(zone <= 8, F.date_add(start, 28))
    return did.group_time_att(ctx.weeks(), ctx.policy, cohort=cohort)


@query("C6_zone_bootstrap", compose(f"""
  SELECT {day('week', 'period')}, {real('stddev_samp(gap-gap_ref)', 'se_boot')},
    {whole('count(gap-gap_ref)', 'n_reps')}
  FROM gaps JOIN (SELECT rep, gap AS gap_ref FROM gaps
                  WHERE week = (SELECT max(week) FROM panel_week_1 WHERE week < {SHOCK})) USING (rep)
  GROUP BY week""", "panel_week_1", extra={
    "zw": """SELECT zone_id, treat_binary, week, sum(log_trip_count) AS s, count(*) AS n
      FROM panel_week_1 GROUP BY ALL""",
    "drawn": f"""SELECT *, {poisson(hash32('zone_id', 'rep', seed=42))} AS w
      FROM zw, (SELECT unnest(generate_series(1, 199)) AS rep)""",
    "gaps": """SELECT rep, week,
        sum(w*s) FILTER (treat_binary=1)/nullif(sum(w*n) FILTER (treat_binary=1), 0)
        - sum(w*s) FILTER (treat_binary=0)/nullif(sum(w*n) FILTER (treat_binary=0), 0) AS gap
      FROM drawn GROUP BY ALL"""}))
def bootstrap(ctx: Context) -> DataFrame:
    return did.group_time_bootstrap(ctx.weeks(), ctx.policy, reps=199)


@query("C7_aggregate_att", compose(f"""
  SELECT {real('avg(att) FILTER (NOT is_pre)', 'agg_att')},
    {whole('count(att) FILTER (NOT is_pre)', 'n_post')} FROM att""", "panel_week_1", extra=att_ctes(SINGLE)))
def aggregate(ctx: Context) -> DataFrame:
    return did.aggregate_att(did.group_time_att(ctx.weeks(), ctx.policy))


# logarithms of the coefficients of the finite cosine series, for even and odd degrees of freedom
STUDENT = {"cosines": """SELECT k, sum(CASE WHEN k=0 THEN 0 ELSE ln((2*k-1.0)/(2.0*k)) END) OVER (ORDER BY k) AS even,
    sum(CASE WHEN k=0 THEN 0 ELSE ln(2.0*k/(2*k+1.0)) END) OVER (ORDER BY k) AS odd
  FROM (SELECT unnest(generate_series(0, 3000)) AS k)"""}


def student_p(t: str, df: str) -> str:
    """Two-sided tail by the finite cosine series of ``STUDENT``, for any whole number of degrees."""
    c2, root = f"({df}/({df}+({t})*({t})))", f"sqrt({df}+({t})*({t}))"
    part = "(SELECT coalesce(sum(exp({k})*pow({c2},k)), 0) FROM cosines WHERE k <= {most})"
    even = part.format(k="even", c2=c2, most=f"({df}-2)//2")
    odd = part.format(k="odd", c2=c2, most=f"({df}-3)/2.0")
    return (f"(1.0 - CASE WHEN {df} % 2 = 0 THEN abs({t})/{root}*{even} ELSE 2/pi()*(atan(abs({t})/sqrt({df}))"
            f" + abs({t})*sqrt({df})/({df}+({t})*({t}))*{odd}) END)")


@query("C8_att_pretrend_test", compose(f"""
  SELECT 'group-time leads' AS test, {real('stat')}, {whole('df')},
    {real(student_p('stat', 'df'), 'p_value')}
  FROM (SELECT avg(z)/(stddev_samp(z)/sqrt(count(z))) AS stat, count(z)-1 AS df
        FROM (SELECT att/(se+1e-8) AS z FROM att WHERE is_pre AND NOT is_ref))""",
    "panel_week_1", extra={**STUDENT, **att_ctes(SINGLE)}))
def att_test(ctx: Context) -> DataFrame:
    return did.att_pretrend(did.group_time_att(ctx.weeks(), ctx.policy))


@query("C9_zone_dose", compose(f"""
  SELECT {whole('zone_id')}, {real('avg(avg_cbd_fee)', 'zone_dose')} FROM {WEEK}
  WHERE date >= {SHOCK} GROUP BY zone_id""", WEEK))
def zone_dose(ctx: Context) -> DataFrame:
    return dose.zone_dose(ctx.panel("week", 5), ctx.policy)


_DOSED = f"""(SELECT p.*, coalesce(d, 0) AS zone_dose, post*coalesce(d, 0) AS x1,
    post*coalesce(d, 0)*coalesce(d, 0) AS x2
  FROM {WEEK} p LEFT JOIN (SELECT zone_id, avg(avg_cbd_fee) AS d FROM {WEEK} WHERE date >= {SHOCK}
    GROUP BY 1) z ON z.zone_id = p.zone_id)"""
_DOSE_FIT = {
    **sweeps(_DOSED.replace("SELECT p.*", "SELECT p.zone_id, p.date, p.log_trip_count"),
             ["log_trip_count", "x1", "x2"]),
    "s": """SELECT count(*) AS n, sum(t_x1*t_x1) AS a, sum(t_x1*t_x2) AS b, sum(t_x2*t_x2) AS c,
        sum(t_x1*t_log_trip_count) AS p, sum(t_x2*t_log_trip_count) AS q,
        sum(t_log_trip_count*t_log_trip_count) AS yy FROM net""",
    "k": """SELECT *, (c*p-b*q)/(a*c-b*b) AS b1, (a*q-b*p)/(a*c-b*b) AS b2, a*c-b*b AS det FROM s""",
    "sc": """SELECT zone_id, sum(t_x1*e) AS s1, sum(t_x2*e) AS s2 FROM (
        SELECT zone_id, t_x1, t_x2, t_log_trip_count-b1*t_x1-b2*t_x2 AS e FROM net, k) GROUP BY 1""",
    "m": """SELECT sum(s1*s1)*count(*)/(count(*)-1.0::DOUBLE) AS m11,
        sum(s1*s2)*count(*)/(count(*)-1.0::DOUBLE) AS m12,
        sum(s2*s2)*count(*)/(count(*)-1.0::DOUBLE) AS m22 FROM sc""",
    "v": """SELECT k.*, (c*c*m11-2*b*c*m12+b*b*m22)/(det*det) AS v11,
        (-b*c*m11+(a*c+b*b)*m12-a*b*m22)/(det*det) AS v12,
        (b*b*m11-2*a*b*m12+a*a*m22)/(det*det) AS v22 FROM k, m""",
}


@query("C10_continuous_did", compose(f"""
  SELECT 'log_trip_count' AS outcome, {real('b1', 'beta_linear')}, {real('b2', 'beta_quad')},
    {real('sqrt(v11)', 'se_linear')}, {real('sqrt(v22)', 'se_quad')},
    {real(normal_p('b1/sqrt(v11)'), 'p_linear')}, {whole('n', 'n_obs')},
    {real('(b1*p+b2*q)/yy', 'r_squared')} FROM v""", WEEK, extra=_DOSE_FIT))
def continuous(ctx: Context) -> DataFrame:
    return dose.continuous_did(ctx.panel("week", 5), ctx.policy).coefficients()


CURVE = compose(f"""
  SELECT {real('d', 'dose')}, {real('b1*d+b2*d*d', 'effect')},
    {real('b1*d+b2*d*d-1.96*band', 'ci_low')}, {real('b1*d+b2*d*d+1.96*band', 'ci_high')},
    {real('b1*d+b2*d*d-1.96*sqrt(v11)*d', 'ci_low_linear')},
    {real('b1*d+b2*d*d+1.96*sqrt(v11)*d', 'ci_high_linear')}
  FROM (SELECT *, sqrt(greatest(v11*d*d+2*v12*d*d*d+v22*d*d*d*d, 0)) AS band
        FROM (SELECT v.*, i*top/99.0 AS d FROM v, (SELECT max(zone_dose) AS top FROM dosed),
              (SELECT unnest(generate_series(0, 99)) AS i)))""",
    WEEK, extra={**_DOSE_FIT, "dosed": f"SELECT * FROM {_DOSED}"})


@query("C11_dose_response_curve", CURVE)
def curve(ctx: Context) -> DataFrame:
    return dose.continuous_did(ctx.panel("week", 5), ctx.policy).curve()


_BINNED = f"""(SELECT zone_id, date, log_trip_count, treat_binary, zone_dose, bin,
    treat_binary*post AS treat_post
  FROM {_DOSED}, (SELECT unnest(generate_series(0, len(edges)-2)) AS bin, edges FROM (
    SELECT list_sort(list_distinct(quantile_cont(zone_dose, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges
    FROM (SELECT DISTINCT zone_dose FROM {_DOSED} WHERE treat_binary = 1)))
  WHERE treat_binary = 0 OR bin = len(list_filter(edges[2:], lambda e: e < zone_dose)))"""
BIN_CTES = {
    "binned": f"SELECT * FROM {_BINNED}",
    **sweeps("binned", ["log_trip_count", "treat_post"], by=["bin"], rounds=20),
    **one_regressor(["log_trip_count"], "treat_post", by=["bin"]),
}
BINS = compose(f"""
  SELECT {whole('bin')}, {real('mean_dose')}, {real('coef', 'att')}, {real('se')},
    {real('coef-1.96*se', 'ci_low')}, {real('coef+1.96*se', 'ci_high')}, {real('p_value')},
    {whole('n', 'n_obs')}
  FROM fits JOIN (SELECT bin, avg(zone_dose) AS mean_dose FROM binned WHERE treat_binary = 1
                  GROUP BY 1) USING (bin)""", WEEK, extra=BIN_CTES)


@query("C12_dose_bin_did", BINS)
def bins(ctx: Context) -> DataFrame:
    return dose.dose_bin_did(ctx.panel("week", 5), ctx.policy)


def spec_ctes(panel: str, specs: list[tuple[str, str, str, str, int, str]]) -> dict[str, str]:
    """CTEs that end in ``checks`` from (check, group, keep, start date, minimum, note) rows."""
    parts = [
        f"SELECT {i} AS spec, zone_id, date, log_trip_count, "
        f"treat_binary*(date >= {start})::INTEGER AS treat_post FROM {panel} WHERE {keep}"
        for i, (_, _, keep, start, _, _) in enumerate(specs)]
    listed = ", ".join(
        f"({i}, '{c}', '{g}', {least}, '{note}')" for i, (c, g, _, _, least, note) in enumerate(specs))
    enough = "coalesce(n, 0) >= greatest(least, 1)"
    usable = f"{enough} AND coef IS NOT NULL"
    return {
        "spread": "\nUNION ALL ".join(parts),
        "specs": f"SELECT * FROM (VALUES {listed}) AS t(spec, \"check\", grp, least, note)",
        **sweeps("spread", ["log_trip_count", "treat_post"], by=["spec"], rounds=25),
        **one_regressor(["log_trip_count"], "treat_post", by=["spec"]),
        "checks": f"""SELECT "check", grp, note, coalesce(n, 0) AS n_obs,
            CASE WHEN {usable} THEN coef END AS theta, CASE WHEN {usable} THEN se END AS se,
            CASE WHEN {usable} THEN p_value END AS p,
            CASE WHEN NOT ({enough}) THEN 'too_few_rows' WHEN coef IS NULL THEN 'not_identified'
                 ELSE 'ok' END AS status
          FROM specs LEFT JOIN fits USING (spec)""",
    }


def spec_sql(panel: str, specs: list[tuple[str, str, str, str, int, str]], more: str = "") -> str:
    return compose(f"""
  SELECT "check", grp AS "group", {real('theta')}, {real('se')}, {real('p')}, {whole('n_obs')},
    note, status{more} FROM checks""", panel, extra=spec_ctes(panel, specs))


def _placebo(k: int) -> tuple:
    fake = f"({SHOCK} + {7 * k})"
    return (f"Placebo shift {k:+d}w", "Placebo Date",
            f"date < {SHOCK} AND date BETWEEN {fake} - 56 AND {fake} + 56", fake, 100,
            "Should be near 0")


PLACEBOS = [_placebo(k) for k in (-8, -4, 4, 8)]
ANTICIPATION = [
    ("Drop first 4w post", "Anticipation", f"(date < {SHOCK} OR date >= {SHOCK} + 28)", SHOCK, 0, ""),
    ("Drop announcement to shock", "Anticipation",
     f"(date < DATE '1998-05-01' OR date >= {SHOCK})", SHOCK, 0, "")]
CONTROLS = [
    ("Exclude buffer zones", "Control Sensitivity", "treat_ring <> 1", SHOCK, 100, ""),
    ("Home-borough control only", "Control Sensitivity",
     "(treat_binary = 1 OR borough = ''AFRICA'')".replace("''", "'"), SHOCK, 100, ""),
    ("Outer-borough control only", "Control Sensitivity",
     "(treat_binary = 1 OR borough IS DISTINCT FROM 'AFRICA')", SHOCK, 100, "")]
WINDOWS = [
    (f"±{k}w window", "Bandwidth", f"date BETWEEN {SHOCK} - {7 * k} AND {SHOCK} + {7 * k}", SHOCK,
     100, "") for k in (4, 8, 12, 16, 26)]
BOROUGHS = [
    (f"Drop {b}", "Leave-One-Borough", f"borough IS DISTINCT FROM '{b}'", SHOCK, 0, "")
    for b in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]


@query("R1_placebo_dates", spec_sql(WEEK1, PLACEBOS))
def placebo(ctx: Context) -> DataFrame:
    return robustness.run_specs(ctx.panel("week", 1), robustness.placebo_dates(ctx.policy))


@query("R2_anticipation", spec_sql(WEEK1, ANTICIPATION))
def anticipation(ctx: Context) -> DataFrame:
    return robustness.run_specs(ctx.panel("week", 1), robustness.anticipation(ctx.policy))


@query("R3_control_groups", spec_sql(MONTH, CONTROLS))
def controls(ctx: Context) -> DataFrame:
    return robustness.run_specs(ctx.panel(), robustness.control_groups(ctx.policy))


_ALT = {**sweeps(f"(SELECT *, treat_binary*post AS treat_post FROM {MONTH})",
                 ["log_trip_count", "trip_count", "treat_post"]),
        **one_regressor(["log_trip_count", "trip_count"], "treat_post")}


@query("R4_alternative_outcome", compose(f"""
  SELECT 'Outcome ' || outcome AS "check", 'Alternative Outcome' AS "group",
    {real('coef', 'theta')}, {real('se')}, {real('p_value', 'p')}, {whole('n', 'n_obs')},
    '' AS note, 'ok' AS status FROM fits""", MONTH, extra=_ALT))
def alternative(ctx: Context) -> DataFrame:
    return robustness.alternative_outcomes(ctx.panel())


@query("R5_bandwidths", spec_sql(WEEK1, WINDOWS))
def widths(ctx: Context) -> DataFrame:
    return robustness.run_specs(ctx.panel("week", 1), robustness.bandwidths(ctx.policy))


@query("R6_leave_one_borough_out", spec_sql(MONTH, BOROUGHS))
def leave_out(ctx: Context) -> DataFrame:
    panel = ctx.panel()
    return robustness.run_specs(panel, robustness.leave_one_borough(panel, ctx.policy))


ALL_SPECS = [*PLACEBOS, *ANTICIPATION, *CONTROLS, *WINDOWS, *BOROUGHS]


def robustness_table(ctx: Context) -> DataFrame:
    """Every specification, and the alternative outcomes of the month panel."""
    return ctx.shared("robustness", lambda: robustness.run_all(
        ctx.panel("week", 1), ctx.policy, more=[robustness.alternative_outcomes(ctx.panel())]))


#: The rows of the specifications and of the alternative outcomes as one CTE ``all_rows``.
CHECK_CTES = {
    **spec_ctes(WEEK1, ALL_SPECS),
    **sweeps(f"(SELECT *, treat_binary*post AS treat_post FROM {MONTH})",
             ["log_trip_count", "trip_count", "treat_post"], tag="o_"),
    **one_regressor(["log_trip_count", "trip_count"], "treat_post", tag="o_"),
    "all_rows": """SELECT "check", grp AS "group", theta, se, p, n_obs, note, status FROM checks
      UNION ALL SELECT 'Outcome ' || outcome, 'Alternative Outcome', coef, se, p_value, n, '', 'ok' FROM o_fits""",
}


@query("R8_all_checks", compose(f"""
  SELECT "check", "group", {real('theta')}, {real('se')}, {real('p')}, {whole('n_obs')}, note, status,
    {stars('p')} AS sig FROM all_rows""", WEEK1, MONTH, extra=CHECK_CTES))
def all_checks(ctx: Context) -> DataFrame:
    return robustness_table(ctx)
