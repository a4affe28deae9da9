"""Double machine learning and heterogeneous effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog.panels import FEATURES, surge_ctes
from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.sqltext import (
    MONTH, compose, day, normal_p, poisson, real, stars, whole,
)
from ripplepanel.operators import cate, dml, features, panel
from ripplepanel.sources import results

PAIR = ["lag1_trip_count", "peak_share"]
TWO = ("log_trip_count", "avg_fare")
DML_OUTCOMES = ("log_trip_count", "trip_count", "avg_distance", "avg_duration", "avg_fare", "surge_share")
#: What the SQL calls them.
_SHORT = {"log_trip_count": "y", "avg_fare": "z", "trip_count": "q", "avg_distance": "l", "avg_duration": "m",
          "surge_share": "s"}
FOLDS, REPS, BOOT = 5, 3, 200
# what varies within a zone: a zone constant would give the treatment away and
# leave no residual treatment to learn from
LEARNED = [
    "month", "week_of_year", "peak_share", "lag1_trip_count", "lag7_trip_count",
    "roll7_mean_trip_count", "roll7_std_trip_count",
]


def feature_panel(ctx: Context) -> DataFrame:
    return ctx.shared("features", lambda: features.add_features(ctx.panel(), ctx.policy))


def outcome_panel(ctx: Context) -> DataFrame:
    """The feature table with the price outcome."""
    return ctx.shared("outcomes", lambda: feature_panel(ctx).join(
        panel.surge_share(ctx.trips(), ctx.policy, "month"), ["zone_id", "date"], "left"))


def h(*parts: str) -> str:
    text = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x'||substr(md5(concat_ws('|', {text})),1,8))::BIGINT"


def plane(y: str, weight: str = "1.0") -> str:
    """b0, b1, b2 of a weighted least-squares plane on x1 and x2."""
    w = f"sum({weight})"

    def m(c: str) -> str:
        return f"(sum({weight}*{c})/{w})"

    def s(a: str, b: str) -> str:
        return f"(sum({weight}*{a}*{b}) - sum({weight}*{a})*sum({weight}*{b})/{w})"

    det = f"({s('x1', 'x1')}*{s('x2', 'x2')} - pow({s('x1', 'x2')}, 2))"
    b1 = f"(({s('x2', 'x2')}*{s('x1', y)} - {s('x1', 'x2')}*{s('x2', y)})/{det})"
    b2 = f"(({s('x1', 'x1')}*{s('x2', y)} - {s('x1', 'x2')}*{s('x1', y)})/{det})"
    return f"{m(y)} - {b1}*{m('x1')} - {b2}*{m('x2')} AS b0_{y}, {b1} AS b1_{y}, {b2} AS b2_{y}"


_ROWS = {
    "features": FEATURES,
    "rows": """SELECT zone_id, date, log_trip_count AS y, avg_fare AS z, treat_binary::DOUBLE AS d,
        lag1_trip_count::DOUBLE AS x1, peak_share AS x2, borough, weekend_flag, peak_share
      FROM features WHERE lag1_trip_count IS NOT NULL""",
}


def residual_ctes(keys: tuple[str, ...] = ("zone_id", "date"), outcomes: tuple[str, ...] = TWO) -> dict[str, str]:
    targets = ("d", *[_SHORT[o] for o in outcomes])
    rows, source = dict(_ROWS), "rows"
    if "surge_share" in outcomes:
        source = "priced_rows"
        named = ", ".join(f"{o}::DOUBLE AS {_SHORT[o]}" for o in outcomes)
        rows = {"features": FEATURES, **surge_ctes("month"), source: f"""
      SELECT zone_id, date, treat_binary::DOUBLE AS d, lag1_trip_count::DOUBLE AS x1, peak_share AS x2, {named}
      FROM features JOIN surge USING (zone_id, date)
      WHERE lag1_trip_count IS NOT NULL AND surge_share IS NOT NULL"""}
    return {
        **rows,
        "folds": f"""SELECT *, ({h(*keys, '(42+rep*1000)')}) % {FOLDS} AS fold
          FROM {source}, (SELECT unnest(generate_series(0, {REPS - 1})) AS rep)""",
        "planes": f"""SELECT k.fold AS fold, rep, {', '.join(plane(t) for t in targets)}
          FROM folds f JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS fold) k
            ON f.fold <> k.fold GROUP BY k.fold, rep""",
        "res": "SELECT f.*, " + ", ".join(
            f"{t}-b0_{t}-b1_{t}*x1-b2_{t}*x2 AS r{t}" for t in targets)
        + " FROM folds f JOIN planes USING (rep, fold)",
    }


def dml_ctes(keys: tuple[str, ...] = ("zone_id", "date"), outcomes: tuple[str, ...] = TWO) -> dict[str, str]:
    parts = []
    for name in outcomes:
        t = _SHORT[name]
        parts.append(f"""SELECT '{name}' AS outcome, rep, any_value(th) AS theta, count(*) AS n,
            sqrt(sum(rd*rd*pow(r{t}-th*rd, 2)))/sum(rd*rd) AS se
          FROM res JOIN (SELECT rep, sum(rd*r{t})/sum(rd*rd) AS th FROM res GROUP BY 1) USING (rep)
          GROUP BY rep""")
    return {
        **residual_ctes(keys, outcomes), "per_rep": "\nUNION ALL ".join(parts),
        "eff0": """SELECT outcome, quantile_cont(theta, 0.5) AS theta, quantile_cont(se, 0.5) AS se,
            count(*) AS n_reps, max(n) AS n_obs FROM per_rep GROUP BY 1""",
        "eff": f"""SELECT *, theta/(se+1e-12) AS t_stat, {normal_p('theta/(se+1e-12)')} AS p_value
            FROM eff0""",
    }


DML_COLUMNS = ", ".join([
    "outcome", real("theta"), real("se"), real("t_stat"), real("p_value"),
    real("theta-1.96*se", "ci_low"), real("theta+1.96*se", "ci_high"), whole("n_reps"),
    whole("n_obs"), f"{stars('p_value')} AS sig"])


def dml_table(ctx: Context) -> DataFrame:
    return ctx.shared("dml_ols", lambda: dml.dml_effects(
        outcome_panel(ctx), PAIR, DML_OUTCOMES, learner="ols", folds=FOLDS, reps=REPS))


@query("C18_learner_quality")
def learners(ctx: Context) -> DataFrame:
    return dml.learner_quality(
        feature_panel(ctx), LEARNED, "log_trip_count", dml.LINEAR + dml.TREES)


@query("C19_cross_fit_residuals", compose(f"""
  SELECT {whole('rep')}, {whole('fold')}, {whole('zone_id')}, {day('date')}, {real('rd', 'r_treat')},
    {real('ry', 'r_log')}, {real('rz', 'r_fare')} FROM res""", MONTH, extra=residual_ctes()))
def residuals(ctx: Context) -> DataFrame:
    res = dml.cross_fit_residuals(
        feature_panel(ctx), PAIR, ["treat_binary", *TWO], "ols", FOLDS, REPS)
    return res.select(
        "rep", "fold", "zone_id", "date", F.col("r_treat_binary").alias("r_treat"),
        F.col("r_log_trip_count").alias("r_log"), F.col("r_avg_fare").alias("r_fare"))


@query("C20_dml_effect", compose(
    f"SELECT {DML_COLUMNS} FROM eff WHERE outcome = 'log_trip_count'", MONTH, extra=dml_ctes()))
def effect(ctx: Context) -> DataFrame:
    return dml.dml_effects(
        feature_panel(ctx), PAIR, ["log_trip_count"], learner="ols", folds=FOLDS, reps=REPS)


@query("C20_dml_zone_folds", compose(f"SELECT {DML_COLUMNS} FROM eff", MONTH,
                                     extra=dml_ctes(("zone_id",))))
def effect_zone_folds(ctx: Context) -> DataFrame:
    return dml.dml_effects(
        feature_panel(ctx), PAIR, TWO, learner="ols", folds=FOLDS, reps=REPS,
        cluster_folds=True)


@query("C21_dml_outcomes", compose(
    f"SELECT {DML_COLUMNS} FROM eff", MONTH, extra=dml_ctes(outcomes=DML_OUTCOMES)))
def effects(ctx: Context) -> DataFrame:
    return dml_table(ctx)


@query("C21_dml_random_forest")
def effects_forest(ctx: Context) -> DataFrame:
    return ctx.shared("dml_forest", lambda: dml.dml_effects(
        outcome_panel(ctx), LEARNED, DML_OUTCOMES, learner="random_forest"))


@query("C21_dml_lasso_ridge")
def effects_penalised(ctx: Context) -> DataFrame:
    parts = [
        dml.dml_effects(outcome_panel(ctx), LEARNED, DML_OUTCOMES, learner=name).withColumn("learner", F.lit(name))
        for name in ("ridge", "lasso")]
    return parts[0].unionByName(parts[1])


@query("R7_learner_sensitivity")
def learner_checks(ctx: Context) -> DataFrame:
    return ctx.shared("learner_checks", lambda: dml.learner_checks(
        feature_panel(ctx), LEARNED))


# --- heterogeneous effects -------------------------------------------------

_DIFF = "(SELECT b0_y + b1_y*{x}.x1 + b2_y*{x}.x2 FROM planes p WHERE p.rep = {rep} AND p.d = {arm})"
CATE = {
    **_ROWS,
    "halves": f"SELECT *, ({h('zone_id', 'date', '42')}) % 2 AS half FROM rows",
    "drawn": f"""SELECT *, CASE rep WHEN 0 THEN 1.0
          ELSE {poisson(h('zone_id', 'date', 'rep', '42'))} END AS w
      FROM halves, (SELECT unnest(generate_series(0, {BOOT})) AS rep) WHERE half = 0""",
    "planes": f"SELECT rep, d, {plane('y', 'w')} FROM drawn GROUP BY rep, d HAVING sum(w) >= 5",
    "gaps": """SELECT a.rep, a.b0_y-b.b0_y AS g0, a.b1_y-b.b1_y AS g1, a.b2_y-b.b2_y AS g2
      FROM planes a JOIN planes b USING (rep) WHERE a.d = 1 AND b.d = 0""",
    "cate0": """SELECT zone_id, date, any_value(y) AS y, any_value(d) AS t, any_value(x1) AS x1,
        any_value(x2) AS x2, any_value(borough) AS borough, any_value(weekend_flag) AS weekend_flag,
        any_value(peak_share) AS peak_share,
        max(g0+g1*x1+g2*x2) FILTER (rep = 0) AS cate,
        stddev_samp(g0+g1*x1+g2*x2) FILTER (rep > 0) AS cate_se, count(*) FILTER (rep > 0) AS n_boot
      FROM halves, gaps WHERE half = 1 GROUP BY zone_id, date""",
    "cate": """SELECT *, cate-1.96*cate_se AS cate_low, cate+1.96*cate_se AS cate_high
      FROM cate0""",
}
BANDS = ", ".join(real(c) for c in ("cate", "cate_low", "cate_high", "cate_se"))


def cate_rows(ctx: Context) -> DataFrame:
    return ctx.shared("cate_ols", lambda: cate.t_learner(
        feature_panel(ctx), PAIR, learner="ols", n_boot=BOOT).rows)


def linear_cate(ctx: Context) -> cate.Cate:
    return cate.Cate(cate_rows(ctx), PAIR, None)


def forest(ctx: Context) -> cate.Cate:
    """Residual forest, kept as result tables like any other fit."""
    spark, root = ctx.spark, ctx.folder("forest")
    rows = results.load_result(spark, "rows", root)
    if rows is None:
        made = cate.residual_forest(feature_panel(ctx), LEARNED)
        results.save_result(made.rows, "rows", root)
        results.save_result(made.importance, "importance", root)
        rows = results.load_result(spark, "rows", root)
    return cate.Cate(rows, LEARNED, results.load_result(spark, "importance", root))


@query("C22_residual_forest")
def forest_rows(ctx: Context) -> DataFrame:
    return forest(ctx).rows.select("zone_id", "date", "cate", "cate_low", "cate_high", "cate_se")


@query("C23_t_learner_ols", compose(
    f"SELECT {whole('zone_id')}, {day('date')}, {real('cate')} FROM cate", MONTH, extra=CATE))
def t_learner(ctx: Context) -> DataFrame:
    return cate_rows(ctx).select("zone_id", "date", "cate")


@query("C23_t_learner_forest")
def t_learner_forest(ctx: Context) -> DataFrame:
    return ctx.shared("t_forest", lambda: cate.t_learner(feature_panel(ctx), LEARNED).rows.select(
        "zone_id", "date", "cate", "cate_low", "cate_high", "cate_se", "n_boot"))


@query("C24_bootstrap_se_ols", compose(f"""
  SELECT {whole('zone_id')}, {day('date')}, {BANDS}, {whole('n_boot')} FROM cate""", MONTH, extra=CATE))
def bootstrap(ctx: Context) -> DataFrame:
    return cate_rows(ctx).select("zone_id", "date", "cate", "cate_low", "cate_high", "cate_se", "n_boot")


@query("C26_feature_importance")
def importance(ctx: Context) -> DataFrame:
    return forest(ctx).importance.orderBy("rank")


@query("C27_best_linear_projection", compose(f"""
  SELECT 'lag1_trip_count' AS feature, {real('b1_cate', 'coefficient')} FROM proj
  UNION ALL SELECT 'peak_share', {real('b2_cate', 'coefficient')} FROM proj""",
    MONTH, extra={**CATE, "proj": f"SELECT {plane('cate')} FROM cate"}))
def projection(ctx: Context) -> DataFrame:
    return cate.best_linear_projection(linear_cate(ctx))


TOC = {
    **CATE,
    "ranked": """SELECT *, row_number() OVER (ORDER BY cate DESC, zone_id, date) AS r,
        count(*) OVER () AS n FROM cate""",
    "toc": """SELECT k/10.0::DOUBLE AS fraction, avg(y) FILTER (t=1) - avg(y) FILTER (t=0)
        AS ate_top_q, count(*) AS n_targeted
      FROM ranked, (SELECT unnest(generate_series(1, 10)) AS k)
      WHERE r <= ceil(k*n/10.0) GROUP BY k""",
}


@query("C28_targeting_curve", compose(f"""
  SELECT {real('fraction')}, {real('ate_top_q')}, {whole('n_targeted')} FROM toc""",
    MONTH, extra=TOC))
def targeting(ctx: Context) -> DataFrame:
    return cate.targeting_curve(cate_rows(ctx))


_PARTIAL = {
    **TOC, **{("r_" + k if k == "planes" else k): v.replace("planes", "r_planes")
              for k, v in residual_ctes().items()},
    "paired": """SELECT c.cate, c.zone_id, c.date, rd, ry,
        row_number() OVER (ORDER BY cate DESC, c.zone_id, c.date) AS r, count(*) OVER () AS n
      FROM cate c JOIN res s ON s.zone_id = c.zone_id AND s.date = c.date WHERE s.rep = 0""",
}


@query("C28_targeting_curve_partial", compose(f"""
  SELECT {real('fraction')}, {real('ate_top_q')}, {whole('n_targeted')}, {real('partial_top_q')}
  FROM toc JOIN (SELECT k/10.0::DOUBLE AS fraction, sum(rd*ry)/sum(rd*rd) AS partial_top_q
                 FROM paired, (SELECT unnest(generate_series(1, 10)) AS k)
                 WHERE r <= ceil(k*n/10.0) GROUP BY k) USING (fraction)""", MONTH, extra=_PARTIAL))
def targeting_partial(ctx: Context) -> DataFrame:
    res = dml.cross_fit_residuals(
        feature_panel(ctx), PAIR, ["treat_binary", *TWO], "ols", FOLDS, REPS)
    first = res.where(F.col("rep") == 0).select(
        "zone_id", "date", F.col("r_treat_binary").alias("r_t"),
        F.col("r_log_trip_count").alias("r_y"))
    return cate.targeting_curve(cate_rows(ctx), residuals=first)


@query("C28_rate_score", compose(f"""
  SELECT {real('avg(ate_top_q)', 'rate_score')} FROM toc""", MONTH, extra=TOC))
def rate(ctx: Context) -> DataFrame:
    return cate.rate_score(cate.targeting_curve(cate_rows(ctx)))


def _cuts(source: str) -> str:
    """Best cut per node of ``source`` (node, cate, x1, x2): least squared error, then feature, then value."""
    sides = " UNION ALL ".join(f"SELECT node, {i} AS f, x{i + 1} AS v, cate FROM {source}" for i in range(2))
    return f"""
  SELECT node, f, (v+nv)/2 AS at FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) AS place FROM (
      SELECT node, f, v, nv,
        round(s*s/n + (ss-s)*(ss-s)/(nn-n) - ss*ss/nn, 9) AS gain
      FROM (SELECT node, f, v, sum(n) OVER up AS n, sum(s) OVER up AS s, lead(v) OVER up AS nv,
              sum(n) OVER (PARTITION BY node, f) AS nn, sum(s) OVER (PARTITION BY node, f) AS ss
            FROM (SELECT node, f, v, count(*)::DOUBLE AS n, sum(cate) AS s FROM ({sides}) GROUP BY ALL)
            WINDOW up AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING))
      WHERE nv IS NOT NULL) WHERE gain > 0) WHERE place = 1"""


def _side(node: str) -> tuple[str, str]:
    low = f"(CASE {node}.f WHEN 0 THEN x1 ELSE x2 END <= {node}.at)"
    name = f"CASE {node}.f WHEN 0 THEN 'lag1_trip_count' ELSE 'peak_share' END"
    text = f"{name} || CASE WHEN {low} THEN ' <= ' ELSE ' > ' END || printf('%.4f', {node}.at)"
    return low, text


TREE = {
    **CATE,
    "top": "SELECT 0 AS node, cate, x1, x2 FROM cate",
    "cut0": _cuts("top"),
    "half0": f"""SELECT CASE WHEN c.f IS NULL THEN NULL WHEN {_side('c')[0]} THEN 0 ELSE 1 END AS node, cate, x1, x2,
        CASE WHEN c.f IS NULL THEN 'all' ELSE {_side('c')[1]} END AS rule
      FROM top LEFT JOIN cut0 c USING (node)""",
    "cut1": _cuts("half0"),
    "leaf": f"""SELECT cate, h.rule || CASE WHEN c.f IS NULL THEN '' ELSE ' and ' || {_side('c')[1]} END AS rule
      FROM half0 h LEFT JOIN cut1 c USING (node)""",
}


@query("C29_policy_tree_linear", compose(f"""
  SELECT rule, {whole('count(*)', 'n')}, {real('avg(cate)', 'mean_cate')} FROM leaf GROUP BY rule""",
    MONTH, extra=TREE))
def tree_linear(ctx: Context) -> DataFrame:
    return cate.policy_tree(linear_cate(ctx))


@query("C29_policy_tree")
def tree(ctx: Context) -> DataFrame:
    return cate.policy_tree(forest(ctx))


@query("C29_policy_tree_totals", compose(f"""
  SELECT {whole('count(*)', 'n')}, {real('avg(cate)', 'mean_cate')}, {whole('0', 'unmatched')}
  FROM cate""", MONTH, extra=CATE))
def tree_totals(ctx: Context) -> DataFrame:
    """Leaves of the tree on the linear effects must partition its rows."""
    leaves = cate.policy_tree(linear_cate(ctx))
    return leaves.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean_cate")) / F.sum("n")).alias("mean_cate"),
        F.count_if(F.col("rule").isNull()).alias("unmatched"))


ZONE_CATE = """SELECT zone_id, avg(cate) AS cate, avg(cate_low) AS cate_low,
    avg(cate_high) AS cate_high, avg(cate_se) AS cate_se FROM cate GROUP BY 1"""


@query("C30_zone_cate", compose(f"""
  SELECT {whole('zone_id')}, {BANDS} FROM ({ZONE_CATE})""", MONTH, extra=CATE))
def by_zone(ctx: Context) -> DataFrame:
    return cate.zone_cate(cate_rows(ctx))


def group_sql(group: str, label: str, source: str = "cate") -> str:
    return f"""SELECT {group} AS {label}, avg(cate) AS mean_cate, stddev_samp(cate) AS std_cate,
      count(cate) AS n, stddev_samp(cate)/sqrt(count(cate)) AS se_cate FROM {source}
      WHERE {group} IS NOT NULL GROUP BY {group}"""


GROUP_COLUMNS = ", ".join([
    real("mean_cate"), real("std_cate"), whole("n"), real("se_cate"),
    real("mean_cate-1.96*se_cate", "ci_low"), real("mean_cate+1.96*se_cate", "ci_high")])


@query("C31_cate_by_borough", compose(f"""
  SELECT borough, {GROUP_COLUMNS} FROM ({group_sql('borough', 'borough')})""", MONTH, extra=CATE))
def by_borough(ctx: Context) -> DataFrame:
    return cate.cate_by_group(cate_rows(ctx), ctx.panel(), "borough")


@query("C31_cate_by_peak", compose(f"""
  SELECT {whole('is_peak')}, {GROUP_COLUMNS}
  FROM ({group_sql('(peak_share >= 0.5)::INTEGER', 'is_peak')})""", MONTH, extra=CATE))
def by_peak(ctx: Context) -> DataFrame:
    return cate.cate_by_group(cate_rows(ctx), cate.add_peak_flag(ctx.panel()), "is_peak")


@query("C31_cate_by_weekend", compose(f"""
  SELECT {whole('weekend_flag')}, {GROUP_COLUMNS}
  FROM ({group_sql('weekend_flag', 'weekend_flag')})""", MONTH, extra=CATE))
def by_weekend(ctx: Context) -> DataFrame:
    return cate.cate_by_group(cate_rows(ctx), ctx.panel(), "weekend_flag")


@query("C32_cate_summary", compose(f"""
  SELECT {real('avg(cate)', 'mean_cate')}, {real('stddev_pop(cate)', 'std_cate')},
    {real('avg((abs(cate/(cate_se+1e-8)) > 1.96)::INTEGER)*100', 'pct_significant')},
    {whole('count(*)', 'n')} FROM cate""", MONTH, extra=CATE))
def summary(ctx: Context) -> DataFrame:
    return cate.cate_summary(cate_rows(ctx))


@query("J5_cate_join_panel", compose(f"""
  SELECT {whole('c.zone_id', 'zone_id')}, {day('c.date', 'date')}, {BANDS},
    {whole('p.trip_count', 'trip_count')}, p.borough AS borough
  FROM cate c JOIN {MONTH} p ON p.zone_id = c.zone_id AND p.date = c.date""", MONTH, extra=CATE))
def joined(ctx: Context) -> DataFrame:
    return cate.with_panel(cate_rows(ctx), ctx.panel(), ["trip_count", "borough"])
