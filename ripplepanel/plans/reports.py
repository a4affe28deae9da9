"""Result tables: estimators side by side, formatted effects, robustness, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import EM_DASH, fixed, stars
from ripplepanel.functions.tails import normal_two_sided

_ESTIMATE = ("estimator", "att", "se", "ci_low", "ci_high", "n_obs", "p_value", "pretrend_p", "note")


def _row(df: DataFrame, name: str, note: str, **columns: str) -> DataFrame:
    kinds = {"n_obs": "long"}
    out = []
    for c in _ESTIMATE:
        if c == "estimator":
            v = F.lit(name)
        elif c == "note":
            v = F.lit(note)
        elif c in columns:
            v = F.col(columns[c]).cast(kinds.get(c, "double"))
        else:
            v = F.lit(None).cast(kinds.get(c, "double"))
        out.append(v.alias(c))
    return df.select(*out)


def pct_text(att: Column, is_log: bool) -> Column:
    """Signed percent change of a log effect, one decimal."""
    if not is_log:
        return F.lit(EM_DASH)
    pct = F.floor(F.expm1(att) * 1000 + F.lit(0.5 + 1e-6)) / F.lit(10.0)
    return F.when(att.isNull(), EM_DASH).otherwise(F.format_string("%+.1f%%", pct))


def estimator_table(
    twfe: DataFrame, att: DataFrame, att_test: DataFrame, sdid: DataFrame,
    dml: DataFrame | None = None, outcome: str = "log_trip_count",
) -> DataFrame:
    """One row per estimator with interval, size, lead test and a starred effect."""
    tested = att.withColumn("_p", att_test.select("p_value").scalar())
    parts = [
        _row(twfe.where(F.col("outcome") == outcome), "TWFE DiD", "Two-way fixed effects",
             att="ate", se="se", ci_low="ci_low", ci_high="ci_high", n_obs="n_obs",
             p_value="p_value"),
        _row(tested, "Group-time DiD", "Mean of post effects", att="agg_att", pretrend_p="_p"),
        _row(sdid.where(F.col("outcome") == outcome), "Synthetic DiD", "Placebo standard error",
             att="tau_hat", se="se", ci_low="ci_low", ci_high="ci_high"),
    ]
    if dml is not None:
        parts.append(_row(
            dml.where(F.col("outcome") == outcome), "Double ML", "Cross-fitted nuisances",
            att="theta", se="se", ci_low="ci_low", ci_high="ci_high", n_obs="n_obs",
            p_value="p_value"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.withColumns({
        "att_display": F.concat(fixed(F.col("att")), stars(F.col("p_value"))),
        "pct_change": pct_text(F.col("att"), outcome.startswith("log")),
    })


def interval_text(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), fixed(low), F.lit(", "), fixed(high), F.lit("]"))


def in_parentheses(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(EM_DASH)).otherwise(F.concat(F.lit("("), fixed(c), F.lit(")")))


def dml_table(effects: DataFrame) -> DataFrame:
    sig = stars(F.col("p_value"))
    return effects.select(
        "outcome", F.concat(fixed(F.col("theta")), sig).alias("theta_text"),
        in_parentheses(F.col("se")).alias("se_text"),
        interval_text(F.col("ci_low"), F.col("ci_high")).alias("ci_text"), "n_obs",
        sig.alias("sig"))


def cate_table(by_borough: DataFrame, by_time: DataFrame | None = None) -> DataFrame:
    """Group effects of several dimensions under one set of columns."""
    def part(df: DataFrame, dimension: str) -> DataFrame:
        group = df.columns[0]
        p = normal_two_sided(F.abs("mean_cate") / (F.col("se_cate") + F.lit(1e-8)))
        sig = stars(p)
        return df.select(
            F.lit(dimension).alias("dimension"), F.col(group).cast("string").alias("level"),
            "mean_cate", "std_cate", "n", "se_cate", "ci_low", "ci_high", sig.alias("sig"),
            F.concat(fixed(F.col("mean_cate")), sig).alias("cate_text"))

    out = part(by_borough, "Borough")
    return out if by_time is None else out.unionByName(part(by_time, "Time of Day"))


def robustness_table(checks: DataFrame, main: DataFrame) -> DataFrame:
    """Checks as text with their distance from the main effect (one row, ``ate``)."""
    sig = F.when(F.col("p").isNull(), "").otherwise(stars(F.col("p")))
    return checks.select(
        "group", "check", F.concat(fixed(F.col("theta")), sig).alias("theta_text"),
        in_parentheses(F.col("se")).alias("se_text"),
        (F.col("theta") - main.select("ate").scalar()).alias("vs_main"), "status")


def pretrend_table(*tests: DataFrame) -> DataFrame:
    table = tests[0]
    for t in tests[1:]:
        table = table.unionByName(t)
    return table.withColumn(
        "verdict", F.when(F.col("p_value") > 0.05, "holds").otherwise("may be violated"))


def executive_summary(
    main: DataFrame, effects: DataFrame, cate_stats: DataFrame, drivers: DataFrame | None = None,
) -> DataFrame:
    """(metric, value, text) rows; percent change only where the outcome is a log."""
    def metric(df: DataFrame, name: Column | str, value: Column, text: Column) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        return df.select(label.alias("metric"), value.alias("value"), text.alias("text"))

    none = F.lit("")
    log = main.where(F.col("outcome").startswith("log"))
    parts = [
        metric(main, "DiD effect", F.col("ate"), stars(F.col("p_value"))),
        metric(log, "DiD percent change", F.col("pct_change"), pct_text(F.col("ate"), True)),
        metric(main, "DiD standard error", F.col("se"), none),
        metric(main, "DiD p-value", F.col("p_value"), none),
        metric(effects, F.concat(F.lit("DML effect "), F.col("outcome")), F.col("theta"),
               stars(F.col("p_value"))),
        metric(cate_stats, "Mean CATE", F.col("mean_cate"), none),
        metric(cate_stats, "Std CATE", F.col("std_cate"), none),
    ]
    if drivers is not None:
        top = drivers.orderBy(F.desc(F.abs(drivers.columns[1])), drivers.columns[0]).limit(1)
        parts.append(metric(top, "Top driver", F.col(drivers.columns[1]), F.col(drivers.columns[0])))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def significant_share(checks: DataFrame) -> DataFrame:
    """Percent of checks with p below 5%; a check without a p does not pass."""
    hit = F.coalesce((F.col("p") < 0.05).cast("int"), F.lit(0))
    return checks.agg((F.avg(hit) * 100).alias("pct_significant"), F.count(F.lit(1)).alias("checks"))
