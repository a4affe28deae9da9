"""Synthetic difference-in-differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplepanel.catalog.registry import Context, query
from ripplepanel.catalog.sqltext import SHOCK, compose, day, hash32, real, whole
from ripplepanel.operators import synth

REPS = 200

_CELLS = {
    "weekly": """SELECT zone_id, week, max(treat_binary) AS treat_binary, avg(log_trip_count) AS y
      FROM panel_week_1 GROUP BY ALL""",
    "cells": f"""SELECT u.zone_id, w.week, u.treat_binary, coalesce(y, 0) AS y, w.week < {SHOCK} AS is_pre
      FROM (SELECT zone_id, max(treat_binary) AS treat_binary FROM weekly GROUP BY 1) u
      CROSS JOIN (SELECT DISTINCT week FROM weekly) w
      LEFT JOIN weekly c ON c.zone_id = u.zone_id AND c.week = w.week""",
}
_UNIFORM = {
    **_CELLS,
    "size": """SELECT count(DISTINCT zone_id) FILTER (treat_binary=1) AS t,
        count(DISTINCT zone_id) FILTER (treat_binary=0) AS c FROM cells""",
    "roles": f"""SELECT 0 AS rep, zone_id, max(treat_binary) AS treated FROM cells GROUP BY zone_id
      UNION ALL
      SELECT rep, zone_id, (row_number() OVER (PARTITION BY rep ORDER BY
          {hash32('zone_id', 'rep', seed=42)}, zone_id)
          <= (SELECT CASE WHEN c <= t THEN c//2 ELSE t END FROM size))::INTEGER
      FROM (SELECT DISTINCT zone_id FROM cells WHERE treat_binary = 0),
           (SELECT unnest(generate_series(1, {REPS})) AS rep)""",
    "tau": """SELECT rep,
        (avg(y) FILTER (treated=1 AND NOT is_pre) - avg(y) FILTER (treated=1 AND is_pre))
        - (avg(y) FILTER (treated=0 AND NOT is_pre) - avg(y) FILTER (treated=0 AND is_pre)) AS tau
      FROM cells JOIN roles USING (zone_id) GROUP BY 1""",
}


def cells_of(ctx: Context) -> DataFrame:
    return ctx.shared("sdid_cells", lambda: synth.weekly_cells(ctx.weeks(), ctx.policy))


def roles_of(ctx: Context) -> DataFrame:
    return ctx.shared("sdid_roles", lambda: synth.replicate_roles(cells_of(ctx), REPS))


def solved(ctx: Context) -> synth.Weights:
    def build() -> DataFrame:
        w = synth.solved_weights(cells_of(ctx), roles_of(ctx))
        return w.unit.unionByName(w.time, allowMissingColumns=True)

    both = ctx.shared("sdid_weights", build)
    return synth.Weights(
        both.where(F.col("zone_id").isNotNull()).select("rep", "zone_id", "w"),
        both.where(F.col("week").isNotNull()).select("rep", "week", "w"))


@query("C13_sdid_cells", compose(f"""
  SELECT {whole('zone_id')}, {day('week')}, {whole('treat_binary')}, {real('y')},
    {whole('is_pre')} FROM cells""", "panel_week_1", extra=_CELLS))
def cells(ctx: Context) -> DataFrame:
    return synth.weekly_cells(ctx.weeks(), ctx.policy)


@query("C13_sdid_cells_complete_units", compose(f"""
  SELECT {whole('zone_id')}, {day('week')}, {whole('treat_binary')}, {real('y')},
    {whole(f'week < {SHOCK}', 'is_pre')} FROM (
    SELECT zone_id, date_trunc('month', week)::DATE AS week, max(treat_binary) AS treat_binary, avg(y) AS y
    FROM weekly GROUP BY 1, 2)
  WHERE zone_id IN (
    SELECT zone_id FROM weekly GROUP BY 1
    HAVING count(DISTINCT date_trunc('month', week)) = (SELECT count(DISTINCT date_trunc('month', week)) FROM weekly))""",
    "panel_week_1", extra=_CELLS))
def cells_complete(ctx: Context) -> DataFrame:
    # a period that most units have: months of the weekly means
    months = ctx.weeks().groupBy("zone_id", "week").agg(
        F.max("treat_binary").alias("treat_binary"), F.avg("log_trip_count").alias("log_trip_count"))
    months = months.withColumn("week", F.trunc("week", "month"))
    return synth.weekly_cells(months, ctx.policy, missing="drop")


@query("C14_unit_weights")
def unit_weights(ctx: Context) -> DataFrame:
    return solved(ctx).unit.where(F.col("rep") == 0).select("zone_id", "w")


@query("C15_time_weights")
def time_weights(ctx: Context) -> DataFrame:
    return solved(ctx).time.where(F.col("rep") == 0).select("week", "w")


@query("C14_C15_weight_checks", compose(f"""
  SELECT 'unit' AS kind, {whole('count(DISTINCT zone_id)', 'n')}, {real('1', 'total')},
    {whole('0', 'negative')}, {whole('1', 'optimal')} FROM cells WHERE treat_binary = 0
  UNION ALL
  SELECT 'time', {whole('count(DISTINCT week)', 'n')}, {real('1', 'total')},
    {whole('0', 'negative')}, {whole('1', 'optimal')} FROM cells WHERE is_pre""",
    "panel_week_1", extra=_CELLS))
def checks(ctx: Context) -> DataFrame:
    return synth.weight_checks(cells_of(ctx), roles_of(ctx), solved(ctx))


@query("C16_sdid")
def estimate(ctx: Context) -> DataFrame:
    return ctx.shared("sdid", lambda: synth.sdid(ctx.weeks(), ctx.policy, reps=REPS))


@query("C16_sdid_uniform", compose(f"""
  SELECT 'log_trip_count' AS outcome, {real('t', 'tau_hat')}, {real('s', 'se')},
    {real('t-1.96*s', 'ci_low')}, {real('t+1.96*s', 'ci_high')}, {whole('n1', 'n_treated')},
    {whole('n0', 'n_control')}, {whole('a', 't_pre')}, {whole('b', 't_post')},
    {whole('0', 'n_dropped')}
  FROM (SELECT max(tau) FILTER (rep=0) AS t, stddev_samp(tau) FILTER (rep>0) AS s FROM tau),
    (SELECT t AS n1, c AS n0 FROM size),
    (SELECT count(DISTINCT week) FILTER (is_pre) AS a,
            count(DISTINCT week) FILTER (NOT is_pre) AS b FROM cells)""", "panel_week_1", extra=_UNIFORM))
def estimate_uniform(ctx: Context) -> DataFrame:
    return synth.sdid(ctx.weeks(), ctx.policy, reps=REPS, uniform=True)


@query("C17_placebo_effects")
def placebo(ctx: Context) -> DataFrame:
    return synth.replicate_tau(cells_of(ctx), roles_of(ctx), solved(ctx)).where(F.col("rep") > 0)


@query("C17_placebo_effects_uniform", compose(f"""
  SELECT {whole('rep')}, {real('tau')} FROM tau WHERE rep > 0""", "panel_week_1", extra=_UNIFORM))
def placebo_uniform(ctx: Context) -> DataFrame:
    w = synth.uniform_weights(cells_of(ctx), roles_of(ctx))
    return synth.replicate_tau(cells_of(ctx), roles_of(ctx), w).where(F.col("rep") > 0)


@query("C17_placebo_roles", compose(f"""
  SELECT {whole('rep')}, {whole('zone_id')}, {whole('treated')} FROM roles""",
    "panel_week_1", extra=_UNIFORM))
def roles(ctx: Context) -> DataFrame:
    return synth.replicate_roles(cells_of(ctx), REPS)
