"""Synthetic difference-in-differences with placebo inference.

The real fit is replicate 0, placebo fits are replicates 1..B. A unit is one row:
its series before the shock, its mean after it, and its role in every replicate
as an array. Tasks hold batches of such rows; what leaves them is a few vectors
along the time axis per replicate, whatever the number of units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.functions.columns import portable_hash
from ripplepanel.operators.within import Z95
from ripplepanel.policy import Policy
from ripplepanel.session import cut

# units that may enter a replicate's working set in one scan
ENTRIES_PER_SCAN = 4


def weekly_cells(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count", missing: str = "zero"
) -> DataFrame:
    """Mean outcome per unit and week on a complete grid.

    ``missing="zero"`` fills gaps with 0; "drop" leaves out units without every
    week (``sdid`` says how many). The grid comes from exploding each unit over the week sequence.
    """
    weekly = panel.groupBy("zone_id", "week").agg(
        F.max("treat_binary").alias("treat_binary"), F.avg(outcome).alias("y"))
    weeks = weekly.agg(F.count_distinct("week")).scalar()
    if missing == "drop":
        full = weekly.groupBy("zone_id").agg(F.count("y").alias("_n")).where(
            F.col("_n") == weeks).select("zone_id")
        cells = weekly.join(full, "zone_id", "left_semi")
    else:
        # as many entries as there are weeks, whatever the number of units
        all_weeks = weekly.agg(F.array_sort(F.collect_set("week"))).scalar()
        units = weekly.groupBy("zone_id").agg(F.max("treat_binary").alias("treat_binary"))
        grid = units.withColumn("week", F.explode(all_weeks))
        cells = grid.join(weekly.select("zone_id", "week", "y"), ["zone_id", "week"], "left")
        cells = cells.withColumn("y", F.coalesce("y", F.lit(0.0)))
    return cells.select(
        "zone_id", "week", "treat_binary", "y",
        (F.col("week") < policy.shock_lit()).alias("is_pre"))


def replicate_roles(cells: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """(rep, zone_id, treated): the real assignment and ``reps`` placebo ones.

    A placebo treats as many controls as there are treated units, the first in
    the order of a hash of (unit, replicate); with too few controls, half.
    """
    units = cells.select("zone_id", "treat_binary").distinct()
    counts = units.agg(
        F.sum("treat_binary").alias("t"), F.sum(1 - F.col("treat_binary")).alias("c")).first()
    take = int(counts["t"] or 0)
    if (counts["c"] or 0) <= take:
        take = int(counts["c"] or 0) // 2
    real = units.select(F.lit(0).alias("rep"), "zone_id", F.col("treat_binary").alias("treated"))
    if reps <= 0:
        return real
    controls = units.where(F.col("treat_binary") == 0).select("zone_id")
    drawn = controls.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = Window.partitionBy("rep").orderBy(
        portable_hash("zone_id", "rep", seed=seed), "zone_id")
    # a filter on row_number lets Spark keep only the first rows of each task
    chosen = drawn.withColumn("_at", F.row_number().over(order)).where(
        F.col("_at") <= take).select("rep", "zone_id", F.lit(1).alias("_in"))
    placebo = drawn.join(chosen, ["rep", "zone_id"], "left").select(
        "rep", "zone_id", F.coalesce("_in", F.lit(0)).alias("treated"))
    return real.unionByName(placebo)


@dataclass(frozen=True)
class Weights:
    """unit: (rep, zone_id, w) of controls; time: (rep, week, w) before the shock."""

    unit: DataFrame
    time: DataFrame


def uniform_weights(cells: DataFrame, roles: DataFrame) -> Weights:
    controls = roles.where(F.col("treated") == 0)
    per_rep = controls.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"))
    unit = controls.join(per_rep, "rep").select("rep", "zone_id", (1 / F.col("_n")).alias("w"))
    pre = cells.where("is_pre").select("week").distinct()
    n = pre.agg(F.count(F.lit(1))).scalar()
    reps = roles.agg(F.array_sort(F.collect_set("rep"))).scalar()
    time = pre.select(F.explode(reps).alias("rep"), "week", (1 / n).alias("w"))
    return Weights(unit, time)


def simplex_least_squares(a: np.ndarray, b: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """argmin ||a w - b||^2 + ridge ||w||^2 over the simplex."""
    return simplex_from_products(
        a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b, max(float(b @ b), 1e-12))


def simplex_from_products(
    gram: np.ndarray, target: np.ndarray, scale: float, tol: float = 1e-12
) -> np.ndarray:
    """argmin w' gram w - 2 target' w over the simplex.

    An active set of positive weights is solved exactly and grows by the point
    with the lowest gradient; a weight that would turn negative leaves. Should
    ties keep it from ending, projected gradient finishes the job.
    """
    n = len(target)
    w = np.zeros(n)
    w[int(np.argmin(np.diag(gram) - 2 * target))] = 1.0
    for _ in range(20 * n + 100):
        g = gram @ w - target
        if w @ g - g.min() <= tol * scale:
            return w
        live = np.union1d(np.nonzero(w > 0)[0], [int(np.argmin(g))])
        while True:
            k = len(live)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = gram[np.ix_(live, live)], 1.0, 1.0
            goal = np.linalg.lstsq(system, np.append(target[live], 1.0), rcond=1e-14)[0][:k]
            falling = goal <= 0
            if not falling.any():
                w = np.zeros(n)
                w[live] = goal
                break
            now = w[live]
            ratio = now[falling] / np.maximum(now[falling] - goal[falling], 1e-300)
            moved = np.maximum(now + ratio.min() * (goal - now), 0.0)
            moved[np.nonzero(falling)[0][int(np.argmin(ratio))]] = 0.0
            w = np.zeros(n)
            w[live] = moved / moved.sum()
            live = live[moved > 0]
    return _projected_gradient(gram, target, scale, tol, w)


def _projected_gradient(
    gram: np.ndarray, target: np.ndarray, scale: float, tol: float, w: np.ndarray
) -> np.ndarray:
    """Accelerated steps, restarted when the momentum turns uphill."""
    step = 1.0 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-300)
    z, momentum = w.copy(), 1.0
    for _ in range(50_000):
        new = _to_simplex(z - step * (gram @ z - target))
        if (z - new) @ (new - w) > 0:
            momentum, z = 1.0, w
            new = _to_simplex(z - step * (gram @ z - target))
        nxt = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        z = new + (momentum - 1) / nxt * (new - w)
        w, momentum = new, nxt
        g = gram @ w - target
        if w @ g - g.min() <= tol * scale:
            return w
    if w @ g - g.min() > max(tol, 1e-8) * scale:
        raise RuntimeError(f"simplex weights off by {w @ g - g.min():g} after 50,000 steps")
    return w


def _to_simplex(v: np.ndarray) -> np.ndarray:
    ordered = np.sort(v)[::-1]
    excess = (np.cumsum(ordered) - 1) / np.arange(1, len(v) + 1)
    last = np.nonzero(ordered > excess)[0][-1]
    return np.maximum(v - excess[last], 0.0)


def unit_points(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per unit: ``a`` its values before the shock by week, ``d`` its mean
    after it, ``roles`` an array with 1 (treated), 0 (control) or -1 (no part) per replicate."""
    series = cells.groupBy("zone_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_pre"), F.struct("week", "y")))).alias("_s"),
        F.avg(F.when(~F.col("is_pre"), F.col("y"))).alias("d")
    ).select("zone_id", F.transform("_s", lambda c: c["y"]).alias("a"), "d")
    # an array of as many entries as there are replicates
    last = roles.agg(F.max("rep")).first()[0] or 0
    parts = roles.groupBy("zone_id").agg(F.map_from_entries(
        F.collect_list(F.struct("rep", "treated"))).alias("_m"))
    parts = parts.select("zone_id", F.transform(
        F.sequence(F.lit(0), F.lit(last)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(-1))
    ).alias("roles"))
    return series.join(parts, "zone_id")


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.array(pdf["a"].to_list(), float).reshape(len(pdf), -1),
            pdf["d"].to_numpy(float), np.array(pdf["roles"].to_list()))


def _replicate_sums(batches):
    """Per replicate the moments of its treated and control units, added up over a task.

    ``goal`` sums the treated series; ``gram`` is X'X of its controls with
    X = [1, a, d], so any column can be centred later.
    """
    goal: dict[int, np.ndarray] = {}
    gram: dict[int, np.ndarray] = {}
    size: dict[int, int] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        a, d, roles = _arrays(pdf)
        x = np.column_stack([np.ones(len(a)), a, d])
        for rep in range(roles.shape[1]):
            treated, control = roles[:, rep] == 1, roles[:, rep] == 0
            goal[rep] = goal.get(rep, 0.0) + a[treated].sum(axis=0)
            size[rep] = size.get(rep, 0) + int(treated.sum())
            gram[rep] = gram.get(rep, 0.0) + x[control].T @ x[control]
    for rep in goal:
        yield pd.DataFrame({"rep": np.array([rep], np.int32), "n": [size[rep]], "goal": [goal[rep].tolist()],
                            "gram": [gram[rep].ravel().tolist()]})


def solved_weights(
    cells: DataFrame, roles: DataFrame, ridge: float = 1e-6, intercept: bool = False,
    tol: float = 1e-9, max_rounds: int = 500,
) -> Weights:
    """Unit weights that match treated weeks before the shock, and time weights
    that match control means after it. ``intercept`` lets levels differ.

    One way for any number of units. Time weights need one week x week matrix of
    sums per replicate, solved in that replicate's task. Unit weights grow a
    working set: each round scans all units once for those that lower the
    objective most, per replicate, and re-solves on the set, until none does.
    """
    points = cut(unit_points(cells, roles), "points")
    weeks = [r[0] for r in cells.where("is_pre").select("week").distinct().orderBy("week").collect()]
    sums = cut(points.select("a", "d", "roles").mapInPandas(
        _replicate_sums, "rep int, n long, goal array<double>, gram array<double>"), "moments")
    width = len(weeks)

    def time_weights(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sum([np.array(g) for g in pdf["gram"]], axis=0).reshape(width + 2, width + 2)
        if m[0, 0] == 0:
            return pd.DataFrame({"rep": [], "week": [], "w": []}).astype({"rep": "int32"})
        if intercept:
            m = m - np.outer(m[0], m[0]) / m[0, 0]
        # by distance from the mean after the shock, as for units
        near = m[1:-1, 1:-1] - m[1:-1, -1:] - m[-1:, 1:-1] + m[-1, -1]
        w = simplex_from_products(near, np.zeros(width), max(m[-1, -1], 1e-12), 1e-11)
        return pd.DataFrame({"rep": pdf["rep"].iloc[0], "week": weeks, "w": w}).astype({"rep": "int32"})

    time = cut(sums.select("rep", "gram").groupBy("rep").applyInPandas(
        time_weights, "rep int, week date, w double"), "time_weights")

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        total = np.sum([np.array(g) for g in pdf["goal"]], axis=0)
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "goal": [(total / max(n, 1)).tolist()]}).astype({"rep": "int32"})

    # a vector along the time axis per replicate
    goal = {r["rep"]: np.array(r["goal"], float) for r in sums.select("rep", "n", "goal").groupBy(
        "rep").applyInPandas(means, "rep int, goal array<double>").collect()}
    unit = _grow_unit_weights(points, goal, ridge, intercept, tol, max_rounds)
    return Weights(unit, time)


def _scan(
    residual: dict[int, np.ndarray], goal: dict[int, np.ndarray], held: dict[int, list[int]],
    intercept: bool, most: int,
):
    """Per task and replicate the controls outside the working set with the lowest gradient."""
    reps = sorted(residual)
    matrix = np.array([residual[r] for r in reps]).reshape(len(reps), -1)
    shift = np.array([goal[r] @ residual[r] for r in reps])

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            a, _, roles = _arrays(pdf)
            if intercept:
                a = a - a.mean(axis=1, keepdims=True)
            score = a @ matrix.T - shift
            score[roles[:, reps] != 0] = np.inf
            zones = pdf["zone_id"].to_numpy()
            for k, rep in enumerate(reps):
                score[np.isin(zones, held[rep]), k] = np.inf
                best = np.lexsort((zones, score[:, k]))[:most]
                best = best[np.isfinite(score[best, k])]
                if len(best):
                    yield pd.DataFrame({"rep": np.full(len(best), rep, np.int32), "g": score[best, k],
                                        "zone_id": zones[best], "a": list(a[best])})

    return run


def _grow_unit_weights(
    points: DataFrame, goal: dict[int, np.ndarray], ridge: float, intercept: bool, tol: float,
    max_rounds: int,
) -> DataFrame:
    spark = points.sparkSession
    if intercept:
        goal = {rep: b - b.mean() for rep, b in goal.items()}
    held: dict[int, dict[int, np.ndarray]] = {rep: {} for rep in goal}
    weight = {rep: np.zeros(0) for rep in goal}
    open_reps = set(goal)
    rows = points.select("zone_id", "a", "d", "roles")
    top = Window.partitionBy("rep").orderBy("g", "zone_id")
    for _ in range(max_rounds):
        residual = {rep: (np.column_stack(list(held[rep].values())) @ weight[rep] if held[rep] else 0.0) - goal[rep]
                    for rep in open_reps}
        found = rows.mapInPandas(
            _scan(residual, goal, {r: list(held[r]) for r in open_reps}, intercept, ENTRIES_PER_SCAN), "rep int, g double, zone_id long, a array<double>")
        best: dict[int, list] = {}
        for r in found.withColumn("_at", F.row_number().over(top)).where(
                F.col("_at") <= ENTRIES_PER_SCAN).drop("_at").orderBy("rep", "g", "zone_id").collect():
            best.setdefault(r["rep"], []).append(r)
        for rep in list(open_reps):
            fresh, b = best.get(rep, []), goal[rep]
            scale = max(float(b @ b), 1e-12)
            if held[rep]:
                # weights add up to 1, so units count by their distance from the goal: no digits cancel
                own = (np.column_stack(list(held[rep].values())) - b[:, None]).T @ residual[rep] + ridge * weight[rep]
                gap = weight[rep] @ own - min(float(own.min()), *(r["g"] for r in fresh[:1]), np.inf)
                if gap <= tol * scale:
                    open_reps.discard(rep)
                    continue
                if not fresh:
                    raise RuntimeError(f"replicate {rep}: weights off by {gap:g} with no unit left to add")
            elif not fresh:  # no controls
                open_reps.discard(rep)
                continue
            for r in fresh:
                held[rep][r["zone_id"]] = np.array(r["a"], float)
            a = np.column_stack(list(held[rep].values())) - b[:, None]
            weight[rep] = simplex_from_products(
                a.T @ a + ridge * np.eye(a.shape[1]), np.zeros(a.shape[1]), scale, tol / 10)
            # units without weight leave; a later scan may bring them back
            keep = weight[rep] > 0
            if len(keep) > 4 * ENTRIES_PER_SCAN + 2 * keep.sum():
                held[rep] = {z: v for (z, v), k in zip(held[rep].items(), keep) if k}
                weight[rep] = weight[rep][keep]
        if not open_reps:
            found_rows = [(int(rep), int(z), float(w)) for rep in goal
                          for z, w in zip(held[rep], weight[rep]) if w > 0]
            return spark.createDataFrame(found_rows, "rep int, zone_id long, w double")
    raise RuntimeError(f"weights did not settle in {max_rounds} rounds")


def replicate_tau(cells: DataFrame, roles: DataFrame, weights: Weights) -> DataFrame:
    """(rep, tau): the effect is the sum of unit weight x (mean after - weighted mean before).

    A treated unit weighs 1/n, a control -w. Series stand once per unit; what is
    paired with replicates are units that carry weight.
    """
    treated = roles.where(F.col("treated") == 1)
    n_treated = treated.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"))
    units = treated.join(n_treated, "rep").select(
        "rep", "zone_id", (1 / F.col("_n")).alias("u")
    ).unionByName(weights.unit.select("rep", "zone_id", (-F.col("w")).alias("u")))
    series = cells.groupBy("zone_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_pre"), F.struct("week", "y")))).alias("_s"),
        F.avg(F.when(~F.col("is_pre"), F.col("y"))).alias("d"))
    series = series.select("zone_id", F.transform("_s", lambda c: c["y"]).alias("a"), "d")
    before = weights.time.groupBy("rep").agg(
        F.array_sort(F.collect_list(F.struct("week", "w"))).alias("_w"))
    before = before.select("rep", F.transform("_w", lambda c: c["w"]).alias("v"))
    dot = F.aggregate(F.zip_with("a", "v", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return units.join(series, "zone_id").join(before, "rep").groupBy("rep").agg(
        F.sum(F.col("u") * (F.col("d") - dot)).alias("tau"))


def sdid(
    panel: DataFrame, policy: Policy, outcome: str = "log_trip_count", reps: int = 200,
    seed: int = 42, uniform: bool = False, ridge: float = 1e-6, intercept: bool = False,
    missing: str = "zero",
) -> DataFrame:
    """One row: effect, placebo standard error, interval and sizes.

    ``n_dropped`` counts units left out for a missing week. Without treated or
    control units left, the effect is null.
    """
    cells = cut(weekly_cells(panel, policy, outcome, missing), "cells")
    roles = cut(replicate_roles(cells, reps, seed), "roles")
    weights = uniform_weights(cells, roles) if uniform else solved_weights(
        cells, roles, ridge, intercept)
    taus = replicate_tau(cells, roles, weights)
    est = taus.agg(
        F.max(F.when(F.col("rep") == 0, F.col("tau"))).alias("tau_hat"),
        F.stddev_samp(F.when(F.col("rep") > 0, F.col("tau"))).alias("se"))
    size = cells.agg(
        F.count_distinct(F.when(F.col("treat_binary") == 1, F.col("zone_id"))).alias("n_treated"),
        F.count_distinct(F.when(F.col("treat_binary") == 0, F.col("zone_id"))).alias("n_control"),
        F.count_distinct(F.when(F.col("is_pre"), F.col("week"))).alias("t_pre"),
        F.count_distinct(F.when(~F.col("is_pre"), F.col("week"))).alias("t_post"),
        F.struct(F.lit(1)).alias("_")).drop("_")
    sizes = {c: size.select(c).scalar() for c in size.columns}
    units = panel.agg(F.count_distinct("zone_id")).scalar()
    sizes["n_dropped"] = units - sizes["n_treated"] - sizes["n_control"]
    return est.select(
        F.lit(outcome).alias("outcome"), "tau_hat", "se",
        (F.col("tau_hat") - Z95 * F.col("se")).alias("ci_low"),
        (F.col("tau_hat") + Z95 * F.col("se")).alias("ci_high"),
        *[v.alias(c) for c, v in sizes.items()])


def weight_checks(cells: DataFrame, roles: DataFrame, weights: Weights, ridge: float = 1e-6) -> DataFrame:
    """Per kind of weights of the real fit: count, sum, least weight, optimality.

    Optimal means no point could take weight and lower the objective: the
    weighted mean of the gradient equals its minimum.
    """
    real = roles.where(F.col("rep") == 0)
    held = cells.where("is_pre").join(real, "zone_id")
    target = held.where(F.col("treated") == 1).groupBy("week").agg(F.avg("y").alias("b"))
    w_unit = weights.unit.where(F.col("rep") == 0).drop("rep")
    w_time = weights.time.where(F.col("rep") == 0).drop("rep")
    control = held.where(F.col("treated") == 0).select("zone_id", "week", "y")
    fit = control.join(w_unit, "zone_id").groupBy("week").agg(F.sum(F.col("w") * F.col("y")).alias("f"))
    r_unit = fit.join(target, "week").select("week", (F.col("f") - F.col("b")).alias("r"))
    g_unit = control.join(r_unit, "week").groupBy("zone_id").agg(
        F.sum(F.col("y") * F.col("r")).alias("g")).join(w_unit, "zone_id", "left").withColumn(
        "w", F.coalesce("w", F.lit(0.0))).select(
        F.lit("unit").alias("kind"), "w", (F.col("g") + F.lit(ridge) * F.col("w")).alias("g"))
    after = cells.where(~F.col("is_pre")).groupBy("zone_id").agg(F.avg("y").alias("b"))
    fit_t = control.join(w_time, "week").groupBy("zone_id").agg(F.sum(F.col("w") * F.col("y")).alias("f"))
    r_time = fit_t.join(after, "zone_id").select("zone_id", (F.col("f") - F.col("b")).alias("r"))
    g_time = control.join(r_time, "zone_id").groupBy("week").agg(
        F.sum(F.col("y") * F.col("r")).alias("g")).join(w_time, "week").select(
        F.lit("time").alias("kind"), "w", "g")
    return g_unit.unionByName(g_time).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"),
        F.count_if(F.col("w") < 0).alias("negative"),
        (F.sum(F.col("w") * F.col("g")) - F.min("g") < 1e-6).cast("int").alias("optimal"))
