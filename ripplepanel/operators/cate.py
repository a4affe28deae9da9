"""Heterogeneous effects: T-learner, residual forest, and what to read off them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplepanel.functions.columns import portable_hash
from ripplepanel.functions.ranking import global_rank, running_sums
from ripplepanel.operators.dml import cross_fit_residuals, fold_of
from ripplepanel.operators.replicates import poisson_weights, replicate_sums
from ripplepanel.operators.stacked_trees import Forest, Growth, Stack
from ripplepanel.operators.within import Z95, cross_sums
from ripplepanel.session import cut


@dataclass(frozen=True)
class Cate:
    """``rows`` has zone_id, date, y, t, the features and cate, cate_se, cate_low, cate_high, and
    n_boot: the replicates or bags behind cate_se."""

    rows: DataFrame
    features: list[str]
    importance: DataFrame | None


def _base(panel: DataFrame, features: Sequence[str], outcome: str, treatment: str) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in features]
    return panel.select(
        "zone_id", "date", F.col(outcome).cast("double").alias("y"),
        F.col(treatment).cast("double").alias("t"), *cols
    ).dropna(subset=["y", "t", *features])


def _banded(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "cate_low": F.col("cate") - Z95 * F.col("cate_se"),
        "cate_high": F.col("cate") + Z95 * F.col("cate_se")})


def _spread(values: Sequence[Column], about: str) -> Column:
    """Sample deviation of some columns, in one run over them; ``about`` is a number near their mean."""
    n = len(values)
    if n < 2:
        return F.lit(None).cast("double")

    def add(so_far: Column, v: Column) -> Column:
        gap = v - F.col(about)
        return F.struct((so_far["s"] + gap).alias("s"), (so_far["q"] + gap * gap).alias("q"))

    return F.aggregate(
        F.array(*values), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), add,
        lambda x: F.sqrt(F.greatest(x["q"] - x["s"] * x["s"] / n, F.lit(0.0)) / (n - 1)))


def t_learner(
    panel: DataFrame, features: Sequence[str], outcome: str = "log_trip_count",
    treatment: str = "treat_binary", learner: str = "random_forest", n_boot: int = 200,
    trees: int = 500, boot_trees: int = 100, seed: int = 42, depth: int = 16,
) -> Cate:
    """Effect = prediction of the treated model minus that of the control model.

    Models fit on one half of the rows (by hash) and predict the other half.
    Errors come from refits with Poisson(1) row weights; a refit whose weights
    leave either arm below 5 is skipped, and ``n_boot`` counts those that are not.
    ``depth`` bounds the trees; rows whose treatment is neither 0 nor 1 are left out.
    """
    features = list(features)
    base = _base(panel, features, outcome, treatment).where(F.col("t").isin(0.0, 1.0))
    half = fold_of(2, seed)
    if learner == "ols":
        return _linear_t(base.where(half == 0), base.where(half == 1), features, n_boot, seed)
    return _forest_t(base, half, features, n_boot, trees, boot_trees, seed, depth)


def _linear_t(
    train: DataFrame, est: DataFrame, features: list[str], n_boot: int, seed: int
) -> Cate:
    """All refits from one pass: replicate 0 is the fit with unit weights."""
    xs = [F.lit(1.0), *[F.col(x) for x in features]]
    k = len(xs)
    # weight x (upper triangle of the products, then the products with y)
    values = [xs[i] * xs[j] for i in range(k) for j in range(i, k)] + [x * F.col("y") for x in xs]
    sums = replicate_sums(train, poisson_weights(("zone_id", "date"), n_boot, seed), values, ["t"])
    found = {(r["rep"], r["t"]): np.array(r["s"]) for r in sums.collect()}  # replicates x 2 rows
    upper = np.triu_indices(k)
    gaps: dict[int, np.ndarray] = {}
    for rep in range(n_boot + 1):
        arms = []
        for arm in (1.0, 0.0):
            s = found.get((rep, arm))
            if s is None or s[0] < 5:
                break
            gram = np.zeros((k, k))
            gram[upper] = s[: len(upper[0])]
            gram = gram + np.triu(gram, 1).T
            arms.append(np.linalg.lstsq(gram, s[len(upper[0]) :], rcond=None)[0])
        if len(arms) == 2:
            gaps[rep] = arms[0] - arms[1]
    if 0 not in gaps:
        raise ValueError("one arm of the training half has fewer than 5 rows")

    def effect(b: np.ndarray) -> Column:
        out = F.lit(float(b[0]))
        for c, x in zip(b[1:], features):
            out = out + F.lit(float(c)) * F.col(x)
        return out

    redrawn = [effect(b) for rep, b in gaps.items() if rep > 0]
    rows = est.withColumn("cate", effect(gaps[0])).withColumn("cate_se", _spread(redrawn, "cate"))
    return Cate(_banded(rows).withColumn("n_boot", F.lit(len(gaps) - 1)), features, None)


def _forest_t(
    base: DataFrame, half: Column, features: list[str], n_boot: int, trees: int, boot_trees: int,
    seed: int, depth: int,
) -> Cate:
    """Both arms of all refits as forests on one copy of the rows; a role is an arm in a replicate."""
    reps = n_boot + 1
    weights = poisson_weights(("zone_id", "date"), n_boot, seed)

    def role(arm: float) -> Column:
        inside = (half == 0) & (F.col("t") == arm)
        return F.transform(weights, lambda w: F.when(inside, w).otherwise(0.0).cast("tinyint"))

    stack = Stack(base, ("zone_id", "date"), features, ["y"], F.concat(role(1.0), role(0.0)), half == 1)
    mass = {r["pos"]: r["m"] for r in stack.rows.select(F.posexplode("_roles").alias("pos", "w")).groupBy(
        "pos").agg(F.sum("w").alias("m")).collect()}  # 2 x replicates rows
    used = [b for b in range(reps) if min(mass.get(b, 0), mass.get(reps + b, 0)) >= 5]
    if 0 not in used:
        raise ValueError("one arm of the training half has fewer than 5 rows")
    forests = [Forest(arm * reps + b, arm * reps + b, 0, seed + arm * reps + b) for b in used for arm in (0, 1)]
    whole, share = stack.grow(forests[:2], Growth(trees, depth, 1))
    parts = whole
    if len(forests) > 2:
        parts = whole.unionByName(stack.grow(forests[2:], Growth(boot_trees, depth, 1))[0])
    sign = F.when(F.col("forest") < reps, F.col("prediction")).otherwise(-F.col("prediction"))
    gaps = parts.groupBy("zone_id", "date", (F.col("forest") % reps).alias("rep")).agg(F.sum(sign).alias("gap"))
    effect = gaps.groupBy("zone_id", "date").agg(
        F.max(F.when(F.col("rep") == 0, F.col("gap"))).alias("cate"),
        F.stddev_samp(F.when(F.col("rep") > 0, F.col("gap"))).alias("cate_se"),
        F.count_if(F.col("rep") > 0).cast("int").alias("n_boot"))
    rows = cut(_banded(base.where(half == 1).join(effect, ["zone_id", "date"]).select(
        "zone_id", "date", "y", "t", *features, "cate", "cate_se", "n_boot")), "cate")
    return Cate(rows, features, _importance(share, features))


def _importance(share: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean share of each feature over the forests, largest first."""
    found = {r["feature"]: r["v"] for r in share.groupBy("feature").agg(F.avg("importance").alias("v")).collect()}
    weights = np.array([found.get(i, 0.0) for i in range(len(features))])
    return importance_rows(share.sparkSession, features, weights / (weights.sum() or 1.0))


def residual_forest(
    panel: DataFrame, features: Sequence[str], outcome: str = "log_trip_count",
    treatment: str = "treat_binary", nuisance: str = "random_forest", folds: int = 5,
    bags: int = 16, trees_per_bag: int = 50, nuisance_trees: int = 200, min_leaf: int = 5,
    seed: int = 42,
) -> Cate:
    """Effects from a forest on cross-fitted residuals.

    Minimises the weighted loss of residual outcome over residual treatment.
    Each bag of trees sees half the rows (by hash); a row is only predicted by
    bags that did not see it, and the spread between those bags is its error.
    """
    if bags < 4 or bags % 2:
        raise ValueError("bags must be an even number of at least 4")
    features = list(features)
    res = cross_fit_residuals(
        panel, features, [treatment, outcome], nuisance, folds, 1, seed, trees=nuisance_trees)
    d, y = F.col(f"r_{treatment}"), F.col(f"r_{outcome}")
    # a row without residual treatment has weight 0 and still gets its effect
    base = cut(res.select(
        "zone_id", "date", F.col(outcome).alias("y"), F.col(treatment).alias("t"), *features,
        F.coalesce(F.try_divide(y, d), F.lit(0.0)).alias("_ratio"), (d * d).alias("_weight")), "residuals")
    # bags come in complementary pairs, so every row stays unseen by half of them
    sides = [F.pmod(portable_hash("zone_id", "date", seed=f"bag{seed}-{b // 2}"), F.lit(2)) for b in range(bags)]
    roles = F.array(*[(side == b % 2).cast("tinyint") for b, side in enumerate(sides)])
    stack = Stack(base, ("zone_id", "date"), features, ["_ratio"], roles, F.lit(True), F.col("_weight"))
    scores, share = stack.grow(
        [Forest(b, b, 0, seed + b) for b in range(bags)], Growth(trees_per_bag, 8, min_leaf))
    effect = scores.groupBy("zone_id", "date").agg(
        F.avg("prediction").alias("cate"), F.stddev_samp("prediction").alias("cate_se"),
        F.count(F.lit(1)).cast("int").alias("n_boot"))
    rows = cut(_banded(base.join(effect, ["zone_id", "date"]).select(
        "zone_id", "date", "y", "t", *features, "cate", "cate_se", "n_boot")), "cate")
    return Cate(rows, features, _importance(share, features))


def importance_rows(spark, features: Sequence[str], weights: np.ndarray) -> DataFrame:
    ranked = sorted(zip(features, weights), key=lambda p: (-p[1], p[0]))
    return spark.createDataFrame(
        [(i + 1, f, float(w)) for i, (f, w) in enumerate(ranked)],
        "rank int, feature string, importance double")


def causal_forest(panel: DataFrame, features: Sequence[str], method: str = "residual", **kw) -> Cate:
    """Either estimator by name: "residual" or "t"."""
    return {"residual": residual_forest, "t": t_learner}[method](panel, features, **kw)


def best_linear_projection(cate: Cate) -> DataFrame:
    """Coefficients of the effect on the features, largest first.

    Centred normal equations from one pass; a constant feature gets 0.
    """
    xs = ["_one", *cate.features, "cate"]
    rows = cate.rows.withColumn("_one", F.lit(1.0))
    sums = cross_sums(rows, [(a, b) for i, a in enumerate(xs) for b in xs[i:]])[()]
    full = np.array([[sums[(a, b) if (a, b) in sums else (b, a)] for b in xs] for a in xs])
    n = full[0, 0]
    mean = full[0] / n
    centred = full - n * np.outer(mean, mean)
    gram, target = centred[1:-1, 1:-1], centred[1:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
    live = scale > 1e-9 * np.maximum(np.sqrt(np.diag(full)[1:-1]), 1e-300)
    beta = np.zeros(len(scale))
    if live.any():
        s = scale[live]
        beta[live] = np.linalg.lstsq(
            gram[np.ix_(live, live)] / np.outer(s, s), target[live] / s, rcond=1e-10)[0] / s
    ranked = sorted(zip(cate.features, beta), key=lambda p: (-abs(p[1]), p[0]))
    return cate.rows.sparkSession.createDataFrame(
        [(f, float(b)) for f, b in ranked], "feature string, coefficient double")


def targeting_curve(
    rows: DataFrame, buckets: int = 10, residuals: DataFrame | None = None
) -> DataFrame:
    """Treated minus control mean among the top q by effect, q = 1/buckets ... 1.

    Exact ranks come from range partitions; each bucket keeps a few sums, and
    the curve accumulates over the buckets. With ``residuals`` (zone_id, date,
    r_t, r_y from a cross-fit) a second curve partials out the covariates.
    """
    held = rows.select("zone_id", "date", "cate", "y", "t")
    if residuals is not None:
        held = held.join(residuals.select("zone_id", "date", "r_t", "r_y"), ["zone_id", "date"])
    ranked = cut(global_rank(held, [F.desc("cate"), F.col("zone_id"), F.col("date")]), "ranked")
    n = ranked.count()
    # top q holds ceil(k n / buckets) rows, so row r first counts at this k
    spot = F.floor(F.col("rank0") * buckets / F.lit(max(n, 1))).cast("int") + 1
    treated = F.col("t") == 1
    parts = {
        "n1": F.count_if(treated), "y1": F.sum(F.when(treated, F.col("y"))),
        "n0": F.count_if(~treated), "y0": F.sum(F.when(~treated, F.col("y")))}
    if residuals is not None:
        parts["dy"] = F.sum(F.col("r_t") * F.col("r_y"))
        parts["dd"] = F.sum(F.col("r_t") * F.col("r_t"))
    sums = ranked.groupBy(F.least(spot, F.lit(buckets)).alias("k")).agg(
        *[v.alias(c) for c, v in parts.items()])
    # at most ``buckets`` rows reach this window
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = sums.select("k", *[
        F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto).alias(c) for c in parts])
    out = total.select(
        (F.col("k") / F.lit(float(buckets))).alias("fraction"),
        (F.try_divide("y1", "n1") - F.try_divide("y0", "n0")).alias("ate_top_q"),
        (F.col("n1") + F.col("n0")).alias("n_targeted"),
        *([F.try_divide("dy", "dd").alias("partial_top_q")] if residuals is not None else []))
    return out


def rate_score(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg("ate_top_q").alias("rate_score"))


def _best_cuts(rows: DataFrame, features: Sequence[str]) -> list:
    """Per open node the cut of least squared error, with what both sides hold; ties to the first feature and cut.

    Rows collapse to one per (node, feature, value) before anything is ordered;
    sums up to each value come from range partitions.
    """
    # array of structs, so that a row is read once for all features
    each = F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value")
    values = rows.select("_node", "cate", each).groupBy("_node", "feature", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cate").alias("s"))
    run = running_sums(values, ["_node", "feature"], ["value"], ["n", "s"])
    whole = rows.groupBy("_node").agg(F.count(F.lit(1)).alias("all_n"), F.sum("cate").alias("all_s"))
    run = run.join(whole, "_node").where(F.col("n_upto") < F.col("all_n"))  # one row per open node on that side
    rest_n, rest_s = F.col("all_n") - F.col("n_upto"), F.col("all_s") - F.col("s_upto")
    gain = (F.col("s_upto") * F.col("s_upto") / F.col("n_upto") + rest_s * rest_s / rest_n
            - F.col("all_s") * F.col("all_s") / F.col("all_n"))
    # nine digits: sums in another order must not choose another cut
    return run.withColumn("gain", F.round(gain, 9)).where("gain > 0").groupBy("_node").agg(
        F.min(F.struct(-F.col("gain"), "feature", "value", "next")).alias("best")).select("_node", "best.*").collect()


def policy_tree(cate: Cate, max_depth: int = 2) -> DataFrame:
    """Leaves of a shallow tree on the effect: rule, rows and mean effect.

    Every level takes the exact best cut, midway between two values that occur.
    The tree has at most 2^depth leaves; their rules become one Column and the
    leaf statistics one aggregate over the rows.
    """
    held = cut(cate.rows.select("cate", *[F.col(f).cast("double").alias(f) for f in cate.features]).where(
        F.col("cate").isNotNull()), "policy")
    leaves: list[tuple[list[str], Column]] = [([], F.lit(True))]
    closed: list[tuple[list[str], Column]] = []
    for _ in range(max_depth):
        node = F.lit(None).cast("int")
        for i, (_, test) in enumerate(leaves):
            node = F.when(test, F.lit(i)).otherwise(node)
        found = {r["_node"]: r for r in _best_cuts(
            held.withColumn("_node", node).where(F.col("_node").isNotNull()), cate.features)}
        fresh = []
        for i, (text, test) in enumerate(leaves):
            if i not in found:
                closed.append((text, test))
                continue
            name = cate.features[found[i]["feature"]]
            cutoff = (found[i]["value"] + found[i]["next"]) / 2
            # a midpoint that rounds up to the next value would move its rows
            if cutoff >= found[i]["next"]:
                cutoff = found[i]["value"]
            fresh += [([*text, f"{name} <= {cutoff:.4f}"], test & (F.col(name) <= F.lit(cutoff))),
                      ([*text, f"{name} > {cutoff:.4f}"], test & (F.col(name) > F.lit(cutoff)))]
        leaves = fresh
    rule = F.lit(None).cast("string")
    for text, test in [*closed, *leaves]:
        rule = F.when(test, F.lit(" and ".join(text) or "all")).otherwise(rule)
    return held.groupBy(rule.alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("cate").alias("mean_cate"))


def zone_cate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("zone_id").agg(
        *[F.avg(c).alias(c) for c in ("cate", "cate_low", "cate_high", "cate_se")])


def with_panel(rows: DataFrame, panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Effects joined to panel columns on (zone_id, date)."""
    return rows.select("zone_id", "date", "cate", "cate_low", "cate_high", "cate_se").join(
        panel.select("zone_id", "date", *columns), ["zone_id", "date"])


def cate_by_group(rows: DataFrame, panel: DataFrame, group: str) -> DataFrame:
    """Mean effect per value of a panel column, with its normal interval."""
    out = with_panel(rows, panel, [group]).where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg("cate").alias("mean_cate"), F.stddev_samp("cate").alias("std_cate"),
        F.count("cate").alias("n"))
    out = out.withColumn("se_cate", F.col("std_cate") / F.sqrt("n"))
    return out.withColumns({
        "ci_low": F.col("mean_cate") - Z95 * F.col("se_cate"),
        "ci_high": F.col("mean_cate") + Z95 * F.col("se_cate")})


def add_peak_flag(panel: DataFrame) -> DataFrame:
    return panel.withColumn("is_peak", (F.col("peak_share") >= 0.5).cast("int"))


def cate_summary(rows: DataFrame) -> DataFrame:
    ratio = F.abs(F.col("cate") / (F.col("cate_se") + F.lit(1e-8)))
    return rows.agg(
        F.avg("cate").alias("mean_cate"), F.stddev_pop("cate").alias("std_cate"),
        (F.avg((ratio > Z95).cast("int")) * 100).alias("pct_significant"),
        F.count("cate").alias("n"))
