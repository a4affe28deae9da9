"""Cross-fitted double machine learning.

Linear learners (ols, ridge, lasso) need only sums of products per fold: every
fold, replicate and target comes out of one pass, since a training fold is the
total minus the held-out fold. Forests and boosting of all folds, replicates and
targets grow together (``stacked_trees``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplepanel.functions.columns import portable_hash, stars
from ripplepanel.functions.tails import normal_two_sided_value
from ripplepanel.operators.stacked_trees import Forest, Growth, Stack
from ripplepanel.operators.within import Z95, cross_sums
from ripplepanel.session import cut

LINEAR = ("ols", "ridge", "lasso")
TREES = ("random_forest", "gradient_boosting")
INNER_FOLDS = 5
# Ridge penalties tried, the size of the lasso path, and its sweeps at most.
RIDGE_GRID = (0.1, 1.0, 10.0)
LASSO_STEPS, LASSO_SPAN, LASSO_SWEEPS = 30, 1e-3, 5000

DML_SCHEMA = (
    "outcome string, theta double, se double, t_stat double, p_value double, ci_low double, "
    "ci_high double, n_reps int, n_obs long"
)


def fold_of(folds: int, seed: int | Column, keys: Sequence[str] = ("zone_id", "date")) -> Column:
    """Fold number from a hash of the row key: the same in every run and engine."""
    tag = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    parts = [F.col(k).cast("string") for k in keys]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts, tag).cast("binary")), 1, 8), 16, 10)
    return F.pmod(h.cast("long"), F.lit(folds)).cast("int")


def tree_growth(name: str, trees: int | None = None) -> Growth:
    if name == "random_forest":
        return Growth(trees or 300, depth=8, min_leaf=5)
    return Growth(trees or 300, depth=5, min_leaf=1, boost=0.05)


def _ridge(gram: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients with the intercept in place 0 unpenalised."""
    penalty = alpha * np.eye(len(gram))
    penalty[0, 0] = 0.0
    return np.linalg.lstsq(gram + penalty, xy, rcond=None)[0]


def _lasso(gram: np.ndarray, xy: np.ndarray, alpha: float, start: np.ndarray | None = None):
    """Coordinate descent on correlations; ``alpha`` is in units of the target.

    A constant feature has no correlation and keeps coefficient 0.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    s = gram[1:, 1:] / n - np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(s), 0.0))
    live = size > 1e-9 * np.maximum(np.abs(mean), 1e-300)
    scale = np.where(live, size, 1.0)
    c = s / np.outer(scale, scale)
    v = np.where(live, (xy[1:] / n - mean * xy[0] / n) / scale, 0.0)
    b = np.zeros(len(v)) if start is None else start[1:] * scale
    order = np.nonzero(live)[0]
    for _ in range(LASSO_SWEEPS):
        before = b.copy()
        for j in order:
            rho = v[j] - c[j] @ b + b[j]
            b[j] = np.sign(rho) * max(abs(rho) - alpha, 0.0)
        if np.max(np.abs(b - before), initial=0.0) <= 1e-7 * np.max(np.abs(b), initial=1e-12):
            break
    else:
        raise RuntimeError(f"the lasso did not settle in {LASSO_SWEEPS} sweeps")
    b = b / scale
    return np.concatenate([[(xy[0] - gram[0, 1:] @ b) / n], b])


def _penalties(name: str, gram: np.ndarray, xy: np.ndarray) -> list[float]:
    if name == "ridge":
        return list(RIDGE_GRID)
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    size = np.sqrt(np.maximum(np.diag(gram)[1:] / n - mean * mean, 0.0))
    corr = np.abs(xy[1:] / n - mean * xy[0] / n) / np.where(size > 0, size, 1.0)
    top = max(float(np.max(np.where(size > 0, corr, 0.0))), 1e-12)
    return list(np.geomspace(top, top * LASSO_SPAN, LASSO_STEPS))


def _fit_linear(name: str, blocks: dict[int, tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """One target from its inner-fold sums (gram, x'y, y'y)."""
    gram = sum(b[0] for b in blocks.values())
    xy = sum(b[1] for b in blocks.values())
    if name == "ols":
        return np.linalg.lstsq(gram, xy, rcond=None)[0]
    fit = _ridge if name == "ridge" else _lasso
    grid = _penalties(name, gram, xy)
    loss = np.zeros(len(grid))
    for held, (g_out, v_out, yy) in blocks.items():
        g_in, v_in = gram - g_out, xy - v_out
        beta = None
        for i, alpha in enumerate(grid):
            beta = fit(g_in, v_in, alpha) if name == "ridge" else fit(g_in, v_in, alpha, beta)
            loss[i] += yy - 2 * beta @ v_out + beta @ g_out @ beta
    return fit(gram, xy, grid[int(np.argmin(loss))])


def _linear_residuals(
    rows: DataFrame, features: Sequence[str], targets: Sequence[str], learner: str, folds: int
) -> DataFrame:
    """Out-of-fold residuals of all targets and replicates, two passes in all."""
    spark = rows.sparkSession
    inner = INNER_FOLDS if learner != "ols" else 1
    tagged = rows.withColumn("_one", F.lit(1.0)).withColumn(
        "_inner", fold_of(inner, F.concat(F.lit("inner"), F.col("rep"))))
    xs = ["_one", *features]
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    pairs += [(x, t) for t in targets for x in xs] + [(t, t) for t in targets]
    sums = cross_sums(tagged, pairs, ["rep", "fold", "_inner"])

    def block(key: tuple, target: str):
        s = sums[key]
        gram = np.array([[s[(a, b) if (a, b) in s else (b, a)] for b in xs] for a in xs])
        return gram, np.array([s[(x, target)] for x in xs]), s[(target, target)]

    table = []
    for rep in sorted({k[0] for k in sums}):
        for fold in range(folds):
            row = [rep, fold]
            for target in targets:
                blocks: dict[int, tuple] = {}
                for key in sums:
                    if key[0] == rep and key[1] != fold:
                        g, v, yy = block(key, target)
                        old = blocks.get(key[2])
                        blocks[key[2]] = (g, v, yy) if old is None else (
                            old[0] + g, old[1] + v, old[2] + yy)
                row += [float(b) for b in _fit_linear(learner, blocks)]
            table.append(tuple(row))
    names = [f"_c_{t}_{j}" for t in range(len(targets)) for j in range(len(xs))]
    coefs = spark.createDataFrame(
        table, "rep int, fold int, " + ", ".join(f"{n} double" for n in names))
    # replicates x folds rows, set by the caller's arguments, not by the data
    joined = rows.withColumn("_one", F.lit(1.0)).join(F.broadcast(coefs), ["rep", "fold"])

    def residual(t: int) -> Column:
        e = F.col(targets[t])
        for j, x in enumerate(xs):
            e = e - F.col(f"_c_{t}_{j}") * F.col(x)
        return e

    out = joined.withColumns({f"r_{t}": residual(i) for i, t in enumerate(targets)})
    return out.drop("_one", *names)


def _tree_residuals(
    base: DataFrame, rows: DataFrame, features: Sequence[str], targets: Sequence[str], learner: str,
    folds: int, fold: Sequence[Column], seed: int, trees: int | None,
) -> DataFrame:
    """Forests of every (replicate, fold, target) grown together on one copy of the rows.

    A row's role is 0 in its own fold, which is where it is predicted.
    """
    n = len(targets)
    roles = F.array(*[(f != k).cast("tinyint") for f in fold for k in range(folds)])
    forests = [Forest(role * n + t, role, t, seed + role * n + t)
               for role in range(len(fold) * folds) for t in range(n)]
    stack = Stack(base, ("zone_id", "date"), features, targets, roles, F.lit(True))
    scores, _ = stack.grow(forests, tree_growth(learner, trees))
    rep = F.floor(F.col("forest") / F.lit(folds * n)).cast("int")
    wide = scores.groupBy("zone_id", "date", rep.alias("rep")).agg(*[
        F.max(F.when(F.col("forest") % n == t, F.col("prediction"))).alias(f"_p_{t}") for t in range(n)])
    out = rows.join(wide, ["zone_id", "date", "rep"], "left")
    return cut(out.withColumns({
        f"r_{t}": F.col(t) - F.col(f"_p_{i}") for i, t in enumerate(targets)
    }).drop(*[f"_p_{i}" for i in range(n)]), "residuals")


def cross_fit_residuals(
    panel: DataFrame, features: Sequence[str], targets: Sequence[str], learner: str = "ols",
    folds: int = 5, reps: int = 1, seed: int = 42, cluster_folds: bool = False,
    trees: int | None = None,
) -> DataFrame:
    """Rows (rep, fold, zone_id, date, targets, r_<target>) with held-out residuals.

    ``cluster_folds`` keeps all rows of a zone in one fold.
    """
    if learner not in LINEAR + TREES:
        raise ValueError(f"unknown learner: {learner}")
    names = list(dict.fromkeys([*features, *targets]))
    base = panel.select(
        "zone_id", "date", *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    keys = ("zone_id",) if cluster_folds else ("zone_id", "date")
    rows = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    rows = rows.withColumn("fold", fold_of(folds, F.lit(seed) + F.col("rep") * 1000, keys))
    if learner in LINEAR:
        return _linear_residuals(rows, features, targets, learner, folds)
    fold = [fold_of(folds, F.lit(seed + r * 1000), keys) for r in range(reps)]
    return _tree_residuals(base, rows, features, targets, learner, folds, fold, seed, trees)


def dml_effects(
    panel: DataFrame, features: Sequence[str], outcomes: Sequence[str],
    treatment: str = "treat_binary", learner: str = "random_forest", folds: int = 5,
    reps: int = 3, seed: int = 42, cluster_folds: bool = False, trees: int | None = None,
) -> DataFrame:
    """Partialled-out effect per outcome, median over replicates.

    The treatment residual is fitted once and shared by all outcomes. A
    replicate whose treatment residual vanishes is left out.
    """
    spark = panel.sparkSession
    targets = [treatment, *outcomes]
    res = cross_fit_residuals(panel, features, targets, learner, folds, reps, seed, cluster_folds, trees)
    if learner in LINEAR:
        res = cut(res, "residuals")
    d = F.col(f"r_{treatment}")
    first = res.groupBy("rep").agg(
        F.count(d).alias("n"), F.sum(d * d).alias("dd"),
        *[F.sum(d * F.col(f"r_{y}")).alias(f"dy_{i}") for i, y in enumerate(outcomes)]).collect()
    used = [r for r in first if (r["dd"] or 0.0) >= 1e-12]
    n_obs = int(first[0]["n"]) if first else 0
    thetas = {r["rep"]: [r[f"dy_{i}"] / r["dd"] for i in range(len(outcomes))] for r in used}
    rows = []
    if used:
        coefs = spark.createDataFrame(
            [(k, *v) for k, v in thetas.items()],
            "rep int, " + ", ".join(f"_t_{i} double" for i in range(len(outcomes))))
        meat = res.join(F.broadcast(coefs), "rep").groupBy("rep").agg(*[
            F.sum(d * d * F.pow(F.col(f"r_{y}") - F.col(f"_t_{i}") * d, 2)).alias(f"m_{i}")
            for i, y in enumerate(outcomes)]).collect()
        dd = {r["rep"]: r["dd"] for r in used}
        for i, y in enumerate(outcomes):
            theta = float(np.median([v[i] for v in thetas.values()]))
            se = float(np.median([np.sqrt(r[f"m_{i}"]) / dd[r["rep"]] for r in meat]))
            t = theta / (se + 1e-12)
            rows.append((y, theta, se, t, normal_two_sided_value(t), theta - Z95 * se,
                         theta + Z95 * se, len(used), n_obs))
    else:
        rows = [(y, None, None, None, None, None, None, 0, n_obs) for y in outcomes]
    return spark.createDataFrame(rows, DML_SCHEMA).withColumn("sig", stars(F.col("p_value")))


def learner_quality(
    panel: DataFrame, features: Sequence[str], target: str, learners: Sequence[str],
    folds: int = 5, trees: int | None = None,
) -> DataFrame:
    """Out-of-fold R squared of each learner for one target."""
    table = None
    for name in learners:
        res = cross_fit_residuals(panel, features, [target], name, folds, trees=trees)
        row = res.agg(
            F.lit(name).alias("learner"), F.count(F.lit(1)).alias("n_obs"),
            (1 - F.sum(F.pow(F.col(f"r_{target}"), 2)) / (
                F.var_pop(target) * F.count(F.lit(1)))).alias("r_squared"))
        table = row if table is None else table.unionByName(row)
    return table


def learner_checks(
    panel: DataFrame, features: Sequence[str], outcome: str = "log_trip_count",
    treatment: str = "treat_binary",
    learners: Sequence[str] = ("random_forest", "gradient_boosting", "lasso"), folds: int = 5,
    reps: int = 2, trees: int | None = None,
) -> DataFrame:
    """The same effect under different learners, in the robustness contract."""
    table = None
    for name in learners:
        row = dml_effects(panel, features, [outcome], treatment, name, folds, reps, trees=trees)
        row = row.select(
            F.lit(f"DML/{name}").alias("check"), F.lit("DML Learners").alias("group"), "theta",
            "se", F.col("p_value").alias("p"), "n_obs", F.lit("").alias("note"),
            F.when(F.col("theta").isNull(), "not_identified").otherwise("ok").alias("status"))
        table = row if table is None else table.unionByName(row)
    return table
