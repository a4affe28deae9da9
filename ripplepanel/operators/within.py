"""Two-way fixed effects by distributed sweeps plus a small solve.

The panel is hashed by unit once and kept in memory or on local disk. Each sweep
joins a direction over the time keys (a written table, broadcast where it is
small), takes it out of the unit means without a shuffle, and shuffles one
partial row per time key. Conjugate gradients choose directions and step sizes
from those rows, so a panel with gaps takes a few sweeps; only tables over the
time axis are written between sweeps, and each goes once the next one is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ripplepanel.functions.tails import normal_two_sided_value
from ripplepanel.session import cut_at, discard

Z95 = 1.96
#: Values of a panel that a task of a sweep takes, if there are not more than the session's partitions hold.
TASK_VALUES = 250_000


@dataclass
class Fit:
    """One regression: ``key`` are the batch key values, ``outcome`` the left side."""

    key: tuple
    outcome: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n_obs: int
    n_clusters: int
    r_squared: float

    def at(self, name: str) -> tuple[float | None, float | None]:
        """Coefficient and standard error, (None, None) if not identified."""
        i = self.names.index(name)
        if np.isnan(self.beta[i]):
            return None, None
        return float(self.beta[i]), float(np.sqrt(max(self.cov[i, i], 0.0)))

    def summary(self, name: str) -> dict:
        coef, se = self.at(name)
        t = p = low = high = None
        if coef is not None and se:
            t = coef / se
            p = normal_two_sided_value(t)
        if coef is not None:
            low, high = coef - Z95 * se, coef + Z95 * se
        return {"coef": coef, "se": se, "t_stat": t, "p_value": p, "ci_low": low, "ci_high": high}


class Demeaned:
    """Columns of a panel net of unit and time means (t_<name>), kept until closed."""

    def __init__(self, base: DataFrame, frame: DataFrame, sweeps: int):
        self.base, self.frame, self.sweeps = base, frame, sweeps

    def __enter__(self) -> "Demeaned":
        return self

    def __exit__(self, *exc) -> None:
        self.base.unpersist()


def two_way_demean(
    df: DataFrame, columns: Sequence[str], unit: str = "zone_id", time: str = "date",
    by: Sequence[str] = (), carry: Sequence[str] = (), tol: float = 1e-10, max_sweeps: int = 500,
) -> Demeaned:
    """Columns net of unit and time means, by conjugate gradients on the time effects.

    Rows with a null in any column are left out. ``by`` batches independent
    panels into the same job; each column of each of them takes its own steps.
    A unit's rows are its periods, one per time key, so the per-unit window
    stays as short as the time axis. Done when the means that remain per period
    are below ``tol`` of a column's size; raises when that takes more than
    ``max_sweeps``: no half-converged result is returned.
    """
    columns = list(dict.fromkeys(columns))
    extra = [c for c in dict.fromkeys(carry) if c not in {*by, unit, time, *columns}]
    # without batches one constant is the batch key; it is no key of the rows' place, since the planner folds a
    # constant away and would take the kept rows for rows of unknown place: every sweep would move them again
    batch, place = list(by) or ["_all"], [*by, unit]
    rows = df.selectExpr(
        *(by or ["0 as _all"]), unit, time, *extra, *[f"cast({c} as double) as {c}" for c in columns]
    ).dropna(subset=columns).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # read once and kept, so that a small panel is not dealt to hundreds of tasks in every sweep
        most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(most, rows.count() * len(columns) // TASK_VALUES))
        base = rows.repartition(parts, *place).sortWithinPartitions(*place).persist(StorageLevel.MEMORY_AND_DISK)
        base.count()
    finally:
        rows.unpersist()
    try:
        effects, sweeps = _time_effects(base, columns, unit, time, batch, place, tol, max_sweeps)
    except BaseException:
        base.unpersist()
        raise
    # one text per column keeps the plan the same and spares thousands of calls
    # into the JVM for a wide regression
    per_unit = f"over (partition by {', '.join(place)})"
    frame = base.join(effects, [*batch, time]).selectExpr(
        *by, unit, time, *extra, *[f"{c} - _g_{c} - avg({c} - _g_{c}) {per_unit} as t_{c}" for c in columns])
    return Demeaned(base, frame, sweeps)


def _time_effects(
    base: DataFrame, columns: list[str], unit: str, time: str, batch: list[str], place: list[str], tol: float,
    max_sweeps: int,
) -> tuple[DataFrame, int]:
    """Effects ``_g_<column>`` per batch and time key, and the sweeps they took.

    The effects solve M g = r, where r sums what unit means leave per period. A
    sweep over the panel gives M times a direction; steps and directions follow
    from sums over the time axis, weighted by rows per period.
    """
    spark = base.sparkSession
    keys = [*batch, time]
    per_unit = f"over (partition by {', '.join(place)})"
    spread = base.selectExpr(*[f"max(abs({c})) as {c}" for c in columns]).first()
    limits = {c: tol * max(spread[c] or 0.0, 1e-12) for c in columns}
    left = base.selectExpr(*keys, *[f"{c} - avg({c}) {per_unit} as {c}" for c in columns])
    start = left.groupBy(*keys).agg(F.expr("cast(count(1) as double) as _n"), *[F.expr(f"sum({c}) as _r_{c}") for c in columns])
    state, path = cut_at(start.selectExpr(
        *keys, "_n", *[f"_r_{c}" for c in columns], *[f"_r_{c} / _n as _p_{c}" for c in columns], *[f"0D as _g_{c}" for c in columns]), "effects")
    written, sweep = [path], 1
    moved = state.selectExpr(*[f"max(abs(_p_{c})) as {c}" for c in columns]).first()
    while any((moved[c] or 0.0) > limits[c] for c in columns):
        sweep += 1
        if sweep > max_sweeps:
            raise RuntimeError(f"fixed effects did not settle in {max_sweeps} sweeps")
        along = base.select(*keys, unit).join(state.select(*keys, *[f"_p_{c}" for c in columns]), keys)
        through = along.selectExpr(*keys, *[f"_p_{c} - avg(_p_{c}) {per_unit} as _q_{c}" for c in columns])
        through = through.groupBy(*keys).agg(*[F.expr(f"sum(_q_{c}) as _q_{c}") for c in columns])
        step, path = cut_at(state.join(through, keys), "direction")
        written.append(path)
        # a row per batch key: step sizes, then the next directions' shares
        size = step.groupBy(*batch).agg(*[F.expr(
            f"coalesce(try_divide(sum(_r_{c} * _r_{c} / _n), sum(_p_{c} * _q_{c})), 0D) as _a_{c}") for c in columns],
            *[F.expr(f"sum(_r_{c} * _r_{c} / _n) as _z_{c}") for c in columns])
        stepped = step.join(size, batch).selectExpr(
            *keys, "_n", *[f"_z_{c}" for c in columns], *[f"_p_{c}" for c in columns],
            *[f"_r_{c} - _a_{c} * _q_{c} as _r_{c}" for c in columns], *[f"_g_{c} + _a_{c} * _p_{c} as _g_{c}" for c in columns])
        turn = stepped.groupBy(*batch).agg(*[F.expr(
            f"coalesce(try_divide(sum(_r_{c} * _r_{c} / _n), max(_z_{c})), 0D) as _b_{c}") for c in columns])
        seen = Observation()
        state, path = cut_at(stepped.join(turn, batch).selectExpr(
            *keys, "_n", *[f"_r_{c}" for c in columns], *[f"_r_{c} / _n + _b_{c} * _p_{c} as _p_{c}" for c in columns],
            *[f"_g_{c}" for c in columns]).observe(seen, *[F.expr(f"max(abs(_r_{c} / _n)) as {c}") for c in columns]), "effects")
        moved = seen.get
        for old in written:
            discard(spark, old)
        written = [path]
    return state.select(*keys, *[f"_g_{c}" for c in columns]), sweep


def cross_sums(
    df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()
) -> dict[tuple, dict[tuple[str, str], float]]:
    """Sum of a*b for each pair and batch key, plus the row count under ("", "").

    A null counts as 0 in its products. Each task multiplies its rows as
    matrices, so what is shuffled is one row per task, key and pair.
    """
    pairs = list(dict.fromkeys(pairs))
    names = sorted({c for p in pairs for c in p})
    spot = {c: i for i, c in enumerate(names)}
    left, right = (np.array([spot[p[k]] for p in pairs], int) for k in (0, 1))
    fields = df.select(*by).schema.fields
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "_at int, _v double"])
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]

    def partial(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            found: dict[tuple, int] = {}
            place = np.zeros(n, np.int64)
            if by:
                place[:] = [found.setdefault(k, len(found)) for k in zip(*[batch.column(c).to_pylist() for c in by])]
            else:
                found[()] = 0
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=len(found)))
            for key, end, start in zip(found, ends, np.append(0, ends[:-1])):
                part = x[order[start:end]]
                flat = np.append((part.T @ part)[left, right], float(len(part)))
                totals[key] = totals.get(key, 0.0) + flat
        for key, flat in totals.items():
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([v] * len(flat), kind) for v, kind in zip(key, kinds)],
                 pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], [*by, "_at", "_v"])

    summed = (
        df.select(*by, F.array(*values).alias("_x")).mapInArrow(partial, schema)
        .groupBy(*by, "_at").agg(F.sum("_v").alias("_v")).collect()
    )
    flats: dict[tuple, np.ndarray] = {}
    for r in summed:
        key = tuple(r[k] for k in by)
        flats.setdefault(key, np.zeros(len(pairs) + 1))[r["_at"]] = r["_v"]
    return {
        key: {("", ""): int(flat[-1]), **{p: float(v) for p, v in zip(pairs, flat)}}
        for key, flat in flats.items()
    }


def _upper(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def _matrix(sums: dict, names: Sequence[str]) -> np.ndarray:
    out = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            out[i, j] = out[j, i] = sums[(a, names[j])]
    return out


def _identified(gram: np.ndarray, scale: np.ndarray) -> list[int]:
    """Columns that add rank, in order: an absorbed or repeated one is left out."""
    kept: list[int] = []
    for j in range(len(gram)):
        if gram[j, j] <= 1e-12 * max(scale[j], 1e-300):
            continue
        if kept:
            block = gram[np.ix_(kept, kept)]
            cross = gram[np.ix_(kept, [j])][:, 0]
            left = gram[j, j] - cross @ np.linalg.solve(block, cross)
            if left <= 1e-10 * gram[j, j]:
                continue
        kept.append(j)
    return kept


def fit_two_way(
    df: DataFrame, outcomes: Sequence[str], regressors: Sequence[str], unit: str = "zone_id",
    time: str = "date", cluster: str | None = None, by: Sequence[str] = (), dof: str = "cr1",
) -> list[Fit]:
    """OLS of each outcome on the regressors net of unit and time effects.

    Covariances cluster on ``cluster`` (default the unit); ``dof`` is "cr1" for
    the G/(G-1) factor or "cr0" for none. All outcomes and batch keys share one
    set of sweeps, one Gram pass and one score pass.
    """
    cluster = cluster or unit
    xs, ys = [f"t_{c}" for c in regressors], [f"t_{c}" for c in outcomes]
    with two_way_demean(df, [*outcomes, *regressors], unit, time, by, carry=[cluster]) as net:
        # the kept panel again, not its source: the source is read once
        squares = net.base.groupBy(*by).agg(*[F.expr(f"sum({c} * {c}) as {c}") for c in regressors])
        sizes = {
            tuple(r[k] for k in by): np.array([r[c] or 0.0 for c in regressors])
            for r in squares.collect()
        }
        pairs = _upper(xs) + [(x, y) for y in ys for x in xs] + [(y, y) for y in ys]
        grams = cross_sums(net.frame, pairs, by)
        solved: dict[tuple, dict] = {}
        for key, sums in grams.items():
            gram = _matrix(sums, xs)
            kept = _identified(gram, sizes[key])
            inverse = np.linalg.inv(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
            betas = np.full((len(ys), len(xs)), np.nan)
            for m, y in enumerate(ys):
                xy = np.array([sums[(x, y)] for x in xs])
                betas[m, kept] = inverse @ xy[kept]
            solved[key] = {"kept": kept, "inverse": inverse, "betas": betas, "gram": gram}
        meats, clusters = _score_sums(net.frame, xs, ys, cluster, by, solved)

    fits = []
    for key, s in solved.items():
        sums, kept = grams[key], s["kept"]
        g = clusters[key]
        scale = g / (g - 1.0) if dof == "cr1" and g > 1 else 1.0
        for m, (y, outcome) in enumerate(zip(ys, outcomes)):
            cov = np.full((len(xs), len(xs)), np.nan)
            cov[np.ix_(kept, kept)] = (
                s["inverse"] @ meats[key][m][np.ix_(kept, kept)] @ s["inverse"] * scale)
            b = np.nan_to_num(s["betas"][m])
            xy = np.array([sums[(x, y)] for x in xs])
            explained = 2 * b @ xy - b @ s["gram"] @ b
            r2 = explained / sums[(y, y)] if sums[(y, y)] > 0 else float("nan")
            fits.append(Fit(key, outcome, list(regressors), s["betas"][m], cov,
                            int(sums[("", "")]), int(g), float(r2)))
    return fits


def _score_sums(
    frame: DataFrame, xs: list[str], ys: list[str], cluster: str, by: Sequence[str], solved: dict
) -> tuple[dict, dict]:
    """Sums of score products over clusters, per batch key and outcome."""
    spark = frame.sparkSession
    names = [[f"_b_{m}_{j}" for j in range(len(xs))] for m in range(len(ys))]
    flat = [n for row in names for n in row]
    values = {key: [float(v) for v in np.nan_to_num(s["betas"]).ravel()]
              for key, s in solved.items()}
    if by:
        key_schema = frame.select(*by).schema
        schema = ", ".join(
            [f"{f.name} {f.dataType.simpleString()}" for f in key_schema]
            + [f"{n} double" for n in flat])
        coefs = spark.createDataFrame([(*k, *v) for k, v in values.items()], schema)
        # one row per regression in the batch: bounded by the batch size
        held, beta = frame.join(F.broadcast(coefs), list(by)), {n: n for n in flat}
    else:
        held, beta = frame, {n: f"{v!r}D" for n, v in zip(flat, values[()])}

    def residual(m: int) -> str:
        fitted = [f"({beta[n]}) * {x}" for n, x in zip(names[m], xs)]
        return f"{ys[m]} - ({' + '.join(fitted)}) as _e_{m}"

    held = held.selectExpr(
        *by, f"{cluster} as _cluster", *xs, *[residual(m) for m in range(len(ys))])
    scored = held.groupBy(*by, "_cluster").agg(*[
        F.expr(f"sum({x} * _e_{m}) as _s_{m}_{j}")
        for m in range(len(ys)) for j, x in enumerate(xs)])
    score_names = [[f"_s_{m}_{j}" for j in range(len(xs))] for m in range(len(ys))]
    sums = cross_sums(scored, [p for row in score_names for p in _upper(row)], by)
    meats = {k: [_matrix(v, row) for row in score_names] for k, v in sums.items()}
    return meats, {k: v[("", "")] for k, v in sums.items()}
