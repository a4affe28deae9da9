"""Stacked forests, replicate sums, running sums and the exact policy tree against brute force."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplepanel.functions.columns import poisson_one, portable_hash
from ripplepanel.functions.ranking import running_sums
from ripplepanel.operators import cate, dml
from ripplepanel.operators.replicates import poisson_weights, replicate_sums
from ripplepanel.operators.stacked_trees import Forest, Growth, Stack, draws

COLUMNS = ["a", "b", "c"]


def exact_tree(x, y, w, depth, least):
    """The plain way: every feature and every cut of a node, ties to the first."""
    total = w.sum()
    mean = (w * y).sum() / total if total else np.nan
    best, found = 0.0, None
    if depth and total >= 2 * least:
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                n, m = w[left].sum(), w[~left].sum()
                if n < least or m < least:
                    continue
                gain = (w * y)[left].sum() ** 2 / n + (w * y)[~left].sum() ** 2 / m - (w * y).sum() ** 2 / total
                if gain > best + 1e-9 * max(1.0, best):
                    best, found = gain, (f, cut)
    if found is None:
        return lambda rows: np.full(len(rows), mean)
    f, cut = found
    left = x[:, f] <= cut
    low, high = (exact_tree(x[s], y[s], w[s], depth - 1, least) for s in (left, ~left))
    return lambda rows: np.where(rows[:, f] <= cut, low(rows), high(rows))


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 14, (300, 3)).astype(float)
    y = 3 * x[:, 0] - x[:, 1] * x[:, 2] + rng.integers(0, 5, 300)
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), float(-y[i])) for i in range(300)],
                                 "id long, a double, b double, c double, y double, z double")
    fold = np.array([r[0] for r in rows.select(F.pmod(F.hash("id"), F.lit(3))).collect()])
    key = np.array([r[0] for r in rows.select(F.xxhash64("id")).collect()]).view(np.uint64)
    return x, y, fold, key, rows


def stack(rows, **kw):
    roles = F.array(*[(F.pmod(F.hash("id"), F.lit(3)) != f).cast("tinyint") for f in range(3)])
    return Stack(rows, ["id"], COLUMNS, ["y", "z"], roles, F.lit(True), **kw)


@pytest.mark.parametrize("block_rows", [1000, 80])
def test_one_tree_equals_brute_force(grown, block_rows):
    x, y, fold, _, rows = grown
    made = stack(rows, block_rows=block_rows)
    assert (made.blocks > 1) == (block_rows == 80)
    scores, share = made.grow([Forest(k, k, 0, k) for k in range(3)], Growth(trees=1, depth=4, min_leaf=3, bag=False), groups=2)
    got = {r["id"]: (r["forest"], r["prediction"]) for r in scores.collect()}
    for k in range(3):
        train = fold != k
        want = exact_tree(x[train], y[train], np.ones(train.sum()), 4, 3)(x)
        for i in np.flatnonzero(fold == k):
            assert got[i] == (k, pytest.approx(want[i]))
    shares = share.groupBy("forest").agg(F.sum("importance").alias("s")).collect()
    assert [r["s"] for r in shares] == [pytest.approx(1.0)] * 3


def test_bagged_forest_equals_brute_force(grown):
    x, y, fold, key, rows = grown
    scores, _ = stack(rows).grow([Forest(7, 1, 1, 5)], Growth(trees=6, depth=3, min_leaf=2))
    bags = draws(key, 5 * 1_000_003 + np.arange(6))
    train = fold != 1
    trees = [exact_tree(x[train], -y[train], b[train].astype(float), 3, 2) for b in bags]
    want = np.mean([t(x) for t in trees], axis=0)
    got = {r["id"]: r["prediction"] for r in scores.collect()}
    assert set(got) == set(np.flatnonzero(fold == 1))
    assert all(got[i] == pytest.approx(want[i]) for i in got)
    assert 0.9 < bags.mean() < 1.1


@pytest.mark.parametrize("growth", [Growth(4, 3, 2), Growth(3, 2, 1, boost=0.3)])
def test_blocks_make_the_same_trees(grown, growth):
    rows = grown[4]
    forests = [Forest(k, k % 3, k // 3, k) for k in range(6)]
    one, many = ([sorted(map(tuple, d.collect())) for d in stack(rows, block_rows=n).grow(forests, growth, groups=3)] for n in (1000, 70))
    for a, b in zip(one, many, strict=True):
        assert len(a) == len(b) and all(r[:-1] == s[:-1] and r[-1] == pytest.approx(s[-1]) for r, s in zip(a, b, strict=True))


def test_boosting_equals_brute_force(grown):
    x, y, fold, _, rows = grown
    scores, _ = stack(rows).grow([Forest(0, 0, 0, 1)], Growth(trees=5, depth=2, min_leaf=1, boost=0.2))
    train = fold != 0
    total = np.full(300, y[train].mean())
    for _ in range(5):
        total += 0.2 * exact_tree(x[train], (y - total)[train], np.ones(train.sum()), 2, 1)(x)
    got = {r["id"]: r["prediction"] for r in scores.collect()}
    assert all(got[i] == pytest.approx(total[i]) for i in got) and len(got) == (fold == 0).sum()


def test_weights_empty_roles_and_rows(spark, grown):
    x, y, _, _, rows = grown
    made = Stack(rows, ["id"], COLUMNS, ["y"], F.array(F.lit(0).cast("tinyint"), (F.col("id") < 200).cast("tinyint")), F.lit(True),
                 weight=F.when(F.col("id") < 100, F.lit(0.0)).otherwise(F.col("id")))
    scores, _ = made.grow([Forest(0, 0, 0, 1), Forest(1, 1, 0, 1)], Growth(trees=1, depth=2, min_leaf=1, bag=False))
    got = {(r["forest"], r["id"]): r["prediction"] for r in scores.collect()}
    assert {f for f, _ in got} == {1}  # an empty role predicts nothing
    i = np.arange(300)
    w = np.where((i >= 100) & (i < 200), i, 0).astype(float)
    want = exact_tree(x[w > 0], y[w > 0], w[w > 0], 2, 0)(x)
    assert all(v == pytest.approx(want[i]) for (_, i), v in got.items()) and len(got) == 100
    scores, share = stack(rows.limit(0)).grow([Forest(0, 0, 0, 1)], Growth(2, 2, 1))
    assert scores.collect() == [] and share.collect() == []


def test_replicate_sums_equal_copies(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(
        [(i, i % 2, float(rng.normal()), None if i % 9 == 0 else float(i)) for i in range(200)], "k long, g int, u double, v double")
    got = {(r["g"], r["rep"]): r["s"] for r in replicate_sums(
        df, poisson_weights(("k",), 12, 5), [F.lit(1.0), F.col("u"), F.col("u") * F.col("v")], ["g"]).collect()}
    copies = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn(
        "w", F.when(F.col("rep") == 0, 1.0).otherwise(poisson_one(portable_hash("k", "rep", seed=5))))
    want = copies.groupBy("g", "rep").agg(F.sum("w"), F.sum(F.expr("w * u")), F.sum(F.expr("w * u * v"))).collect()
    assert len(want) == len(got) == 26
    for r in want:
        assert got[r["g"], r["rep"]] == pytest.approx(list(r)[2:])
    assert replicate_sums(df.limit(0), poisson_weights(("k",), 3, 5), [F.col("u")], ["g"]).collect() == []


def test_running_sums_cross_partitions(spark):
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"k": ["hot"] * 400 + ["a", "b", "b"], "o": [*rng.permutation(400), 1, 5, 2], "n": rng.integers(0, 9, 403)})
    out = running_sums(spark.createDataFrame(df), ["k"], ["o"], ["n"])
    got = {(r["k"], r["o"]): (r["n_upto"], r["next"]) for r in out.collect()}
    df = df.sort_values(["k", "o"])
    df["upto"], df["next"] = df.groupby("k").n.cumsum(), df.groupby("k").o.shift(-1)
    assert len(got) == len(df)
    for r in df.itertuples():
        assert got[r.k, r.o] == (r.upto, None if np.isnan(r.next) else r.next)


def effects(n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({"zone_id": np.arange(n) % 20, "date": [date(2024, 1, 1 + i // 20) for i in range(n)],
                         "x1": rng.integers(0, 40, n) / 4, "x2": rng.normal(size=n)})
    rows["cate"] = np.round(np.where(rows.x1 > 5, 1.0, 0.0) + 0.3 * rows.x2, 3)
    return rows


def test_policy_tree_is_the_exact_one(spark):
    rows = effects()
    got = cate.policy_tree(cate.Cate(spark.createDataFrame(rows), ["x1", "x2"], None)).toPandas().set_index("rule")
    x = rows[["x1", "x2"]].to_numpy()
    leaf = exact_tree(x, rows.cate.to_numpy(), np.ones(len(rows)), 2, 1)(x)
    want = pd.Series(leaf).round(9).value_counts()
    assert sorted(zip(got.n, got.mean_cate.round(9))) == sorted(zip(want.to_numpy(), want.index))
    flat = cate.policy_tree(cate.Cate(spark.createDataFrame(rows.assign(cate=1.0)), ["x1", "x2"], None)).collect()
    assert [(r["rule"], r["n"]) for r in flat] == [("all", 240)]


@pytest.mark.parametrize("learner", ["random_forest", "gradient_boosting"])
def test_forests_find_the_planted_effect(spark, learner):
    rng = np.random.default_rng(4)
    n = 700
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    d = (x1 + rng.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame(pd.DataFrame({
        "zone_id": np.arange(n) % 40, "date": [date(2024, 1, 1 + i // 40) for i in range(n)], "x1": x1, "x2": x2, "treat_binary": d,
        "log_trip_count": 1 + 2 * x1 - x2 + 0.5 * d + rng.normal(0, 0.3, n), "other": x2}))
    rows = {r["outcome"]: r for r in dml.dml_effects(df, ["x1", "x2"], ["log_trip_count", "other"], learner=learner, folds=4,
                                                     reps=2, trees=80).collect()}
    assert rows["log_trip_count"]["theta"] == pytest.approx(0.5, abs=0.2) and rows["log_trip_count"]["n_obs"] == n
    assert abs(rows["other"]["theta"]) < 0.1 and rows["other"]["n_reps"] == 2
