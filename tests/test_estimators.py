from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ripplepanel.operators import cate, did, dml, dose, robustness, synth
from ripplepanel.operators import within
from ripplepanel.operators.within import fit_two_way, two_way_demean
from tests.data import dummy_regression, panel


@pytest.fixture(scope="module")
def gappy():
    return panel(drop=0.25, seed=3)


def test_two_way_fit_equals_dummy_regression(spark, gappy):
    df = gappy.assign(tp=gappy.treat_binary * gappy.post, z=gappy.x ** 2)
    want, se = dummy_regression(df, "log_trip_count", ["tp", "x", "z"])
    fit = fit_two_way(spark.createDataFrame(df), ["log_trip_count", "trip_count"], ["tp", "x", "z"])[0]
    assert fit.beta == pytest.approx(want, abs=1e-8)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(se, rel=1e-6)


def test_batches_match_fits_of_their_own(spark, gappy):
    df = gappy.assign(tp=gappy.treat_binary * gappy.post, g=gappy.zone_id % 2)
    both = {f.key: f for f in fit_two_way(spark.createDataFrame(df), ["log_trip_count"], ["tp", "x"], by=["g"])}
    for g in (0, 1):
        own = fit_two_way(spark.createDataFrame(df[df.g == g]), ["log_trip_count"], ["tp", "x"])[0]
        assert both[(g,)].beta == pytest.approx(own.beta, nan_ok=True, abs=1e-9)
        assert both[(g,)].cov == pytest.approx(own.cov, nan_ok=True, abs=1e-9)
        assert both[(g,)].n_obs == own.n_obs


def test_products_take_a_null_as_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, None, 5.0), (2, 1.0, None)], "g int, a double, b double")
    got = within.cross_sums(df, [("a", "b"), ("b", "b")], ["g"])
    assert got == {(1,): {("", ""): 2, ("a", "b"): 6.0, ("b", "b"): 34.0}, (2,): {("", ""): 1, ("a", "b"): 0.0, ("b", "b"): 0.0}}
    assert within.cross_sums(df, [("a", "a")])[()] == {("", ""): 3, ("a", "a"): 5.0}
    assert within.cross_sums(df.limit(0), [("a", "a")], ["g"]) == {}


def plain_sweeps(df, columns, tol=1e-10):
    """Alternating means until the time effects stand still, and how often that takes."""
    unit, time = df.zone_id.to_numpy(), df.date.astype("category").cat.codes.to_numpy()
    count = 0
    for c in columns:
        y, g = df[c].to_numpy(float), np.zeros(time.max() + 1)
        for sweep in range(1, 5000):
            u = pd.Series(y - g[time]).groupby(unit).mean()
            fresh = pd.Series(y - u.loc[unit].to_numpy()).groupby(time).mean().to_numpy()
            moved, g = np.abs(fresh - g).max(), fresh
            if moved <= tol * np.abs(y).max():
                break
        count = max(count, sweep)
    return count


def test_few_sweeps_on_a_panel_with_gaps(spark):
    rng = np.random.default_rng(9)
    df = panel(n_units=40, n_weeks=30, seed=2)
    # units come and go: neighbours overlap for a few weeks only
    at = df.date.astype("category").cat.codes
    df = df[(at - df.zone_id * 0.7).abs() < 4 + rng.integers(0, 2, len(df))].reset_index(drop=True)
    columns = ["log_trip_count", "x"]
    with two_way_demean(spark.createDataFrame(df), columns) as net:
        got = net.frame.toPandas().sort_values(["zone_id", "date"])
    df = df.sort_values(["zone_id", "date"])
    d = np.hstack([pd.get_dummies(df.zone_id).to_numpy(float), pd.get_dummies(df.date).to_numpy(float)])
    for c in columns:
        want = df[c] - d @ np.linalg.lstsq(d, df[c], rcond=None)[0]
        assert got[f"t_{c}"].to_numpy() == pytest.approx(want.to_numpy(), abs=1e-8)
    assert 3 * net.sweeps <= plain_sweeps(df, columns)


def test_absorbed_regressor_is_not_identified(spark, gappy):
    fit = fit_two_way(spark.createDataFrame(gappy), ["log_trip_count"], ["treat_binary", "x"])[0]
    assert fit.at("treat_binary") == (None, None) and fit.at("x")[0] is not None


def test_unsettled_sweeps_raise(spark, gappy):
    with pytest.raises(RuntimeError):
        two_way_demean(spark.createDataFrame(gappy), ["log_trip_count"], max_sweeps=2)


def test_planted_effect_is_found(spark, gappy):
    row = did.twfe_did(spark.createDataFrame(gappy)).first()
    assert abs(row["ate"] + 0.12) < 3 * row["se"] and row["se"] < 0.05
    assert row["pct_change"] == pytest.approx((np.exp(row["ate"]) - 1) * 100)
    assert did.twfe_did(spark.createDataFrame(gappy), ["trip_count"]).first()["pct_change"] is None


def test_two_week_event_study_equals_did(spark):
    df = panel(seed=5)
    df = df[df.rel_week.isin([-1, 0])]
    study = did.event_study(spark.createDataFrame(df))
    row = did.twfe_did(spark.createDataFrame(df)).first()
    coef = {r["rel_week"]: r for r in study.coefficients.collect()}
    assert coef[0]["coef"] == pytest.approx(row["ate"]) and coef[-1]["coef"] == 0
    assert study.pretrend.first()["p_value"] is None  # no leads to test


def test_event_study_on_gaps(spark, gappy):
    df = gappy[gappy.rel_week.between(-4, 4)].reset_index(drop=True)
    weeks = [w for w in sorted(df.rel_week.unique()) if w != -1]
    for w in weeks:
        df[f"d{w}"] = ((df.rel_week == w) & (df.treat_binary == 1)).astype(float)
    want, se = dummy_regression(df, "log_trip_count", [f"d{w}" for w in weeks])
    got = {r["rel_week"]: r for r in did.event_study(
        spark.createDataFrame(gappy), window=4).coefficients.collect()}
    assert [got[w]["coef"] for w in weeks] == pytest.approx(list(want), abs=1e-8)
    assert [got[w]["se"] for w in weeks] == pytest.approx(list(se), rel=1e-6)


def test_group_time_effects(spark, policy):
    df = panel(seed=7)
    att = did.group_time_att(spark.createDataFrame(df), policy)
    rows = {r["rel_week"]: r for r in att.collect()}
    m = df.groupby(["treat_binary", "rel_week"])["log_trip_count"].mean()
    want = (m[1, 3] - m[1, -1]) - (m[0, 3] - m[0, -1])
    assert rows[3]["att"] == pytest.approx(want)
    assert rows[-1]["is_ref"] and rows[-1]["att"] == 0
    assert did.aggregate_att(att).first()["agg_att"] == pytest.approx(-0.12, abs=0.06)
    assert did.att_pretrend(att).first()["df"] == 8
    boot = did.group_time_bootstrap(spark.createDataFrame(df), policy, reps=60).collect()
    assert all(r["se_boot"] is not None for r in boot) and len(boot) == 20


def test_continuous_and_binned_dose(spark, policy):
    df = panel(seed=9, noise=0.01)
    df["log_trip_count"] = df["log_trip_count"] - 0.2 * df["avg_cbd_fee"]
    res = dose.continuous_did(spark.createDataFrame(df), policy, quadratic=False)
    assert res.fit.beta[0] == pytest.approx(-0.2 - 0.12 / 1.75, abs=0.06)
    curve = res.curve().orderBy("dose").collect()
    assert len(curve) == 100 and curve[0]["effect"] == 0 and curve[-1]["dose"] == pytest.approx(2.5)
    bins = dose.dose_bin_did(spark.createDataFrame(df), policy, n_bins=2).collect()
    assert [r["bin"] for r in bins] == [0, 1] and bins[0]["att"] > bins[1]["att"]
    none = dose.dose_bin_did(spark.createDataFrame(df[df.treat_binary == 0]), policy)
    assert none.count() == 0


def test_robustness_statuses(spark, policy):
    sdf = spark.createDataFrame(panel(n_weeks=20, seed=11))
    rows = {r["check"]: r for r in robustness.run_all(sdf, policy).collect()}
    assert rows["Placebo shift +8w"]["status"] == "too_few_rows"
    assert rows["Exclude buffer zones"]["n_obs"] == 11 * 20
    main = did.twfe_did(sdf.where("treat_ring <> 1")).first()
    assert rows["Exclude buffer zones"]["theta"] == pytest.approx(main["ate"])
    assert rows["Exclude buffer zones"]["se"] == pytest.approx(main["se"])
    assert {"Drop Bronx", "Drop Queens"} <= set(rows) and "Drop Manhattan" not in rows


def test_missing_borough_is_kept(spark, policy):
    df = panel(seed=2)
    df.loc[df.zone_id == 12, "borough"] = None
    rows = {r["check"]: r for r in robustness.run_specs(
        spark.createDataFrame(df), robustness.control_groups(policy)).collect()}
    outer = ((df.treat_binary == 1) | (df.borough != "Manhattan")).sum()
    assert rows["Outer-borough control only"]["n_obs"] == outer


def test_simplex_solver_is_optimal():
    rng = np.random.default_rng(0)
    a = rng.normal(3, 0.4, (16, 12))
    b = a[:, :3].mean(axis=1) + rng.normal(0, 0.05, 16)
    w = synth.simplex_least_squares(a, b, 1e-6)
    g = (a.T @ a + 1e-6 * np.eye(12)) @ w - a.T @ b
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w @ g - g.min() < 1e-7


@pytest.mark.parametrize("intercept", [False, True])
def test_sdid_weights_equal_a_dense_solve(spark, policy, intercept):
    sdf = spark.createDataFrame(panel(n_units=9, n_treated=3, n_weeks=14, seed=4, noise=0.02))
    cells = synth.weekly_cells(sdf, policy).cache()
    roles = synth.replicate_roles(cells, 2).cache()
    found = synth.solved_weights(cells, roles, intercept=intercept)
    wide = cells.toPandas().pivot(index="zone_id", columns="week", values="y")
    pre = np.array([w < policy.shock for w in wide.columns])
    taus = {r["rep"]: r["tau"] for r in synth.replicate_tau(cells, roles, found).collect()}
    for rep, part in roles.toPandas().groupby("rep"):
        y = wide.loc[part.zone_id].to_numpy()
        treated = part.treated.to_numpy() == 1
        a, b = y[~treated][:, pre].T, y[treated].mean(axis=0)[pre]
        c, d = y[~treated][:, pre], y[~treated][:, ~pre].mean(axis=1)
        if intercept:
            ac, bc, cc, dc = a - a.mean(axis=0), b - b.mean(), c - c.mean(axis=0), d - d.mean()
        else:
            ac, bc, cc, dc = a, b, c, d
        omega, lam = synth.simplex_least_squares(ac, bc, 1e-6), synth.simplex_least_squares(cc, dc)
        want = (y[treated][:, ~pre].mean() - (y[treated][:, pre] @ lam).mean()) - omega @ (d - c @ lam)
        assert taus[rep] == pytest.approx(want, abs=1e-3)
    assert taus[0] == pytest.approx(-0.12, abs=0.05)
    if not intercept:
        checks = synth.weight_checks(cells, roles, found).collect()
        assert all(r["optimal"] == 1 and r["negative"] == 0 for r in checks)
        assert all(r["total"] == pytest.approx(1) for r in checks)


def test_uniform_sdid_is_did_of_means(spark, policy):
    df = panel(n_units=6, n_treated=4, n_weeks=14, seed=6)
    row = synth.sdid(spark.createDataFrame(df), policy, reps=5, uniform=True).first()
    m = df.groupby(["treat_binary", "post"])["log_trip_count"].mean()
    assert row["tau_hat"] == pytest.approx((m[1, 1] - m[1, 0]) - (m[0, 1] - m[0, 0]))
    assert (row["n_treated"], row["n_control"]) == (4, 2) and row["se"] is not None


def test_single_treated_unit_and_missing_weeks(spark, policy):
    df = panel(n_units=7, n_treated=1, n_weeks=14, seed=8)
    df = df[~((df.zone_id == 7) & (df.rel_week == 0))]
    sdf = spark.createDataFrame(df)
    assert synth.weekly_cells(sdf, policy, missing="drop").select("zone_id").distinct().count() == 6
    zero = synth.weekly_cells(sdf, policy)
    assert zero.count() == 7 * 14 and zero.where("y = 0").count() == 1
    row = synth.sdid(sdf, policy, reps=3, missing="drop").first()
    assert row["tau_hat"] == pytest.approx(-0.12, abs=0.1) and row["n_dropped"] == 1
    assert synth.sdid(sdf, policy, reps=3).first()["n_dropped"] == 0


def _covariate_data(n=600, seed=1, effect=0.5):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    d = (x1 + rng.normal(size=n) > 0).astype(float)
    y = 1 + 2 * x1 - x2 + effect * d + rng.normal(0, 0.3, n)
    return pd.DataFrame({
        "zone_id": np.arange(n) % 40, "date": [date(2024, 1, 1 + i // 40) for i in range(n)],
        "x1": x1, "x2": x2, "treat_binary": d, "log_trip_count": y})


@pytest.mark.parametrize("learner", ["ols", "ridge", "lasso"])
def test_linear_dml(spark, learner):
    df = _covariate_data()
    row = dml.dml_effects(spark.createDataFrame(df), ["x1", "x2"], ["log_trip_count"],
                          learner=learner, reps=2).first()
    assert abs(row["theta"] - 0.5) < 4 * row["se"] and row["n_obs"] == 600 and row["n_reps"] == 2


def test_held_out_residuals_equal_separate_fits(spark):
    df = _covariate_data(200)
    got = dml.cross_fit_residuals(
        spark.createDataFrame(df), ["x1", "x2"], ["log_trip_count"], "ols", folds=4).toPandas()
    for fold in range(4):
        train, test = got[got.fold != fold], got[got.fold == fold]
        a = np.column_stack([np.ones(len(train)), train.x1, train.x2])
        b = np.linalg.lstsq(a, train.log_trip_count, rcond=None)[0]
        want = test.log_trip_count - np.column_stack([np.ones(len(test)), test.x1, test.x2]) @ b
        assert test.r_log_trip_count.to_numpy() == pytest.approx(want.to_numpy())


def test_lasso_optimality():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(150), rng.normal(size=(150, 5))])
    y = x @ np.array([1, 2, 0, 0, -1, 0.0]) + rng.normal(size=150)
    b = dml._lasso(x.T @ x, x.T @ y, 0.3)
    sd = x[:, 1:].std(axis=0)
    g = ((x[:, 1:] - x[:, 1:].mean(axis=0)) / sd).T @ (y - x @ b) / 150
    live = b[1:] != 0
    assert np.abs(g[live]) == pytest.approx(0.3, abs=1e-5) and (np.abs(g[~live]) <= 0.3 + 1e-6).all()


def test_zone_folds_and_vanishing_treatment(spark):
    df = spark.createDataFrame(_covariate_data(200))
    res = dml.cross_fit_residuals(df, ["x1"], ["log_trip_count"], "ols", cluster_folds=True)
    assert res.groupBy("zone_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    known = df.withColumn("copy", F.col("treat_binary"))
    row = dml.dml_effects(known, ["copy", "x1"], ["log_trip_count"], learner="ols").first()
    assert row["theta"] is None and row["n_reps"] == 0
    with pytest.raises(ValueError):
        dml.cross_fit_residuals(df, ["x1"], ["log_trip_count"], "unknown")


def _uneven(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.uniform(-1, 1, n), rng.uniform(-1, 1, n)
    d = (rng.random(n) < 0.5).astype(float)
    y = x2 + (1 + 2 * x1) * d + rng.normal(0, 0.2, n)
    return pd.DataFrame({
        "zone_id": np.arange(n) % 30, "date": [date(2024, 1, 1 + i // 30) for i in range(n)],
        "x1": x1, "x2": x2, "treat_binary": d, "log_trip_count": y})


@pytest.mark.parametrize("method,kw", [
    ("t", {"learner": "ols", "n_boot": 10}),
    ("t", {"trees": 8, "n_boot": 2, "boot_trees": 4}),
    ("residual", {"nuisance": "ols", "folds": 2, "bags": 4, "trees_per_bag": 8})])
def test_planted_heterogeneity(spark, method, kw):
    sdf = spark.createDataFrame(_uneven())
    found = cate.causal_forest(sdf, ["x1", "x2"], method, **kw)
    got = found.rows.toPandas()
    assert np.corrcoef(got.cate, 1 + 2 * got.x1)[0, 1] > 0.8
    assert got.cate.mean() == pytest.approx(1.0, abs=0.25) and (got.cate_se > 0).all()
    if method == "residual":
        assert found.importance.first()["feature"] == "x1"
        assert len(got) == 900


def test_readings_of_effects(spark):
    rows = _uneven(200).assign(y=lambda d: d.log_trip_count, t=lambda d: d.treat_binary)
    rows["cate"] = 1 + 2 * rows.x1
    rows.loc[:60, "cate"] = 9.0  # a third of all rows tie
    rows = rows.assign(cate_se=0.5, cate_low=0.0, cate_high=1.0)
    sdf = spark.createDataFrame(rows[[
        "zone_id", "date", "y", "t", "x1", "x2", "cate", "cate_se", "cate_low", "cate_high"]])
    curve = cate.targeting_curve(sdf).orderBy("fraction").collect()
    ranked = rows.sort_values(["cate", "zone_id", "date"], ascending=[False, True, True])
    for k, r in enumerate(curve, 1):
        top = ranked.head(-(-k * 200 // 10))
        want = top[top.t == 1].y.mean() - top[top.t == 0].y.mean()
        assert r["ate_top_q"] == pytest.approx(want) and r["n_targeted"] == len(top)
    clean = spark.createDataFrame(rows.assign(cate=1 + 2 * rows.x1 - 3 * rows.x2))
    found = cate.Cate(clean, ["x1", "x2"], None)
    blp = cate.best_linear_projection(found).collect()
    assert [(r["feature"], round(r["coefficient"], 6)) for r in blp] == [("x2", -3.0), ("x1", 2.0)]
    leaves = cate.policy_tree(found).collect()
    assert len(leaves) == 4 and sum(r["n"] for r in leaves) == 200
    assert all(r["rule"] for r in leaves)


def test_event_study_without_window_takes_every_week(spark):
    df = panel(n_units=10, n_weeks=40, start=date(2024, 7, 15))
    found = {r["rel_week"]: r["coef"] for r in did.event_study(spark.createDataFrame(df), window=None).coefficients.collect()}
    weeks = sorted(set(df["rel_week"]) - {-1})
    assert min(weeks) < -16 and set(found) == {*weeks, -1}
    for w in weeks:
        df[f"w{w}"] = (df["rel_week"] == w) * df["treat_binary"]
    b, _ = dummy_regression(df, "log_trip_count", [f"w{w}" for w in weeks])
    assert np.allclose([found[w] for w in weeks], b, atol=1e-6)


def test_sweeps_leave_a_panel_where_it_is(spark):
    with two_way_demean(spark.createDataFrame(panel()), ["log_trip_count"]) as net:
        assert net.base.rdd.getNumPartitions() == 1
        left = net.base.selectExpr("date", "log_trip_count - avg(log_trip_count) over (partition by zone_id) as x")
        left.collect()
        plan = left._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "Exchange" not in plan
