import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplepanel.functions import columns, tails
from ripplepanel.functions.ranking import exact_quantiles, global_rank


def test_normal_tail_expression(spark):
    zs = [-3.0, -1.96, 0.0, 0.5, 1.0, 2.5758, 5.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(
        tails.normal_two_sided(F.col("z")).alias("p")).collect()
    for z, r in zip(zs, got):
        assert r["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=2e-7)


@pytest.mark.parametrize("x,df,want", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (18.307038053275146, 10, 0.05), (24.99579013972863, 15, 0.05), (0.0, 4, 1.0)])
def test_chi_square_tail(x, df, want):
    assert tails.chi2_sf(x, df) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("t,df,want", [
    (12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (2.1447866879169273, 14, 0.05),
    (1.959963984540054, 1e7, 0.05), (0.0, 5, 1.0), (0.1, 30, 0.92101)])
def test_student_tail(t, df, want):
    assert tails.student_two_sided(t, df) == pytest.approx(want, rel=1e-4)


def test_exact_quantiles_with_ties(spark):
    values = [0.0] * 40 + [1.0] * 5 + [2.5, 3.5, 9.0, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    probs = [0, 0.2, 0.5, 0.85, 0.9, 0.95, 1.0]
    assert exact_quantiles(df, "v", probs, ["k"]) == pytest.approx(list(np.quantile(values, probs)))
    assert exact_quantiles(df.where("v > 100"), "v", probs) == []


def test_global_rank_is_a_permutation(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 7, 500)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double").repartition(5)
    rows = global_rank(df, [F.desc("v"), F.col("k")]).collect()
    want = sorted(range(500), key=lambda i: (-values[i], i))
    assert {r["k"]: r["rank0"] for r in rows} == {k: i for i, k in enumerate(want)}


def test_hash_is_portable_and_poisson_has_mean_one(spark):
    df = spark.range(1).select(columns.portable_hash(F.lit(12), seed=7).alias("h"))
    assert df.first()["h"] == 981220465
    draws = [r["w"] for r in spark.range(20000).select(columns.poisson_one(
        columns.portable_hash("id", seed="s")).alias("w")).collect()]
    assert np.mean(draws) == pytest.approx(1.0, abs=0.03)
    assert np.var(draws) == pytest.approx(1.0, abs=0.05)
    assert Counter(draws)[0.0] / 20000 == pytest.approx(math.exp(-1), abs=0.01)


def test_bins_text_and_rounding(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (None,), (-0.00001,)], "v double")
    out = df.select(
        columns.right_closed_bin(F.col("v"), [0.0, 1.0, 2.0]).alias("b"),
        columns.right_closed_bin(F.col("v"), [0.0, 1.0, 2.0], False).alias("open"),
        columns.fixed(F.col("v"), 2).alias("t"), columns.round4(F.col("v")).alias("r")).collect()
    assert [r["b"] for r in out] == [1, 1, 2, 2, None, None]
    assert [r["open"] for r in out] == [None, 1, 2, 2, None, None]
    assert [r["t"] for r in out][:5] == ["0.00", "1.00", "1.50", "2.00", "—"]
    assert math.copysign(1, out[5]["r"]) == 1 and out[5]["r"] == 0
