"""The whole ladder on one small panel: every table is there and says what its operator says."""

import os

import pytest

from ripplepanel.catalog import Context
from ripplepanel.operators import did, panel as panels
from ripplepanel.plans import ladder

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_ladder_saves_every_table(spark, tmp_path):
    ctx = Context(spark, SF)
    weeks = ctx.panel("month", 5).join(
        panels.surge_share(ctx.trips(), ctx.policy, "month"), ["zone_id", "date"], "left").cache()
    saved = ladder.measure(weeks, ctx.policy, str(tmp_path), ["lag1_trip_count", "peak_share"], placebo_reps=3, learner="ols", trees=4)
    assert set(saved) >= {"twfe", "event_study", "group_time_att", "dose_bins", "sdid", "dml", "cate", "robustness", "table_estimators",
                          "table_dml", "table_robustness", "table_leads", "table_cate", "targeting_curve"}
    assert {r["outcome"] for r in saved["dml"].collect()} >= {"surge_share", "log_trip_count"}
    groups = {r["group"] for r in saved["robustness"].select("group").distinct().collect()}
    assert groups >= {"DML Learners", "Alternative Outcome", "Placebo Date", "Bandwidth"}
    main = did.twfe_did(weeks).first()
    got = next(r for r in saved["twfe"].collect() if r["outcome"] == "log_trip_count")
    assert got["ate"] == pytest.approx(main["ate"]) and saved["table_robustness"].count() == saved["robustness"].count()
    again = saved["table_estimators"].collect()
    assert len(again) >= 4 and spark.read.parquet(f"{tmp_path}/table_estimators").count() == len(again)
