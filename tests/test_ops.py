import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattlens.operators import ops
from wattlens.streaming import live


def cases(spark):
    rows = [(i + 1, f"c{i}", 90.0 - i, "High" if i < 3 else "Low", "A", "T", 10.0 * i, "r", None) for i in range(80)]
    queue = spark.createDataFrame(rows, "priority_rank int, customer_id string, risk_score double, risk_level string, area_id string, "
                                        "transformer_id string, estimated_loss_all_30d double, main_reason string, recommended_action string")
    return ops.create_cases(queue, ["Team B", "Team A"])


def test_case_life(spark):
    new = cases(spark)
    got = new.orderBy("case_id").collect()
    assert len(got) == 75 and got[0].case_id == "NTL-00001" and got[0].recommended_action == ""
    assert [r.assigned_team for r in got[:3]] == ["Team A", "Team B", "Team A"]
    sent = ops.dispatch(new, "Team B", 2).withColumn("event_time", F.lit(1))
    done = spark.createDataFrame([("NTL-00001", "Team B", "Confirmed NTL", 3), ("NTL-00001", "Team B", "In Field", 2)],
                                 "case_id string, assigned_team string, status string, event_time int")
    now = ops.case_state(new, sent.unionByName(done))
    state = {r.case_id: (r.status, r.assigned_team, r.inspection_result) for r in now.collect()}
    assert state["NTL-00001"] == ("Confirmed NTL", "Team B", "Pending") and state["NTL-00002"][0] == "Assigned" and state["NTL-00003"][0] == "New"
    summary = {r.assigned_team: (r.total, r.dispatched, r.confirmed, r.open) for r in ops.team_summary(now).collect()}
    assert summary == {"Team A": (37, 0, 0, 0), "Team B": (38, 2, 1, 1)}
    kpis = ops.case_kpis(now, ["New"]).first()
    assert (kpis.open_cases, kpis.confirmed, kpis.in_view) == (74, 1, 73)
    assert [r.case_id for r in ops.team_board(now, "Team B").collect()] == ["NTL-00001", "NTL-00002"]


def test_case_text_is_never_null(spark):
    df = spark.createDataFrame([("nan",), (None,), ("None",), ("x",)], "t string")
    assert [r.v for r in df.select(ops.case_text(F.col("t")).alias("v")).collect()] == ["", "", "", "x"]


def test_requests(spark):
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    rows = [("R1", "asked", t(1), "admin", "loss", "why"), ("R1", "answered", t(3), "analyst", "loss", "because"),
            ("R1", "answered", t(5), "other", "loss", "later"), ("R2", "asked", t(2), "admin", "area", ""), ("R3", "answered", t(2), "x", "", "lost")]
    events = spark.createDataFrame(rows, "request_id string, kind string, event_time timestamp, actor string, topic string, note string")
    state = {r.request_id: (r.status, r.answered_by, r.response) for r in ops.request_state(events).collect()}
    assert state == {"R1": ("Answered", "analyst", "because"), "R2": ("Pending", None, None)}
    assert tuple(ops.pending_requests(ops.request_state(events)).first()) == (1, 1)


def test_feed_is_newest_first_and_bounded(spark):
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("time"))
    got = [r.event_id for r in ops.activity_feed(events, 400).collect()]
    assert got == list(range(999, 699, -1))


def test_correlation_with_gaps_and_constants(spark):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"risk_score": rng.normal(size=40), "zero_day_ratio": rng.normal(size=40), "unpaid_bills": 3.0})
    frame["fraud_probability"] = np.where(rng.uniform(size=40) < 0.3, np.nan, frame["risk_score"] + rng.normal(size=40))
    frame["flatline_ratio"] = [1.0, 2.0] + [np.nan] * 38
    got = {(r.a, r.b): r.correlation for r in ops.correlation(spark.createDataFrame(frame).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame])).collect()}
    expected = frame.drop(columns="flatline_ratio").corr().round(2)
    assert len(got) == 16
    for (a, b), value in got.items():
        assert (value is None and np.isnan(expected.loc[a, b])) or value == pytest.approx(expected.loc[a, b], abs=0.011)


def test_counts_keep_empty_levels(spark):
    df = spark.createDataFrame([("High",), ("High",), ("Low",)], "risk_level string")
    assert [(r.risk_level, r.rows) for r in ops.level_counts(df).collect()] == [("Low", 1), ("Medium", 0), ("High", 2), ("Critical", 0)]


def test_snapshot(spark):
    new = cases(spark)
    customers = new.select("customer_id", "risk_score", "risk_level", "estimated_loss_all_30d")
    areas = spark.createDataFrame([("A", 50.0, 1)], "area_id string, area_risk_score double, forecast_priority int")
    loss = spark.createDataFrame([(10.0,), (5.4,)], "predicted_loss_all double")
    out = json.loads(ops.context_snapshot(customers, areas, new, new, loss, areas, quality={"rows": 3}).first().context)
    assert out["totals"]["customers_analyzed"] == 75 and out["case_status_counts"] == {"New": 75}
    assert [r["customer_id"] for r in out["top_20_customers_by_risk"]][:2] == ["c0", "c1"] and len(out["top_15_inspection_priority"]) == 15
    assert out["forecast_30d_total_loss_lek"] == 15.0 and out["data_quality"] == {"rows": 3}


def test_live_panel_follows_appended_events(spark, tmp_path):
    folder, target = str(tmp_path / "events"), str(tmp_path / "panel")
    schema = "case_id string, event_time int, status string"
    ops.append_events(spark.createDataFrame([("a", 1, "Assigned"), ("b", 1, "Assigned")], schema), folder)
    ops.append_events(spark.createDataFrame([("a", 2, "In Field")], schema), folder)
    stream = live.start_panel(live.latest_case_events(live.read_events(spark, folder, schema)), target, str(tmp_path / "cp"), "1 second")
    try:
        stream.processAllAvailable()
        ops.append_events(spark.createDataFrame([("b", 5, "False Alarm"), ("b", 4, "Inspected")], schema), folder)
        stream.processAllAvailable()
    finally:
        stream.stop()
    assert {r.case_id: r.status for r in live.read_panel(spark, target).collect()} == {"a": "In Field", "b": "False Alarm"}
