import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattlens.operators import audit, forecast


def series(spark, values):
    start = dt.date(2024, 1, 1)
    rows = [(n, start + dt.timedelta(days=i), float(v)) for n, s in values.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "series string, date date, value double")


def by_hand(values, horizon):
    """The definition, one series at a time."""
    y = pd.Series(values, index=pd.date_range("2024-01-01", periods=len(values)))
    recent = y.iloc[-56:]
    level, before = recent.iloc[-14:].median(), recent.iloc[-28:-14]
    before = before.median() if len(before) else level
    limit = 0.08 * max(level, 1)
    trend = min(max((level - before) / 14, -limit), limit)
    low = max(0, recent.quantile(0.05) * 0.45)
    high = max(recent.quantile(0.95) * 1.55, level * 1.8, 1)
    out = []
    for step in range(1, horizon + 1):
        day = y.index[-1] + pd.Timedelta(days=step)
        same = recent[recent.index.dayofweek == day.dayofweek]
        seasonal = same.median() if len(same) else level
        out.append(min(max(0.56 * seasonal + 0.34 * level + 0.10 * (level + trend * step), low), high))
    return out


def test_many_series_at_once(spark):
    rng = np.random.default_rng(2)
    data = {"long": rng.gamma(2, 5, 100), "month": rng.gamma(2, 5, 20), "growing": np.arange(12) * 3.0}
    out = forecast.weekly_forecast(series(spark, data), 30).toPandas()
    for name, values in data.items():
        got = out[out["series"] == name].sort_values("step")["forecast"]
        assert list(got) == pytest.approx(by_hand(values, 30)), name


def test_short_and_flat_series_repeat_their_median(spark):
    out = forecast.weekly_forecast(series(spark, {"short": [1, 5, 2], "flat": [4.0] * 20}), 3).collect()
    assert {(r.series, r.forecast) for r in out} == {("short", 2.0), ("flat", 4.0)}


def event_table(spark, n, drops):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=i), 5.0, 0.0, float(drops(i)), 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "date date, average_consumption double, zero_events double, sudden_drop_events double, "
                                       "flatline_events double, weather_mismatch_events double")


def test_loss_forecast_by_money(spark):
    events = event_table(spark, 40, lambda i: 1 + i % 3)
    out = forecast.loss_forecast(events, F.lit(3000.0)).orderBy("date").collect()
    pressure = np.array([0.8 * (1 + i % 3) for i in range(40)])
    money = pressure * 3000 / pressure[-30:].sum()
    expected = np.clip(0.78 * np.array(by_hand(money, 30)) + 0.22 * 100, 0, max(np.percentile(money, 98), 250, 1))
    assert [r.predicted_loss_all for r in out] == pytest.approx(list(expected), abs=0.006)
    assert [r.cumulative_predicted_loss for r in out] == pytest.approx(list(np.cumsum(expected)), abs=0.006)
    assert out[0].date == dt.date(2024, 2, 10) and len(out) == 30


def test_loss_forecast_without_events(spark):
    out = forecast.loss_forecast(event_table(spark, 40, lambda i: 0), F.lit(3000.0)).orderBy("date").collect()
    shape = 1 + 0.05 * np.sin(2 * np.pi * np.arange(30) / 7)
    assert [r.predicted_loss_all for r in out] == pytest.approx(list(100 * (0.72 + 0.28 * 0.35) * shape), abs=0.006)


def test_no_history(spark):
    customers = spark.createDataFrame([(10.0, 30, 60, 0, 3000.0)], "avg_consumption double, sudden_drop_count int, zero_days int, "
                                                                  "flatline_days int, estimated_loss_all_30d double")
    out = forecast.loss_forecast_without_history(customers, dt.date(2024, 1, 31)).orderBy("date").collect()
    assert out[0].date == dt.date(2024, 2, 1) and out[0].predicted_zero_consumption_events == 2.0
    factor = (0.95 * 2 + 0.80 * 1) / 3
    assert out[0].predicted_loss_all == pytest.approx(100 * (0.72 + 0.28 * factor), abs=0.006)


def test_forecast_rank_ties_go_to_the_lower_id(spark):
    customers = spark.createDataFrame([("b", 50.0), ("a", 50.0), ("c", 60.0)], "customer_id string, risk_score double")
    ranks = forecast.customer_forecast(customers).orderBy("forecast_priority").collect()
    assert [r.customer_id for r in ranks] == ["c", "a", "b"]


def test_audit(spark, readings):
    daily = readings({"a": [1] * 5})
    empty = spark.createDataFrame([], "customer_id string, risk_level string, estimated_loss_all_30d double")
    assert [r.audit_area for r in audit.operational_audit(empty, daily).collect()] == ["Data coverage"]
    customers = spark.createDataFrame([(f"c{i}", "High", 0.0, None) for i in range(4)],
                                      "customer_id string, risk_level string, estimated_loss_all_30d double, fraud_label double")
    found = {r.audit_area: r.finding for r in audit.operational_audit(customers, daily, 2.5).collect()}
    assert list(found) == ["GIS integration", "Feedback loop", "Inspection capacity", "Historical depth", "Data quality", "Financial impact"]
    assert found["Inspection capacity"] == "High/Critical queue is large (100.0% of customers)."
    good = spark.createDataFrame([(f"c{i}", "High" if i < 2 else "Low", 5.0, 1.0, 41.0, 20.0) for i in range(30)],
                                 "customer_id string, risk_level string, estimated_loss_all_30d double, fraud_label double, latitude double, longitude double")
    assert [r.audit_area for r in audit.operational_audit(good, readings({"a": [1] * 70})).collect()] == ["Operational readiness"]
