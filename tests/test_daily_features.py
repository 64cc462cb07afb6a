import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalog import tracks
from wattlens.operators import daily, enrich, features


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("customer_id", "date").collect()]


def test_rolling_minimums_and_lag(readings):
    values = list(np.random.default_rng(3).uniform(0, 20, 60))
    out = daily.daily_context(readings({"a": values, "b": [4.0]}))
    got = rows(out.filter("customer_id = 'a'"), "rolling_7d_mean", "rolling_30d_mean", "rolling_30d_std", "previous_30d_mean")
    s = pd.Series(values)
    m30 = s.rolling(30, min_periods=7).mean()
    for column, expected in enumerate([s.rolling(7, min_periods=2).mean(), m30, s.rolling(30, min_periods=7).std(), m30.shift(7)]):
        for i, e in enumerate(expected):
            assert got[i][column] == (None if np.isnan(e) else pytest.approx(e))
    assert rows(out.filter("customer_id = 'b'"), "rolling_7d_mean", "flatline_flag") == [(None, 0)]


def test_flags_need_a_baseline(readings):
    out = daily.daily_context(readings({"zero": [0.0] * 20, "drop": [10.0] * 20 + [3.9, 4.1, 26.0]}))
    zero = rows(out.filter("customer_id = 'zero'"), "sudden_drop_flag", "low_relative_flag", "flatline_flag", "zero_flag")
    assert set(zero) == {(0, 0, 0, 1)}  # zero baseline and zero median never fire; a flat zero is not a flat line
    drop = rows(out.filter("customer_id = 'drop'"), "sudden_drop_flag", "sudden_spike_flag")
    assert drop[-3:] == [(1, 0), (0, 0), (0, 1)]
    flat = rows(out.filter("customer_id = 'drop'"), "flatline_flag")
    assert flat[5] == (0,) and flat[6] == (1,)


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 7, 7),)], "date date")
    assert [(r.month, r.day_of_week, r.season) for r in daily.calendar(df).orderBy("date").collect()] == [
        (1, 0, "winter"), (7, 6, "summer")]


def test_weather_flags(readings):
    base = readings({"a": [10.0] * 20 + [1.0, 30.0]}).withColumn("weather_demand_pressure", F.when(F.dayofmonth("date") == 21, 1).otherwise(0))
    out = daily.daily_context(base.withColumn("temp_mean", F.lit(5.0)))
    got = rows(out, "low_on_extreme_weather_flag", "high_on_normal_weather_flag", "weather_consumption_mismatch")
    assert got[-2:] == [(1, 0, 1), (0, 1, 1)] and set(got[:-2]) == {(0, 0, 0)}


def test_weather_ladder(spark, readings):
    own = [("Fier", "2024-01-01", 3.0)]
    default = [("Tirana", f"2024-01-0{i}", 30.0) for i in (1, 2)]
    weather = spark.createDataFrame(own + default, "city string, date string, temp_mean double").withColumn("date", F.to_date("date"))
    df = readings({"a": [1, 1, 1]}).withColumn("city", F.lit("Fier"))
    out = enrich.attach_weather(df, enrich.with_temperature_context(weather))
    assert rows(out, "temp_mean", "weather_class") == [(3.0, -1), (30.0, 1), (18.0, 0)]


def test_extended_weather_covers_every_day(readings):
    df = readings({"a": [1, 1, 1]}).withColumn("city", F.lit("Korce"))
    out = enrich.extend_weather(None, df)
    assert out.count() == 3 and out.filter("temp_mean is null").count() == 0


def test_streaks_and_slopes(readings):
    df = readings({"a": [0, 9, 0, 0, 9, 0, 0, 0, 9], "b": [1, 2, 4], "c": [5, 5, 5], "d": [1, 2]})
    context = daily.daily_context(df)
    streaks = {r.customer_id: r.longest_zero_streak for r in features.longest_streaks(context).collect()}
    assert streaks == {"a": 3, "b": 0, "c": 0, "d": 0}
    slopes = {r.customer_id: r.consumption_trend_slope for r in features.trend_slope(context).collect()}
    assert slopes["b"] == pytest.approx(1.5) and slopes["c"] == 0 and slopes["d"] == 0


def test_periods(readings):
    values = [float(i) for i in range(1, 151)]
    out = features.aggregate_customers(daily.daily_context(readings({"a": values, "b": values[:30]})))
    got = {r.customer_id: r for r in out.collect()}
    a, b = got["a"], got["b"]
    assert (a.last_30_mean, a.previous_90_mean, a.first_90_mean) == (np.mean(values[-30:]), np.mean(values[30:120]), np.mean(values[:90]))
    assert b.previous_90_mean is None and b.recent_drop_pct == 0  # falls back to the first 90
    assert a.recent_spike_pct == pytest.approx((a.last_30_mean - a.previous_90_mean) / a.previous_90_mean)
    assert a.median_consumption == np.median(values) and a.days_observed == 150
    assert b.std_consumption == pytest.approx(np.std(values[:30], ddof=1))


@pytest.mark.parametrize("n", [2, 3, 7, 26, 101])
def test_bands_equal_quantile_cuts_of_ranks(spark, n):
    df = spark.createDataFrame([(f"c{i:03}", float(i // 2)) for i in range(n)], "customer_id string, first_90_mean double")
    got = [r.consumption_band for r in features.consumption_bands(df).orderBy("customer_id").collect()]
    assert got == list(pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False) + 1)


def test_one_customer_is_band_one(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "customer_id string, first_90_mean double")
    assert {r.customer_id: r.consumption_band for r in features.consumption_bands(df).collect()} == {"a": 1, "b": None}


def test_payment_scores(spark):
    df = spark.createDataFrame([("a", 12, "Suspended"), ("b", None, None)], "customer_id string, payment_late_count_12m int, account_status string")
    got = {r.customer_id: (r.payment_on_time_ratio, r.payment_risk_score) for r in features.payment_scores(df).collect()}
    assert got["a"] == (0.0, pytest.approx(42.0)) and got["b"] == (1.0, 0.0)
    plain = features.payment_scores(df.select("customer_id"))
    assert {r.payment_risk_score for r in plain.collect()} == {0.0}


def test_features_do_not_depend_on_order_or_partitions(spark, readings):
    rng = np.random.default_rng(5)
    df = readings({f"c{i}": rng.uniform(0, 9, 40) for i in range(12)})
    first = features.customer_features(daily.daily_context(df)).orderBy("customer_id").toPandas()
    again = features.customer_features(daily.daily_context(df.repartition(3).orderBy(F.rand(1)))).orderBy("customer_id").toPandas()
    pd.testing.assert_frame_equal(first, again[first.columns], rtol=1e-9)


def test_attaching_weather_asks_the_readings_nothing(spark):
    """Cities and days without weather of their own take the default city's, and nothing is read for it beforehand."""
    day = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    weather = spark.createDataFrame([(day[0], "Home", 5.0), (day[1], "Home", 6.0), (day[0], "Far", 9.0), (day[2], "Far", None)],
                                    "date date, city string, temp_mean double")
    unread = spark.range(1).select(F.lit("a").alias("customer_id"), F.lit(day[0]).alias("date"),
                                   F.raise_error(F.lit("read")).cast("string").alias("city"))
    enrich.attach_weather(unread, weather, "Home")
    rows = [("a", day[0], "Far"), ("a", day[1], "Far"), ("a", day[2], "Far"), ("b", day[0], "New"), ("b", day[1], None)]
    df = spark.createDataFrame(rows, "customer_id string, date date, city string")
    out = {(r.customer_id, r.date.day): (r.city, r.temp_mean) for r in enrich.attach_weather(df, weather, "Home").collect()}
    assert out == {("a", 1): ("Far", 9.0), ("a", 2): ("Far", 6.0), ("a", 3): ("Far", 18.0), ("b", 1): ("New", 5.0), ("b", 2): ("Home", 6.0)}


def test_windows_keep_their_partitions(spark, readings, monkeypatch):
    """As many as the session's shuffle partitions; by shuffled bytes it would be one."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(tracks, "supplier_weather", lambda s, d: readings({f"c{i}": [1.0, 2.0] for i in range(40)}))
    assert tracks.supplier_daily(spark, "").rdd.getNumPartitions() == count
