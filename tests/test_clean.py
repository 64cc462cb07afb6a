import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.operators import clean


def test_decimal_comma_and_odd_numbers(spark):
    texts = ["1,5", "1,234", "1,234,567", "1 234,5", "1e3", "1d", "-", "NULL", "inf", " 7 ", "nan", "", "-2.5"]
    expected = [1.5, 1.234, None, 1234.5, 1000.0, None, None, None, None, 7.0, None, None, -2.5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", clean.coerce_numeric(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == expected


def test_date_formats(spark):
    texts = ["2014-01-02", "2014/1/2", "1/13/2014", "13/1/2014", "01/02/2014", "2014.1.2", "12:30", "2014", "x", None,
             "2014-01-02 10:30:00", "2014-02-30"]
    day = dt.date
    expected = [day(2014, 1, 2), day(2014, 1, 2), day(2014, 1, 13), day(2014, 1, 13), day(2014, 1, 2), day(2014, 1, 2),
                None, None, None, None, day(2014, 1, 2), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.d for r in df.select("i", clean.parse_date(F.col("t")).alias("d")).orderBy("i").collect()] == expected


def raw(spark, rows):
    return spark.createDataFrame(rows, "customer_id string, date string, consumption_kwh string, fraud_label double, seq int")


def test_null_and_blank_ids_are_dropped(spark):
    df = raw(spark, [(None, "2024-01-01", "1", None, 0), ("  ", "2024-01-01", "1", None, 1), (" a ", "2024-01-01", "1", None, 2)])
    assert [r.customer_id for r in clean.trim_ids(df).collect()] == ["a"]


def test_whole_cleaning(spark):
    rows = [("a", "2024-01-01", "2", None, 1), ("a", "2024-01-01", "4", 1.0, 2), ("a", "2024-01-01", "6", 0.0, 3),
            ("a", "2024-01-02", "-5", None, 4), ("a", "2024-01-03", "8", None, 5), ("a", "bad", "8", None, 6),
            ("b", "2024-01-01", None, None, 7), ("", "2024-01-01", "3", None, 8)]
    cleaned, report = clean.clean_readings(raw(spark, rows), "seq")
    got = {(r.customer_id, r.date.day): (r.consumption_kwh, r.fraud_label) for r in cleaned.collect()}
    cap = np.quantile([4.0, 8.0], 0.995)
    own = np.median([4.0, cap])
    # missing reading of a: its own median; b has none: median of everything after the first fill
    assert got[("a", 1)] == (4.0, 1.0)
    assert got[("a", 2)][0] == pytest.approx(own)
    assert got[("a", 3)] == (pytest.approx(cap), 1.0)
    assert got[("b", 1)] == (pytest.approx(np.median([4.0, own, cap])), None)
    r = report.first()
    assert (r.initial_rows, r.clean_rows, r.customers, r.invalid_dates_removed) == (8, 4, 2, 1)
    assert (r.duplicate_customer_date_readings_merged, r.negative_values_replaced, r.missing_consumption_filled) == (2, 1, 2)
    assert r.extreme_values_capped == 1
    history = min(np.median([3, 1]) / 90, 1)
    expected = (0.30 * (1 - 2 / 8) + 0.25 * (1 - 1 / 8) + 0.20 * (1 - 2 / 8) + 0.25 * history) * 100
    assert r.data_readiness_score == pytest.approx(round(expected, 1))


def test_missing_label_column(spark, readings):
    assert clean.propagate_labels(readings({"a": [1, 2]})).first().fraud_label is None


def test_approximate_cap_is_close(readings):
    df = readings({"a": range(1, 1001)})
    limit = df.select(clean.cap_value(df, approximate=True).alias("v")).first().v
    assert limit == pytest.approx(995, abs=2)
