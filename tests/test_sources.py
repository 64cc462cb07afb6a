import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from wattlens import pipeline
from wattlens.sources import detect, readers, reshape, sinks


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_tolerant_scan(spark, tmp_path):
    path = write(tmp_path / "m.csv", "﻿ CONS_NO ;city;value\na;Korçë;1,5\nb;x;2;too;many\nc;y\n\nd;z;3\n")
    out = readers.scan_csv(spark, path)
    assert out.columns == ["CONS_NO", "city", "value"]
    assert {tuple(r) for r in out.collect()} == {("a", "Korçë", "1,5"), ("c", "y", None), ("d", "z", "3")}
    latin = write(tmp_path / "l.csv", "id\tname\n1\tKorçë\n", "latin1")
    assert readers.scan_csv(spark, latin).collect()[0]["name"] == "Korçë"


@pytest.mark.parametrize("name,expected", [
    ("2014/1/1", dt.date(2014, 1, 1)), ("1/13/2014", dt.date(2014, 1, 13)), ("13/1/2014", dt.date(2014, 1, 13)), ("01.02.2014", dt.date(2014, 1, 2)),
    ("1999-01-01", None), ("flag", None), ("2014/13/40", None), ("20140101", None)])
def test_header_dates(name, expected):
    assert detect.header_date(name) == expected


def wide(spark):
    rows = [("x1", "1,5", "2", None, "1"), ("x2", "3", "-", "4", "0")]
    return spark.createDataFrame(rows, "`1/2/2014` string, `2014/1/1` string, `1/3/2014` string, `a.b` string, FLAG string").toDF(
        "who", "1/2/2014", "2014/1/1", "1.3.2014", "FLAG")


def test_wide_layout(spark):
    df = wide(spark)
    layout = detect.detect_layout(df)
    assert (layout.kind, layout.id_column, layout.label_column, len(layout.day_columns)) == ("wide", "who", "FLAG", 3)
    assert layout.confidence == 0.55 and len(layout.issues) == 1
    long = reshape.to_long(df, layout)
    got = {(r.customer_id, r.date.day): (r.consumption_kwh, r.fraud_label) for r in long.collect()}
    assert got == {("x1", 1): (2.0, 1.0), ("x1", 2): (1.5, 1.0), ("x1", 3): (None, 1.0), ("x2", 1): (None, 0.0), ("x2", 2): (3.0, 0.0), ("x2", 3): (4.0, 0.0)}
    recent = reshape.to_long(df, layout, max_days=2)
    assert {r.date.day for r in recent.collect()} == {2, 3}


def test_long_layout_and_unknown_tables(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "1", "Z")], "`Meter ID` string, day string, kwh string, area_id string")
    layout = detect.detect_layout(df)
    assert (layout.kind, layout.id_column, layout.date_column, layout.consumption_column) == ("long", "Meter ID", "day", "kwh")
    assert reshape.to_long(df, layout).first().area_id == "Z"
    with pytest.raises(ValueError):
        detect.detect_layout(spark.createDataFrame([(1,)], "x int"))


def test_generated_ids_follow_the_file(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(10)], "v string").repartition(1).coalesce(1)
    got = readers.generated_ids(df).orderBy("v").collect()
    assert sorted(r["Generated Customer ID"] for r in got) == [f"ROW_{i:06d}" for i in range(1, 11)]


def test_profile_and_empty_axes(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, "x", None), (None, None, None)], "a int, b string, c string")
    assert tuple(detect.profile_table(df).first()) == (4, 3, 8, 66.67, 1, 0, 1)
    out = detect.drop_empty_axes(df)
    assert out.columns == ["a", "b"] and out.count() == 3


def test_samples(spark):
    clients = spark.createDataFrame([(f"c{i}", 1 if i < 3 else 0) for i in range(50)], "client_id string, target int")
    chosen = reshape.sample_balanced(clients, 20).collect()
    assert len(chosen) == 20 and sum(r.target for r in chosen) == 3  # fewer positives than the quota of seven
    many = spark.createDataFrame([(f"c{i}", 1 if i < 45 else 0) for i in range(50)], "client_id string, target int")
    topped = reshape.sample_balanced(many, 20).collect()
    assert len(topped) == 20 and sum(r.target for r in topped) == 15  # five negatives, filled up with positives
    again = reshape.sample_balanced(many.repartition(3), 20).collect()
    assert {r.client_id for r in again} == {r.client_id for r in topped}
    readings = spark.createDataFrame([(f"c{i % 9}", i) for i in range(90)], "customer_id string, v int")
    assert reshape.sample_customers(readings, "customer_id", 4).count() == 40


def test_invoices_without_electricity_keep_all_rows(spark):
    invoices = spark.createDataFrame([("a", "2020-01-05", "GAZ", None, 0, 10.0), ("a", "2020-02-05", "gaz", 2.0, 2, 10.0)],
                                     "client_id string, invoice_date string, counter_type string, counter_coefficient double, months_number int, consommation_level_1 double")
    clients = spark.createDataFrame([("a", 1, 60, "31/12/2019")], "client_id string, target int, district int, creation_date string")
    got = {r.date: (r.consumption_kwh, r.area_id, r.meter_age) for r in reshape.invoice_to_readings(invoices, clients).collect()}
    assert got == {dt.date(2020, 1, 5): (10.0, "DISTRICT_60", 5 / 365.25), dt.date(2020, 2, 5): (10.0, "DISTRICT_60", 36 / 365.25)}
    electric = reshape.prefer_electricity(invoices.withColumn("counter_type", F.when(F.col("months_number") == 2, "elec").otherwise("GAZ")))
    assert electric.count() == 1


def test_mapping_by_hand(spark):
    with pytest.raises(ValueError):
        reshape.apply_mapping(wide(spark), {"customer_col": "nobody"})
    out = reshape.apply_mapping(wide(spark), {"customer_col": "who", "date_cols": ["1/2/2014", "2014/1/1"], "label_col": "FLAG"}, max_days=1)
    assert {(r.customer_id, r.date, r.consumption_kwh) for r in out.collect()} == {("x1", dt.date(2014, 1, 2), 1.5), ("x2", dt.date(2014, 1, 2), 3.0)}


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "customer_id string, risk_score double")
    assert readers.read_result(spark, str(tmp_path / "none"), df.schema).count() == 0
    sinks.write_table(df, str(tmp_path / "t"))
    assert readers.read_result(spark, str(tmp_path / "t"), df.schema).collect() == df.collect()
    sinks.write_exports({"register": df}, str(tmp_path / "x"))
    assert spark.read.option("header", True).csv(str(tmp_path / "x" / "register")).first().customer_id == "a"


def test_whole_run(spark, tmp_path):
    lines = ["customer_id,date,consumption_kwh,fraud_label,area_id,latitude,longitude"]
    for c in range(25):
        for d in range(70):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
            kwh = 0.0 if c == 3 and d > 40 else 5 + (c * 7 + d * 3) % 11
            lines.append(f"C{c:02d},{day},{kwh},{int(c in (3, 4, 5))},A{c % 4},{41 + c / 100},{20 + c / 100}")
    path = write(tmp_path / "in.csv", "\n".join(lines))
    folder = str(tmp_path / "out")
    out = pipeline.run(spark, path, folder, trees=(5, 10, 10))
    summary = out["summary"].first()
    assert summary.customers_analyzed == 25 and summary.records_analyzed == 25 * 70 and summary.weather_context_enabled
    top = out["priority"].orderBy("priority_rank").first()
    assert top.customer_id == "C03" and top.main_reason
    assert out["customer_forecast"].count() == 25 and out["loss_forecast"].count() == 30
    assert spark.read.parquet(f"{folder}/clean_readings").where("month = '2024-02'").count() == 25 * 29
    assert spark.read.json(f"{folder}/ingestion_report").first().schema.schema_type == "long"
    point = json.loads(spark.read.text(f"{folder}/inspection_route").first().value)
    assert point["geometry"]["type"] == "LineString" and point["properties"]["points"] == 25
    assert {r.customer_id for r in spark.read.parquet(f"{folder}/daily_dashboard").select("customer_id").distinct().collect()} >= {"C03"}
