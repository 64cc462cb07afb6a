"""Whole runs and awkward deliveries: quoted line breaks, repeated headers, first labels, weather copies, saved models."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattlens import pipeline
from wattlens.operators import enrich, models, units
from wattlens.plans import staging
from wattlens.plans.joins import lookup_join
from wattlens.sources import readers, reshape


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_quoted_line_breaks_stay_in_their_value(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,date,kwh\n"x\ny",2024-01-03,5\nb,2024-01-04\nc,2024-01-05,1,2\nd,2024-01-06,7\n')
    rows = {tuple(r) for r in readers.scan_csv(spark, path).collect()}
    assert rows == {("x\ny", "2024-01-03", "5"), ("b", "2024-01-04", None), ("d", "2024-01-06", "7")}


def test_only_the_first_line_of_a_file_is_its_header(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder / "1.csv", "id;kwh\na;1\nid;kwh\nb;2\n")
    write(folder / "2.csv", "id;kwh\nc;3\n")
    rows = sorted(tuple(r) for r in readers.scan_csv(spark, str(folder)).collect())
    assert rows == [("a", "1"), ("b", "2"), ("c", "3"), ("id", "kwh")]


def test_encodings_and_empty_files(spark, tmp_path):
    assert readers.scan_csv(spark, write(tmp_path / "l.csv", "id,city\n1,Tiranë\n", "latin-1")).first().city == "Tiranë"
    assert readers.scan_csv(spark, write(tmp_path / "e.csv", "\n\n")).columns == []


def test_weather_copies_do_not_multiply_readings(spark):
    readings = spark.createDataFrame([("a", dt.date(2024, 1, 1), "Here"), ("b", dt.date(2024, 1, 1), "Far")],
                                     "customer_id string, date date, city string")
    weather = spark.createDataFrame([(dt.date(2024, 1, 1), "Here", 9.0, 1), (dt.date(2024, 1, 1), "Here", 5.0, 2)],
                                    "date date, city string, temp_mean double, _order int")
    covered = enrich.extend_weather(weather, readings)
    out = {r.customer_id: r.temp_mean for r in enrich.attach_weather(readings, covered, "Here").collect()}
    assert out["a"] == 9.0 and len(out) == 2
    direct = {r.customer_id: r.temp_mean for r in enrich.attach_weather(readings, weather, "Here").collect()}
    assert direct == {"a": 9.0, "b": 9.0}  # the default city's day stands in


def test_weather_of_many_days_is_broadcast(spark):
    days = spark.range(200_000).select(F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 20_000).cast("int")).alias("date"),
                                       F.concat(F.lit("C"), F.floor(F.col("id") / 20_000).cast("string")).alias("city"),
                                       F.round(F.rand(1) * 40, 2).alias("temp_mean"))
    readings = spark.range(1000).select(F.col("id").cast("string").alias("customer_id"), F.lit("C1").alias("city"),
                                        F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    plan = enrich.attach_weather(readings, days, "C0")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lookup_join_multiplies_rows_of_keys_that_repeat(spark):
    left = spark.createDataFrame([("a", 1)], "g string, id int")
    table = spark.createDataFrame([("a", 1), ("a", 2)], "g string, x int")
    assert lookup_join(left, table, ["g"], ["id"]).count() == 2  # hence the condition in its description


def test_first_label_of_copies_by_the_files_order(spark, tmp_path):
    path = write(tmp_path / "r.csv", "customer_id,date,consumption_kwh,fraud_label\n"
                 "a,2024-01-01,5,1\na,2024-01-01,7,0\nb,2024-01-01,1,\nb,2024-01-01,1,0\nb,bad,1,1\n")
    cleaned, _, report = pipeline.ingest(spark, path)
    assert {r.customer_id: r.fraud_label for r in cleaned.collect()} == {"a": 1.0, "b": 0.0}
    row = report.first().cleaning
    assert row.initial_rows == 5 and row.invalid_dates_removed == 1 and row.duplicate_customer_date_readings_merged == 2


def test_mapping_by_hand_with_free_day_headers(spark, tmp_path):
    path = write(tmp_path / "w.csv", "who,3 Jan 2024,2024-01-04 00:00:00,note\nx,1,2,n\n")
    cleaned, _, report = pipeline.ingest(spark, path, mapping={
        "schema_type": "wide", "customer_col": "who", "date_cols": ["3 Jan 2024", "2024-01-04 00:00:00"]})
    assert {r.date.day: round(r.consumption_kwh) for r in cleaned.collect()} == {3: 1, 4: 2}  # the cap takes a little of the 2
    assert report.first().schema.customer_col == "who"
    with pytest.raises(ValueError):
        pipeline.ingest(spark, path, mapping={"customer_col": "who", "date_cols": ["note"]})


def test_meter_age_is_that_of_the_first_reading(spark):
    rows = spark.createDataFrame([("a", "2020-01-05", 1.0), ("a", "2020-02-05", 1.0)], "client_id string, invoice_date string, consommation_level_1 double")
    clients = spark.createDataFrame([("a", 1, "31/12/2019")], "client_id string, target int, creation_date string")
    cleaned, customers, _ = pipeline.ingest_invoices(rows, clients)
    assert customers.first().meter_age == pytest.approx(5 / 365.25) and cleaned.count() == 2


def test_varying_kind_of_anomaly(spark):
    rows = [("u", "B", f"2024-01-0{i}", 5.0, "normal" if i == 1 else "theft", "Flat") for i in range(1, 8)]
    rows += [("v", "B", "2024-01-01", 1.0, None, "Flat"), ("w", "B", "2024-01-01", 1.0, "b", "Flat"), ("w", "B", "2024-01-02", 1.0, "a", "Flat")]
    df = spark.createDataFrame(rows, "unit_id string, building_id string, date string, kwh double, anomaly_type string, unit_type string")
    readings = units.building_standardize(df)
    assert {r.date.day: r.anomaly_type for r in readings.filter("unit_id = 'u'").collect()}[1] == "normal"
    agg = units.unit_agg(units.unit_lag_flags(units.unit_daily_flags(readings)))
    assert {r.unit_id: r.anomaly_type for r in agg.collect()} == {"u": "theft", "v": "unknown", "w": "a"}


def test_unit_run_from_file_to_folder(spark, tmp_path):
    lines = ["unit_id,building_id,date,kwh,fraud_label"]
    for u in range(60):
        for day in range(1, 7):
            lines.append(f"u{u},B{u % 5},2024-01-0{day},{0.0 if u % 6 == 0 else 4 + (u * day) % 9},{int(u % 6 == 0)}")
    path, folder = write(tmp_path / "u.csv", "\n".join(lines) + "\n"), str(tmp_path / "out")
    results = pipeline.run_units(spark, path, folder, trees=(10, 10))
    row = spark.read.json(f"{folder}/metrics").first()
    assert row.units == 60 and row.positive_units == 10 and row.fraud_classifier_roc_auc == 1.0
    assert spark.read.parquet(f"{folder}/feature_importance").count() == len(units.K.UNIT_FEATURES)
    assert spark.read.parquet(f"{folder}/raw").count() == 360 and results["building_scores"].count() == 5


def test_run_writes_models_and_metrics_and_uses_them_again(spark, tmp_path):
    lines = ["customer_id,date,consumption_kwh,fraud_label"]
    for c in range(60):
        for day in range(40):
            date = dt.date(2024, 1, 1) + dt.timedelta(days=day)
            lines.append(f"c{c},{date},{0.1 if c % 5 == 0 and day > 20 else 5 + (c * day) % 7},{int(c % 5 == 0)}")
    path, folder = write(tmp_path / "r.csv", "\n".join(lines) + "\n"), str(tmp_path / "run")
    first = pipeline.run(spark, path, folder, trees=(5, 5, 5))
    metrics = spark.read.json(f"{folder}/model_metrics").first()
    assert metrics.expected_consumption_mae >= 0 and 0 <= metrics.fraud_classifier_roc_auc <= 1
    assert set(pipeline.saved_models(folder)) == {"expected", "fraud"} and spark.read.parquet(f"{folder}/feature_importance").count() > 20
    table = first["model_table"].drop("expected_last_30_consumption", "expected_deviation_pct", "ai_anomaly_score",
                                      "isolation_forest_flag", "fraud_probability")
    again = models.score_models(table, (5, 5, 5), saved=pipeline.saved_models(folder))
    probability = lambda out: {r.customer_id: round(r.fraud_probability, 9) for r in out.collect()}
    assert probability(again) == probability(first["model_table"])


def test_exact_medians_fill_gaps(spark):
    frame = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None), (None, None), (float("nan"), 4.0)], "f_a double, f_b double")
    assert models.medians(frame, ["a", "b"]) == {"a": 2.0, "b": 4.0}


def test_stored_tables_survive_an_interrupted_write_and_follow_their_inputs(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)

    def broken():
        return spark.range(5).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))

    with pytest.raises(Exception, match="lost"):
        staging.stored(spark, "t", broken)
    assert staging.stored(spark, "t", lambda: spark.range(4)).count() == 4
    assert staging.stored(spark, "t", broken).count() == 4
    assert staging.stored(spark, "u", lambda: spark.read.parquet(folder), folder).count() == 3
    spark.range(2).write.mode("append").parquet(folder)
    assert staging.stored(spark, "u", lambda: spark.read.parquet(folder), folder).count() == 5


def test_samples_follow_an_order_that_other_engines_share(spark):
    import hashlib
    ids = [f"c{i}" for i in range(50)]
    chosen = reshape.sample_ids(spark.createDataFrame([(i,) for i in ids], "id string"), "id", 7).collect()
    assert [r.id for r in chosen] == sorted(ids, key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:7]
