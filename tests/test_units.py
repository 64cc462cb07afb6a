import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.operators import units
from wattlens.plans import clustered
from wattlens.plans.joins import stored_bytes
from wattlens.sources.detect import find_unit_header


@pytest.fixture(scope="module")
def delivered(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), f"B{u % 3}", f"U{u:02d}", float(0 if u == 4 else rng.uniform(3, 12)), float(u % 4),
             "Shop" if u % 5 == 0 else "Apartment", "TX-1", 1 if u == 4 else 0) for u in range(15) for d in range(30)]
    rows += rows[:40]  # the same readings delivered twice
    return spark.createDataFrame(rows, "reading_date date, block string, flat_id string, kwh double, level double, unit_type string, "
                                       "transformer_id string, is_fraud int")


@pytest.fixture(scope="module")
def results(delivered):
    return {k: v.toPandas() for k, v in units.analyze_units(delivered, models_on=False).items()}


def test_headers_match_whole_words():
    columns = ["flat_id", "area_sqm", "unit_area", "reading_date"]
    assert find_unit_header(columns, ["latitude", "lat"]) is None
    assert find_unit_header(["flat_id", "unit lat"], ["latitude", "lat"]) == "unit lat"
    assert find_unit_header(columns, ["area_sqm", "sqm"]) == "area_sqm"


def test_columns_are_carried_and_copies_merged(delivered):
    out = units.building_standardize(delivered)
    assert out.count() == 15 * 30
    assert {r.transformer_id for r in out.select("transformer_id").distinct().collect()} == {"TX-1"}
    assert {r.unit_type for r in out.select("unit_type").distinct().collect()} == {"Shop", "Apartment"}
    row = out.filter("unit_id = 'U07'").orderBy("date").first()
    expected = 1.45 + 2.5 * 1.05 + 75 * 0.037 + 3 * 0.12 + row.heating_degree_days * 0.24 + row.cooling_degree_days * 0.38
    assert row.expected_kwh == pytest.approx(expected) and row.floors == 3


def test_missing_columns_are_reported(spark):
    with pytest.raises(ValueError, match="building_id"):
        units.building_standardize(spark.createDataFrame([(1,)], "unit_id int"))


def test_totals_agree_over_units_floors_and_buildings(results):
    u, b, f, m = (results[k] for k in ("unit_scores", "building_scores", "floor_scores", "metrics"))
    assert len(u) == b["units"].sum() == f["units"].sum() == m["units"][0] == 15
    assert u["estimated_loss_lek_30d"].sum() == pytest.approx(b["estimated_loss_lek_30d"].sum()) == pytest.approx(f["estimated_loss_lek_30d"].sum())
    assert b["high_risk_units"].sum() == f["high_risk_units"].sum() == m["high_risk_units"][0]
    assert m["records"][0] == 450


def test_building_score_follows_from_its_units(results):
    for _, b in results["building_scores"].iterrows():
        mine = results["unit_scores"].query("building_id == @b.building_id")
        high = mine["risk_level"].isin(["High", "Critical"]).sum()
        expected = 0.55 * np.percentile(mine["risk_score"], 90) + 0.30 * mine["risk_score"].mean() + 0.15 * min(100 * high / len(mine), 100)
        assert b["risk_score"] == pytest.approx(expected, abs=0.0051)


def test_daily_missing_energy(results):
    d = results["daily_summary"]
    assert len(d) == 30
    gap = (d["expected_consumption_kwh"] - d["total_consumption_kwh"]).clip(lower=0)
    assert list(d["estimated_missing_kwh"]) == pytest.approx(list(gap))


def test_dead_meter_leads_and_ranks_follow_the_score(results):
    u = results["unit_scores"].sort_values("priority_rank")
    assert u["unit_id"].iloc[0] == "U04" and u["main_reason"].iloc[0] == "below similar units"
    assert u["risk_score"].is_monotonic_decreasing
    assert u["fraud_probability"].iloc[0] == pytest.approx(1 / (1 + np.exp(-(u["risk_score"].iloc[0] - 55) / 12)), abs=1e-4)


def test_mode_and_driver_ties(spark):
    df = spark.createDataFrame([("x",), ("b",), ("a",), ("b",), ("a",)], "k string").select(F.mode("k", True).alias("m"))
    assert df.first().m == "a"
    tie = {c: F.lit(7.0) for c in units.DRIVER_COLUMNS}
    row = units.top_driver(spark.createDataFrame([("u", "b", "Low", None, 0.1, 0.2)], "unit_id string, building_id string, risk_level string, "
                           "expected_gap_pct double, peer_low_gap_pct double, weather_mismatch_ratio double").withColumns(tie)).first()
    assert row.main_reason == "below expected consumption"
    assert row.alert_explanation.endswith("Expected gap: nan%, peer low gap: 10%, weather mismatch: 20%.")


def test_peers_fall_back_without_a_city(spark):
    rows = [("u1", "X", "City", "A", 1.0), ("u2", "X", "City", "A", 3.0), ("u3", None, "City", "A", 8.0), ("u4", None, None, "A", 9.0)]
    df = spark.createDataFrame(rows, "unit_id string, city string, location_type string, unit_type string, avg_consumption double")
    got = {r.unit_id: r.peer_avg_consumption for r in units.unit_peer(df).collect()}
    assert got == {"u1": 2.0, "u2": 2.0, "u3": 3.0, "u4": 5.5}


def test_steps_by_unit_keep_their_partitions(spark, delivered):
    """As many as the session's shuffle partitions, so that memory of a task doesn't follow the shuffled bytes."""
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    standard = units.building_standardize(delivered)
    assert len(standard.inputFiles()) > 1
    assert units.unit_lag_flags(units.unit_daily_flags(standard)).rdd.getNumPartitions() == count


def test_partitions_follow_the_files(spark, delivered, tmp_path, monkeypatch):
    """A session's number of partitions alone would let a task's memory grow with the table."""
    delivered.write.parquet(f"{tmp_path}/files")
    read = spark.read.parquet(f"{tmp_path}/files")
    count, size = int(spark.conf.get("spark.sql.shuffle.partitions")), stored_bytes(read)
    assert clustered.enough_partitions(read) == clustered.enough_partitions(delivered) == count
    monkeypatch.setattr(clustered, "PARTITION_BYTES", -(-size // (4 * count)))
    assert clustered.enough_partitions(read) == 4 * count
    standard = units.building_standardize(read)
    assert units.unit_lag_flags(units.unit_daily_flags(standard)).rdd.getNumPartitions() > count
