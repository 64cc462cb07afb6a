import pytest
from pyspark.sql import functions as F

from wattlens import constants as K
from wattlens.functions import columns as C
from wattlens.operators import explain, geo, risk


def one(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")


def test_levels_and_colors(spark):
    df = numbers(spark, [0.0, 30.0, 30.01, 60.0, 60.5, 80.0, 81.0, 100.0])
    assert one(df, C.risk_level(F.col("x"))) == ["Low", "Low", "Medium", "Medium", "High", "High", "Critical", "Critical"]
    assert one(df, C.risk_color(F.col("x"))) == ["green", "green", "green", "yellow", "yellow", "orange", "red", "red"]
    df = numbers(spark, [37.9, 38.0, 63.9, 64.0, 81.9, 82.0])
    assert one(df, C.unit_level(F.col("x"))) == ["Low", "Medium", "Medium", "High", "High", "Critical"]


def test_nulls_infinities_and_zero_division(spark):
    df = numbers(spark, [None, float("inf"), float("nan"), 150.0, -3.0])
    assert one(df, C.clip100(C.num(F.col("x")))) == [None, None, None, 100.0, 0.0]
    assert one(df, C.ratio(F.lit(1.0), F.lit(0.0))) == [None] * 5


def test_tariff(spark):
    df = spark.createDataFrame([(0, 10.0, "Residential"), (1, 24.0, "residential"), (2, 10.0, "shop"), (3, None, None)], "i int, x double, t string")
    assert one(df, C.tariff(F.col("x"), F.col("t"))) == [8.5, 9.5, 9.5, 9.5]


def scored_input(spark):
    rows = [(f"c{i}", f"A{i % 3}" if i else None, f"T{i % 2}", float(i), i / 20, i / 10, i % 4 / 10, 8.0 + i, 9.0, float(i * 9) if i % 2 else None,
             41.0, 20.0) for i in range(12)]
    return spark.createDataFrame(rows, "customer_id string, area_id string, transformer_id string, sudden_behavior_score double, recent_drop_pct double, "
                                       "peer_deviation_pct double, zero_day_ratio double, previous_90_mean double, last_30_mean double, fraud_probability double, "
                                       "latitude double, longitude double")


def test_scores_stay_in_range_and_unknown_areas_are_left_out(spark):
    customers, areas, transformers, queue = risk.score_all(scored_input(spark))
    got = customers.collect()
    assert len(got) == 12 and all(0 <= r.risk_score <= 100 for r in got)
    assert {r.area_id for r in areas.collect()} == {"A0", "A1", "A2"}
    lost = next(r for r in got if r.customer_id == "c0")
    assert lost.area_risk_score == 0 and lost.estimated_loss_all_30d == 0
    order = ["Low", "Medium", "High", "Critical"]
    ranked = sorted(got, key=lambda r: r.risk_score)
    assert [order.index(r.risk_level) for r in ranked] == sorted(order.index(r.risk_level) for r in ranked)
    ranks = queue.orderBy("priority_rank").collect()
    assert [r.priority_rank for r in ranks] == list(range(1, 13))
    assert sorted((r.inspection_priority_score for r in ranks), reverse=True) == [r.inspection_priority_score for r in ranks]
    assert queue.columns == [c for c in K.PRIORITY_COLUMNS if c in queue.columns]


def test_probability_only_raises_the_score(spark):
    df = scored_input(spark)
    with_p = {r.customer_id: r.ai_combined_score for r in risk.prelim_risk(df.withColumn("ai_anomaly_score", F.lit(50.0))).collect()}
    assert with_p["c0"] == 50.0 and with_p["c1"] == 50.0 and with_p["c11"] == 99.0


def test_constant_column_stretches_to_zero(spark):
    assert {r.s for r in risk.minmax_100(numbers(spark, [4.0, 4.0]), "x", "s").collect()} == {0.0}


def test_reasons(spark):
    df = spark.createDataFrame([("quiet",)], "customer_id string")
    row = explain.add_explanations(df).first()
    assert row.main_reason == K.NO_REASON and row.recommended_action == K.ACTIONS["monitor"]
    df = df.withColumns({"recent_drop_pct": F.lit(0.505), "payment_risk_score": F.lit(71.0), "unpaid_bills": F.lit(3),
                         "payment_late_count_12m": F.lit(7), "arrears_amount_lek": F.lit(12500.5), "zero_days": F.lit(9),
                         "longest_zero_streak": F.lit(5), "zero_day_ratio": F.lit(0.01)})
    row = explain.add_explanations(df).first()
    assert row.main_reason == ("Irregular billing/payment behavior: 7 late payments and 3 unpaid bills in 12 months, "
                               "arrears 12,500 Lek.")
    assert row.alert_explanation.split(" | ")[1:] == [
        "Recent consumption dropped 50% compared with the customer's previous baseline.",
        "Detected 9 zero/near-zero consumption days, longest streak 5 days."]
    assert row.recommended_action == K.ACTIONS["zero"]
    late = explain.add_explanations(df.withColumn("payment_risk_score", F.lit(60.0))).first()
    assert late.main_reason.startswith("Recent consumption dropped") and late.alert_explanation.endswith("12,500 Lek.")


def test_map_filter_and_route(spark):
    rows = [(1, "a", 41.0, 20.0), (2, "sea", 41.0, 19.0), (3, "b", 40.0, 20.5), (4, "none", None, 20.0)]
    df = spark.createDataFrame(rows, "priority_rank int, customer_id string, latitude double, longitude double")
    assert [r.customer_id for r in geo.valid_geo(df).orderBy("priority_rank").collect()] == ["a", "b"]
    assert '"coordinates":[[20.0,41.0],[20.5,40.0]]' in geo.inspection_route(df).first().feature
    assert geo.inspection_route(df.limit(2)).count() == 0
    assert geo.off_map_count(df).first().off_map == 2


@pytest.mark.parametrize("high,expected", [(0, 2), (40, 40)])
def test_daily_subset_tops_up(spark, high, expected):
    scores = [(f"c{i:03d}", 70.0 if i < high else 1.0) for i in range(max(high, 2))]
    customers = spark.createDataFrame(scores, "customer_id string, risk_score double")
    assert risk.daily_subset(customers, customers.select("customer_id")).count() == expected
