"""Exact selection equals sorting, for brackets, ties, nulls, small and hot groups, and when a sketch misses."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.operators import models
from wattlens.plans import selection


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 4 else f"g{i % 5}" if i % 8 else None, None if i % 97 == 0 else 5.0 if i % 3 == 0 else round(rng.gauss(0, 50), 2))
            for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double").repartition(7).persist()


def settings(monkeypatch, small, accuracy=10_000, window=1_000_000):
    monkeypatch.setattr(selection, "SMALL_GROUP", small)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "SLACK", 3 / accuracy)
    monkeypatch.setattr(selection, "WINDOW_ROWS", window)


@pytest.mark.parametrize("small,accuracy,window", [(20_000, 10_000, 10 ** 6), (300, 200, 10 ** 6), (300, 200, 10)])
def test_quantiles_equal_the_sort(table, monkeypatch, small, accuracy, window):
    settings(monkeypatch, small, accuracy, window)
    rows, df = table
    for q in (0.0, 0.37, 0.5, 0.995, 1.0):
        got = {r.g: r.x for r in selection.group_quantile(df, ["g"], "v", q, "x").collect()}
        for g in {r[1] for r in rows}:
            assert got[g] == pytest.approx(np.quantile([r[2] for r in rows if r[1] == g and r[2] is not None], q))
        assert df.select(selection.exact_quantile(df, "v", q).alias("x")).first().x == pytest.approx(
            np.quantile([r[2] for r in rows if r[2] is not None], q))


@pytest.mark.parametrize("small", [20_000, 100])
def test_ranks_with_ties_broken_by_id(table, monkeypatch, small):
    settings(monkeypatch, small, 500)
    rows, df = table
    ordered = sorted((r[2], r[0]) for r in rows if r[2] is not None)
    shares = [0.2, 0.5, 0.9]
    found = selection.at_ranks(df, [], "v", shares, [(j, F.floor(F.col("n") * s)) for j, s in enumerate(shares)], "id").collect()
    assert {r.r: (r.v, r.tie) for r in found} == {j: ordered[int(len(ordered) * s) - 1] for j, s in enumerate(shares)}


def test_only_the_bracket_is_kept_and_a_missed_rank_is_found(table, monkeypatch):
    settings(monkeypatch, 100, 1000)
    rows, df = table
    wide = df.filter("v <> 5")
    bounds = selection.brackets(wide, [], "v", [0.5])
    kept = selection.kept_counts(wide, [], "v", bounds, 1, None)
    assert kept.filter("v is not null").count() < 60 and kept.agg(F.sum("rows")).first()[0] < wide.count()
    settings(monkeypatch, 100, 1000)
    monkeypatch.setattr(selection, "SLACK", -0.1)  # brackets that hold nothing
    values = [r[2] for r in rows if r[2] is not None]
    assert df.select(selection.exact_quantile(df, "v", 0.5).alias("x")).first().x == pytest.approx(np.quantile(values, 0.5))


def test_nothing_and_one(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert selection.group_quantile(empty, ["g"], "v", 0.5, "x").count() == 0
    one = spark.createDataFrame([("a", 3.0), ("b", None)], "g string, v double")
    assert [tuple(r) for r in selection.group_quantile(one, ["g"], "v", 0.9, "x").collect()] == [("a", 3.0)]


@pytest.mark.parametrize("small", [20_000, 50])
def test_holdout_is_the_share_with_the_smallest_hashes(spark, monkeypatch, small):
    settings(monkeypatch, small, 400)
    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("customer_id"), F.when(F.col("id") % 10 == 0, 1.0)
                                  .when(F.col("id") == 1, None).otherwise(0.0).alias("fraud_label"))
    drawn = df.withColumn("draw", F.xxhash64("customer_id", F.lit(42))).collect()
    split = models.stratified_split(df, "fraud_label")
    got = {r.customer_id for r in split.filter("is_holdout").collect()}
    expected = set()
    for label in (0.0, 1.0, None):
        own = sorted((r.draw, r.customer_id) for r in drawn if r.fraud_label == label)
        expected |= {i for _, i in own[:round(0.25 * len(own) + 1e-9)]}
    assert got == expected and split.columns == ["customer_id", "fraud_label", "is_holdout"]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Sort " not in plan
