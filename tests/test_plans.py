import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlens.plans.joins import lookup_join
from wattlens.plans.ordering import global_rank, group_rank, running_totals
from wattlens.plans.selection import exact_quantile, group_quantile
from wattlens.plans.staging import stage, staging_root, stored


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' holds most rows, and the value 5.0 a third of them."""
    rng = random.Random(1)
    rows = [(i, "hot" if i % 4 else f"g{i % 5}", 5.0 if i % 3 == 0 else round(rng.uniform(0, 100), 1)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double").repartition(7).persist()


def test_global_rank(skewed):
    rows, df = skewed
    expected = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    for n in (2, 7):
        got = {r.id: r["rank"] for r in global_rank(df.repartition(n), ["v", "id"]).collect()}
        assert got == expected


def test_group_rank(skewed):
    rows, df = skewed
    expected = {}
    for g in {r[1] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))):
            expected[r[0]] = i + 1
    got = {r.id: r["rank"] for r in group_rank(df, ["g"], [F.desc("v"), "id"]).collect()}
    assert got == expected


def test_running_totals(skewed):
    rows, df = skewed
    out = running_totals(df, ["v", "id"], {"total": "v"}).orderBy("v", "id").collect()
    assert [r.total for r in out] == pytest.approx(list(np.cumsum([r[2] for r in sorted(rows, key=lambda r: (r[2], r[0]))])))


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.995, 1.0])
def test_quantiles(skewed, q):
    rows, df = skewed
    by_group = {r.g: r.x for r in group_quantile(df, ["g"], "v", q, "x").collect()}
    for g in {r[1] for r in rows}:
        assert by_group[g] == pytest.approx(np.quantile([r[2] for r in rows if r[1] == g], q))
    assert df.select(exact_quantile(df, "v", q).alias("x")).first().x == pytest.approx(np.quantile([r[2] for r in rows], q))


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(exact_quantile(df, "v", 0.5).alias("x")).first().x is None


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_join_gives_the_same_rows_beyond_the_broadcast_limit(spark, skewed, limit):
    rows, df = skewed
    table = spark.createDataFrame([("hot", 1), ("g0", 2), (None, 3)], "g string, x int")
    got = {r.id: r.x for r in lookup_join(df, table, ["g"], ["id"], broadcast_bytes=limit).collect()}
    assert got == {r[0]: {"hot": 1, "g0": 2}.get(r[1]) for r in rows}
    kept = lookup_join(df, table.select("g"), ["g"], ["id"], how="left_semi", broadcast_bytes=limit)
    assert kept.columns == df.columns
    assert kept.count() == sum(r[1] in ("hot", "g0") for r in rows)


def test_staging(spark):
    assert staging_root(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert stage(spark.range(5)).count() == 5
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert stored(spark, "k", build).count() == stored(spark, "k", build).count() == 3
    assert len(calls) == 1
