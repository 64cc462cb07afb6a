"""Column decisions from sketches equal those from exact counts, with one small shuffle."""
import random

from pyspark.sql import functions as F

from wattlens.sources import detect


def tables(spark):
    rng = random.Random(4)
    yield spark.createDataFrame([(f"x{i}", f"y{i // 2}", str(i), "1,5", " same ") for i in range(400)], "b string, a string, n string, v string, c string")
    yield spark.createDataFrame([(f"k{i}", f"k{i % 399}", f"k{i}") for i in range(400)], "p string, q string, r string")  # one copy; ties
    yield spark.range(30_000).select(F.concat(F.lit("m"), "id").alias("unique"), F.concat(F.lit("m"), F.col("id") % 29_990).alias("almost"),
                                     (F.col("id") % 2).alias("flag"), (F.col("id") / 7).alias("kwh"),
                                     F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("day"))
    yield spark.createDataFrame([(None, "a", rng.choice(["0", "1"])) for _ in range(30)], "empty string, one string, mark string")
    yield spark.createDataFrame([], "x string, `a.b` string")
    yield spark.createDataFrame([("0", "0.0", "1/2/2024", "-3"), ("1", "1", "2/2/2024", "x"), ("1", "0", None, "")], "`a.b` string, b string, c string, d string")


def test_sketches_choose_what_exact_counts_choose(spark):
    for df in tables(spark):
        best = detect.infer_id_column(df, df.columns).first()
        assert detect.choose_id_column(df, df.columns) == (best["column"] if best else None)
        assert detect.choose_roles(df) == {r["column"]: r["role"] for r in detect.infer_roles(df).collect()}


def test_only_close_candidates_are_counted(spark, monkeypatch):
    counted = []
    real = detect.distinct_counts
    monkeypatch.setattr(detect, "distinct_counts", lambda df, columns, trim=False: counted.append(sorted(columns)) or real(df, columns, trim))
    df = spark.range(20_000).select(F.concat(F.lit("id-"), "id").alias("key"), F.concat(F.lit("id-"), F.col("id") % 19_999).alias("near"),
                                    F.concat(F.lit("t"), F.col("id") % 5).alias("kind"), (F.col("id") * 0.5).alias("v"))
    assert detect.choose_id_column(df, df.columns) == "key" and counted == [["key", "near"]]
    assert detect.choose_id_column(df, ["key", "kind", "v"]) == "key" and len(counted) == 1
    detect.choose_roles(df)
    assert counted[1:] == [["key", "near"]]


def test_sketches_shuffle_one_row_per_column_and_task(spark):
    df = spark.range(1000).selectExpr("cast(id as string) as a", "id % 7 as b")
    plan = detect.column_sketches(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(column") == 1 and plan.count("Exchange ") == 1
