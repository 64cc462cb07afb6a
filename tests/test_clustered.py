"""The daily table clustered by customer: no second shuffle, one bucket for one customer."""
import datetime as dt

from wattlens.operators import daily, features, ops
from wattlens.plans.clustered import clustered, dealt, stored_clustered


def readings_of(spark):
    return spark.createDataFrame([(f"c{i % 23}", dt.date(2024, 1, 1) + dt.timedelta(days=i // 23), float(i % 7)) for i in range(23 * 60)],
                                 "customer_id string, date date, consumption_kwh double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_shuffle_into_the_table_and_none_behind_it(spark):
    rows = readings_of(spark)
    context = daily.daily_context(dealt(rows, "customer_id", 5))
    assert plan_of(context).count("Exchange ") == 1
    table = clustered(context, "customer_id", ["date"], "daily", 5)
    plan = plan_of(features.aggregate_customers(table))
    assert "Exchange" not in plan and "Bucketed: true" in plan
    plain = {tuple(r) for r in features.aggregate_customers(daily.daily_context(rows)).collect()}
    assert {tuple(r) for r in features.aggregate_customers(table).collect()} == plain


def test_one_customer_reads_one_bucket(spark):
    table = clustered(daily.daily_context(dealt(readings_of(spark), "customer_id", 5)), "customer_id", ["date"], "daily", 5)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)  # else the plan doesn't print the buckets
    try:
        plan = plan_of(ops.customer_timeline(table, "c7"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 5" in plan and "PushedFilters: [IsNotNull(customer_id), EqualTo(customer_id,c7)]" in plan
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 40)  # a partition for every file that is read
    try:
        timeline = ops.customer_timeline(table, "c7")
        assert timeline.rdd.getNumPartitions() == 1 and table.rdd.getNumPartitions() == 5 and timeline.count() == 60
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stored_tables_are_built_once_and_empty_ones_stay_empty(spark):
    built = []

    def build():
        built.append(1)
        return dealt(readings_of(spark), "customer_id")

    for _ in range(2):
        assert stored_clustered(spark, "twice", build, "customer_id", ["date"]).count() == 23 * 60
    assert len(built) == 1
    assert clustered(dealt(readings_of(spark).limit(0), "customer_id"), "customer_id", ["date"]).count() == 0
