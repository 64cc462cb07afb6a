"""Times the headline queries and prints one JSON line."""
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def headline(spark) -> dict:
    """Each entry starts from the given tables; nothing is shared between entries."""
    from catalog import queries as Q, tracks as T
    from wattlens.operators import clean, features, forecast, ops, risk, units
    from wattlens.plans.staging import stage

    def scored():
        daily = stage(T.supplier_daily(spark, FOLDER), "daily")
        table = stage(features.customer_features(daily, T.supplier_dimension(spark, FOLDER)), "features")
        return risk.score_all(T.model_inputs(table))

    return {
        "clean_readings": lambda: clean.clean_readings(T.events_raw(spark, FOLDER), "sequence")[0],
        "daily_context": lambda: T.supplier_daily(spark, FOLDER),
        "customer_features": lambda: T.supplier_features(spark, FOLDER),
        "order_features": lambda: T.order_features(spark, FOLDER),
        "inspection_priority": lambda: scored()[3],
        "weekly_forecast": lambda: forecast.weekly_forecast(Q.customer_series(spark, FOLDER)),
        "invoice_to_readings": lambda: Q.QUERIES["invoice_to_readings"](spark, FOLDER),
        "unit_scores": lambda: units.unit_scores(units.unit_features(T.unit_readings(spark, FOLDER)), models_on=False),
        "building_daily": lambda: Q.QUERIES["building_daily"](spark, FOLDER),
        "roc_auc": lambda: Q.QUERIES["roc_auc"](spark, FOLDER),
        "case_events": lambda: ops.latest(T.case_events(spark, FOLDER), "case_id", "event_time"),
    }


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", str(max(8, int(CPUS))))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    entries = headline(spark)
    tracker = spark.sparkContext.statusTracker()
    entries["clean_readings"]().limit(1).collect()  # warm-up: start executors, load and compile the code all entries share
    times, jobs = {}, {}
    for name, build in entries.items():
        spark.sparkContext.setJobGroup(name, name)
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "jobs": jobs, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
