"""Writing results."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_scores(customers: DataFrame, areas: DataFrame, transformers: DataFrame, priority: DataFrame,
                 daily: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The four score tables, each sorted by its score, and the daily rows of the high-risk customers."""
    write_table(customers.orderBy(F.desc("risk_score"), "customer_id"), f"{folder}/customer_risk_scores", fmt)
    write_table(areas.orderBy(F.desc("area_risk_score"), "area_id"), f"{folder}/area_risk_scores", fmt)
    write_table(transformers.orderBy(F.desc("transformer_risk_score"), "transformer_id"),
                f"{folder}/transformer_risk_scores", fmt)
    write_table(priority.orderBy("priority_rank"), f"{folder}/inspection_priority", fmt)
    write_table(daily, f"{folder}/daily_dashboard", fmt)


def write_forecasts(loss: DataFrame, areas: DataFrame, customers: DataFrame, folder: str,
                    fmt: str = "parquet") -> None:
    write_table(loss.orderBy("date"), f"{folder}/loss_forecast", fmt)
    write_table(areas.orderBy("forecast_priority"), f"{folder}/area_forecast", fmt)
    write_table(customers.orderBy("forecast_priority"), f"{folder}/customer_forecast", fmt)


def write_readings(clean: DataFrame, folder: str) -> None:
    """Cleaned readings in (customer, date) order, one directory per month for partition pruning.

    The range partitioning uses both keys, so a customer with a long history is split as well.
    """
    by_month = clean.withColumn("month", F.date_format("date", "yyyy-MM"))
    (by_month.repartitionByRange("month", "customer_id", "date")
     .sortWithinPartitions("month", "customer_id", "date")
     .write.mode("overwrite").partitionBy("month").parquet(f"{folder}/clean_readings"))


def write_json(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Newline-delimited text, one JSON document per line (GeoJSON features)."""
    lines.select("feature").write.mode("overwrite").text(path)


def write_maps(customers: DataFrame, areas: DataFrame, priority: DataFrame, folder: str) -> None:
    from wattlens.operators import geo
    write_lines(geo.customer_geojson(customers, min_risk=30), f"{folder}/customer_risk_points")
    write_lines(geo.area_geojson(areas), f"{folder}/area_risk_points")
    write_lines(geo.inspection_route(priority), f"{folder}/inspection_route")


def write_exports(tables: dict[str, DataFrame], folder: str) -> None:
    """CSV downloads: register, queue, cases, forecasts, audit."""
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}", "csv")
