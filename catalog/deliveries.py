"""Queries that deliver the given tables as files, read them again, and write results that are read back."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalog import tracks as T
from catalog.queries import query, scored_forecast
from wattlens import pipeline
from wattlens.operators import forecast
from wattlens.plans.staging import staging_root
from wattlens.sources import readers, sinks


def folder_of(s, name: str) -> str:
    return f"{staging_root(s)}/{name}-{uuid.uuid4().hex}"


def deliver(rows: DataFrame, header: str, path: str) -> str:
    """Write the column `lines` (physical lines of one row each, none of them empty) as text files with a header each."""
    lines = rows.select(F.explode("lines").alias(header))
    (lines.write.option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").option("escapeQuotes", False)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query
def src_1(s, d):
    """Events as a messy file: line breaks and doubled quotes in values, stray quotes, rows with a field too many."""
    e = T.table(s, d, "events")
    key, kind, user = F.col("event_id"), F.col("event_type"), T.text("user_id")
    eid = T.text("event_id")
    lines = (F.when(key % 17 == 0, F.array(F.concat_ws(",", eid, kind, user, F.lit("one too many"))))
             .when(key % 13 == 0, F.array(F.concat(F.lit('"'), F.concat_ws(",", eid, kind, user))))
             .when(key % 11 == 0, F.array(F.concat(eid, F.lit(',"'), kind), F.concat(F.lit('line two",'), user)))
             .when(key % 7 == 0, F.array(F.concat(eid, F.lit(',"say ""'), kind, F.lit('"", twice",'), user)))
             .otherwise(F.array(F.concat_ws(",", eid, kind, user))))
    path = deliver(e.select(lines.alias("lines")), "event_id,event_type,user_id", folder_of(s, "delivery"))
    rows, _ = readers.scan_rows(s, path)
    return rows.select("fate", F.col("cells.c0").alias("event_id"), F.col("cells.c1").alias("event_type"),
                       F.col("cells.c2").alias("user_id"))


def delivered_events(s, d) -> str:
    """The E track as a semicolon file; decimal commas stand as they are, copies of a day in the order of the events."""
    fields = ["customer_id", "date", "consumption_kwh", "fraud_label"]
    raw = T.events_raw(s, d).repartitionByRange("sequence").sortWithinPartitions("sequence")
    line = F.concat_ws(";", *[F.coalesce(T.text(c), F.lit("")) for c in fields])
    return deliver(raw.select(F.array(line).alias("lines")), ";".join(fields), folder_of(s, "delivery") + ".csv")


@query
def cln_18(s, d):
    """A whole ingest: the file is read, detected, cleaned, stored; the stored readings are read back."""
    folder = folder_of(s, "ingest")
    pipeline.ingest(s, delivered_events(s, d), folder)
    stored = s.read.parquet(f"{folder}/clean_readings")
    return stored.select("customer_id", "date", "consumption_kwh")


@query
def src_6(s, d):
    """Weather delivered as a file and read as a dimension."""
    weather = T.nation_weather(s, d).select("date", "city", "temp_mean")
    path = folder_of(s, "weather") + ".csv"
    weather.write.option("header", True).csv(path)
    return readers.read_weather(s, path).select("date", "city", "temp_mean")


@query
def snk_1(s, d):
    """Score tables written and read back: the queue."""
    customers, areas, transformers, queue, daily_rows = scored_forecast(s, d)
    folder = folder_of(s, "scores")
    sinks.write_scores(customers, areas, transformers, queue, daily_rows.select("customer_id", "date"), folder)
    return readers.read_result(s, f"{folder}/inspection_priority", queue.schema)


@query
def src_8(s, d):
    """A stored result, and one that was never written, which is empty."""
    customers, areas, _, queue, _ = scored_forecast(s, d)
    folder = folder_of(s, "results")
    sinks.write_table(areas, f"{folder}/area_risk_scores")
    missing = readers.read_result(s, f"{folder}/never_written", areas.schema)
    return readers.read_result(s, f"{folder}/area_risk_scores", areas.schema).unionByName(missing)


@query
def snk_2(s, d):
    """Forecasts written and read back: the areas."""
    customers, areas, _, _, context = scored_forecast(s, d)
    loss = forecast.loss_forecast(forecast.daily_events(context), forecast.total_loss(customers))
    folder, areas_next = folder_of(s, "forecasts"), forecast.area_forecast(areas)
    sinks.write_forecasts(loss, areas_next, forecast.customer_forecast(customers), folder)
    back = readers.read_result(s, f"{folder}/area_forecast", areas_next.schema)
    return back.select("forecast_priority", "area_id", "forecasted_area_risk_next_30d")


@query
def snk_3(s, d):
    """The ingestion report as JSON: what became of the delivered records."""
    folder = folder_of(s, "ingest")
    pipeline.ingest(s, delivered_events(s, d), folder)
    return s.read.json(f"{folder}/ingestion_report").select("scan.records", "scan.repaired_records", "scan.skipped_records",
                                                           "schema.schema_type", "schema.customer_col")


@query
def ops_29(s, d):
    """Exports as CSV, read back by the tolerant scan."""
    _, _, _, queue, _ = scored_forecast(s, d)
    folder = folder_of(s, "exports")
    sinks.write_exports({"queue": queue.select("priority_rank", "customer_id", "risk_level", "main_reason")}, folder)
    return readers.scan_csv(s, f"{folder}/queue")
