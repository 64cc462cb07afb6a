"""The whole run: ingest, enrich, features, models, scores, forecasts, outputs."""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlens.operators import clean, daily, enrich, features, forecast, models, risk, units
from wattlens.plans.clustered import clustered, dealt
from wattlens.plans.staging import stage
from wattlens.sources import detect, readers, reshape, sinks


def ingest(spark: SparkSession, path: str, folder: str | None = None, max_customers: int | None = None,
           max_days: int | None = None, mapping: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read, detect, reshape and clean one delivered table. Returns readings, customer dimension and report.

    The delivered file is parsed once into a staged table; profile, detection and cleaning read its columns. `mapping`
    names the columns by hand (see `reshape.apply_mapping`) in place of the detection.
    """
    table, counts = readers.read_delivery(spark, path)
    raw, scan = readers.clean_headers(table), counts.select(F.struct("*")).scalar()
    profile = detect.profile_table(raw).select(F.struct("*").alias("raw_profile")).scalar()
    ordered = reshape.in_file_order(raw)
    if mapping:
        rows = reshape.apply_mapping(ordered, mapping, max_customers, max_days)
        kind, id_column, label, confidence, issues = (str(mapping.get("schema_type", "wide")).lower(), mapping["customer_col"],
                                                      mapping.get("label_col"), 1.0, [])
    else:
        layout = detect.detect_layout(raw)
        rows = reshape.to_long(ordered, layout, max_customers, max_days)
        kind, id_column, label, confidence, issues = (layout.kind, layout.id_column, layout.label_column, layout.confidence,
                                                      layout.issues)
    cleaned, customers, report = clean_and_split(rows)
    report = report.withColumns({
        "raw_profile": profile, "scan": scan,
        "schema": F.struct(F.lit(kind).alias("schema_type"), F.lit(id_column).alias("customer_col"),
                           F.lit(label).alias("label_col"), F.lit(confidence).alias("schema_confidence"),
                           F.array(*[F.lit(i) for i in issues]).cast("array<string>").alias("issues"))})
    return store(cleaned, customers, report, folder)


def ingest_invoices(invoices: DataFrame, clients: DataFrame, folder: str | None = None,
                    max_customers: int | None = None, max_days: int | None = None
                    ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for a pair of invoice and client tables."""
    rows = reshape.invoice_rows(invoices, clients, max_customers, max_days)
    return store(*clean_and_split(rows), folder)


def clean_and_split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attributes go to the customer dimension; only measures and labels pass through the cleaning."""
    rows, customers = enrich.split_customers(clean.trim_ids(rows))
    cleaned, report = clean.clean_readings(rows, reshape.SEQUENCE if reshape.SEQUENCE in rows.columns else None)
    return cleaned, stage(customers, "customers"), report.select(F.struct("*").alias("cleaning"))


def store(cleaned: DataFrame, customers: DataFrame, report: DataFrame, folder: str | None
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    cleaned = stage(cleaned, "readings")  # later steps read it several times
    if folder:
        sinks.write_readings(cleaned, folder)
        sinks.write_table(customers, f"{folder}/customers")
        sinks.write_json(report, f"{folder}/ingestion_report")
    return cleaned, customers, report


def analyze(readings: DataFrame, customers: DataFrame | None = None, weather: DataFrame | None = None,
            trees: tuple[int, int, int] = (120, 250, 350), seed: int = 42, models_on: bool = True,
            saved: dict | None = None, keep: dict | None = None) -> dict[str, DataFrame]:
    """All result tables of a run from cleaned readings. `saved` and `keep` are models to use and models that were used
    (see `models.score_models`)."""
    readings, own = enrich.split_customers(readings)
    dimension = stage(enrich.default_metadata(own if customers is None else customers), "dimension")
    located = enrich.attach_metadata(readings, dimension.select("customer_id", "city"))
    covered = stage(enrich.extend_weather(weather, located), "weather")
    weathered = enrich.attach_weather(located, covered)
    context = clustered(daily.daily_context(dealt(weathered, "customer_id")), "customer_id", ["date"], "daily")
    table = stage(features.customer_features(context, dimension), "features")
    if models_on:
        table = stage(models.score_models(table, trees, seed, saved, keep), "scored")
    scores, areas, transformers, priority = risk.score_all(table)
    areas = stage(areas, "areas")
    loss, area_next, customer_next = forecast.generate_forecasts(scores, areas, context)
    loss, area_next = stage(loss, "loss"), stage(area_next, "area_forecast")
    return {"daily": context, "customers": scores, "areas": areas, "transformers": transformers, "priority": priority,
            "daily_subset": risk.daily_subset(scores, context), "loss_forecast": loss, "area_forecast": area_next,
            "customer_forecast": customer_next, "model_table": table,
            "summary": risk.pipeline_summary(scores, areas, context, loss, area_next)}


def run(spark: SparkSession, path: str, folder: str, weather_path: str | None = None, max_customers: int | None = None,
        max_days: int | None = None, trees: tuple[int, int, int] = (120, 250, 350), seed: int = 42,
        mapping: dict | None = None, models_from: str | None = None) -> dict[str, DataFrame]:
    """Ingest one file, analyze it and write every output, the models and their metrics.

    `models_from` is the folder of an earlier run whose models are used again instead of being fitted.
    """
    cleaned, customers, _ = ingest(spark, path, folder, max_customers, max_days, mapping)
    saved = saved_models(models_from) if models_from else None
    used: dict = {}
    out = analyze(cleaned, customers, weather=readers.read_weather(spark, weather_path), trees=trees, seed=seed, saved=saved,
                  keep=used)
    for name, model in used.items():
        models.save_model(model, f"{folder}/models/{name}")
    metrics = models.model_metrics(out["model_table"], trees, seed)
    sinks.write_json(metrics, f"{folder}/model_metrics")
    if "fraud" in used:
        names = models.classifier_features(out["model_table"])
        sinks.write_table(models.feature_importance(used["fraud"], names, spark), f"{folder}/feature_importance")
    sinks.write_scores(out["customers"], out["areas"], out["transformers"], out["priority"], out["daily_subset"], folder)
    sinks.write_maps(out["customers"], out["areas"], out["priority"], folder)
    sinks.write_forecasts(out["loss_forecast"], out["area_forecast"], out["customer_forecast"], folder)
    sinks.write_json(out["summary"], f"{folder}/pipeline_summary")
    return out | {"model_metrics": metrics}


def saved_models(folder: str) -> dict:
    """The models that a run has left in its folder; the classifier is missing where labels were too few."""
    found = {}
    for name in ("expected", "fraud"):
        try:
            found[name] = models.load_model(f"{folder}/models/{name}")
        except (Py4JJavaError, AnalysisException):
            continue
    return found


def run_units(spark: SparkSession, path: str, folder: str, mapping: dict[str, str] | None = None, models_on: bool = True,
              trees: tuple[int, int] = (180, 260), seed: int = 42) -> dict[str, DataFrame]:
    """The unit analysis from a delivered file to a folder of results."""
    raw = readers.clean_headers(readers.read_delivery(spark, path)[0])
    results = units.analyze_units(raw, mapping, models_on, trees, seed)
    units.save_unit_results(results, folder)
    return results
