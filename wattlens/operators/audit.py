"""Findings about coverage, labels, capacity, history and data quality of a run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlens.functions.columns import col_or, is_high, num

# fixed values: area, finding, impact, improvement, priority. `{0}` takes the measured figure.
FINDINGS = {
    "coverage": ("Data coverage", "No customer risk output found.", "Analysts cannot prioritize inspections.",
                 "Run Data Intake and NTL Detection first.", "Critical"),
    "gis": ("GIS integration", "Some customer coordinates are missing or synthetic.",
            "Maps and field routing may be inaccurate.",
            "Connect meter registry, address database, transformer GIS and OpenStreetMap geocoding.", "High"),
    "labels": ("Feedback loop", "Confirmed theft / false alarm labels are limited or missing.",
               "The supervised fraud probability model cannot learn from field outcomes.",
               "Save inspection results from Case Management and feed them back into the model every month.", "High"),
    "large": ("Inspection capacity", "High/Critical queue is large ({0}% of customers).",
              "Field teams may not handle all alerts.",
              "Use forecast priority, area clustering, estimated loss and route planning to narrow the daily queue.", "High"),
    "small": ("Model sensitivity", "High/Critical queue is very small ({0}% of customers).",
              "The model may be too strict for exploratory detection.",
              "Review score thresholds and compare with known inspection outcomes.", "Medium"),
    "depth": ("Historical depth", "Only {0} days are available in the dashboard sample.",
              "Seasonal and trend detection may be weak.",
              "Use at least 6-12 months of meter readings for production NTL detection.", "High"),
    "history": ("Historical depth", "Daily consumption history is missing from dashboard outputs.",
                "Analysts cannot review customer timelines.",
                "Export daily history for high-risk and sampled normal customers.", "High"),
    "quality": ("Data quality", "Missing-cell rate is {0}%.", "Missing readings can create false anomalies.",
                "Add missing-reading reason codes, meter communication status and billing correction flags.", "Medium"),
    "loss": ("Financial impact", "Estimated loss is missing or zero.", "Managers cannot compare inspection value by case.",
             "Add tariff class, contract power, customer category and historical billing amount.", "Medium"),
    "ready": ("Operational readiness", "No major blocking gap detected in the current prototype outputs.",
              "The platform can support a pilot workflow.",
              "Next step: connect real GIS, inspection outcomes, and role-based access.", "Medium"),
}
COLUMNS = ["audit_area", "finding", "operational_impact", "recommended_improvement", "priority"]


def finding(key: str, figure: Column | None = None) -> Column:
    texts = [F.lit(t) for t in FINDINGS[key]]
    if figure is not None:
        texts[1] = F.replace(texts[1], F.lit("{0}"), figure)
    return F.struct(*[t.alias(c) for t, c in zip(texts, COLUMNS)])


def operational_audit(customers: DataFrame, daily: DataFrame, missing_percent: float = 0.0) -> DataFrame:
    """At most a handful of rows: every finding that applies, or one that says the run is in order."""
    located = {"latitude", "longitude"} <= set(customers.columns)
    lost = F.col("latitude").isNull() | F.col("longitude").isNull() if located else F.lit(True)
    loss = num(col_or(customers, "estimated_loss_all_30d", None))
    facts = customers.agg(
        F.count("*").alias("n"), F.count_if(lost).alias("unlocated"),
        F.count(num(col_or(customers, "fraud_label", None))).alias("labels"),
        F.coalesce(F.avg(is_high(col_or(customers, "risk_level", None).cast("string")).cast("double")) * 100,
                   F.lit(0.0)).alias("rate"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("loss"))
    days = (daily.select("date").filter(F.col("date").isNotNull()).distinct().agg(F.count("*")).scalar()
            if "date" in daily.columns else F.lit(0))
    facts = facts.withColumn("days", days).withColumn("missing", F.lit(float(missing_percent)))
    rate = F.format_string("%.1f", F.bround("rate", 1))
    rows = [
        F.when(F.col("unlocated") > 0, finding("gis")),
        F.when(F.col("labels") <= 20, finding("labels")),
        F.when(F.col("rate") > 25, finding("large", rate)).when(F.col("rate") < 1, finding("small", rate)),
        F.when(F.col("days") == 0, finding("history")).when(F.col("days") < 60, finding("depth", F.col("days").cast("string"))),
        F.when(F.col("missing") > 2, finding("quality", F.format_string("%.2f", "missing"))),
        F.when(F.lit("estimated_loss_all_30d" in customers.columns) & (F.col("loss") <= 0), finding("loss")),
    ]
    found = F.array_compact(F.array(*rows))
    listed = (F.when(F.col("n") == 0, F.array(finding("coverage")))
              .when(F.size(found) == 0, F.array(finding("ready"))).otherwise(found))
    return facts.select(F.posexplode(listed).alias("_i", "f")).select("f.*")
