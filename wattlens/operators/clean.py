"""Cleaning of long readings. Order matters: merge copies, drop negatives, cap, fill, propagate labels.

The merge groups by (customer, day) and pre-aggregates before its shuffle, so a customer who owns a large
share of the raw rows is reduced to one row per day. Every later per-customer window is then bounded by the
number of calendar days.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens import constants as K
from wattlens.functions.columns import num, ratio
from wattlens.plans.selection import exact_quantile
from wattlens.plans.staging import stage

KEYS = ["customer_id", "date"]


def date_shape(fmt: str) -> str:
    """Pattern of the texts a date format can read."""
    digits = {"yyyy": r"\d{4}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + "".join(digits.get(part, re.escape(part)) for part in re.split(r"(yyyy|M|d)", fmt)) + "$"


def parse_date(value: Column) -> Column:
    """Day, or NULL. Dates, also with a time behind, in ISO form; other text by the fixed list of formats.

    A format is tried only on text of its shape: a failed parse costs far more than a pattern check.
    """
    text = F.trim(value.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), text.try_cast("timestamp"))
    tries = [F.when(text.rlike(date_shape(fmt)), F.try_to_timestamp(text, F.lit(fmt))) for fmt in K.DATE_FORMATS]
    return F.coalesce(iso, *tries).cast("date")


def coerce_numeric(value: Column) -> Column:
    """Number from messy text: blanks removed, a single decimal comma accepted, anything else NULL."""
    text = F.trim(value.cast("string"))
    text = F.when(~text.isin(K.NULL_TOKENS), text)
    text = F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"(?<=\d),(?=\d{1,3}$)", ".")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), num(text))


def trim_ids(df: DataFrame) -> DataFrame:
    """Rows with a customer id, trimmed; null and blank ids are dropped."""
    return (df.withColumn("customer_id", F.trim(F.col("customer_id").cast("string")))
            .filter(F.length("customer_id") > 0))


def typed_rows(df: DataFrame) -> DataFrame:
    """Ids trimmed, date and consumption parsed; rows whose date does not parse keep a NULL date."""
    kwh = F.col("consumption_kwh")
    kwh = num(kwh) if dict(df.dtypes)["consumption_kwh"] != "string" else coerce_numeric(kwh)
    date = F.col("date") if dict(df.dtypes)["date"] == "date" else parse_date(F.col("date"))
    return trim_ids(df).withColumn("date", date).withColumn("consumption_kwh", kwh)


def merge_duplicates(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """One row per customer and day: mean reading, first known label and attributes.

    `sequence` names a column that orders the copies; without it the smallest known value is taken. The
    column `copies` counts the merged rows. Text attributes are better moved to the customer dimension before
    (`enrich.split_customers`), because an aggregate with text results has to sort its input.
    """
    others = [c for c in df.columns if c not in [*KEYS, "consumption_kwh", sequence]]

    def first(name: str) -> Column:
        if sequence is None:
            return F.min(name)
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(sequence)))

    return df.groupBy(*KEYS).agg(F.avg("consumption_kwh").alias("consumption_kwh"),
                                 *[first(c).alias(c) for c in others], F.count("*").alias("copies"))


def drop_negatives(df: DataFrame) -> DataFrame:
    return df.withColumn("consumption_kwh", F.when(F.col("consumption_kwh") >= 0, F.col("consumption_kwh")))


def cap_value(df: DataFrame, approximate: bool = False) -> Column:
    """Scalar: the upper limit for readings. Exact by default; the sketch trades exactness for one scan."""
    if approximate:
        return df.agg(F.percentile_approx("consumption_kwh", K.CAP_QUANTILE, 100000)).scalar()
    return exact_quantile(df, "consumption_kwh", K.CAP_QUANTILE)


def cap_outliers(df: DataFrame, limit: Column | None = None) -> DataFrame:
    """Readings limited to the cap (only if it is positive)."""
    limit = cap_value(df) if limit is None else limit
    kwh = F.col("consumption_kwh")
    return df.withColumn("consumption_kwh", F.when((limit > 0) & (kwh > limit), limit).otherwise(kwh))


def fill_missing(df: DataFrame) -> DataFrame:
    """Missing readings: median of the customer, else of all readings, else 0."""
    own = F.median("consumption_kwh").over(Window.partitionBy("customer_id"))
    filled = stage(df.withColumn("consumption_kwh", F.coalesce("consumption_kwh", own)), "filled")
    if filled.filter(F.col("consumption_kwh").isNull()).isEmpty():
        return filled
    overall = exact_quantile(filled, "consumption_kwh", 0.5)
    return filled.withColumn("consumption_kwh", F.coalesce("consumption_kwh", overall, F.lit(0.0)))


def propagate_labels(df: DataFrame) -> DataFrame:
    """The first known label of a customer on all its rows."""
    if "fraud_label" not in df.columns:
        return df.withColumn("fraud_label", F.lit(None).cast("double"))
    whole = (Window.partitionBy("customer_id").orderBy("date")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    label = num(F.col("fraud_label"))
    return df.withColumn("fraud_label", F.first(label, ignorenulls=True).over(whole))


def clean_readings(df: DataFrame, sequence: str | None = None, approximate_cap: bool = False
                   ) -> tuple[DataFrame, DataFrame]:
    """Cleaned readings and a one-row report of what was done."""
    # staged: the cap, the fill and the report all read the merged rows; rows without a valid date merge to one per customer,
    # so that the report can count them without parsing the dates again
    groups = stage(merge_duplicates(typed_rows(df), sequence), "merged")
    merged = groups.filter(F.col("date").isNotNull())
    positive = drop_negatives(merged)
    limit = cap_value(positive, approximate_cap)
    clean = propagate_labels(fill_missing(cap_outliers(positive, limit))).drop("copies")
    return clean, cleaning_report(df, groups, limit)


def cleaning_report(raw: DataFrame, groups: DataFrame, limit: Column) -> DataFrame:
    """Counters of the cleaning steps and the readiness score, one row. Of the raw rows only their number is read."""
    undated = F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("copies"))), F.lit(0))
    scanned = {"rows": raw.agg(F.count("*")).scalar(), "undated": groups.agg(undated).scalar()}
    merged = groups.filter(F.col("date").isNotNull())
    kwh = F.col("consumption_kwh")
    kept = F.when(kwh >= 0, kwh)
    per_customer = merged.groupBy("customer_id").agg(
        F.count("*").alias("days"), F.sum("copies").alias("copies"), F.min("date").alias("first"),
        F.max("date").alias("last"), F.count_if(kwh < 0).alias("negative"),
        F.count_if(kept.isNull()).alias("missing"), F.count_if((limit > 0) & (kept > limit)).alias("capped"))
    # `days` takes at most one value per calendar day, which bounds the median's buffer
    totals = per_customer.agg(
        F.coalesce(F.sum("days"), F.lit(0)).alias("clean_rows"), F.count("*").alias("customers"),
        F.min("first").alias("date_min"), F.max("last").alias("date_max"),
        F.coalesce(F.sum("copies") - F.sum("days"), F.lit(0)).alias("duplicate_customer_date_readings_merged"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative_values_replaced"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_consumption_filled"),
        F.coalesce(F.sum("capped"), F.lit(0)).alias("extreme_values_capped"),
        F.coalesce(F.median("days"), F.lit(0.0)).alias("median_history_days_per_customer"))
    report = (totals.withColumns({"initial_rows": scanned["rows"], "invalid_dates_removed": scanned["undated"]})
              .withColumn("cap_value_99_5_percentile", F.coalesce(limit, F.lit(0.0))))
    return report.withColumn("data_readiness_score", F.round(readiness(), 1))


def readiness() -> Column:
    """Readiness in percent from the report columns."""
    def share_ok(bad: str) -> Column:
        broken = F.col(bad) / F.greatest(F.col("initial_rows"), F.lit(1))
        return 1.0 - F.least(broken, F.lit(1.0))

    history = F.least(F.col("median_history_days_per_customer") / K.READINESS_DAYS, F.lit(1.0))
    parts = {"completeness": share_ok("missing_consumption_filled"), "dates": share_ok("invalid_dates_removed"),
             "duplicates": share_ok("duplicate_customer_date_readings_merged"), "history": history}
    weighted = [part * K.READINESS_WEIGHTS[name] for name, part in parts.items()]
    return reduce(lambda a, b: a + b, weighted) * 100
