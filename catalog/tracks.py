"""Meter data derived from the given tables.

E: events as raw meter rows (several per user and day). S: line items as daily supplier meters. O: orders as
daily customer meters. Faults are planted by rules on the keys, so that every flag has something to find; all
rows of the tables are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattlens.operators import daily, enrich, explain, features, risk, units
from wattlens.operators.enrich import temperature_context
from wattlens.plans.clustered import dealt, enough_partitions, stored_clustered
from wattlens.plans.staging import stored


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; the small shift keeps exact halves on one side in every engine."""
    return df.select(*[F.round(F.col(f"`{n}`") + 1e-9, digits).alias(n) if t == "double" else F.col(f"`{n}`")
                       for n, t in df.dtypes])


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- E ---
def events_raw(spark, folder) -> DataFrame:
    """Raw meter rows as text, with gaps, negatives, decimal commas, blank ids and bad dates."""
    e = table(spark, folder, "events")
    eid, value = F.col("event_id"), text(F.col("value"))
    kwh = (F.when(eid % 53 == 0, F.lit(None).cast("string")).when(eid % 59 == 0, F.concat(F.lit("-"), value))
           .when(eid % 7 == 0, F.replace(value, F.lit("."), F.lit(","))).otherwise(value))
    day = F.date_format("ts", "yyyy-MM-dd")
    us, eu = F.date_format("ts", "M/d/yyyy"), F.date_format("ts", "yyyy/M/d")
    date = F.when(eid % 97 == 0, "not a date").when(eid % 5 == 0, us).when(eid % 5 == 1, eu).otherwise(day)
    ids = F.when(eid % 101 == 0, "  ").otherwise(F.concat(F.lit(" "), text("user_id")))
    label = F.when(eid % 4 == 0, F.when(F.col("user_id") % 9 == 0, 1.0).otherwise(0.0))
    return e.select(ids.alias("customer_id"), date.alias("date"), kwh.alias("consumption_kwh"),
                    label.alias("fraud_label"), eid.alias("sequence"))


def events_typed(spark, folder) -> DataFrame:
    """The same rows as ids, days and numbers; gaps and negatives are kept."""
    e = table(spark, folder, "events")
    eid = F.col("event_id")
    kwh = F.when(eid % 53 == 0, F.lit(None)).when(eid % 59 == 0, -F.col("value")).otherwise(F.col("value"))
    return e.select(text("user_id").alias("customer_id"), F.to_date("ts").alias("date"), kwh.alias("consumption_kwh"),
                    F.when(eid % 4 == 0, F.when(F.col("user_id") % 9 == 0, 1.0).otherwise(0.0)).alias("fraud_label"),
                    eid.alias("sequence"))


# --- S ---
def supplier_kwh() -> Column:
    key, day, q = F.col("l_suppkey"), F.col("l_shipdate"), F.col("l_quantity")
    return (F.when((key % 7 == 3) & F.month(day).isin(2, 9), 0.0)
            .when((key % 11 == 5) & (F.year(day) >= 2000), 12.0)
            .when((key % 5 == 1) & (day >= F.lit("2001-06-01").cast("timestamp")), F.floor(q / 8).cast("double"))
            .otherwise(q))


def supplier_readings(spark, folder, spread=False) -> DataFrame:
    """Whole kWh per supplier and ship date. `spread` deals the items by supplier and date into as many partitions as they need."""
    items = table(spark, folder, "lineitem").select(
        text("l_suppkey").alias("customer_id"), F.to_date("l_shipdate").alias("date"), supplier_kwh().alias("kwh"))
    if spread:
        items = items.repartition(enough_partitions(items), "customer_id", "date")
    return items.groupBy("customer_id", "date").agg(F.sum("kwh").alias("consumption_kwh"))


def payment_fields(key: Column, balance: Column) -> dict[str, Column]:
    status = F.when(key % 10 == 0, "suspended").when(key % 10 == 1, "under_review").otherwise("active")
    return {"payment_late_count_12m": (key % 13).cast("int"), "unpaid_bills": (key % 7).cast("int"),
            "avg_payment_delay_days": (key % 90).cast("double"),
            "arrears_amount_lek": F.greatest(F.lit(0.0), -balance) * 100,
            "disconnections_12m": (key % 4).cast("int"), "months_since_last_payment": (key % 9).cast("double"),
            "account_status": status}


def supplier_dimension(spark, folder) -> DataFrame:
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "residential").when(key % 3 == 1, "commercial").otherwise("industrial")
    fields = {
        "customer_id": text(key), "customer_type": kind, "area_id": F.col("n_name"),
        "transformer_id": F.concat(F.lit("TR_"), text(key % 70)), "city": F.col("n_name"),
        "latitude": 39.5 + (nation * 13 % 25) * 0.14 + (key % 10) * 0.01,
        "longitude": 18.7 + (nation * 7 % 25) * 0.1 + (key % 10) * 0.01,
        "meter_age": (key % 20).cast("double"), "contract_power_kw": 3.0 + key % 30,
        "fraud_label": F.when(F.col("s_acctbal") < 0, 1.0).otherwise(0.0),
        **payment_fields(key, F.col("s_acctbal"))}
    return s.join(n, s.s_nationkey == n.n_nationkey).select(*[e.alias(c) for c, e in fields.items()])


def nation_weather(spark, folder) -> DataFrame:
    """Seasonal weather for four fifths of the nations over the ship dates."""
    span = table(spark, folder, "lineitem").agg(
        F.struct(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))).scalar()
    n = table(spark, folder, "nation").filter(F.col("n_nationkey") % 5 != 4)
    days = n.select("n_nationkey", F.col("n_name").alias("city"), F.explode(F.sequence(span["a"], span["b"])).alias("date"))
    temp = F.round(enrich.seasonal_temperature(16 + F.col("n_nationkey") % 5, F.lit(11.0), F.col("date")), 2)
    out = days.select("date", "city", temp.alias("temp_mean"))
    return out.withColumns(temperature_context(F.col("temp_mean")))


WEATHER_HOME = "NATION_0"


def supplier_weather(spark, folder, attributes=("city",)) -> DataFrame:
    """S readings with city and weather; the other attributes are joined per customer later."""
    dimension = supplier_dimension(spark, folder)
    readings = enrich.attach_metadata(supplier_readings(spark, folder), dimension.select("customer_id", *attributes))
    return enrich.attach_weather(readings, nation_weather(spark, folder), WEATHER_HOME)


def supplier_daily(spark, folder) -> DataFrame:
    return daily.daily_context(dealt(supplier_weather(spark, folder), "customer_id"))


def supplier_features(spark, folder) -> DataFrame:
    return features.customer_features(supplier_daily(spark, folder), supplier_dimension(spark, folder))


def model_inputs(df: DataFrame) -> DataFrame:
    """Stand-ins for the model outputs, from the id: scoring is then checkable without a model."""
    key = F.col("customer_id").cast("long")
    probability = F.when(key % 3 != 0, (key * 53 % 101).cast("double"))
    return df.withColumns({"ai_anomaly_score": (key * 37 % 101).cast("double"), "fraud_probability": probability})


# A run writes its result tables once and all later questions read them. The tables below are such results:
# built from the given tables on first use in an application, then read back.
def daily_table(spark, folder) -> DataFrame:
    """Clustered by customer, as a run keeps it."""
    def build():
        return daily.daily_context(dealt(supplier_weather(spark, folder), "customer_id"))
    return stored_clustered(spark, f"{folder} daily", build, "customer_id", ["date"], "daily")


def feature_table(spark, folder) -> DataFrame:
    return stored(spark, f"{folder} features", lambda: features.customer_features(
        daily_table(spark, folder), supplier_dimension(spark, folder)))


def supplier_inputs(spark, folder) -> DataFrame:
    return model_inputs(feature_table(spark, folder))


def customer_table(spark, folder) -> DataFrame:
    def build():
        return explain.add_explanations(risk.score_customers(supplier_inputs(spark, folder))[0])
    return stored(spark, f"{folder} customers", build)


def area_table(spark, folder) -> DataFrame:
    return stored(spark, f"{folder} areas", lambda: risk.area_risk(customer_table(spark, folder)))


def supplier_scores(spark, folder):
    """(customers, areas, transformers, queue) of the S track."""
    customers = customer_table(spark, folder)
    transformers = risk.transformer_risk(risk.prelim_risk(supplier_inputs(spark, folder)))
    return customers, area_table(spark, folder), transformers, risk.inspection_priority(customers)


# --- O ---
def order_readings(spark, folder) -> DataFrame:
    """Whole kWh per customer and order date."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(text("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.sum(F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("consumption_kwh"))


def customer_dimension(spark, folder) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    key = F.col("c_custkey")
    fields = {"customer_id": text(key), "customer_type": F.col("c_mktsegment"), "area_id": F.col("n_name"),
              "transformer_id": F.concat(F.lit("TR_"), text(key % 70)), "city": F.col("n_name"),
              "fraud_label": F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0),
              **payment_fields(key, F.col("c_acctbal"))}
    return c.join(n, c.c_nationkey == n.n_nationkey).select(*[e.alias(k) for k, e in fields.items()])


def order_daily(spark, folder) -> DataFrame:
    return daily.daily_context(order_readings(spark, folder))


def order_features(spark, folder) -> DataFrame:
    return features.customer_features(order_daily(spark, folder), customer_dimension(spark, folder))


# --- units ---
def unit_rows(spark, folder) -> DataFrame:
    """S readings as delivered unit readings: headers differ from the canonical names."""
    readings = supplier_readings(spark, folder, spread=True)
    readings = dealt(readings, "customer_id", enough_partitions(readings))
    dim = supplier_dimension(spark, folder).select("customer_id", "city", F.col("fraud_label").alias("is_fraud"))
    key = F.col("customer_id").cast("long")
    return readings.join(dim, "customer_id", "left").select(
        F.col("date").alias("reading_date"), F.concat(F.lit("B"), text(key % 20)).alias("building"),
        F.col("customer_id").alias("flat_id"), F.col("consumption_kwh").alias("kwh"),
        (key % 7).cast("int").alias("storey"), (40.0 + key % 60).alias("sqm"), (1.0 + key % 5).alias("residents"), "city",
        F.when(key % 4 == 0, "Village").otherwise("City").alias("settlement_type"),
        F.when(key % 6 == 0, "Shop").otherwise("Apartment").alias("unit_type"), "is_fraud")


def unit_readings(spark, folder) -> DataFrame:
    return units.building_standardize(unit_rows(spark, folder))


def unit_feature_table(spark, folder) -> DataFrame:
    return stored(spark, f"{folder} units", lambda: units.unit_features(unit_readings(spark, folder)))


def unit_flagged(spark, folder) -> DataFrame:
    return units.unit_lag_flags(units.unit_daily_flags(unit_readings(spark, folder)))


def unit_scored(spark, folder) -> DataFrame:
    return stored(spark, f"{folder} unit scores",
                  lambda: units.unit_scores(unit_feature_table(spark, folder), models_on=False))


# --- cases, activity and requests from the event log ---
def case_events(spark, folder) -> DataFrame:
    """Status updates: every event is an update of the case of its user."""
    e = table(spark, folder, "events")
    status = (F.when(F.col("event_type") == "click", "Assigned").when(F.col("event_type") == "view", "In Field")
              .when(F.col("event_type") == "signup", "Inspected").when(F.col("event_type") == "purchase", "Confirmed NTL")
              .otherwise("False Alarm"))
    return e.select(F.format_string("NTL-%05d", F.col("user_id") % 60 + 1).alias("case_id"),
                    F.struct("ts", "event_id").alias("event_time"), status.alias("status"),
                    F.concat(F.lit("Inspection Team "), text(F.col("event_id") % 3 + 1)).alias("assigned_team"),
                    F.col("event_type").alias("inspection_result"), F.col("props").alias("field_notes"))


def request_events(spark, folder) -> DataFrame:
    """Requests: the first half of the event types ask, purchases answer."""
    e = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "purchase", "answered").otherwise("asked")
    return e.select(F.concat(F.lit("REQ-"), text(F.col("event_id") % 4001)).alias("request_id"), kind.alias("kind"),
                    F.col("ts").alias("event_time"), text("user_id").alias("actor"), F.col("event_type").alias("topic"),
                    F.col("props").alias("note"), "event_id")


TEAMS = ["Inspection Team 1", "Inspection Team 2", "Inspection Team 3"]
