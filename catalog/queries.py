"""One function per registered query: (spark, folder) -> DataFrame."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from catalog import tracks as T
from wattlens import constants as K, pipeline
from wattlens.functions import columns as C
from wattlens.operators import (audit, clean, daily, enrich, explain, features, forecast, geo, metrics, models, ops,
                                risk, units)
from wattlens.plans.clustered import dealt
from wattlens.plans.staging import stage
from wattlens.sources import detect, reshape

QUERIES = {}


def query(fn):
    """Register under the function's name; doubles are rounded for comparison."""
    QUERIES[fn.__name__] = lambda spark, folder: T.tidy(fn(spark, folder))
    return fn


# ---------------------------------------------------------------- sources and detection
@query
def src_3(s, d):
    e = T.table(s, d, "events")
    sparse = e.select(F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"), F.lit(None).cast("string").alias("empty"),
                      F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return detect.drop_empty_axes(sparse)


def invoices(s, d):
    items = T.table(s, d, "lineitem")
    return items.select(T.text("l_suppkey").alias("client_id"), F.to_date("l_shipdate").alias("invoice_date"),
                        F.when(F.col("l_returnflag") != "R", "ELEC").otherwise("GAZ").alias("counter_type"),
                        F.when(F.col("l_linenumber") % 4 == 0, 0).otherwise(1).alias("counter_coefficient"),
                        F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber")).alias("months_number"),
                        F.col("l_quantity").alias("consommation_level_1"), (F.col("l_quantity") / 2).alias("consommation_level_2"),
                        F.lit(0).alias("consommation_level_3"), F.lit(None).cast("double").alias("consommation_level_4"))


def clients(s, d):
    sup = T.table(s, d, "supplier")
    born = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("s_suppkey") % 3000).cast("int"))
    return sup.select(T.text("s_suppkey").alias("client_id"), F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("target"),
                      F.col("s_nationkey").alias("disrict"), (F.col("s_nationkey") % 5).alias("region"),
                      (F.col("s_suppkey") % 3).alias("client_catg"), F.date_format(born, "dd/MM/yyyy").alias("creation_date"))


@query
def invoice_to_readings(s, d):
    return reshape.invoice_to_readings(invoices(s, d), clients(s, d))


@query
def src_5(s, d):
    return reshape.prefer_electricity(invoices(s, d)).groupBy("client_id").agg(F.count("*").alias("rows"))


@query
def infer_id_column(s, d):
    c = T.table(s, d, "customer")
    return detect.infer_id_column(c, c.columns)


@query
def infer_roles(s, d):
    e = T.table(s, d, "events")
    flags = e.select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", "value",
                     (F.col("user_id") % 2).alias("mark"))
    return detect.infer_roles(flags)


@query
def choose_id_column(s, d):
    """The id column as a run picks it, with the rows of the column that it names."""
    c = T.table(s, d, "customer")
    name = detect.choose_id_column(c, c.columns)
    return c.select(F.lit(name).alias("chosen"), F.col(name).cast("string").alias("id"))


@query
def choose_roles(s, d):
    """Roles from sketches; every column of the line items and events once."""
    items, e = T.table(s, d, "lineitem"), T.table(s, d, "events")
    days = items.select("l_orderkey", "l_quantity", "l_returnflag", F.to_date("l_shipdate").alias("l_shipdate"),
                        (F.col("l_linenumber") % 2).alias("odd"))
    ids = e.select(F.concat(F.lit("E"), "event_id").alias("event_key"), F.concat(F.lit("U"), "user_id").alias("user_key"))
    found = [{"table": t, "column": c, "role": r} for t, df in (("lineitem", days), ("events", ids))
             for c, r in detect.choose_roles(df).items()]
    roles = s.createDataFrame(found, "table string, column string, role string")  # one row per column
    counts = items.agg(F.count("*").alias("n")).withColumn("table", F.lit("lineitem")).unionByName(
        e.agg(F.count("*").alias("n")).withColumn("table", F.lit("events")))
    return roles.join(counts, "table").select("table", "column", "role", "n")


@query
def profile_table(s, d):
    e = T.table(s, d, "events")
    return detect.profile_table(e.select("user_id", "event_type", F.when(F.col("event_id") % 53 != 0, F.floor("value")).alias("value")))


def wide_events(s, d) -> tuple[DataFrame, list[str]]:
    """E track with one column per day of January 2024, as delivered in wide files."""
    e = T.table(s, d, "events").select(T.text("user_id").alias("CONS_NO"), F.to_date("ts").alias("day"), "value")
    seen = e.select("day").distinct().orderBy("day").collect()  # one row per calendar day
    days = [r["day"] for r in seen]
    cells = [F.round(F.sum(F.when(F.col("day") == F.lit(x), F.col("value"))), 2).cast("string").alias(f"{x.month}/{x.day}/{x.year}")
             for x in days]
    return e.groupBy("CONS_NO").agg(*cells, F.max((F.col("CONS_NO").cast("int") % 9 == 0).cast("int")).alias("FLAG"))


@query
def wide_to_long(s, d):
    wide = wide_events(s, d)
    return reshape.to_long(wide, detect.detect_layout(wide))


@query
def sch_8(s, d):
    raw = T.events_raw(s, d).withColumnsRenamed({"customer_id": "who", "date": "when_read", "consumption_kwh": "amount"})
    return reshape.apply_mapping(raw, {"schema_type": "long", "customer_col": "who", "date_col": "when_read",
                                       "consumption_col": "amount", "label_col": "fraud_label"})


@query
def cln_2(s, d):
    raw = T.events_raw(s, d).withColumnsRenamed({"customer_id": "meter_id", "date": "reading_date", "consumption_kwh": "usage"})
    return reshape.to_long(raw, detect.detect_layout(raw))


# ---------------------------------------------------------------- cleaning
@query
def sample_customers(s, d):
    readings = T.order_readings(s, d)
    return reshape.sample_customers(readings, "customer_id", 100)


@query
def sample_balanced(s, d):
    return reshape.sample_balanced(clients(s, d), 40)


@query
def cln_7(s, d):
    return reshape.recent_days(T.order_readings(s, d), 365)


@query
def cln_8(s, d):
    return clean.trim_ids(T.events_raw(s, d)).groupBy("customer_id").agg(F.count("*").alias("rows"))


@query
def cln_9(s, d):
    typed = clean.typed_rows(T.events_raw(s, d))
    return typed.groupBy("date").agg(F.count("*").alias("rows"))


@query
def coerce_numeric(s, d):
    raw = T.events_raw(s, d)
    return raw.select("sequence", clean.coerce_numeric(F.col("consumption_kwh")).alias("consumption_kwh"))


@query
def merge_duplicates(s, d):
    return clean.merge_duplicates(T.events_typed(s, d), "sequence")


@query
def cln_12(s, d):
    return clean.drop_negatives(T.events_typed(s, d)).select("sequence", "consumption_kwh")


def merged(s, d):
    return stage(clean.drop_negatives(clean.merge_duplicates(T.events_typed(s, d), "sequence")))


@query
def cap_outliers(s, d):
    return clean.cap_outliers(merged(s, d)).select("customer_id", "date", "consumption_kwh")


@query
def fill_missing(s, d):
    return clean.fill_missing(merged(s, d)).select("customer_id", "date", "consumption_kwh")


@query
def cln_15(s, d):
    return clean.propagate_labels(merged(s, d)).select("customer_id", "date", "fraud_label")


@query
def pipeline_labels(s, d):
    """First labels by the pipeline's own path: copies of a day disagree, and the file's order decides."""
    label = F.when(F.col("sequence") % 4 == 0, F.when(F.col("sequence") % 8 == 0, 1.0).otherwise(0.0))
    raw = T.events_raw(s, d).withColumn("fraud_label", label).drop("sequence")
    rows = reshape.to_long(reshape.in_file_order(raw), detect.detect_layout(raw))
    return pipeline.clean_and_split(rows)[0].select("customer_id", "date", "fraud_label")


@query
def cln_16(s, d):
    cleaned, _ = clean.clean_readings(T.events_raw(s, d), "sequence")
    return cleaned.repartitionByRange("customer_id", "date").sortWithinPartitions("customer_id", "date")


@query
def readiness_report(s, d):
    return clean.clean_readings(T.events_raw(s, d), "sequence")[1]


# ---------------------------------------------------------------- joins
@query
def jn_1(s, d):
    from wattlens.plans.joins import lookup_join
    rows = invoices(s, d).select(F.col("client_id").alias("customer_id"), F.col("invoice_date").alias("date"),
                                 "consommation_level_1")
    dim = reshape.client_dimension(clients(s, d)).drop("_created")
    joined = lookup_join(rows, dim, ["customer_id"], spread=["customer_id", "date"])
    return joined.groupBy("area_id", "transformer_id").agg(F.sum("consommation_level_1").alias("kwh"), F.count("*").alias("rows"))


@query
def attach_metadata(s, d):
    out = enrich.attach_metadata(T.order_readings(s, d), T.customer_dimension(s, d))
    return out.select("customer_id", "date", "consumption_kwh", "customer_type", "area_id", "transformer_id", "fraud_label")


WEATHER = ["customer_id", "date", "city", "temp_mean", "heating_degree_days", "cooling_degree_days", "weather_class",
           "is_cold", "is_hot", "weather_demand_pressure"]


@query
def attach_weather(s, d):
    return T.supplier_weather(s, d).select(WEATHER)


@query
def jn_4(s, d):
    """Only the cities without own weather: theirs comes from the default city."""
    covered = T.nation_weather(s, d).select("city").distinct()
    return T.supplier_weather(s, d).select(WEATHER).join(covered, "city", "left_anti")


@query
def jn_5(s, d):
    readings = enrich.attach_metadata(T.supplier_readings(s, d), T.supplier_dimension(s, d))
    weather = T.nation_weather(s, d)
    return enrich.extend_weather(weather, readings).select("date", "city", "temp_mean", "weather_class")


@query
def extend_weather_duplicates(s, d):
    """Every delivered day twice, the second time warmer: each reading still meets one row, the first."""
    readings = enrich.attach_metadata(T.supplier_readings(s, d), T.supplier_dimension(s, d).select("customer_id", "city"))
    weather = T.nation_weather(s, d)
    twice = weather.withColumn("_order", F.lit(1)).unionByName(
        weather.withColumn("temp_mean", F.col("temp_mean") + 30).withColumn("_order", F.lit(2)))
    out = enrich.attach_weather(readings, enrich.extend_weather(twice, readings), T.WEATHER_HOME)
    return out.groupBy("city").agg(F.count("*").alias("readings"), F.avg("temp_mean").alias("temp_mean"))


@query
def jn_6(s, d):
    agg = enrich.attach_metadata(features.aggregate_customers(T.supplier_daily(s, d)), T.supplier_dimension(s, d))
    return agg.select("customer_id", "last_30_mean", "avg_temp_mean", "longest_low_streak", "consumption_trend_slope",
                      "area_id", "meter_age", "account_status")


PEER = ["customer_type", "consumption_band", "peer_avg_last_30", "peer_median_last_30", "peer_avg_total", "peer_count"]


@query
def peer_stats(s, d):
    agg = stage(enrich.attach_metadata(features.aggregate_customers(T.order_daily(s, d)), T.customer_dimension(s, d)))
    return features.peer_stats(features.consumption_bands(agg)).select(PEER)


@query
def agg_12(s, d):
    agg = stage(enrich.attach_metadata(features.aggregate_customers(T.supplier_daily(s, d)), T.supplier_dimension(s, d)))
    return features.peer_stats(features.consumption_bands(agg)).select(PEER)


def prelim(s, d):
    return risk.prelim_risk(T.supplier_inputs(s, d))


@query
def geo_risk(s, d):
    p = prelim(s, d)
    out = risk.geo_risk(p, risk.area_risk_pre(p), risk.transformer_risk(p))
    return out.select("customer_id", "area_risk_score", "anomaly_density", "transformer_risk_score",
                      "transformer_anomaly_density", "geographic_risk_score")


@query
def jn_9(s, d):
    """Daily rows of the customers with a negative balance."""
    marked = T.customer_dimension(s, d).filter(F.col("fraud_label") == 1).select("customer_id")
    return T.order_readings(s, d).join(marked, "customer_id", "left_semi")


@query
def jn_10(s, d):
    chosen = reshape.sample_balanced(clients(s, d), 40)
    return clients(s, d).join(chosen, "client_id", "left_anti")


@query
def jn_11(s, d):
    labels = T.supplier_dimension(s, d).select("customer_id", "fraud_label")
    return enrich.attach_metadata(T.supplier_readings(s, d), labels).groupBy("fraud_label").agg(
        F.count("*").alias("rows"), F.sum("consumption_kwh").alias("kwh"))


# ---------------------------------------------------------------- daily context
def daily_columns(*names):
    def run(s, d):
        return T.supplier_daily(s, d).select("customer_id", "date", *names)
    return run


for _name, _columns in {
    "calendar": ["month", "day_of_week", "season"],
    "rolling_7": ["rolling_7d_mean"],
    "rolling_30": ["rolling_30d_mean"],
    "rolling_std_30": ["rolling_30d_std"],
    "lag_baseline": ["previous_30d_mean"],
    "drop_spike": ["drop_vs_previous_30d_pct", "spike_vs_previous_30d_pct", "sudden_drop_flag", "sudden_spike_flag"],
    "zero_flag": ["zero_flag"],
    "low_relative": ["low_relative_flag"],
    "flatline": ["flatline_flag"],
    "day_10": ["temperature_abs_deviation", "weather_expected_high_usage"],
    "low_extreme": ["low_on_extreme_weather_flag"],
    "high_normal": ["high_on_normal_weather_flag"],
    "weather_mismatch": ["weather_consumption_mismatch"],
}.items():
    _run = daily_columns(*_columns)
    _run.__name__ = _name
    query(_run)


@query
def day_14(s, d):
    """Readings without weather: the weather columns are constants."""
    out = daily.daily_context(T.order_readings(s, d))
    return out.groupBy("weather_demand_pressure", "weather_class", "temperature_abs_deviation", "heating_degree_days",
                       "is_cold", "weather_consumption_mismatch").agg(F.count("*").alias("rows"))


@query
def classify_weather(s, d):
    w = T.nation_weather(s, d).select("date", "city", "temp_mean")
    return w.withColumn("weather_class", C.weather_class(F.col("temp_mean")))


@query
def degree_days(s, d):
    return T.nation_weather(s, d)


@query
def climatology(s, d):
    span = T.table(s, d, "orders").agg(F.struct(F.to_date(F.min("o_orderdate")).alias("a"),
                                                F.to_date(F.max("o_orderdate")).alias("b"))).scalar()
    names = list(K.CITY_CLIMATE)
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("n_nationkey") % len(names) + 1)
    cities = T.table(s, d, "nation").select(picked.alias("city")).distinct()
    return enrich.climatology(cities, span["a"], span["b"]).select("date", "city", "temp_mean", "heating_degree_days")


# ---------------------------------------------------------------- customer features
@query
def customer_agg(s, d):
    return features.customer_aggregate(T.supplier_daily(s, d))


def feature_columns(*names, track=T.supplier_daily):
    def run(s, d):
        return features.aggregate_customers(track(s, d)).select("customer_id", *names)
    return run


for _name, _columns in {
    "cv": ["cv_consumption"],
    "recent_change": ["recent_drop_pct", "recent_spike_pct"],
    "day_ratios": ["zero_day_ratio", "low_day_ratio", "flatline_ratio"],
}.items():
    _run = feature_columns(*_columns)
    _run.__name__ = _name
    query(_run)


@query
def period_means(s, d):
    return features.period_means(T.supplier_daily(s, d))


@query
def weather_agg(s, d):
    return features.weather_aggregate(T.supplier_daily(s, d))


@query
def longest_streak(s, d):
    return features.longest_streaks(T.supplier_daily(s, d))


@query
def trend_slope(s, d):
    return features.trend_slope(T.supplier_daily(s, d))


@query
def first_meta(s, d):
    every = T.supplier_dimension(s, d).columns[1:]
    return features.customer_metadata(daily.daily_context(dealt(T.supplier_weather(s, d, every), "customer_id")))


@query
def payment_risk(s, d):
    out = features.payment_scores(T.customer_dimension(s, d))
    return out.select("customer_id", "payment_on_time_ratio", "payment_risk_score")


@query
def consumption_band(s, d):
    agg = stage(features.aggregate_customers(T.order_daily(s, d)))
    return features.consumption_bands(agg).select("customer_id", "first_90_mean", "consumption_band")


@query
def peer_deviation(s, d):
    return T.order_features(s, d).select("customer_id", "peer_deviation_pct", "customer_vs_peer_ratio")


@query
def sudden_score(s, d):
    return T.supplier_features(s, d).select("customer_id", "sudden_behavior_score")


@query
def weather_score(s, d):
    return T.feature_table(s, d).select("customer_id", "weather_context_score")


# ---------------------------------------------------------------- models and their quality
@query
def feature_vector(s, d):
    rows = models.feature_vector(T.feature_table(s, d)).select("customer_id", F.posexplode("x").alias("position", "value"))
    return rows.select("customer_id", F.element_at(F.array(*map(F.lit, K.MODEL_FEATURES)), F.col("position") + 1).alias("feature"),
                       "value")


def facts(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """What must hold of a model's output whatever its trees are: rows, gaps, values out of range."""
    v = F.col(value)
    return df.agg(F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"),
                  F.count_if((v < low) | (v > high)).alias("out_of_range"), (F.max(v) > F.min(v)).alias("varies"))


@query
def expected_consumption(s, d):
    out = models.expected_consumption(T.feature_table(s, d))
    top = T.feature_table(s, d).agg(F.max("last_30_mean")).scalar()  # a forest never predicts beyond its labels
    return facts(out.withColumn("v", F.col("expected_last_30_consumption") / F.greatest(top, F.lit(0.01))), "v", 0, 1.000001)


@query
def anomaly_score(s, d):
    return facts(models.anomaly_score(T.feature_table(s, d), K.MODEL_FEATURES), "ai_anomaly_score", 0, 100)


@query
def fraud_probability(s, d):
    return facts(models.fraud_probability(T.feature_table(s, d)), "fraud_probability", 0, 100)


@query
def stratified_split(s, d):
    out = models.stratified_split(T.customer_dimension(s, d).select("customer_id", "fraud_label"), "fraud_label")
    return out.groupBy("fraud_label", "is_holdout").agg(F.count("*").alias("rows"))


@query
def feature_importance(s, d):
    table = T.feature_table(s, d)
    used = [f for f in K.MODEL_FEATURES if f in table.columns]
    model = models.fit_classifier(table.filter(F.col("fraud_label").isNotNull()), used)
    shares = models.feature_importance(model, used, s)
    return shares.agg(F.count("*").alias("rows"), F.sum("importance").alias("total"), F.count_if(F.col("importance") < 0).alias("negative"))


def scored_orders(s, d):
    """Every order with a score (its price in thousands, so scores repeat) and a label (urgent or not)."""
    o = T.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"),
                    (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("y"))


@query
def roc_auc(s, d):
    return metrics.roc_auc(scored_orders(s, d), "y", "score")


@query
def average_precision(s, d):
    return metrics.average_precision(scored_orders(s, d), "y", "score")


@query
def topk_metrics(s, d):
    return metrics.topk_metrics(scored_orders(s, d), "y", "score", "id")


def line_prices(s, d):
    items = T.table(s, d, "lineitem")
    return items.select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 3000).alias("p"))


@query
def mae(s, d):
    return metrics.mae(line_prices(s, d), "y", "p")


@query
def r2(s, d):
    return metrics.r2(line_prices(s, d), "y", "p")


# ---------------------------------------------------------------- risk
@query
def minmax_100(s, d):
    return risk.minmax_100(T.table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "scaled").drop("c_acctbal")


@query
def tariff(s, d):
    f = T.feature_table(s, d)
    return f.select("customer_id", C.tariff(F.col("last_30_mean"), F.col("customer_type")).alias("tariff"))


PRELIM = ["customer_id", "historical_deviation_score", "peer_deviation_score", "sudden_flags_score",
          "context_deviation_score", "weather_context_score", "payment_behavior_score", "ai_combined_score",
          "preliminary_risk_score"]


@query
def prelim_risk(s, d):
    return prelim(s, d).select(PRELIM)


@query
def area_risk_pre(s, d):
    return risk.area_risk_pre(prelim(s, d))


@query
def transformer_risk(s, d):
    return risk.transformer_risk(prelim(s, d))


@query
def final_risk(s, d):
    return risk.score_customers(T.supplier_inputs(s, d))[0].select("customer_id", "geographic_risk_score", "risk_score", "risk_level")


@query
def risk_level(s, d):
    o = T.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("score"))
    return o.select("o_orderkey", C.risk_level(F.col("score")).alias("risk_level"))


@query
def estimated_loss(s, d):
    out = risk.score_customers(T.supplier_inputs(s, d))[0]
    return out.select("customer_id", "estimated_missing_kwh_30d", "estimated_loss_all_30d")


@query
def inspection_priority(s, d):
    return T.supplier_scores(s, d)[3]


@query
def area_risk(s, d):
    return T.supplier_scores(s, d)[1]


@query
def rsk_12(s, d):
    """All scores of the customers, with explanations."""
    return T.supplier_scores(s, d)[0].select(
        "customer_id", "preliminary_risk_score", "geographic_risk_score", "risk_score", "risk_level", "estimated_missing_kwh_30d",
        "estimated_loss_all_30d", "main_reason", "recommended_action", "alert_explanation")


@query
def daily_subset(s, d):
    daily_rows = T.daily_table(s, d).select("customer_id", "date", "consumption_kwh")
    return risk.daily_subset(T.supplier_scores(s, d)[0], daily_rows)


def scored_forecast(s, d):
    customers, areas, transformers, queue = T.supplier_scores(s, d)
    return customers, areas, transformers, queue, T.daily_table(s, d)


@query
def pipeline_summary(s, d):
    customers, areas, _, _, context = scored_forecast(s, d)
    events = stage(forecast.daily_events(context))
    loss = forecast.loss_forecast(events, forecast.total_loss(customers))
    return risk.pipeline_summary(customers, areas, context, loss, forecast.area_forecast(areas))


# ---------------------------------------------------------------- explanations and maps
@query
def reasons(s, d):
    return T.supplier_scores(s, d)[0].select("customer_id", "main_reason")


@query
def exp_2(s, d):
    out = features.payment_scores(T.customer_dimension(s, d))
    return out.select("customer_id", explain.payment_reason(out).alias("payment_reason"))


@query
def action(s, d):
    return T.supplier_scores(s, d)[0].select("customer_id", "recommended_action")


@query
def exp_4(s, d):
    return T.supplier_scores(s, d)[0].select("customer_id", "alert_explanation")


@query
def valid_geo(s, d):
    return geo.valid_geo(T.supplier_dimension(s, d)).select("customer_id", "latitude", "longitude")


@query
def risk_color(s, d):
    o = T.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("score"))
    return o.select("o_orderkey", C.risk_color(F.col("score")).alias("color"))


def parsed(lines: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """GeoJSON lines back as columns, so that numbers compare as numbers."""
    out = [F.get_json_object("feature", f"$.properties.{f}").alias(f) for f in fields if f != key]
    xy = [F.get_json_object("feature", f"$.geometry.coordinates[{i}]").cast("double").alias(n)
          for i, n in enumerate(("longitude", "latitude"))]
    return lines.select(key, *xy, *out)


@query
def customer_geojson(s, d):
    lines = geo.customer_geojson(T.supplier_scores(s, d)[0], 30)
    out = parsed(lines, "customer_id", ["risk_score", "risk_level", "area_id", "transformer_id", "color"])
    return out.withColumn("risk_score", F.col("risk_score").cast("double"))


@query
def area_geojson(s, d):
    fields = ["area_risk_score", "area_risk_level", "customers", "high_risk_customers", "critical_customers", "anomaly_density", "color"]
    out = parsed(geo.area_geojson(T.supplier_scores(s, d)[1]), "area_id", fields)
    numbers = {c: F.col(c).cast("double") for c in ("area_risk_score", "anomaly_density")}
    counts = {c: F.col(c).cast("long") for c in ("customers", "high_risk_customers", "critical_customers")}
    return out.withColumns({**numbers, **counts})


@query
def inspection_route(s, d):
    route = geo.inspection_route(T.supplier_scores(s, d)[3])
    points = F.from_json(F.get_json_object("feature", "$.geometry.coordinates"), "array<array<double>>")
    rows = route.select("points", F.posexplode(points).alias("stop", "p"))
    return rows.select("points", (F.col("stop") + 1).alias("stop"), F.col("p")[0].alias("longitude"), F.col("p")[1].alias("latitude"))


@query
def heat_weights(s, d):
    return geo.heat_weights(T.supplier_scores(s, d)[0], "risk_score")


@query
def geo_7(s, d):
    return geo.map_center(T.supplier_dimension(s, d))


@query
def geo_8(s, d):
    return geo.off_map_count(T.supplier_dimension(s, d))


@query
def top_points(s, d):
    out = geo.top_points(T.supplier_scores(s, d)[0], 500, "customer_id")
    return out.select("customer_id", "latitude", "longitude", "risk_score", "risk_level", "main_reason")


# ---------------------------------------------------------------- forecast and audit
def supplier_events(s, d):
    return stage(forecast.daily_events(T.daily_table(s, d)), "events")


@query
def daily_events(s, d):
    return forecast.daily_events(T.supplier_daily(s, d))


def customer_series(s, d):
    return T.supplier_readings(s, d).select(F.col("customer_id").alias("series"), "date", F.col("consumption_kwh").alias("value"))


@query
def forecast_levels(s, d):
    return forecast.forecast_levels(customer_series(s, d)).select("series", "n", "last_date", "level", "trend", "low", "high")


@query
def fc_3(s, d):
    aged = forecast.with_recency(customer_series(s, d)).filter(F.col("_age") <= forecast.RECENT)
    return aged.groupBy("series", F.weekday("date").alias("weekday")).agg(F.median("value").alias("seasonal"))


@query
def weekly_forecast(s, d):
    return forecast.weekly_forecast(customer_series(s, d))


def base_loss(s, d):
    """Current loss without models: 30 times the shortfall of every customer at its tariff."""
    f = T.feature_table(s, d)
    return risk.estimated_loss(f).agg(F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0))).scalar()


@query
def loss_history(s, d):
    return forecast.loss_history(supplier_events(s, d), base_loss(s, d)).select("date", "event_pressure", "daily_loss")


LOSS = ["date", "predicted_average_consumption", "predicted_total_events", "predicted_loss_all"]


@query
def loss_forecast(s, d):
    return forecast.loss_forecast(supplier_events(s, d), base_loss(s, d)).select(LOSS)


@query
def fc_7(s, d):
    """No flagged readings in the history: the forecast follows event pressure instead of money."""
    quiet = supplier_events(s, d).withColumns({c: F.lit(0.0) for c in forecast.EVENTS})
    return forecast.loss_forecast(quiet, base_loss(s, d)).select(LOSS)


@query
def fc_8(s, d):
    f = risk.estimated_loss(T.feature_table(s, d))
    return forecast.loss_forecast_without_history(f, dt.date(2024, 1, 31))


@query
def fc_9(s, d):
    return forecast.loss_forecast(supplier_events(s, d), base_loss(s, d))


@query
def area_forecast(s, d):
    out = forecast.area_forecast(T.supplier_scores(s, d)[1])
    return out.select("forecast_priority", "area_id", "forecasted_area_risk_next_30d")


@query
def customer_forecast(s, d):
    out = forecast.customer_forecast(T.supplier_scores(s, d)[0])
    return out.select("forecast_priority", "customer_id", "forecasted_customer_risk_next_30d", "risk_level")


@query
def forecast_kpis(s, d):
    customers, areas, _, _, context = scored_forecast(s, d)
    events = stage(forecast.daily_events(context))
    current = forecast.total_loss(customers)
    loss = stage(forecast.loss_forecast(events, current))
    return forecast.forecast_kpis(loss, current, forecast.area_forecast(areas))


@query
def fc_13(s, d):
    customers, areas, _, _, context = scored_forecast(s, d)
    return forecast.generate_forecasts(customers, areas, context)[0]


@query
def operational_audit(s, d):
    customers = T.supplier_scores(s, d)[0].drop("latitude")
    missing = QUERIES["profile_table"](s, d).first()["missing_percent"]
    return audit.operational_audit(customers, T.supplier_readings(s, d), missing_percent=missing)


# ---------------------------------------------------------------- units and buildings
@query
def building_standardize(s, d):
    keep = ["unit_id", "date", "building_id", "consumption_kwh", "floor", "area_sqm", "household_size", "city", "location_type",
            "unit_type", "building_type", "transformer_id", "latitude", "longitude", "temp_mean", "fraud_label", "anomaly_type"]
    return T.unit_readings(s, d).select(keep)


@query
def bld_2(s, d):
    return T.unit_readings(s, d).groupBy("building_id").agg(F.max("floors").alias("floors"), F.count("*").alias("rows"))


@query
def expected_kwh(s, d):
    return T.unit_readings(s, d).select("unit_id", "date", "expected_kwh")


@query
def unit_daily_flags(s, d):
    out = units.unit_daily_flags(T.unit_readings(s, d))
    return out.select("unit_id", "date", "consumption_gap_pct", "weather_low_mismatch", "normal_high_mismatch", "zero_flag", "low_expected_flag")


@query
def unit_lag_flags(s, d):
    return T.unit_flagged(s, d).select("unit_id", "date", "prev_kwh", "sudden_drop_flag", "small_change")


@query
def unit_agg(s, d):
    return units.unit_agg(T.unit_flagged(s, d)).drop("latitude", "longitude", "contracted_power_kw", "meter_type", "connection_type")


RATIOS = ["unit_id", "zero_ratio", "flatline_ratio", "low_expected_ratio", "weather_mismatch_ratio", "expected_gap_pct",
          "kwh_per_sqm", "kwh_per_person", "cv_consumption"]


@query
def unit_ratios(s, d):
    return units.unit_ratios(units.unit_agg(T.unit_flagged(s, d))).select(RATIOS)


def unit_features(s, d):
    return T.unit_feature_table(s, d)


@query
def unit_peer(s, d):
    return unit_features(s, d).select("unit_id", "peer_avg_consumption", "peer_low_gap_pct")


@query
def unit_loss(s, d):
    return unit_features(s, d).select("unit_id", "estimated_missing_kwh_30d", "estimated_loss_lek_30d")


@query
def bld_10(s, d):
    return facts(units.unit_anomaly(unit_features(s, d)), "building_ai_anomaly_score", 0, 100)


@query
def bld_11(s, d):
    return facts(units.unit_probability(unit_features(s, d))[0], "fraud_probability", 0, 1)


@query
def unit_anomaly_type(s, d):
    """A kind of anomaly that changes from reading to reading: the most frequent one counts."""
    key, day = F.col("flat_id").cast("long"), F.col("reading_date")
    kind = (F.when(F.dayofmonth(day) % 3 == 0, "normal").when(F.month(day) % 2 == 0, F.concat(F.lit("theft_"), T.text(key % 4)))
            .when(F.dayofmonth(day) % 2 == 0, "bypass"))
    standard = units.building_standardize(T.unit_rows(s, d).withColumn("anomaly_type", kind))
    return units.unit_agg(units.unit_lag_flags(units.unit_daily_flags(standard))).select("unit_id", "anomaly_type")


@query
def bld_12(s, d):
    u = unit_features(s, d)
    return u.select("unit_id", units.unit_minmax(u, "estimated_loss_lek_30d").alias("scaled"))


@query
def unit_components(s, d):
    return units.unit_components(unit_features(s, d)).select(
        "unit_id", "consumption_deviation_score", "peer_deviation_score", "meter_behavior_score", "weather_context_score", "loss_impact_score")


@query
def unit_risk(s, d):
    return T.unit_scored(s, d).select("unit_id", "risk_score", "fraud_probability")


@query
def unit_level(s, d):
    o = T.table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("score"))
    return o.select("o_orderkey", C.unit_level(F.col("score")).alias("risk_level"))


@query
def top_driver(s, d):
    return T.unit_scored(s, d).select("unit_id", "main_reason", "recommended_action", "alert_explanation")


@query
def bld_17(s, d):
    return T.unit_scored(s, d).select("priority_rank", "unit_id", "risk_score", "risk_level")


@query
def building_scores(s, d):
    return units.building_scores(T.unit_scored(s, d)).drop("latitude", "longitude")


@query
def floor_scores(s, d):
    return units.floor_scores(T.unit_scored(s, d))


@query
def building_daily(s, d):
    return units.building_daily(T.unit_flagged(s, d))


@query
def building_metrics(s, d):
    scored = T.unit_scored(s, d)
    quality = units.ranking_quality(scored, "risk_score")  # the score stands in for a model's probability
    return units.building_metrics(T.unit_flagged(s, d), scored, units.building_scores(scored), quality)


@query
def city_exposure(s, d):
    return units.city_exposure(units.building_scores(T.unit_scored(s, d)))


@query
def bld_25(s, d):
    out = units.unit_explorer(T.unit_scored(s, d), places=["City"], levels=["Low", "Medium"], min_score=5)
    return out.select("priority_rank", "unit_id", "building_id", "risk_score", "risk_level")


# ---------------------------------------------------------------- operations
@query
def loss_economics(s, d):
    return ops.loss_economics(T.supplier_scores(s, d)[0])


@query
def top_loss_areas(s, d):
    return ops.top_loss_areas(T.supplier_scores(s, d)[1])


@query
def headline_kpis(s, d):
    customers, areas, _, _ = T.supplier_scores(s, d)
    return ops.headline_kpis(customers, areas)


@query
def risk_histogram(s, d):
    return ops.risk_histogram(T.supplier_scores(s, d)[0])


@query
def level_counts(s, d):
    return ops.level_counts(T.supplier_scores(s, d)[0])


@query
def top_areas(s, d):
    return ops.top_areas(T.supplier_scores(s, d)[1])


@query
def daily_trend(s, d):
    return ops.daily_trend(T.daily_table(s, d))


@query
def weather_trend(s, d):
    return ops.weather_trend(T.daily_table(s, d))


@query
def weather_kpis(s, d):
    customers, _, _, _, context = scored_forecast(s, d)
    return ops.weather_kpis(context, customers)


@query
def risk_register(s, d):
    out = ops.risk_register(T.supplier_scores(s, d)[0], min_score=30, query="1", levels=["Medium", "High", "Critical"])
    return out.select("customer_id", "risk_score", "risk_level", "area_id", "estimated_loss_all_30d", "main_reason")


@query
def customer_timeline(s, d):
    return ops.customer_timeline(T.daily_table(s, d), "7")


@query
def driver_breakdown(s, d):
    return ops.driver_breakdown(T.supplier_scores(s, d)[0])


@query
def indicators(s, d):
    return ops.indicators(T.supplier_scores(s, d)[0])


@query
def correlation(s, d):
    return ops.correlation(T.supplier_scores(s, d)[0])


def cases(s, d):
    return ops.create_cases(T.supplier_scores(s, d)[3], T.TEAMS)


@query
def create_cases(s, d):
    return cases(s, d)


@query
def dispatch(s, d):
    return ops.dispatch(cases(s, d), "Inspection Team 2", 5)


def live_cases(s, d):
    return ops.case_state(cases(s, d), T.case_events(s, d))


@query
def case_state(s, d):
    return live_cases(s, d).select("case_id", "customer_id", "status", "assigned_team", "inspection_result", "field_notes")


@query
def team_summary(s, d):
    return ops.team_summary(live_cases(s, d))


@query
def case_kpis(s, d):
    return ops.case_kpis(live_cases(s, d), ["New", "Assigned", "In Field"])


@query
def team_board(s, d):
    return ops.team_board(live_cases(s, d), "Inspection Team 2").select("case_id", "customer_id", "risk_score", "status")


@query
def board_kpis(s, d):
    return ops.board_kpis(ops.team_board(live_cases(s, d), "Inspection Team 2"))


@query
def team_scope(s, d):
    customers, areas, transformers, queue = T.supplier_scores(s, d)
    live = ops.case_state(ops.create_cases(queue, T.TEAMS), T.case_events(s, d))
    mine, my_areas, my_transformers = ops.team_scope(customers, areas, transformers, live, "Inspection Team 2")
    parts = [mine.select(F.lit("customer").alias("kind"), F.col("customer_id").alias("id")),
             my_areas.select(F.lit("area").alias("kind"), F.col("area_id").alias("id")),
             my_transformers.select(F.lit("transformer").alias("kind"), F.col("transformer_id").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def activity_feed(s, d):
    e = T.table(s, d, "events").select("event_id", F.col("ts").alias("time"), T.text("user_id").alias("actor"), F.col("event_type").alias("action"))
    return ops.activity_feed(e, 50).select("event_id", "actor", "action")


@query
def request_state(s, d):
    out = ops.request_state(T.request_events(s, d), "event_id")
    return out.select("request_id", "requested_by", "topic", "status", "answered_by", "response")


@query
def pending_requests(s, d):
    return ops.pending_requests(ops.request_state(T.request_events(s, d), "event_id"))


@query
def context_snapshot(s, d):
    customers, areas, _, queue, context = scored_forecast(s, d)
    loss = forecast.loss_forecast(stage(forecast.daily_events(context)), forecast.total_loss(customers))
    text = ops.context_snapshot(customers, areas, queue, ops.create_cases(queue, T.TEAMS), loss, forecast.area_forecast(areas))

    def at(path, kind):
        return F.get_json_object("context", f"$.{path}").cast(kind)

    return text.select(
        at("totals.customers_analyzed", "long").alias("customers"), at("totals.high_or_critical", "long").alias("high_or_critical"),
        at("totals.critical", "long").alias("critical"), at("totals.estimated_current_30d_loss_lek", "double").alias("loss"),
        at("top_20_customers_by_risk[0].customer_id", "string").alias("first_customer"),
        at("top_areas_by_risk[0].area_id", "string").alias("first_area"),
        F.json_array_length(at("top_15_inspection_priority", "string")).cast("long").alias("queue_rows"),
        at("forecast_30d_total_loss_lek", "double").alias("forecast"))


@query
def register_kpis(s, d):
    return ops.register_kpis(T.supplier_scores(s, d)[0])


@query
def top_lists(s, d):
    customers, areas, transformers, _ = T.supplier_scores(s, d)
    return ops.top_lists(customers, transformers, forecast.area_forecast(areas), forecast.customer_forecast(customers))
