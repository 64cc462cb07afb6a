"""Risk of customers, areas and transformers, estimated loss, and the inspection queue."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wattlens import constants as K
from wattlens.functions.columns import (at_most, clip100, col_or, is_high, num, num_or, ratio, risk_level, tariff)
from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

PRELIM_WEIGHTS = {"ai_combined_score": 0.32, "historical_deviation_score": 0.28, "peer_deviation_score": 0.18,
                  "sudden_flags_score": 0.14, "weather_context_score": 0.08}
FINAL_WEIGHTS = {"ai_combined_score": 0.26, "historical_deviation_score": 0.21, "peer_deviation_score": 0.16,
                 "geographic_risk_score": 0.13, "sudden_flags_score": 0.08, "weather_context_score": 0.08,
                 "payment_behavior_score": 0.08}
LOCATION_DEFAULTS = {"area_id": "UNKNOWN_AREA", "transformer_id": "UNKNOWN_TRANSFORMER"}


def weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in weights.items()])


def minmax_100(df: DataFrame, column: str, name: str) -> DataFrame:
    """Column stretched to 0-100 over the whole table; a constant column becomes 0."""
    return df.withColumn(name, stretched(df, column))


def stretched(df: DataFrame, column: str) -> Column:
    value = F.coalesce(num(F.col(column)), F.lit(0.0))
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = span["hi"] - span["lo"]
    return F.when(width < 1e-9, 0.0).otherwise((value - span["lo"]) / width * 100)


def component_scores(df: DataFrame) -> DataFrame:
    """The component scores 0-100 of a customer."""
    def share(name: str, factor: float = 1.0) -> Column:
        return at_most(num_or(df, name) * factor, 1)

    history = (55 * share("recent_drop_pct") + 20 * share("low_day_ratio", 3) + 15 * share("zero_day_ratio", 4)
               + 10 * share("flatline_ratio", 4))
    anomaly, fraud = num_or(df, "ai_anomaly_score"), num(col_or(df, "fraud_probability", None))
    return df.withColumns({
        "historical_deviation_score": clip100(history),
        "peer_deviation_score": clip100(100 * share("peer_deviation_pct")),
        "sudden_flags_score": clip100(num_or(df, "sudden_behavior_score")),
        "context_deviation_score": clip100(100 * share("expected_deviation_pct")),
        "weather_context_score": clip100(num_or(df, "weather_context_score")),
        "payment_behavior_score": clip100(num_or(df, "payment_risk_score")),
        "ai_combined_score": F.greatest(anomaly, fraud),  # a missing probability is skipped
    })


def prelim_risk(features: DataFrame) -> DataFrame:
    """Risk of a customer before its surroundings are known."""
    return component_scores(features).withColumn("preliminary_risk_score", clip100(weighted(PRELIM_WEIGHTS)))


def with_location(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(v) for c, v in LOCATION_DEFAULTS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def by_place(df: DataFrame, key: str, score: str, high: int, critical: int, extra: dict[str, Column]) -> DataFrame:
    """Counts, mean score and centre per area or transformer; unknown places are left out."""
    columns = {"customers": F.count("customer_id"), "high_risk_customers": F.count_if(F.col(score) >= high),
               "critical_customers": F.count_if(F.col(score) >= critical), "_mean": F.avg(score), **extra}
    for c in ("latitude", "longitude"):
        if c in df.columns:
            columns[c] = F.avg(num(F.col(c)))
    known = with_location(df).filter(F.col(key).isNotNull())
    places = known.groupBy(key).agg(*[e.alias(n) for n, e in columns.items()])
    return places.withColumn("_density", ratio(F.col("high_risk_customers"), F.col("customers")))


def concentrated(base: Column, factor: float) -> Column:
    """A cluster of risky customers stands out even when single scores are moderate."""
    return clip100(F.greatest(clip100(base), F.coalesce(F.col("_density"), F.lit(0.0)) * factor))


def area_risk_pre(prelim: DataFrame) -> DataFrame:
    """Area risk from preliminary customer risk: this one feeds the customers' final score."""
    places = by_place(prelim, "area_id", "preliminary_risk_score", K.PRELIM_HIGH, K.PRELIM_CRITICAL,
                      {"avg_ai_anomaly": F.avg(num_or(prelim, "ai_anomaly_score"))})
    base = 0.50 * F.col("_mean") + 0.40 * F.col("_density") * 100 + 0.10 * stretched(places, "critical_customers")
    return (places.withColumn("area_risk_score", concentrated(base, 250))
            .withColumn("area_risk_level", risk_level(F.col("area_risk_score")))
            .withColumnsRenamed({"_mean": "avg_preliminary_risk", "_density": "anomaly_density"}))


def transformer_risk(prelim: DataFrame) -> DataFrame:
    places = by_place(prelim, "transformer_id", "preliminary_risk_score", K.PRELIM_HIGH, K.PRELIM_CRITICAL, {})
    base = 0.60 * F.col("_mean") + 0.40 * F.col("_density") * 100
    return (places.withColumn("transformer_risk_score", concentrated(base, 230)).drop("critical_customers")
            .withColumnsRenamed({"_mean": "avg_preliminary_risk", "_density": "transformer_anomaly_density"}))


def geo_risk(prelim: DataFrame, areas: DataFrame, transformers: DataFrame) -> DataFrame:
    """Customers with the risk of their area and transformer."""
    df = with_location(prelim)
    df = lookup_join(df, areas.select("area_id", "area_risk_score", "anomaly_density"), ["area_id"],
                     spread=["customer_id"])
    df = lookup_join(df, transformers.select("transformer_id", "transformer_risk_score", "transformer_anomaly_density"),
                     ["transformer_id"], spread=["customer_id"])
    found = ["area_risk_score", "anomaly_density", "transformer_risk_score", "transformer_anomaly_density"]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in found})
    return df.withColumn("geographic_risk_score",
                         clip100(0.65 * F.col("area_risk_score") + 0.35 * F.col("transformer_risk_score")))


def final_risk(df: DataFrame) -> DataFrame:
    """Final score and level; a known fraud probability can only raise the score."""
    base = clip100(weighted(FINAL_WEIGHTS))
    fraud = num(col_or(df, "fraud_probability", None))
    score = F.when(fraud.isNotNull(), F.greatest(base, 0.65 * fraud + 0.35 * base)).otherwise(base)
    return df.withColumn("risk_score", clip100(score)).withColumn("risk_level", risk_level(F.col("risk_score")))


def estimated_loss(df: DataFrame) -> DataFrame:
    """Missing energy of 30 days and its value."""
    expected = "expected_last_30_consumption" if "expected_last_30_consumption" in df.columns else "previous_90_mean"
    shortfall = num(col_or(df, expected, 0.0)) - num(col_or(df, "last_30_mean", 0.0))
    missing = F.when(shortfall.isNotNull(), F.greatest(shortfall, F.lit(0.0))) * 30
    price = tariff(num(col_or(df, "last_30_mean", 0.0)), col_or(df, "customer_type", "residential"))
    return df.withColumn("estimated_missing_kwh_30d", missing).withColumn(
        "estimated_loss_all_30d", F.col("estimated_missing_kwh_30d") * price)


def area_risk(final: DataFrame) -> DataFrame:
    """Area risk for reporting, from final scores with its own weights."""
    places = by_place(final, "area_id", "risk_score", K.FINAL_HIGH, K.FINAL_CRITICAL,
                      {"avg_ai_anomaly": F.avg(num_or(final, "ai_anomaly_score")),
                       "estimated_loss_all_30d": F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0))})
    base = 0.50 * F.col("_mean") + 0.35 * F.col("_density") * 100 + 0.15 * stretched(places, "critical_customers")
    return (places.withColumn("area_risk_score", concentrated(base, 250))
            .withColumn("area_risk_level", risk_level(F.col("area_risk_score")))
            .withColumnsRenamed({"_mean": "avg_risk_score", "_density": "anomaly_density"}))


def inspection_priority(final: DataFrame, top_n: int = K.QUEUE_SIZE) -> DataFrame:
    """The first `top_n` customers to inspect, ranked by risk, value and surroundings."""
    from pyspark.sql import Window
    score = clip100(0.55 * F.col("risk_score") + 0.25 * stretched(final, "estimated_loss_all_30d")
                    + 0.20 * F.col("geographic_risk_score"))
    top = (final.withColumn("inspection_priority_score", score)
           .orderBy(F.desc("inspection_priority_score"), "customer_id").limit(top_n))
    order = Window.orderBy(F.desc("inspection_priority_score"), "customer_id")  # over top_n rows only
    ranked = top.withColumn("priority_rank", F.row_number().over(order))
    return ranked.select([c for c in K.PRIORITY_COLUMNS if c in ranked.columns])


def score_customers(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final customer scores and transformer scores.

    Features are read by the area step, the transformer step and the final join, so they should be a stored table.
    """
    prelim = prelim_risk(features)
    areas, transformers = area_risk_pre(prelim), transformer_risk(prelim)
    return estimated_loss(final_risk(geo_risk(prelim, areas, transformers))), transformers


def score_all(features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Customers with explanations, areas, transformers and the queue."""
    from wattlens.operators.explain import add_explanations
    scored, transformers = score_customers(features)
    customers = stage(add_explanations(scored), "customer_scores")
    return customers, area_risk(customers), transformers, inspection_priority(customers)


def daily_subset(customers: DataFrame, daily: DataFrame, limit: int = 500, least: int = 30) -> DataFrame:
    """Daily rows of at most 500 high-risk customers; the top 30 join in when there are fewer than 30."""
    order = [F.desc("risk_score"), "customer_id"]
    best = customers.select("customer_id", "risk_score").orderBy(*order)
    high = best.filter(F.col("risk_score") >= K.FINAL_HIGH).limit(limit)
    enough = high.agg(F.count("*")).scalar() >= least
    ids = high.unionByName(best.limit(least).filter(~enough)).select("customer_id").distinct()
    return daily.join(F.broadcast(ids), "customer_id", "left_semi")  # at most limit + least ids


def pipeline_summary(customers: DataFrame, areas: DataFrame, daily: DataFrame, loss_forecast: DataFrame,
                     area_forecast: DataFrame) -> DataFrame:
    """One row with the headline figures of a run."""
    people = customers.agg(
        F.count("customer_id").alias("customers_analyzed"),
        F.count_if(is_high(F.col("risk_level"))).alias("high_risk_customers"),
        F.count_if(F.col("risk_level") == "Critical").alias("critical_customers"),
        F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0)).alias("estimated_loss_all_30d"))
    with_weather = "temp_mean" in daily.columns
    readings = daily.agg(F.struct(
        F.count("*").alias("records_analyzed"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        (F.avg("temp_mean") if with_weather else F.lit(None).cast("double")).alias("avg_weather_temperature"),
        (F.count_if(F.col("weather_demand_pressure") == 1) if with_weather else F.lit(0).cast("long"))
        .alias("weather_extreme_days"))).scalar()
    places = areas.agg(F.struct(
        F.count_if(is_high(F.col("area_risk_level"))).alias("high_risk_areas"),
        F.max_by("area_id", F.struct("area_risk_score", "area_id")).alias("top_area"))).scalar()
    out = people.withColumns({n: readings[n] for n in ("records_analyzed", "date_min", "date_max",
                                                        "avg_weather_temperature", "weather_extreme_days")})
    out = out.withColumns({n: places[n] for n in ("high_risk_areas", "top_area")})
    return out.withColumns({
        "forecast_30d_loss_all": F.coalesce(loss_forecast.agg(F.sum("predicted_loss_all")).scalar(), F.lit(0.0)),
        "top_forecast_area": area_forecast.agg(F.min_by("area_id", "forecast_priority")).scalar(),
        "weather_context_enabled": F.lit(with_weather)})
