"""Customer features from the daily context: one aggregate per customer plus peers and scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens import constants as K
from wattlens.functions.columns import at_most, clip, col_or, num, num_or, ratio
from wattlens.operators.daily import customer, in_order
from wattlens.operators.enrich import attach_metadata
from wattlens.plans.joins import lookup_join
from wattlens.plans.selection import at_ranks, group_quantile
from wattlens.plans.staging import stage

STREAKS = {"longest_zero_streak": "zero_flag", "longest_low_streak": "low_relative_flag",
           "longest_weather_mismatch_streak": "weather_consumption_mismatch"}
META = ["customer_type", "area_id", "transformer_id", "latitude", "longitude", "city", "meter_age",
        "contract_power_kw", "fraud_label", "temp_mean", "weather_class", *K.PAYMENT_COLUMNS]


def positions(daily: DataFrame) -> DataFrame:
    """Row number from the start and from the end, new-day marker, and the current run length of each flag.

    A run is the distance to the last row without the flag, so all streaks need one running maximum each over
    the same window, and no grouping by island.
    """
    row = F.row_number().over(in_order())
    count = F.count("*").over(customer())
    # the median as a window value keeps the later aggregate inside generated code
    df = daily.withColumns({"_row": row, "_from_end": count - row + 1,
                            "_median": F.median("consumption_kwh").over(customer()),
                            "_new_day": F.coalesce(F.lag("date").over(in_order()) != F.col("date"), F.lit(True)).cast("int")})
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    runs = {}
    for name, source in STREAKS.items():
        if source in daily.columns:
            last_clear = F.max(F.when(F.coalesce(F.col(source), F.lit(0)) != 1, F.col("_row"))).over(so_far)
            runs[f"_run_{name}"] = F.col("_row") - F.coalesce(last_clear, F.lit(0))
    return df.withColumns(runs)


def longest_streaks(daily: DataFrame) -> DataFrame:
    """Longest run of consecutive flagged readings per customer."""
    placed = positions(daily)
    return placed.groupBy("customer_id").agg(*streak_columns(placed))


def streak_columns(placed: DataFrame) -> list[Column]:
    return [F.max(f"_run_{n}").alias(n) if f"_run_{n}" in placed.columns else F.lit(0).alias(n) for n in STREAKS]


def slope_column() -> Column:
    """Least-squares slope over the reading number; 0 for fewer than three or (nearly) constant readings."""
    kwh = F.col("consumption_kwh")
    first = F.min_by(kwh, F.col("_row"))
    tolerance = 1e-8 + 1e-5 * F.abs(first)
    constant = F.greatest(F.max(kwh) - first, first - F.min(kwh)) <= tolerance
    return F.when((F.count("*") < 3) | constant, 0.0).otherwise(F.regr_slope(kwh, F.col("_row").cast("double")))


def trend_slope(daily: DataFrame) -> DataFrame:
    return positions(daily).groupBy("customer_id").agg(slope_column().alias("consumption_trend_slope"))


def period_columns() -> dict[str, Column]:
    """Means of the last 30 readings, of the 90 before them and of the first 90."""
    kwh, end, row = F.col("consumption_kwh"), F.col("_from_end"), F.col("_row")
    return {
        "last_30_mean": F.avg(F.when(end <= 30, kwh)),
        "previous_90_mean": F.avg(F.when(end.between(31, 120), kwh)),
        "first_90_mean": F.avg(F.when(row <= 90, kwh)),
    }


def period_means(daily: DataFrame) -> DataFrame:
    return positions(daily).groupBy("customer_id").agg(*[e.alias(n) for n, e in period_columns().items()])


def base_columns() -> dict[str, Column]:
    kwh = F.col("consumption_kwh")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return {
        "total_consumption": F.coalesce(F.sum(kwh), F.lit(0.0)),
        "avg_consumption": F.avg(kwh),
        "median_consumption": F.max("_median"),
        "std_consumption": F.coalesce(F.stddev_samp(kwh), F.lit(0.0)),
        "max_consumption": F.max(kwh),
        "min_consumption": F.min(kwh),
        "days_observed": F.sum("_new_day"),
        "zero_days": total("zero_flag"),
        "low_days": total("low_relative_flag"),
        "sudden_drop_count": total("sudden_drop_flag"),
        "sudden_spike_count": total("sudden_spike_flag"),
        "flatline_days": total("flatline_flag"),
        "last_date": F.max("date"),
    }


def customer_aggregate(daily: DataFrame) -> DataFrame:
    return positions(daily).groupBy("customer_id").agg(*[e.alias(n) for n, e in base_columns().items()])


def weather_columns(daily: DataFrame) -> dict[str, Column]:
    means = {"avg_temp_mean": "temp_mean", "avg_heating_degree_days": "heating_degree_days",
             "avg_cooling_degree_days": "cooling_degree_days",
             "avg_weather_demand_pressure": "weather_demand_pressure"}
    sums = {"weather_mismatch_days": "weather_consumption_mismatch",
            "low_extreme_weather_days": "low_on_extreme_weather_flag",
            "high_normal_weather_days": "high_on_normal_weather_flag", "cold_days": "is_cold", "hot_days": "is_hot"}
    out = {n: F.avg(c) if c in daily.columns else F.lit(0.0) for n, c in means.items()}
    out.update({n: F.coalesce(F.sum(c), F.lit(0)).cast("long") if c in daily.columns else F.lit(0).cast("long")
                for n, c in sums.items()})
    return out


def weather_aggregate(daily: DataFrame) -> DataFrame:
    columns = {"days_observed": F.sum("_new_day"), **weather_columns(daily)}
    agg = positions(daily).groupBy("customer_id").agg(*[e.alias(n) for n, e in columns.items()])
    return agg.withColumns(weather_ratios())


def weather_ratios() -> dict[str, Column]:
    days = F.col("days_observed")
    return {
        "weather_mismatch_ratio": F.coalesce(ratio(F.col("weather_mismatch_days"), days), F.lit(0.0)),
        "extreme_weather_day_ratio": F.coalesce(ratio(F.col("cold_days") + F.col("hot_days"), days), F.lit(0.0)),
    }


def day_ratios() -> dict[str, Column]:
    days = F.col("days_observed")
    return {name: F.coalesce(ratio(F.col(count), days), F.lit(0.0)) for name, count in
            {"zero_day_ratio": "zero_days", "low_day_ratio": "low_days", "flatline_ratio": "flatline_days"}.items()}


def variation() -> Column:
    return F.coalesce(ratio(F.col("std_consumption"), F.col("avg_consumption")), F.lit(0.0))


def recent_change() -> dict[str, Column]:
    """Relative fall and rise of the last 30 readings against the 90 before (or the first 90)."""
    base, last = F.coalesce("previous_90_mean", "first_90_mean"), F.col("last_30_mean")

    def positive(value: Column) -> Column:
        return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))

    return {"recent_drop_pct": positive(ratio(base - last, base)),
            "recent_spike_pct": positive(ratio(last - base, base))}


def first_metadata(daily: DataFrame) -> list[Column]:
    """Attributes as they stand on the first reading of the customer."""
    return [F.min_by(c, "_row").alias(c) for c in META if c in daily.columns]


def customer_metadata(daily: DataFrame) -> DataFrame:
    placed = positions(daily)
    return placed.groupBy("customer_id").agg(*first_metadata(placed))


def aggregate_customers(daily: DataFrame) -> DataFrame:
    """Everything that depends on one customer's readings, in a single aggregate over the windows' partitioning."""
    placed = positions(daily)
    columns = {**base_columns(), **period_columns(), **weather_columns(daily),
               "consumption_trend_slope": slope_column()}
    agg = placed.groupBy("customer_id").agg(*[e.alias(n) for n, e in columns.items()],
                                            *streak_columns(placed), *first_metadata(daily))
    return agg.withColumns({"cv_consumption": variation(), **recent_change(), **day_ratios(), **weather_ratios()})


def payment_scores(df: DataFrame) -> DataFrame:
    """Share of bills paid on time and the payment risk; 0 where no billing data exists."""
    months = 12.0
    late = num_or(df, "payment_late_count_12m")
    status = F.lower(F.coalesce(col_or(df, "account_status", "active").cast("string"), F.lit("")))
    boost = F.when(status.contains("suspend"), 1.0).when(status.contains("review"), 0.5).otherwise(0.0)
    weighted = (0.30 * at_most(late / months, 1)
                + 0.22 * at_most(num_or(df, "unpaid_bills") / 6.0, 1)
                + 0.16 * at_most(num_or(df, "avg_payment_delay_days") / 60.0, 1)
                + 0.12 * at_most(num_or(df, "disconnections_12m") / 3.0, 1)
                + 0.10 * at_most(num_or(df, "arrears_amount_lek") / 100000.0, 1)
                + 0.10 * at_most(num_or(df, "months_since_last_payment") / 6.0, 1))
    return df.withColumns({"payment_on_time_ratio": clip((months - late) / months, 0, 1),
                           "payment_risk_score": clip(weighted * 100 + 12 * boost, 0, 100)})


def consumption_bands(features: DataFrame) -> DataFrame:
    """Quintile 1-5 by the mean of the first 90 readings; ties by customer id.

    Band b ends at rank 1 + b (n - 1) / 5, rounded down. Only the four customers at these ranks are looked for; the features
    are read a few times here, so they should be a stored table.
    """
    known = features.select("customer_id", "first_90_mean")
    ends = at_ranks(known, [], "first_90_mean", [b / 5 for b in range(1, 5)],
                    [(b - 1, 1 + F.floor(F.lit(b) * (F.col("n") - 1) / 5)) for b in range(1, 5)], "customer_id")
    cuts = ends.agg(F.sort_array(F.collect_list(F.struct("v", "tie"))).alias("cuts")).scalar()  # four rows
    own = F.struct(F.col("first_90_mean").alias("v"), F.col("customer_id").alias("tie"))
    band = sum(((cuts[i] < own).cast("int") for i in range(4)), F.lit(1))
    return features.withColumn("consumption_band", F.when(F.col("first_90_mean").isNotNull(), band).cast("int"))


PEERS = ["customer_type", "consumption_band"]


def peer_stats(features: DataFrame) -> DataFrame:
    """Means, median and size per customer type and consumption band."""
    known = features.filter(F.col("customer_type").isNotNull() & F.col("consumption_band").isNotNull())
    sums = known.groupBy(*PEERS).agg(F.avg("last_30_mean").alias("peer_avg_last_30"),
                                     F.avg("total_consumption").alias("peer_avg_total"),
                                     F.count("customer_id").alias("peer_count"))
    medians = group_quantile(known.select(*PEERS, "last_30_mean"), PEERS, "last_30_mean", 0.5, "peer_median_last_30")
    return sums.join(medians, PEERS, "left")


def peer_deviation(features: DataFrame) -> DataFrame:
    """Gap to the mean of the peers."""
    joined = lookup_join(features, peer_stats(features), PEERS, spread=["customer_id"])
    peer, own = F.col("peer_avg_last_30"), F.col("last_30_mean")
    gap = F.greatest(F.coalesce(ratio(peer - own, peer), F.lit(0.0)), F.lit(0.0))
    return joined.withColumns({"peer_deviation_pct": gap,
                               "customer_vs_peer_ratio": F.coalesce(ratio(own, peer), F.lit(1.0))})


def behavior_scores(df: DataFrame) -> DataFrame:
    """Rule-based suspicion from drops, zeros, lows and flat readings, and from the weather."""
    sudden = (0.35 * at_most(F.col("recent_drop_pct"), 1) + 0.20 * at_most(F.col("zero_day_ratio") * 4, 1)
              + 0.20 * at_most(F.col("low_day_ratio") * 3, 1) + 0.15 * at_most(F.col("flatline_ratio") * 4, 1)
              + 0.10 * at_most(F.col("sudden_drop_count") / 20, 1))
    weather = (0.55 * at_most(F.col("weather_mismatch_ratio") * 5, 1)
               + 0.25 * at_most(F.col("low_extreme_weather_days") / 12, 1)
               + 0.20 * at_most(F.col("longest_weather_mismatch_streak") / 10, 1))
    return df.withColumns({"sudden_behavior_score": sudden * 100, "weather_context_score": weather * 100})


def customer_features(daily: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """One row per customer with all features.

    Attributes come from the readings, or better from the customer dimension: joined here, they need not be
    carried through the windows on every reading.
    """
    if customers is None:
        df = aggregate_customers(daily)
    else:
        df = attach_metadata(aggregate_customers(daily.drop(*K.CUSTOMER_COLUMNS)), customers)
    df = payment_scores(df)
    if "customer_type" not in df.columns:
        df = df.withColumn("customer_type", F.lit("unknown"))
    if "fraud_label" in df.columns:
        df = df.withColumn("fraud_label", num(F.col("fraud_label")))
    return behavior_scores(peer_deviation(consumption_bands(stage(df, "customer_agg"))))
