"""Daily context: calendar, rolling baselines and flags of each reading.

Input: cleaned readings, one row per customer and day. All windows share the partitioning by customer, so the
whole step costs one shuffle, and a partition of the window is bounded by the calendar.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattlens import constants as K
from wattlens.functions.columns import flag, num_or, ratio


def customer():
    return Window.partitionBy("customer_id")


def in_order():
    return customer().orderBy("date")


def calendar(df: DataFrame) -> DataFrame:
    month = F.month("date")
    season = (F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
              .when(month.isin(6, 7, 8), "summer").otherwise("autumn"))
    return df.withColumns({"month": month, "day_of_week": F.weekday("date"), "season": season})


def last_rows(n: int):
    return in_order().rowsBetween(-(n - 1), 0)


def rolling(df: DataFrame) -> DataFrame:
    """Means of the last 7 and 30 readings, their spread, and the 30-reading mean seven readings ago."""
    kwh = "consumption_kwh"

    def over(aggregate, n: int, at_least_n: int):
        return F.when(F.count(kwh).over(last_rows(n)) >= at_least_n, aggregate.over(last_rows(n)))

    df = df.withColumns({
        "rolling_7d_mean": over(F.avg(kwh), 7, 2),
        "rolling_30d_mean": over(F.avg(kwh), 30, 7),
        "rolling_30d_std": over(F.stddev_samp(kwh), 30, 7),
        "_median": F.median(kwh).over(customer()),
    })
    return df.withColumn("previous_30d_mean", F.lag("rolling_30d_mean", 7).over(in_order()))


def consumption_flags(df: DataFrame) -> DataFrame:
    """Drop, spike, zero, low and flat readings. A zero or missing baseline never fires."""
    kwh, base = F.col("consumption_kwh"), F.col("previous_30d_mean")
    drop, spike = ratio(base - kwh, base), ratio(kwh - base, base)
    own = F.nullif(F.col("_median"), F.lit(0.0))
    flat = (F.coalesce("rolling_30d_std", F.lit(999.0)) < K.FLAT_STD) & (F.coalesce("rolling_30d_mean", F.lit(0.0)) > 0)
    return df.withColumns({
        "drop_vs_previous_30d_pct": drop,
        "spike_vs_previous_30d_pct": spike,
        "sudden_drop_flag": flag(drop > K.DROP_SHARE),
        "sudden_spike_flag": flag(spike > K.SPIKE_SHARE),
        "zero_flag": flag(kwh <= K.ZERO_KWH),
        "low_relative_flag": flag(kwh < own * K.LOW_SHARE),
        "flatline_flag": flag(flat),
    })


def weather_flags(df: DataFrame) -> DataFrame:
    """Readings that do not fit the weather; constants when the readings carry no weather."""
    if "temp_mean" not in df.columns:
        zeros = ["weather_demand_pressure", "weather_class", "is_cold", "is_hot", "low_on_extreme_weather_flag",
                 "high_on_normal_weather_flag", "weather_consumption_mismatch"]
        doubles = ["temperature_abs_deviation", "heating_degree_days", "cooling_degree_days"]
        return df.withColumns({**{c: F.lit(0) for c in zeros}, **{c: F.lit(0.0) for c in doubles}})
    kwh, own = F.col("consumption_kwh"), F.nullif(F.col("_median"), F.lit(0.0))
    pressure = num_or(df, "weather_demand_pressure")
    low = flag((pressure == 1) & (kwh < own * K.COLD_HOT_LOW_SHARE))
    high = flag((pressure == 0) & (kwh > own * K.NORMAL_HIGH_SHARE)
                & (F.coalesce("previous_30d_mean", F.lit(0.0)) > 0))
    return df.withColumns({
        "heating_degree_days": num_or(df, "heating_degree_days"),
        "cooling_degree_days": num_or(df, "cooling_degree_days"),
        "weather_demand_pressure": pressure,
        "weather_class": num_or(df, "weather_class").cast("int"),
        "temperature_abs_deviation": F.abs(num_or(df, "temp_mean", 18.0) - 18.0),
        "weather_expected_high_usage": (pressure == 1).cast("int"),
        "low_on_extreme_weather_flag": low,
        "high_on_normal_weather_flag": high,
        "weather_consumption_mismatch": F.greatest(low, high),
    })


def daily_context(readings: DataFrame) -> DataFrame:
    """Readings with calendar, rolling baselines and all flags."""
    return weather_flags(consumption_flags(rolling(calendar(readings)))).drop("_median")
