"""Thirty-day planning forecast of events and loss, and forecast rankings.

Series are forecast in long form, any number at once. A series has one value per day, so its windows and
quantiles are bounded by the calendar.
"""
from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens import constants as K
from wattlens.functions.columns import clip, clip100, num, num_or
from wattlens.plans.ordering import global_rank

EVENTS = {"zero_events": "zero_flag", "sudden_drop_events": "sudden_drop_flag", "flatline_events": "flatline_flag",
          "weather_mismatch_events": "weather_consumption_mismatch"}
PRESSURE = {"zero_events": 0.95, "sudden_drop_events": 0.80, "flatline_events": 0.35, "weather_mismatch_events": 0.25}
RECENT, LEVEL_ROWS = 56, 14


def daily_events(daily: DataFrame) -> DataFrame:
    """Mean reading and number of flagged readings per day."""
    sums = [F.coalesce(F.sum(num_or(daily, c)), F.lit(0.0)).alias(n) for n, c in EVENTS.items()]
    return daily.filter(F.col("date").isNotNull()).groupBy("date").agg(
        F.avg(num_or(daily, "consumption_kwh")).alias("average_consumption"), *sums)


def with_recency(series: DataFrame) -> DataFrame:
    """Row number from the newest day of each series."""
    newest_first = Window.partitionBy("series").orderBy(F.desc("date"))
    value = F.coalesce(num(F.col("value")), F.lit(0.0))
    return (series.filter(F.col("date").isNotNull())
            .select("series", "date", value.alias("value"), F.row_number().over(newest_first).alias("_age")))


def forecast_levels(series: DataFrame) -> DataFrame:
    """Recent level, capped daily trend and the range a forecast may take, per series."""
    return levels_of(with_recency(series))


def levels_of(aged: DataFrame) -> DataFrame:
    value, age = F.col("value"), F.col("_age")
    recent = F.when(age <= RECENT, value)
    base = aged.groupBy("series").agg(
        F.count("*").alias("n"), F.max("date").alias("last_date"), F.median(value).alias("median_all"),
        F.stddev_pop(value).alias("spread"),
        F.median(F.when(age <= LEVEL_ROWS, value)).alias("level"),
        F.median(F.when(age.between(LEVEL_ROWS + 1, 2 * LEVEL_ROWS), value)).alias("_previous"),
        F.percentile(recent, F.lit(0.05)).alias("q05"), F.percentile(recent, F.lit(0.95)).alias("q95"))
    limit = 0.08 * F.greatest(F.col("level"), F.lit(1.0))
    slope = (F.col("level") - F.coalesce("_previous", "level")) / 14.0
    return base.select(
        "series", "n", "last_date", "median_all", "spread", "level",
        F.least(F.greatest(slope, -limit), limit).alias("trend"),
        F.greatest(F.lit(0.0), F.col("q05") * 0.45).alias("low"),
        F.greatest(F.col("q95") * 1.55, F.col("level") * 1.8, F.lit(1.0)).alias("high"))


def weekly_forecast(series: DataFrame, horizon: int = 30) -> DataFrame:
    """Blend of same-weekday history, recent level and short trend for each of the next days.

    Short (under ten days) or flat series repeat their median.
    """
    aged = with_recency(series)
    weekday = (aged.filter(F.col("_age") <= RECENT).groupBy("series", F.weekday("date").alias("_weekday"))
               .agg(F.median("value").alias("_seasonal")))
    steps = levels_of(aged).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("date", F.date_add("last_date", F.col("step")))
    joined = steps.withColumn("_weekday", F.weekday("date")).join(weekday, ["series", "_weekday"], "left")
    level = F.col("level")
    blend = 0.56 * F.coalesce("_seasonal", "level") + 0.34 * level + 0.10 * (level + F.col("trend") * F.col("step"))
    bounded = F.least(F.greatest(blend, F.col("low")), F.col("high"))
    flat = (F.col("n") < 10) | (F.col("spread") < 1e-9)
    return joined.select("series", "step", "date", F.when(flat, F.col("median_all")).otherwise(bounded).alias("forecast"))


def pressure_column() -> Column:
    return sum((F.col(c) * w for c, w in PRESSURE.items()), F.lit(0.0))


def loss_history(events: DataFrame, current_loss: Column) -> DataFrame:
    """Event pressure per day and its value, anchored so that the last 30 days carry the current loss."""
    newest_first = Window.orderBy(F.desc("date"))  # one row per calendar day
    aged = events.select("date", pressure_column().alias("event_pressure")).withColumn(
        "_age", F.row_number().over(newest_first))
    recent = aged.agg(F.sum(F.when(F.col("_age") <= 30, F.col("event_pressure")))).scalar()
    usable = (recent > 1e-9) & (current_loss > 0)
    return aged.select("date", "_age", "event_pressure",
                       F.when(usable, F.col("event_pressure") * current_loss / recent).alias("daily_loss"))


def loss_forecast(events: DataFrame, current_loss: Column, horizon: int = 30) -> DataFrame:
    """Loss and events of the next days with running total and planning range."""
    history = loss_history(events, current_loss)
    counts = events.select("date", F.explode(F.create_map(*[
        x for c in ("average_consumption", *EVENTS) for x in (F.lit(c), F.col(c))])).alias("series", "value"))
    money = history.select("date", F.lit("money").alias("series"), F.coalesce("daily_loss", F.lit(0.0)).alias("value"))
    columns = ["series", "date", "value"]
    predicted = weekly_forecast(counts.select(columns).unionByName(money.select(columns)), horizon)
    names = ["average_consumption", *EVENTS, "money"]
    wide = predicted.groupBy("step", "date").agg(
        *[F.max(F.when(F.col("series") == n, F.col("forecast"))).alias(n) for n in names])
    base = current_loss / max(horizon, 1)
    facts = history.agg(F.struct(
        F.count("daily_loss").alias("days"), F.coalesce(F.sum("daily_loss"), F.lit(0.0)).alias("total"),
        F.percentile("daily_loss", F.lit(0.98)).alias("top"),
        F.median(F.when(F.col("_age") <= 30, F.col("event_pressure"))).alias("usual"))).scalar()
    by_money = (facts["days"] >= 10) & (facts["total"] > 0)
    from_money = 0.78 * F.col("money") + 0.22 * base
    factor = clip(pressure_column() / F.greatest(facts["usual"], F.lit(1.0)), 0.35, 2.25)
    shape = 1.0 + 0.05 * F.sin(F.lit(2 * math.pi) * (F.col("step") - 1) / 7.0)
    from_pressure = base * (0.72 + 0.28 * factor) * shape
    rows = wide.withColumn("_loss", F.when(by_money, from_money).otherwise(from_pressure))
    whole = Window.partitionBy()  # `horizon` rows
    money_cap = F.greatest(facts["top"], base * 2.5, F.lit(1.0))
    pressure_cap = F.greatest(base * 2.0, F.max("_loss").over(whole), F.lit(1.0))
    cap = F.when(by_money, money_cap).otherwise(pressure_cap)
    return finish(rows.withColumn("_loss", F.least(F.greatest(F.col("_loss"), F.lit(0.0)), cap)))


def finish(rows: DataFrame) -> DataFrame:
    """Forecast table from the raw predictions of `horizon` rows."""
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    loss, events = F.col("_loss"), sum((F.col(c) for c in EVENTS), F.lit(0.0))
    return rows.select(
        "date", F.round("average_consumption", 3).alias("predicted_average_consumption"),
        F.round("sudden_drop_events", 2).alias("predicted_sudden_drop_events"),
        F.round("zero_events", 2).alias("predicted_zero_consumption_events"),
        F.round("flatline_events", 2).alias("predicted_flatline_events"),
        F.round("weather_mismatch_events", 2).alias("predicted_weather_mismatch_events"),
        F.round(events, 2).alias("predicted_total_events"),
        F.round(loss, 2).alias("predicted_loss_all"),
        F.round(F.sum("_loss").over(so_far), 2).alias("cumulative_predicted_loss"),
        F.round(loss * 0.82, 2).alias("forecast_lower_loss"),
        F.round(loss * 1.18, 2).alias("forecast_upper_loss"),
        F.lit(K.PLANNING_NOTE).alias("planning_note"))


def loss_forecast_without_history(customers: DataFrame, today: dt.date, horizon: int = 30) -> DataFrame:
    """Constant forecast from the customer table when there is no daily history."""
    per_day = max(horizon, 1)
    totals = customers.agg(
        F.coalesce(F.avg(num_or(customers, "avg_consumption")), F.lit(0.0)).alias("average_consumption"),
        F.coalesce(F.sum(num_or(customers, "sudden_drop_count")) / per_day, F.lit(0.0)).alias("sudden_drop_events"),
        F.coalesce(F.sum(num_or(customers, "zero_days")) / per_day, F.lit(0.0)).alias("zero_events"),
        F.coalesce(F.sum(num_or(customers, "flatline_days")) / per_day, F.lit(0.0)).alias("flatline_events"),
        F.lit(0.0).alias("weather_mismatch_events"),
        F.coalesce(F.sum(num_or(customers, "estimated_loss_all_30d")) / per_day, F.lit(0.0)).alias("_base"))
    steps = totals.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    usual = F.greatest(F.col("sudden_drop_events") + F.col("zero_events") + F.col("flatline_events"), F.lit(1.0))
    factor = clip(pressure_column() / usual, 0.35, 2.25)
    shape = 1.0 + 0.05 * F.sin(F.lit(2 * math.pi) * (F.col("step") - 1) / 7.0)
    loss = F.col("_base") * (0.72 + 0.28 * factor) * shape
    rows = steps.withColumns({"date": F.date_add(F.lit(today), F.col("step")), "_raw": loss})
    cap = F.greatest(F.col("_base") * 2.0, F.max("_raw").over(Window.partitionBy()), F.lit(1.0))
    return finish(rows.withColumn("_loss", F.least(F.greatest(F.col("_raw"), F.lit(0.0)), cap)))


def against_max(df: DataFrame, name: str) -> Column:
    """Value relative to the column's maximum (at least 1), in percent."""
    value = num_or(df, name)
    return value / F.greatest(df.agg(F.max(value)).scalar(), F.lit(1.0)) * 100


def area_forecast(areas: DataFrame) -> DataFrame:
    """Areas ranked by the risk expected for the next 30 days."""
    score = (0.54 * num_or(areas, "area_risk_score") + 24 * clip(num_or(areas, "anomaly_density"), 0, 1)
             + 0.12 * against_max(areas, "high_risk_customers") + 0.07 * against_max(areas, "critical_customers")
             + 0.03 * against_max(areas, "estimated_loss_all_30d"))
    scored = areas.withColumn("forecasted_area_risk_next_30d", F.round(clip100(score), 2))
    return global_rank(scored, [F.desc("forecasted_area_risk_next_30d"), "area_id"], "forecast_priority")


def customer_forecast(customers: DataFrame) -> DataFrame:
    """Customers ranked by the risk expected for the next 30 days."""
    def unit(name: str) -> Column:
        return clip(num_or(customers, name), 0, 1) * 100

    trend = (0.24 * unit("recent_drop_pct") + 0.20 * unit("zero_day_ratio") + 0.16 * unit("flatline_ratio")
             + 0.16 * against_max(customers, "sudden_drop_count") + 0.12 * unit("weather_mismatch_ratio")
             + 0.12 * clip100(num_or(customers, "payment_risk_score")))
    value = against_max(customers, "estimated_loss_all_30d")
    score = F.round(clip100(0.68 * num_or(customers, "risk_score") + 0.24 * trend + 0.08 * value), 2)
    keep = ["customer_id", "risk_score", "forecasted_customer_risk_next_30d", "risk_level", "area_id", "transformer_id",
            "estimated_loss_all_30d", "main_reason", "recommended_action"]
    scored = customers.withColumn("forecasted_customer_risk_next_30d", score)
    slim = scored.select([c for c in keep if c in scored.columns])
    return global_rank(slim, [F.desc("forecasted_customer_risk_next_30d"), "customer_id"], "forecast_priority")


def total_loss(customers: DataFrame) -> Column:
    """Scalar: current 30-day loss of all customers."""
    return customers.agg(F.coalesce(F.sum(num_or(customers, "estimated_loss_all_30d")), F.lit(0.0))).scalar()


def generate_forecasts(customers: DataFrame, areas: DataFrame, daily: DataFrame, horizon: int = 30
                       ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loss, area and customer forecast. `daily` is the full daily table, not the drill-down subset."""
    from wattlens.plans.staging import stage
    events = stage(daily_events(daily), "daily_events")
    return loss_forecast(events, total_loss(customers), horizon), area_forecast(areas), customer_forecast(customers)


def forecast_kpis(loss: DataFrame, current_loss: Column, areas: DataFrame) -> DataFrame:
    """Total, change against the last 30 days, peak day, direction and the leading area."""
    value = F.coalesce(num(F.col("predicted_loss_all")), F.lit(0.0))
    peak = F.min_by("date", F.struct(-value, F.col("date")))
    row = loss.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("projected_loss"), peak.alias("peak_day"))
    delta = F.when(current_loss > 0, (F.col("projected_loss") - current_loss) / current_loss * 100).otherwise(0.0)
    row = row.withColumn("last_30d_loss", current_loss).withColumn("delta_pct", delta)
    direction = F.when(F.col("delta_pct") > 4, "rise").when(F.col("delta_pct") < -4, "fall").otherwise("stay about flat")
    return row.withColumns({"direction": direction,
                            "top_forecast_area": areas.agg(F.min_by("area_id", "forecast_priority")).scalar()})
