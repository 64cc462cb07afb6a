"""Customer attributes and weather joined to the readings."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattlens import constants as K
from wattlens.functions.columns import first_known, num, weather_class
from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

DEFAULT_METADATA = {"customer_type": "residential", "city": K.DEFAULT_CITY}


def attach_metadata(readings: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join of the customer dimension; values already on the readings win.

    Both sides are keyed by customer and readings hold one row per customer and day, so the join reuses the
    partitioning of the per-customer windows.
    """
    shared = [c for c in customers.columns if c in readings.columns and c != "customer_id"]
    dim = customers.withColumnsRenamed({c: f"_dim_{c}" for c in shared})
    out = readings.join(dim, "customer_id", "left")
    for c in shared:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_dim_{c}"))).drop(f"_dim_{c}")
    return out


def default_metadata(df: DataFrame) -> DataFrame:
    """Customer attributes the scoring needs, with constant defaults where the upload has none; coordinates stay unknown."""
    df = df.withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude") if c not in df.columns})
    for name, value in DEFAULT_METADATA.items():
        known = F.col(name) if name in df.columns else F.lit(None).cast("string")
        df = df.withColumn(name, F.coalesce(known, F.lit(value)))
    return df


def text_columns(df: DataFrame, keys: list[str]) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in keys]


def first_attributes(df: DataFrame, key: str, columns: list[str], order: str = "date") -> DataFrame:
    """One row per key with the earliest known value of every column.

    Equal combinations collapse before the shuffle, and only those few rows per key are compared. Taking the
    first text directly would sort all readings: Spark has no hash aggregation with text results.
    """
    combinations = df.groupBy(key, *columns).agg(F.min(order).alias("_first"))
    return combinations.groupBy(key).agg(*[first_known(F.col(c), F.col("_first")).alias(c) for c in columns])


def split_customers(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings without attributes, customer dimension with the earliest known attributes).

    A creation date (`_created`) becomes the meter's age on the customer's earliest reading: it is equal on all readings of
    a customer, where the age itself would make every one of them different.
    """
    if "_created" in readings.columns:
        rest, customers = split_customers(readings.withColumnRenamed("_created", "_made"))
        made = readings.groupBy("customer_id").agg(F.min("_created").alias("_made"), F.min("date").alias("_from"))
        age = F.greatest(F.datediff("_from", "_made") / 365.25, F.lit(0.0))
        return rest.drop("_made"), customers.join(made, "customer_id", "left").withColumn(
            "meter_age", F.when(age.isNotNull(), age)).drop("_made", "_from")
    present = [c for c in K.CUSTOMER_COLUMNS if c in readings.columns]
    if not present:
        return readings, readings.select("customer_id").distinct()
    return readings.drop(*present), first_attributes(readings, "customer_id", present)


def temperature_context(temp: Column) -> dict[str, Column]:
    """Degree days, class and pressure that follow from the mean temperature."""
    kind = weather_class(temp)
    return {
        "heating_degree_days": F.greatest(F.lit(K.HEATING_BASE) - temp, F.lit(0.0)),
        "cooling_degree_days": F.greatest(temp - K.COOLING_BASE, F.lit(0.0)),
        "weather_class": kind,
        "is_cold": (kind == -1).cast("int"),
        "is_hot": (kind == 1).cast("int"),
        "weather_demand_pressure": F.abs(kind),
    }


def with_temperature_context(df: DataFrame, temp: str = "temp_mean") -> DataFrame:
    return df.withColumns(temperature_context(F.col(temp)))


def seasonal_temperature(base: Column, amplitude: Column, date: Column) -> Column:
    """Normal temperature of the day: yearly cosine with its peak in July."""
    return base + amplitude * F.cos(F.lit(2 * math.pi) * (F.dayofyear(date) - 200) / 365.25)


def city_climate(city: Column) -> tuple[Column, Column, Column, Column]:
    """Mean, amplitude, longitude and latitude of a city; unknown cities get the default city's values."""
    def pick(i: int) -> Column:
        table = F.create_map(*[F.lit(x) for name, v in K.CITY_CLIMATE.items() for x in (name, v[i])])
        return F.coalesce(F.try_element_at(table, city), F.lit(K.CITY_CLIMATE[K.DEFAULT_CITY][i]))
    return pick(0), pick(1), pick(2), pick(3)


def climatology(cities: DataFrame, start, end) -> DataFrame:
    """Seasonal normal weather for every city and every day from `start` to `end` (columns or dates)."""
    days = F.explode(F.sequence(start, end))
    spine = cities.select("city", days.alias("date"))
    mean, amplitude, lon, lat = city_climate(F.col("city"))
    temp = F.round(seasonal_temperature(mean, amplitude, F.col("date")), 2)
    out = spine.select("date", "city", lat.alias("latitude"), lon.alias("longitude"), temp.alias("temp_mean"))
    return with_temperature_context(out)


def extend_weather(weather: DataFrame | None, readings: DataFrame) -> DataFrame:
    """Weather that covers all cities and days of the readings, one row per day and city; the first delivered row
    wins, delivered rows win over seasonal normals."""
    span = readings.agg(F.struct(F.min("date").alias("a"), F.max("date").alias("b"))).scalar()
    cities = readings.select("city").filter(F.col("city").isNotNull()).distinct()
    normal = climatology(cities, span["a"], span["b"])
    if weather is None:
        return normal
    weather = first_per_day(weather)
    missing = normal.join(weather.select("date", "city"), ["date", "city"], "left_anti")
    return weather.unionByName(missing, allowMissingColumns=True)


def first_per_day(weather: DataFrame, order: str = "_order") -> DataFrame:
    """One weather row per day and city: the first by the `order` column if there is one, else the smallest."""
    values = [c for c in weather.columns if c not in ("date", "city", order)]
    row = F.struct(*values)
    first = F.min_by(row, F.col(order)) if order in weather.columns else F.min(row)
    return weather.groupBy("date", "city").agg(first.alias("w")).select("date", "city", "w.*")


def attach_weather(readings: DataFrame, weather: DataFrame, default_city: str = K.DEFAULT_CITY) -> DataFrame:
    """Weather by day and city, else of the default city on that day, else constants."""
    city = F.col("city") if "city" in readings.columns else F.lit(None).cast("string")
    readings = readings.withColumn("city", F.coalesce(city, F.lit(default_city)))
    renamed = weather.withColumnsRenamed({"latitude": "weather_latitude", "longitude": "weather_longitude"})
    values = [c for c in renamed.columns if c not in ("date", "city") and c not in readings.columns]
    order = [c for c in ("_order",) if c in weather.columns]
    values = [c for c in values if c not in order]
    own = stage(first_per_day(renamed.select("date", "city", *order, *values)), "weather")
    usual = own.filter(F.col("city") == default_city).select("date", *[F.col(c).alias(f"_fb_{c}") for c in values])
    # one city can hold a large share of all readings: beyond the broadcast size the join spreads a key over salts
    out = lookup_join(readings, own, ["date", "city"], spread=["customer_id"], stored=True)
    out = lookup_join(out, usual, ["date"], spread=["customer_id"])  # one row per day; the readings need not be asked for their cities
    filled = {}
    for c in values:
        value = F.coalesce(c, f"_fb_{c}")
        default = K.WEATHER_DEFAULTS.get(c)
        filled[c] = value if default is None else F.coalesce(num(value), F.lit(default)).cast(
            "double" if isinstance(default, float) else "int")
    return out.withColumns(filled).drop(*[f"_fb_{c}" for c in values])
