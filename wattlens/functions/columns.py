"""Column helpers shared by the operators. All are plain expressions, so they stay inside codegen."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlens import constants as K


def num(value: Column) -> Column:
    """Number or NULL; infinities and NaN become NULL so that comparisons stay three-valued."""
    number = value.try_cast("double")
    usable = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(usable, number)


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column if the table has it, else a constant (optional inputs degrade to a default)."""
    return F.col(name) if name in df.columns else F.lit(default)


def num_or(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """Numeric column with a default for both a missing column and a missing value."""
    return F.coalesce(num(col_or(df, name, default)), F.lit(float(default)))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL on a zero or missing denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to a range and keep NULL (`greatest`/`least` alone would turn NULL into a bound)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def clip100(value: Column) -> Column:
    return clip(value, 0.0, 100.0)


def at_most(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(float(limit))))


def at_least(value: Column, limit: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(limit))))


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition does not fire."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def risk_level(score: Column) -> Column:
    """Low / Medium / High / Critical with right-closed edges."""
    low, medium, high = K.CUSTOMER_LEVEL_EDGES
    return (F.when(score <= low, "Low").when(score <= medium, "Medium")
            .when(score <= high, "High").when(score.isNotNull(), "Critical"))


def unit_level(score: Column) -> Column:
    """Level of units and buildings: own edges, left-closed."""
    medium, high, critical = K.UNIT_LEVEL_EDGES
    return (F.when(score >= critical, "Critical").when(score >= high, "High")
            .when(score >= medium, "Medium").otherwise("Low"))


def risk_color(score: Column) -> Column:
    expr = None
    for edge, name in K.COLOR_EDGES:
        expr = F.when(score >= edge, name) if expr is None else expr.when(score >= edge, name)
    return expr.otherwise("green")


def tariff(last_30_mean: Column, customer_type: Column) -> Column:
    """Price per kWh: the low band holds for residential customers up to the monthly limit."""
    low_volume = F.coalesce(last_30_mean, F.lit(0.0)) * 30 <= K.TARIFF_LIMIT_KWH
    residential = F.coalesce(F.lower(customer_type), F.lit("")).contains("resid")
    return F.when(residential & low_volume, K.TARIFF_LOW).otherwise(K.TARIFF_HIGH)


def weather_class(temp_mean: Column) -> Column:
    return F.when(temp_mean < K.COLD_BELOW, -1).when(temp_mean > K.HOT_ABOVE, 1).otherwise(0)


def is_high(level: Column) -> Column:
    return level.isin("High", "Critical")


def first_known(value: Column, order: Column) -> Column:
    """Aggregate: value of the earliest row that has one (plain min_by would return its NULL)."""
    return F.min_by(value, F.when(value.isNotNull(), order))
