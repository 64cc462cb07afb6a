"""Coordinates, map layers and the inspection route."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlens import constants as K
from wattlens.functions.columns import col_or, num, risk_color


def on_map() -> Column:
    """Inside the map envelope and not in the sea strip to the west."""
    lat, lon = num(F.col("latitude")), num(F.col("longitude"))
    sea = (lon < K.SEA_WEST_OF) & lat.between(*K.SEA_LATITUDE)
    return F.coalesce(lat.between(*K.MAP_LATITUDE) & lon.between(*K.MAP_LONGITUDE) & ~sea, F.lit(False))


def on_building_map() -> Column:
    lat, lon = num(F.col("latitude")), num(F.col("longitude"))
    return F.coalesce(lat.between(*K.BUILDING_LATITUDE) & lon.between(*K.BUILDING_LONGITUDE), F.lit(False))


def valid_geo(df: DataFrame) -> DataFrame:
    if not {"latitude", "longitude"} <= set(df.columns):
        return df
    return df.filter(on_map()).withColumns({c: num(F.col(c)) for c in ("latitude", "longitude")})


def off_map_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(~on_map()).alias("off_map"))


def map_center(df: DataFrame) -> DataFrame:
    """Median position of the valid points."""
    from wattlens.plans.selection import group_quantile
    points = valid_geo(df)
    lat = group_quantile(points, [], "latitude", 0.5, "latitude").scalar()
    lon = group_quantile(points, [], "longitude", 0.5, "longitude")
    return lon.select(lat.alias("latitude"), "longitude")


def heat_weights(df: DataFrame, column: str, valid: bool = True) -> DataFrame:
    """Point weights relative to the largest (at least 1)."""
    points = valid_geo(df) if valid else df
    points = points.filter(F.col(column).isNotNull())
    value = F.coalesce(num(F.col(column)), F.lit(0.0))
    top = F.greatest(points.agg(F.max(value)).scalar(), F.lit(1.0))
    return points.select("latitude", "longitude", (value / top).alias("weight"))


def top_points(df: DataFrame, n: int, id_column: str, building: bool = False) -> DataFrame:
    """The n riskiest points on the map."""
    points = df.filter(on_building_map()) if building else valid_geo(df)
    return points.orderBy(F.desc("risk_score"), id_column).limit(n)


def feature(point: dict[str, Column]) -> Column:
    """GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    properties = F.struct(*[e.alias(n) for n, e in point.items()])
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              properties.alias("properties")), {"ignoreNullFields": "false"})


def customer_geojson(customers: DataFrame, min_risk: float = 0) -> DataFrame:
    """One feature per customer on the map with at least the given risk."""
    df = valid_geo(customers).filter(F.col("risk_score") >= min_risk)
    properties = {"customer_id": F.col("customer_id"), "risk_score": F.round("risk_score", 2),
                  **{c: col_or(df, c, None).cast("string") for c in
                     ("risk_level", "area_id", "transformer_id", "main_reason", "recommended_action")},
                  "color": risk_color(F.col("risk_score"))}
    return df.select("customer_id", feature(properties).alias("feature"))


def area_geojson(areas: DataFrame) -> DataFrame:
    df = valid_geo(areas)
    properties = {"area_id": F.col("area_id"), "area_risk_score": F.round("area_risk_score", 2),
                  "area_risk_level": F.col("area_risk_level"), "customers": F.col("customers"),
                  "high_risk_customers": F.col("high_risk_customers"), "critical_customers": F.col("critical_customers"),
                  "anomaly_density": F.round("anomaly_density", 3), "color": risk_color(F.col("area_risk_score"))}
    return df.select("area_id", feature(properties).alias("feature"))


def inspection_route(priority: DataFrame, max_points: int = 25) -> DataFrame:
    """One line through the first valid points of the queue; no row for fewer than two points."""
    stops = valid_geo(priority).orderBy("priority_rank").limit(max_points)
    line = stops.agg(F.sort_array(F.collect_list(F.struct("priority_rank", "longitude", "latitude"))).alias("stops"))
    coordinates = F.transform("stops", lambda s: F.array(s["longitude"], s["latitude"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    properties = F.struct(F.lit("Suggested inspection route").alias("name"), F.size("stops").alias("points"))
    return line.filter(F.size("stops") >= 2).select(
        F.size("stops").alias("points"),
        F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                           properties.alias("properties"))).alias("feature"))
