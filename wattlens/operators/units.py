"""Units, floors and buildings: a second scoring model on expected consumption per reading."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens import constants as K
from wattlens.functions.columns import (at_least, clip, clip100, first_known, flag, is_high, num, num_or, ratio,
                                        unit_level)
from wattlens.operators import metrics, models
from wattlens.operators.clean import coerce_numeric, parse_date
from wattlens.operators.enrich import (city_climate, first_attributes, seasonal_temperature, temperature_context,
                                        text_columns)
from wattlens.plans.clustered import dealt, enough_partitions
from wattlens.plans.joins import lookup_join
from wattlens.plans.ordering import global_rank
from wattlens.plans.selection import exact_quantile, group_quantile
from wattlens.plans.staging import stage
from wattlens.sources.detect import find_unit_header

REQUIRED = ["date", "building_id", "unit_id", "consumption_kwh"]
NUMBERS = ["floor", "area_sqm", "household_size", "latitude", "longitude", "fraud_label", "expected_kwh"]
DEFAULTS = {"city": K.DEFAULT_CITY, "location_type": "City", "floor": 0.0, "area_sqm": 75.0, "household_size": 2.5,
            "building_type": "Residential", "unit_type": "Apartment", "meter_type": "Unknown",
            "connection_type": "Individual Meter", "building_age": 20.0, "contracted_power_kw": 5.5}
ATTRIBUTES = ["building_id", "city", "location_type", "building_type", "unit_type", "meter_type", "connection_type",
              "transformer_id", "floor", "floors", "area_sqm", "household_size", "contracted_power_kw", "latitude",
              "longitude"]
PEER_LEVELS = [["city", "location_type", "unit_type"], ["location_type", "unit_type"]]
UNIT_DEPTH = 8  # of the unit classifier's trees, as the definition has it
DRIVER_COLUMNS = list(K.UNIT_DRIVERS)
RISK_WEIGHTS = {"building_ai_anomaly_score": 0.23, "consumption_deviation_score": 0.22, "peer_deviation_score": 0.18,
                "meter_behavior_score": 0.17, "weather_context_score": 0.12, "loss_impact_score": 0.08}


def building_standardize(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Unit readings with canonical names, types and defaults, one row per unit and day.

    Columns are found by header unless mapped by hand; all other columns are carried along. Readings of one
    unit and day are averaged before any per-unit step, so a window over a unit is bounded by the calendar.
    The text attributes of the unit (ATTRIBUTES) take its earliest known value. A text that varies per reading, such as
    the kind of anomaly, stays per day: its most frequent value, and the smallest of equally frequent ones. The most
    frequent kind over all readings of the unit is `unit_anomaly_type`.
    """
    found = {role: find_unit_header(df.columns, names) for role, names in K.UNIT_HEADERS.items()}
    found.update(mapping or {})
    missing = [r for r in REQUIRED if not found.get(r)]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    used = set(found.values())
    columns = [F.col(f"`{c}`").alias(r) for r, c in found.items() if c]
    columns += [F.col(f"`{c}`") for c in df.columns if c not in used and c not in found]
    out = df.select(*columns)
    types = dict(out.dtypes)
    kwh = F.col("consumption_kwh")
    kwh = coerce_numeric(kwh) if types["consumption_kwh"] == "string" else num(kwh)
    out = out.withColumns({
        "date": F.col("date") if types["date"] == "date" else parse_date(F.col("date")),
        "building_id": F.col("building_id").cast("string"), "unit_id": F.col("unit_id").cast("string"),
        "consumption_kwh": at_least(kwh, 0),
        **{c: num(F.col(c)) for c in NUMBERS if c in out.columns}})
    out = out.filter(F.col("date").isNotNull() & F.col("consumption_kwh").isNotNull() & F.col("unit_id").isNotNull())
    texts = [c for c in text_columns(out, ["unit_id"]) if c in ATTRIBUTES]
    varying = [c for c in text_columns(out, ["unit_id"]) if c not in ATTRIBUTES]
    days = one_per_day(out.drop(*texts, *varying))
    merged = dealt(days, "unit_id", enough_partitions(out)).join(first_attributes(out, "unit_id", texts), "unit_id", "left")
    for name in varying:
        merged = merged.join(most_frequent(out, ["unit_id", "date"], name), ["unit_id", "date"], "left")
    if "anomaly_type" in varying:
        merged = merged.join(most_frequent(out, ["unit_id"], "anomaly_type")
                             .withColumnRenamed("anomaly_type", "unit_anomaly_type"), "unit_id", "left")
    # the number of floors and the rows themselves both need the merged readings
    return expected_kwh(with_unit_defaults(stage(merged, "unit_days")))


def most_frequent(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The most frequent known value per key, the smallest of equally frequent ones; counted before anything moves."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(name).alias("v"))).alias("_best")).select(
        *keys, F.col("_best.v").alias(name))


def one_per_day(df: DataFrame) -> DataFrame:
    others = [c for c in df.columns if c not in ("unit_id", "date", "consumption_kwh", "fraud_label", "expected_kwh")]
    means = [c for c in ("consumption_kwh", "expected_kwh") if c in df.columns]
    label = [F.max("fraud_label").alias("fraud_label")] if "fraud_label" in df.columns else []
    return df.groupBy("unit_id", "date").agg(*[F.avg(c).alias(c) for c in means], *label,
                                             *[F.min(c).alias(c) for c in others])


def with_unit_defaults(df: DataFrame) -> DataFrame:
    for name, value in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    df = building_floors(df)
    prefix = F.concat(F.lit("TR-"), F.upper(F.substring(F.col("city").cast("string"), 1, 3)))
    if "transformer_id" not in df.columns:
        df = df.withColumn("transformer_id", prefix)
    mean, amplitude, lon, lat = city_climate(F.col("city"))
    if not {"latitude", "longitude"} <= set(df.columns):
        df = df.withColumns({"latitude": lat, "longitude": lon})
    df = df.withColumns({
        "latitude": clip(num_or(df, "latitude", K.HOME_LATITUDE), *K.BUILDING_LATITUDE),
        "longitude": clip(num_or(df, "longitude", K.HOME_LONGITUDE), *K.BUILDING_LONGITUDE)})
    if "temp_mean" not in df.columns:
        df = df.withColumn("temp_mean", F.round(seasonal_temperature(mean, amplitude, F.col("date")), 2))
    context = temperature_context(num(F.col("temp_mean")))
    df = df.withColumns({c: e for c, e in context.items() if c not in df.columns})
    label = F.coalesce(num(F.col("fraud_label")), F.lit(0.0)) if "fraud_label" in df.columns else F.lit(0.0)
    df = df.withColumn("fraud_label", clip(label, 0, 1).cast("int"))
    if "anomaly_type" not in df.columns:
        df = df.withColumn("anomaly_type", F.when(F.col("fraud_label") == 1, "uploaded_positive_label").otherwise("unknown"))
    return df


def building_floors(df: DataFrame) -> DataFrame:
    """Number of floors: the highest floor seen in the building, at least 1."""
    if "floors" in df.columns:
        return df
    top = df.groupBy("building_id").agg(F.greatest(F.max(num(F.col("floor"))).cast("int"), F.lit(1)).alias("floors"))
    return lookup_join(df, top, ["building_id"], spread=["unit_id", "date"])


def expected_kwh(df: DataFrame) -> DataFrame:
    """Expected reading from people, size, floor and degree days where none is delivered."""
    if "expected_kwh" in df.columns:
        return df
    people, size, floor = num_or(df, "household_size", 2.5), num_or(df, "area_sqm", 70.0), num_or(df, "floor", 2.0)
    return df.withColumn("expected_kwh", 1.45 + people * 1.05 + size * 0.037 + floor * 0.12
                         + num_or(df, "heating_degree_days") * 0.24 + num_or(df, "cooling_degree_days") * 0.38)


def unit_daily_flags(df: DataFrame) -> DataFrame:
    """Gap to the expected reading and flags of each reading."""
    df = df.withColumns({c: num_or(df, c) for c in ("consumption_kwh", "expected_kwh", "area_sqm", "household_size", "floor")})
    kwh, expected = F.col("consumption_kwh"), F.col("expected_kwh")
    pressure = num_or(df, "weather_demand_pressure")
    return df.withColumns({
        "consumption_gap_pct": ratio(expected - kwh, expected),
        "weather_low_mismatch": flag((pressure >= 1) & (kwh < expected * 0.35)),
        "normal_high_mismatch": flag((pressure == 0) & (kwh > expected * 1.85)),
        "zero_flag": flag(kwh <= K.ZERO_KWH),
        "low_expected_flag": flag(kwh < expected * 0.25)})


def unit_lag_flags(df: DataFrame) -> DataFrame:
    """Fall against the previous reading, and readings that hardly change. Dealt by unit, which a later aggregate keeps."""
    kwh, before = F.col("consumption_kwh"), F.col("prev_kwh")
    along = Window.partitionBy("unit_id").orderBy("date")
    df = dealt(df, "unit_id", enough_partitions(df)).withColumn("prev_kwh", F.lag("consumption_kwh").over(along))
    return df.withColumns({"sudden_drop_flag": flag((before > 2) & (kwh < before * 0.28)),
                           "small_change": flag(F.abs(kwh - before) < 0.04)})


def unit_agg(flagged: DataFrame) -> DataFrame:
    """One row per unit."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    kwh = F.col("consumption_kwh")
    return flagged.groupBy("unit_id").agg(
        *[first_known(F.col(c), F.col("date")).alias(c) for c in ATTRIBUTES if c in flagged.columns],
        F.count("*").alias("readings"), F.avg(kwh).alias("avg_consumption"), F.median(kwh).alias("median_consumption"),
        F.coalesce(F.stddev_samp(kwh), F.lit(0.0)).alias("std_consumption"), F.sum(kwh).alias("total_consumption"),
        F.avg("expected_kwh").alias("avg_expected_kwh"), F.sum("expected_kwh").alias("total_expected_kwh"),
        total("zero_flag").alias("zero_days"), total("low_expected_flag").alias("low_expected_days"),
        total("sudden_drop_flag").alias("sudden_drop_days"), total("small_change").alias("flatline_days"),
        total("weather_low_mismatch").alias("weather_low_mismatch_days"),
        total("normal_high_mismatch").alias("normal_high_mismatch_days"),
        F.avg("temp_mean").alias("avg_temp_mean"), F.avg("weather_demand_pressure").alias("avg_weather_demand_pressure"),
        F.max("fraud_label").alias("fraud_label"),
        F.coalesce(F.min("unit_anomaly_type") if "unit_anomaly_type" in flagged.columns else F.mode("anomaly_type", True),
                   F.lit("unknown")).alias("anomaly_type"))


def unit_ratios(units: DataFrame) -> DataFrame:
    """Shares of flagged readings and consumption relative to size; an undefined ratio stays NULL."""
    n, avg = F.col("readings"), F.col("avg_consumption")
    return units.withColumns({
        "zero_ratio": ratio(F.col("zero_days"), n), "flatline_ratio": ratio(F.col("flatline_days"), n),
        "low_expected_ratio": ratio(F.col("low_expected_days"), n),
        "weather_mismatch_ratio": ratio(F.col("weather_low_mismatch_days") + F.col("normal_high_mismatch_days"), n),
        "expected_gap_pct": ratio(F.col("avg_expected_kwh") - avg, F.col("avg_expected_kwh")),
        "kwh_per_sqm": ratio(avg, F.col("area_sqm")), "kwh_per_person": ratio(avg, F.col("household_size")),
        "cv_consumption": ratio(F.col("std_consumption"), avg)})


def unit_peer(units: DataFrame) -> DataFrame:
    """Median of similar units: same city, kind of place and unit type; without city; of all units.

    The wider levels are computed only if some unit is still without a median. `units` should be a stored table.
    """
    units = units.withColumn("peer_avg_consumption", F.lit(None).cast("double"))
    for keys in PEER_LEVELS:
        if units.filter(F.col("peer_avg_consumption").isNull()).isEmpty():
            break
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        medians = group_quantile(units.filter(known).select(*keys, "avg_consumption"), keys, "avg_consumption", 0.5, "_median")
        units = lookup_join(units, medians, keys, spread=["unit_id"])
        units = units.withColumn("peer_avg_consumption", F.coalesce("peer_avg_consumption", "_median")).drop("_median")
    if not units.filter(F.col("peer_avg_consumption").isNull()).isEmpty():
        overall = exact_quantile(units, "avg_consumption", 0.5)
        units = units.withColumn("peer_avg_consumption", F.coalesce("peer_avg_consumption", overall))
    gap = ratio(F.col("peer_avg_consumption") - F.col("avg_consumption"), F.col("peer_avg_consumption"))
    return units.withColumn("peer_low_gap_pct", F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)))


def unit_loss(units: DataFrame) -> DataFrame:
    """Missing energy of 30 days at the flat unit tariff."""
    gap = F.col("avg_expected_kwh") - F.col("avg_consumption")
    return (units.withColumn("estimated_missing_kwh_30d", at_least(gap, 0) * 30)
            .withColumn("estimated_loss_lek_30d", F.col("estimated_missing_kwh_30d") * K.UNIT_TARIFF))


def unit_features(readings: DataFrame) -> DataFrame:
    """From standardised readings to one row per unit with ratios, peers and loss. A staged table."""
    units = stage(unit_ratios(unit_agg(unit_lag_flags(unit_daily_flags(readings)))), "units")
    return stage(unit_loss(unit_peer(units)), "unit_features")


def unit_anomaly(units: DataFrame, trees: int = 180, seed: int = 42) -> DataFrame:
    """Isolation-forest score of the units; 0 with fewer than ten."""
    if units.limit(10).count() < 10:
        return units.withColumn("building_ai_anomaly_score", F.lit(0.0))
    filled = known_features(units)
    scored = models.anomaly_score(filled, K.UNIT_FEATURES, "_score", "unit_id", trees, seed)
    slim = scored.select("unit_id", F.round("_score", 2).alias("building_ai_anomaly_score"))
    return units.join(slim, "unit_id", "left")


def enough_unit_labels(units: DataFrame) -> bool:
    """At least 40 units and 5 of each class."""
    known, ones = models.label_counts(units, "fraud_label")
    return known >= 40 and min(ones, known - ones) >= 5


def known_features(units: DataFrame) -> DataFrame:
    return units.withColumns({c: F.coalesce(num(F.col(c)), F.lit(0.0)) for c in K.UNIT_FEATURES if c in units.columns})


def unit_probability(units: DataFrame, trees: int = 260, seed: int = 42):
    """(units with fraud_probability or NULL, fitted model or None). Needs 40 units and 5 of each class."""
    if not enough_unit_labels(units):
        return units.withColumn("fraud_probability", F.lit(None).cast("double")), None
    filled = known_features(units)
    model = models.fit_classifier(filled, K.UNIT_FEATURES, trees=trees, depth=UNIT_DEPTH, seed=seed)
    scored = models.classify(filled, model, K.UNIT_FEATURES, "fraud_probability").select("unit_id", "fraud_probability")
    return units.join(scored, "unit_id", "left"), model


def unit_minmax(df: DataFrame, column: str) -> Column:
    """Value stretched to 0-1 over the table; a constant column becomes 0."""
    from wattlens.operators.risk import stretched
    return stretched(df, column) / 100


def unit_components(units: DataFrame) -> DataFrame:
    """Component scores 0-100, rounded to two decimals."""
    behavior = (F.col("zero_ratio") * 42 + F.col("flatline_ratio") * 34
                + F.least(F.col("sudden_drop_days"), F.lit(12)) / 12 * 24)
    gap = F.when(F.col("expected_gap_pct").isNotNull(), clip(F.col("expected_gap_pct"), 0, 1.2) / 1.2 * 100)
    return units.withColumns({
        "consumption_deviation_score": F.round(gap, 2),
        "peer_deviation_score": F.round(clip(F.col("peer_low_gap_pct"), 0, 1) * 100, 2),
        "meter_behavior_score": F.round(clip100(behavior), 2),
        "weather_context_score": F.round(clip(F.col("weather_mismatch_ratio"), 0, 1) * 100, 2),
        "loss_impact_score": F.round(unit_minmax(units, "estimated_loss_lek_30d") * 100, 2)})


def unit_risk(units: DataFrame, supervised: bool) -> DataFrame:
    """Risk score and level. A model probability is blended in; without one it follows from the score."""
    base = F.round(clip100(reduce(lambda a, b: a + b, [F.col(c) * w for c, w in RISK_WEIGHTS.items()])), 2)
    units = units.withColumn("risk_score", base)
    if supervised:
        blend = 0.68 * F.col("risk_score") + 0.32 * (F.col("fraud_probability") * 100)
        units = units.withColumn("risk_score", F.round(clip100(blend), 2))
    else:
        logistic = 1 / (1 + F.exp(-(F.col("risk_score") - 55) / 12))
        units = units.withColumn("fraud_probability", F.round(logistic, 4))
    return units.withColumn("risk_level", unit_level(F.col("risk_score")))


def top_driver(units: DataFrame) -> DataFrame:
    """Strongest component in words (the first one on a tie), action and explanation."""
    strongest = F.greatest(*[F.col(c) for c in DRIVER_COLUMNS])
    reason = F.coalesce(*[F.when(F.col(c) == strongest, F.lit(K.UNIT_DRIVERS[c])) for c in DRIVER_COLUMNS])
    units = units.withColumns({
        "main_reason": reason,
        "recommended_action": F.when(is_high(F.col("risk_level")), K.UNIT_ACTION_URGENT).otherwise(K.UNIT_ACTION_MONITOR)})

    def share(name: str) -> Column:
        known = F.bround(F.col(name) * 100, 0).cast("long").cast("string")
        return F.concat(F.coalesce(known, F.lit("nan")), F.lit("%"))

    text = F.concat(F.col("unit_id"), F.lit(" in "), F.col("building_id"), F.lit(" is "), F.col("risk_level"),
                    F.lit(" risk because the strongest signal is "), F.col("main_reason"),
                    F.lit(". Expected gap: "), share("expected_gap_pct"), F.lit(", peer low gap: "),
                    share("peer_low_gap_pct"), F.lit(", weather mismatch: "), share("weather_mismatch_ratio"), F.lit("."))
    return units.withColumn("alert_explanation", text)


def unit_scores(features: DataFrame, models_on: bool = True, trees: tuple[int, int] = (180, 260), seed: int = 42,
                keep: dict | None = None) -> DataFrame:
    """Scored and ranked units. `models_on=False` leaves both models out (anomaly 0, logistic probability). `keep` gets the
    fitted classifier as `fraud`."""
    if models_on:
        units, model = unit_probability(unit_anomaly(features, trees[0], seed), trees[1], seed)
        if keep is not None:
            keep["fraud"] = model
    else:
        units, model = features.withColumn("building_ai_anomaly_score", F.lit(0.0)), None
    scored = top_driver(unit_risk(unit_components(units), supervised=model is not None))
    return global_rank(scored, [F.desc("risk_score"), "unit_id"], "priority_rank")


def unit_explorer(units: DataFrame, cities: list[str] | None = None, places: list[str] | None = None,
                  levels: list[str] | None = None, min_score: float = 40, limit: int = 300) -> DataFrame:
    """The first 300 units that pass the chosen filters."""
    for column, chosen in (("city", cities), ("location_type", places), ("risk_level", levels)):
        if chosen:
            units = units.filter(F.col(column).isin(chosen))
    return units.filter(F.coalesce("risk_score", F.lit(0.0)) >= min_score).orderBy("priority_rank").limit(limit)


def building_scores(units: DataFrame) -> DataFrame:
    """One row per building. Scores have two decimals, so the percentile's buffer holds at most 10,001 values."""
    def first(name: str) -> Column:
        return first_known(F.col(name), F.col("priority_rank")).alias(name)

    high, critical = is_high(F.col("risk_level")), F.col("risk_level") == "Critical"
    buildings = units.groupBy("building_id").agg(
        *[first(c) for c in ("city", "location_type", "building_type", "transformer_id")],
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
        F.count("unit_id").alias("units"), F.count_if(high).alias("high_risk_units"),
        F.count_if(critical).alias("critical_units"), F.avg("risk_score").alias("avg_risk_score"),
        F.max("risk_score").alias("max_risk_score"), F.percentile("risk_score", F.lit(0.9)).alias("p90_risk_score"),
        F.avg("fraud_probability").alias("avg_fraud_probability"),
        F.sum("estimated_loss_lek_30d").alias("estimated_loss_lek_30d"),
        F.coalesce(F.mode("main_reason", True), F.lit("N/A")).alias("top_reason"))
    crowded = F.least(ratio(F.col("high_risk_units"), F.col("units")) * 100, F.lit(100.0))
    score = 0.55 * F.col("p90_risk_score") + 0.30 * F.col("avg_risk_score") + 0.15 * crowded
    buildings = buildings.withColumn("risk_score", F.round(clip100(score), 2))
    buildings = buildings.withColumn("risk_level", unit_level(F.col("risk_score")))
    return global_rank(buildings, [F.desc("risk_score"), "building_id"], "priority_rank")


def floor_scores(units: DataFrame) -> DataFrame:
    """One row per building and floor."""
    return units.filter(F.col("floor").isNotNull()).groupBy("building_id", "floor").agg(
        first_known(F.col("city"), F.col("priority_rank")).alias("city"), F.count("unit_id").alias("units"),
        F.avg("risk_score").alias("avg_risk_score"), F.max("risk_score").alias("max_risk_score"),
        F.count_if(is_high(F.col("risk_level"))).alias("high_risk_units"),
        F.sum("estimated_loss_lek_30d").alias("estimated_loss_lek_30d"))


def building_daily(flagged: DataFrame) -> DataFrame:
    """Totals per day and the energy missing against the expectation."""
    days = flagged.groupBy("date").agg(
        F.sum("consumption_kwh").alias("total_consumption_kwh"), F.sum("expected_kwh").alias("expected_consumption_kwh"),
        F.sum("weather_low_mismatch").alias("weather_mismatch_events"), F.sum("zero_flag").alias("zero_events"),
        F.sum("sudden_drop_flag").alias("sudden_drop_events"), F.avg("temp_mean").alias("avg_temperature"))
    gap = F.col("expected_consumption_kwh") - F.col("total_consumption_kwh")
    return days.withColumn("estimated_missing_kwh", F.greatest(gap, F.lit(0.0)))


def ranking_quality(units: DataFrame, score: str) -> DataFrame:
    """One row: ROC AUC and average precision of a score against the units' labels."""
    auc = metrics.roc_auc(units, "fraud_label", score).scalar()
    precision = metrics.average_precision(units, "fraud_label", score).scalar()
    return units.sparkSession.range(1).select(auc.alias("fraud_classifier_roc_auc"),
                                              precision.alias("fraud_classifier_average_precision"))


def unit_model_quality(features: DataFrame, trees: int = 260, seed: int = 42) -> DataFrame | None:
    """Quality of the unit classifier on a stratified 28 % hold-out; None where labels are too few for it."""
    if not enough_unit_labels(features):
        return None
    filled = known_features(features)
    out = models.classifier_metrics(filled, K.UNIT_FEATURES, "fraud_label", "unit_id", 0.28, trees, UNIT_DEPTH, seed)
    return out.select("fraud_classifier_roc_auc",
                      F.col("fraud_classifier_avg_precision").alias("fraud_classifier_average_precision"))


def building_metrics(flagged: DataFrame, units: DataFrame, buildings: DataFrame,
                     quality: DataFrame | None = None) -> DataFrame:
    """One row of counts and totals, with the quality of a model's scores if it is given."""
    if quality is not None:
        row = stage(quality, "quality")
        return building_metrics(flagged, units, buildings).withColumns({c: row.select(c).scalar() for c in row.columns})
    readings = flagged.agg(F.struct(F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"))).scalar()
    places = buildings.agg(F.struct(F.count("*").alias("n"), F.count_if(is_high(F.col("risk_level"))).alias("high"))).scalar()
    out = units.agg(F.count("*").alias("units"), F.coalesce(F.sum("fraud_label"), F.lit(0)).alias("positive_units"),
                    F.count_if(is_high(F.col("risk_level"))).alias("high_risk_units"),
                    F.count_if(F.col("risk_level") == "Critical").alias("critical_units"),
                    F.coalesce(F.sum("estimated_loss_lek_30d"), F.lit(0.0)).alias("estimated_loss_lek_30d"))
    return out.withColumns({"records": readings["n"], "date_min": readings["a"], "date_max": readings["b"],
                            "buildings": places["n"], "high_risk_buildings": places["high"]})


def city_exposure(buildings: DataFrame) -> DataFrame:
    """Mean risk and number of buildings per city and kind of place."""
    return buildings.groupBy("city", "location_type").agg(
        F.avg("risk_score").alias("risk_score"), F.count_if(is_high(F.col("risk_level"))).alias("high_risk_buildings"),
        F.count("building_id").alias("buildings"))


def analyze_units(df: DataFrame, mapping: dict[str, str] | None = None, models_on: bool = True,
                  trees: tuple[int, int] = (180, 260), seed: int = 42) -> dict[str, DataFrame]:
    """The whole unit analysis as named tables."""
    readings = stage(building_standardize(df, mapping), "unit_readings")
    flagged = unit_lag_flags(unit_daily_flags(readings))
    features = unit_features(readings)
    used: dict = {}
    units = unit_scores(features, models_on, trees, seed, used)
    buildings = building_scores(units)
    quality = unit_model_quality(features, trees[1], seed) if models_on else None
    return {"raw": readings, "unit_scores": units, "building_scores": buildings, "floor_scores": floor_scores(units),
            "daily_summary": building_daily(flagged), "feature_importance": importance_table(readings.sparkSession, used.get("fraud")),
            "metrics": building_metrics(flagged, units, buildings, quality)}


def importance_table(spark, model) -> DataFrame:
    """Importance of every unit feature, unknown without a model."""
    if model is not None:
        return models.feature_importance(model, K.UNIT_FEATURES, spark)
    return spark.createDataFrame([(f, None) for f in K.UNIT_FEATURES], "feature string, importance double")


def save_unit_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    from wattlens.sources.sinks import write_json, write_table
    for name, table in results.items():
        write_json(table, f"{folder}/{name}") if name == "metrics" else write_table(table, f"{folder}/{name}", fmt)
