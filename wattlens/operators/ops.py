"""Questions of daily operation: figures, lists, trends, cases, teams, activity and requests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattlens import constants as K
from wattlens.functions.columns import col_or, is_high, num, num_or, ratio, tariff


def loss_economics(customers: DataFrame) -> DataFrame:
    """Billed and expected value of 30 days; the gap between them is the estimated loss."""
    price = tariff(num_or(customers, "last_30_mean"), col_or(customers, "customer_type", "residential"))
    actual, loss = num_or(customers, "last_30_mean") * 30.0 * price, num_or(customers, "estimated_loss_all_30d")
    totals = customers.agg(
        F.sum(actual + loss).alias("expected"), F.sum(actual).alias("actual"), F.sum(loss).alias("loss"),
        F.sum(num_or(customers, "estimated_missing_kwh_30d")).alias("missing_kwh"),
        F.count_if(loss > 0).alias("customers_with_loss"))
    share = F.when(F.col("expected") > 0, F.col("loss") / F.col("expected") * 100).otherwise(0.0)
    return totals.withColumn("leakage_pct", share)


def top_by(df: DataFrame, score: str, id_column: str, n: int) -> DataFrame:
    """The n rows with the highest score; ties by id."""
    return df.orderBy(F.desc_nulls_last(score), id_column).limit(n)


def top_loss_areas(areas: DataFrame, n: int = 8) -> DataFrame:
    known = areas.filter(F.col("area_id").isNotNull())
    return top_by(known, "estimated_loss_all_30d", "area_id", n).select("area_id", "estimated_loss_all_30d")


def top_areas(areas: DataFrame, n: int = 10) -> DataFrame:
    return top_by(areas, "area_risk_score", "area_id", n).select("area_id", "area_risk_score", "area_risk_level")


def headline_kpis(customers: DataFrame, areas: DataFrame) -> DataFrame:
    """Totals, share of high-risk customers, the area to look at first and the overall status."""
    row = customers.agg(
        F.count("customer_id").alias("customers"), F.count_if(is_high(F.col("risk_level"))).alias("high_or_critical"),
        F.count_if(F.col("risk_level") == "Critical").alias("critical"),
        F.coalesce(F.sum(num_or(customers, "estimated_loss_all_30d")), F.lit(0.0)).alias("estimated_loss_all_30d"))
    places = areas.agg(F.struct(
        F.count_if(is_high(F.col("area_risk_level"))).alias("high"),
        F.min_by("area_id", F.struct(-F.col("area_risk_score"), F.col("area_id"))).alias("top"))).scalar()
    share = F.col("high_or_critical") / F.greatest(F.col("customers"), F.lit(1)) * 100
    row = row.withColumns({"pct_high": share, "high_risk_areas": places["high"], "top_area": places["top"]})
    level = (F.when(F.col("pct_high") >= 15, "Critical").when(F.col("pct_high") >= 7, "High")
             .when(F.col("pct_high") >= 3, "Medium").otherwise("Low"))
    return row.withColumn("status_level", level)


def risk_histogram(customers: DataFrame, bins: int = 35) -> DataFrame:
    """Customers per equal-width bin of the risk score 0-100."""
    index = F.least(F.floor(F.col("risk_score") * bins / 100), F.lit(bins - 1)).cast("int")
    return (customers.filter(F.col("risk_score").isNotNull()).groupBy(index.alias("bin"))
            .agg(F.count("*").alias("customers"))
            .withColumn("bin_start", F.col("bin") * 100.0 / bins))


def level_counts(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """Rows per level in the fixed order; a level without rows counts 0."""
    counts = df.agg(*[F.count_if(F.col(level) == name).alias(name) for name in K.LEVELS])
    rows = F.array(*[F.struct(F.lit(i).alias("level_order"), F.lit(n).alias("risk_level"), F.col(n).alias("rows"))
                     for i, n in enumerate(K.LEVELS)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def daily_trend(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.avg("consumption_kwh").alias("average_consumption"),
                                     F.sum("sudden_drop_flag").alias("sudden_drop_events"))


def weather_trend(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.avg("consumption_kwh").alias("average_consumption"),
                                     F.avg("temp_mean").alias("average_temperature"),
                                     F.sum("weather_consumption_mismatch").alias("weather_mismatch_events"))


def weather_kpis(daily: DataFrame, customers: DataFrame) -> DataFrame:
    at_risk = customers.agg(F.count_if(F.col("weather_context_score") > 40)).scalar()
    return daily.agg(F.avg("temp_mean").alias("avg_temperature"),
                     F.count_if(F.col("weather_demand_pressure") == 1).alias("extreme_weather_days"),
                     F.coalesce(F.sum("weather_consumption_mismatch"), F.lit(0)).alias("mismatch_events")
                     ).withColumn("customers_with_weather_risk", at_risk)


def risk_register(customers: DataFrame, min_score: float = 60, query: str = "", levels: list[str] | None = None,
                  areas: list[str] | None = None) -> DataFrame:
    """Customers filtered by score, part of the id, level and area. Order on output by risk."""
    out = customers.filter(F.col("risk_score") >= min_score)
    if query:
        out = out.filter(F.lower("customer_id").contains(query.lower()))
    if levels:
        out = out.filter(F.col("risk_level").isin(levels))
    if areas:
        out = out.filter(F.col("area_id").isin(areas))
    return out.orderBy(F.desc("risk_score"), "customer_id")


def register_kpis(register: DataFrame) -> DataFrame:
    return register.agg(F.count("*").alias("customers"), F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("average_risk"),
                        F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0)).alias("estimated_loss"))


def customer_timeline(daily: DataFrame, customer_id: str) -> DataFrame:
    """Readings and baseline of one customer; of a table clustered by customer one bucket is read, and of it few row groups."""
    return (daily.filter(F.col("customer_id") == customer_id)
            .select("customer_id", "date", "consumption_kwh", "rolling_30d_mean"))


def driver_breakdown(customers: DataFrame) -> DataFrame:
    """The seven driver scores of every customer as rows."""
    have = {c: label for c, label in K.DRIVER_LABELS.items() if c in customers.columns}
    slim = customers.select("customer_id", *[num(F.col(c)).alias(label) for c, label in have.items()])
    return slim.unpivot(["customer_id"], [F.col(f"`{label}`") for label in have.values()], "driver", "score")


# fixed values: name and meaning of each indicator
INDICATORS = [
    ("Mean customer consumption", "Average daily consumption across customers."),
    ("Median customer consumption", "Typical customer consumption level."),
    ("Consumption volatility", "Average instability in consumption."),
    ("Mean risk score", "Average suspicious behavior score."),
    ("High-risk customer rate", "Share of customers classified as High or Critical."),
    ("Critical customer rate", "Share requiring urgent verification."),
    ("Total estimated 30-day loss", "Estimated suspicious under-recorded value."),
]


def indicators(customers: DataFrame) -> DataFrame:
    """Seven statistics of the customer table, one per row."""
    from wattlens.plans.selection import exact_quantile
    middle = exact_quantile(customers, "median_consumption", 0.5)
    row = customers.agg(
        F.avg("avg_consumption").alias("i0"), F.avg("std_consumption").alias("i2"), F.avg("risk_score").alias("i3"),
        (F.avg(is_high(F.col("risk_level")).cast("double")) * 100).alias("i4"),
        (F.avg((F.col("risk_level") == "Critical").cast("double")) * 100).alias("i5"),
        F.sum("estimated_loss_all_30d").alias("i6")).withColumn("i1", middle)
    rows = F.array(*[F.struct(F.lit(name).alias("indicator"), F.col(f"i{i}").alias("value"), F.lit(text).alias("meaning"))
                     for i, (name, text) in enumerate(INDICATORS)])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def correlation(customers: DataFrame, columns: list[str] = K.CORRELATION_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair of drivers with more than two values, from one aggregate.

    Rows where one of the two is missing do not count for the pair; a constant driver gives NULL.
    """
    value = {c: num(F.col(c)) for c in columns if c in customers.columns}
    known = customers.agg(F.count("*").alias("n"), *[F.count(v).alias(c) for c, v in value.items()]).first()
    have = [c for c in value if known[c] > 2]

    def spread(a: str, b: str) -> Column:
        whole = known[b] == known["n"]
        return F.stddev_samp(value[a] if whole else F.when(value[b].isNotNull(), value[a]))

    pairs = [(a, b) for i, a in enumerate(have) for b in have[i:]]
    rows = []
    for a, b in pairs:
        r = F.round(F.try_divide(F.covar_samp(value[a], value[b]), spread(a, b) * spread(b, a)), 2)
        rows += [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), r.alias("correlation")) for x, y in {(a, b), (b, a)}]
    if not rows:
        return customers.sparkSession.createDataFrame([], "a string, b string, correlation double")
    return customers.agg(F.array(*rows).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def create_cases(priority: DataFrame, teams: list[str], n: int = K.CASE_COUNT) -> DataFrame:
    """The first n of the queue as new cases, teams in turn."""
    place = F.row_number().over(Window.orderBy("priority_rank"))  # over n rows
    have = [c for c in K.CASE_COLUMNS if c in priority.columns]
    first = priority.select(have).orderBy("priority_rank").limit(n).withColumn("_i", place - 1)
    names = F.array(*[F.lit(t) for t in sorted(teams) or ["Inspection Team 1"]])
    team = F.element_at(names, (F.pmod(F.col("_i"), F.size(names)) + 1).cast("int"))
    texts = {c: case_text(F.col(c)) for c in ("area_id", "transformer_id", "risk_level", "main_reason",
                                              "recommended_action") if c in have}
    return (first.withColumns(texts).withColumns({
        "case_id": F.format_string("NTL-%05d", F.col("_i") + 1), "status": F.lit("New"), "assigned_team": team,
        "inspection_result": F.lit("Pending"), "field_notes": F.lit("")}).drop("_i")
        .select("case_id", *have, "status", "assigned_team", "inspection_result", "field_notes"))


def case_text(value: Column) -> Column:
    """Text of a case field: missing values and their spellings become empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.isin("nan", "None"), "").otherwise(text)


def latest(events: DataFrame, key: str, time: str, tie: str | None = None) -> DataFrame:
    """Newest event per key. Partial aggregation keeps one row per key and task before the shuffle."""
    values = [c for c in events.columns if c != key]
    order = F.struct(*[F.col(c) for c in (time, tie) if c])
    newest = events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("e"))
    return newest.select(key, "e.*")


def case_state(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases with their latest status, team, result and notes.

    `events` are appended updates: case_id, event_time and any of the four fields.
    """
    fields = [c for c in ("status", "assigned_team", "inspection_result", "field_notes") if c in events.columns]
    newest = latest(events.select("case_id", "event_time", *fields), "case_id", "event_time")
    new = newest.select("case_id", *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = cases.join(new, "case_id", "left")
    return out.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields}).drop(*[f"_new_{c}" for c in fields])


def dispatch(cases: DataFrame, team: str, n: int) -> DataFrame:
    """Update events that hand the n riskiest new cases to a team."""
    chosen = cases.filter(F.col("status") == "New").orderBy(F.desc("risk_score"), "case_id").limit(n)
    return chosen.select("case_id", F.lit(team).alias("assigned_team"), F.lit("Assigned").alias("status"))


def team_summary(cases: DataFrame) -> DataFrame:
    status = F.col("status")
    return cases.groupBy("assigned_team").agg(
        F.count("case_id").alias("total"), F.count_if(status != "New").alias("dispatched"),
        F.count_if(status == "Confirmed NTL").alias("confirmed"),
        F.count_if(~status.isin(*K.CLOSED_STATUSES, "New")).alias("open"))


def case_kpis(cases: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Open, confirmed and false cases and their potential loss; `in_view` counts the chosen statuses."""
    status = F.col("status")
    chosen = status.isin(statuses) if statuses else F.lit(True)
    return cases.agg(F.count_if(~status.isin(K.CLOSED_STATUSES)).alias("open_cases"),
                     F.count_if(status == "Confirmed NTL").alias("confirmed"),
                     F.count_if(status == "False Alarm").alias("false_alarms"),
                     F.count_if(status != "New").alias("dispatched"),
                     F.count_if(chosen).alias("in_view"),
                     F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0)).alias("potential_loss"))


def team_board(cases: DataFrame, team: str) -> DataFrame:
    """Dispatched cases of one team, riskiest first."""
    mine = cases.filter((F.col("assigned_team") == team) & (F.col("status") != "New"))
    return mine.orderBy(F.desc("risk_score"), "case_id")


def board_kpis(board: DataFrame) -> DataFrame:
    return board.agg(F.count("*").alias("dispatched"), F.count_if(is_high(F.col("risk_level"))).alias("high_or_critical"),
                     F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0)).alias("potential_loss"),
                     F.count_if(~F.col("status").isin(K.CLOSED_STATUSES)).alias("still_open"))


def team_scope(customers: DataFrame, areas: DataFrame, transformers: DataFrame, cases: DataFrame, team: str
               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, areas and transformers that a team has dispatched cases for."""
    ids = team_board(cases, team).select("customer_id").distinct()
    mine = customers.join(ids, "customer_id", "left_semi")
    return (mine, areas.join(mine.select("area_id").distinct(), "area_id", "left_semi"),
            transformers.join(mine.select("transformer_id").distinct(), "transformer_id", "left_semi"))


def activity_feed(events: DataFrame, limit: int = 50, keep: int = K.FEED_SIZE, time: str = "time",
                  tie: str = "event_id") -> DataFrame:
    """Newest activity first; the feed never reaches back more than `keep` events."""
    return events.orderBy(F.desc(time), F.desc(tie)).limit(min(limit, keep))


REQUEST_COLUMNS = ["requested_by", "topic", "note", "status", "requested_at", "answered_by", "answered_at", "response"]


def request_state(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Current state of every request from its `asked` and `answered` events, newest request first.

    The first event of a request asks; the first answer settles it.
    """
    asked, answer = F.col("kind") == "asked", F.col("kind") == "answered"
    order = F.struct(*[F.col(c) for c in ("event_time", tie) if c])
    question = F.min_by(F.struct(F.col("actor").alias("requested_by"), "topic", "note",
                                 F.col("event_time").alias("requested_at")), F.when(asked, order))
    reply = F.min_by(F.struct(F.col("actor").alias("answered_by"), F.col("event_time").alias("answered_at"),
                              F.col("note").alias("response")), F.when(answer, order))
    state = events.groupBy("request_id").agg(question.alias("q"), reply.alias("a"))
    return (state.filter(F.col("q").isNotNull()).select("request_id", "q.*", "a.*")
            .withColumn("status", F.when(F.col("answered_at").isNotNull(), "Answered").otherwise("Pending"))
            .select("request_id", *REQUEST_COLUMNS))


def pending_requests(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count_if(F.col("status") != "Answered").alias("pending"),
                        F.count_if(F.col("status") == "Answered").alias("answered"))


TOP_CUSTOMER = ["customer_id", "risk_score", "risk_level", "area_id", "transformer_id", "main_reason",
                "recommended_action", "estimated_loss_all_30d"]
TOP_AREA = ["area_id", "area_risk_score", "area_risk_level", "customers", "high_risk_customers",
            "critical_customers", "anomaly_density", "estimated_loss_all_30d"]


def records(df: DataFrame, columns: list[str], order: list, n: int) -> Column:
    """Scalar: the first n rows as an array of structs."""
    have = [c for c in columns if c in df.columns]
    top = df.orderBy(*order).limit(n)
    place = F.row_number().over(Window.orderBy(*order))  # over n rows
    packed = top.select(place.alias("_i"), F.struct(*have).alias("r"))
    listed = packed.agg(F.sort_array(F.collect_list(F.struct("_i", "r"))).alias("v"))
    return listed.select(F.transform("v", lambda x: x["r"])).scalar()


def context_snapshot(customers: DataFrame, areas: DataFrame, priority: DataFrame, cases: DataFrame,
                     loss_forecast: DataFrame, area_forecast: DataFrame, quality: dict | None = None,
                     metrics: dict | None = None) -> DataFrame:
    """Compact summary of a run as one JSON text: totals, short lists, case counts, metrics, data quality."""
    totals = customers.agg(
        F.struct(F.count("customer_id").alias("customers_analyzed"),
                 F.count_if(is_high(F.col("risk_level"))).alias("high_or_critical"),
                 F.count_if(F.col("risk_level") == "Critical").alias("critical"),
                 F.round(F.coalesce(F.sum("estimated_loss_all_30d"), F.lit(0.0)), 0)
                 .alias("estimated_current_30d_loss_lek")).alias("totals"))
    statuses = cases.groupBy("status").agg(F.count("*").alias("n"))  # a handful of statuses
    counts = statuses.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n"))))).scalar()
    parts = {
        "top_20_customers_by_risk": records(customers, TOP_CUSTOMER, [F.desc("risk_score"), "customer_id"], 20),
        "top_areas_by_risk": records(areas, TOP_AREA, [F.desc("area_risk_score"), "area_id"], 10),
        "top_15_inspection_priority": records(priority, ["priority_rank", "customer_id", "risk_score", "area_id",
                                                         "main_reason"], ["priority_rank"], 15),
        "case_status_counts": counts,
        "forecast_30d_total_loss_lek": F.round(loss_forecast.agg(F.sum("predicted_loss_all")).scalar(), 0),
        "top_forecast_areas": records(area_forecast, ["area_id", "forecasted_area_risk_next_30d"], ["forecast_priority"], 5),
    }
    for name, facts in (("model_metrics", metrics), ("data_quality", quality)):
        if facts:
            parts[name] = F.struct(*[F.lit(v).alias(k) for k, v in facts.items()])
    full = totals.withColumns(parts)
    return full.select(F.to_json(F.struct(*full.columns)).alias("context"))


def top_lists(customers: DataFrame, transformers: DataFrame, areas: DataFrame, customer_forecast: DataFrame
              ) -> DataFrame:
    """The short lists of the pages as one table: list, place, id, score."""
    def short(df: DataFrame, name: str, id_column: str, score: str, order: list, n: int) -> DataFrame:
        top = df.orderBy(*order).limit(n)
        place = F.row_number().over(Window.orderBy(*order))  # over n rows
        return top.select(F.lit(name).alias("list"), place.alias("place"), F.col(id_column).alias("id"),
                          F.col(score).cast("double").alias("score"))

    parts = [
        short(customers, "attention", "customer_id", "risk_score", [F.desc("risk_score"), "customer_id"], 15),
        short(customers, "weather", "customer_id", "weather_context_score",
              [F.desc("weather_context_score"), "customer_id"], 50),
        short(transformers, "transformers", "transformer_id", "transformer_risk_score",
              [F.desc("transformer_risk_score"), "transformer_id"], 80),
        short(areas, "area_forecast", "area_id", "forecasted_area_risk_next_30d", ["forecast_priority"], 30),
        short(customer_forecast, "customer_forecast", "customer_id", "forecasted_customer_risk_next_30d",
              ["forecast_priority"], 50),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "time timestamp, actor string, role string, action string, detail string")


def append_events(events: DataFrame, path: str) -> None:
    """Append to an event table; the current state is always derived from it."""
    events.write.mode("append").parquet(path)
