"""The same questions in SQL for DuckDB, written from the definitions and not from the library's constants.

`STEPS` are named steps; a query is prefixed with the steps it mentions. In the column list of `rounded`, a
leading `~` marks a double that is rounded like the queries' output.
"""
from __future__ import annotations

import re

STEPS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    STEPS[name] = sql.strip()


def with_steps(sql: str) -> str:
    """Prefix a query with the steps it uses, directly or through other steps."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in set(re.findall(r"[a-z_0-9]+", text)) & STEPS.keys():
            if name not in needed:
                needed.add(name)
                collect(STEPS[name])

    collect(sql)
    parts = [f"{n} AS (\n{s}\n)" for n, s in STEPS.items() if n in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def r(expression: str, digits: int = 4) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE) + 1e-9, {digits})"


def rounded(columns: str) -> str:
    names = [c.strip() for c in columns.split(",")]
    return ", ".join(f"{r(c[1:])} AS {c[1:]}" if c.startswith("~") else c for c in names)


def oracle(name: str, columns: str, rest: str) -> None:
    ORACLE[name] = with_steps(f"SELECT {rounded(columns)} {rest}")


def oracle_sql(name: str, sql: str) -> None:
    ORACLE[name] = with_steps(sql.strip())


# ---------------------------------------------------------------- tracks
step("e_raw", """
SELECT CASE WHEN event_id % 101 = 0 THEN '  ' ELSE ' ' || CAST(user_id AS VARCHAR) END AS customer_id,
       CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date,
       CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN -value ELSE value END AS consumption_kwh,
       CASE WHEN event_id % 4 = 0 THEN CASE WHEN user_id % 9 = 0 THEN 1.0 ELSE 0.0 END END AS fraud_label,
       event_id AS sequence
FROM events""")
step("e_typed", """
SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(ts AS DATE) AS date,
       CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN -value ELSE value END AS consumption_kwh,
       CASE WHEN event_id % 4 = 0 THEN CASE WHEN user_id % 9 = 0 THEN 1.0 ELSE 0.0 END END AS fraud_label,
       event_id AS sequence
FROM events""")
step("e_merged", """
SELECT customer_id, date, AVG(consumption_kwh) AS consumption_kwh,
       ARG_MIN(fraud_label, sequence) FILTER (WHERE fraud_label IS NOT NULL) AS fraud_label, COUNT(*) AS copies
FROM e_typed GROUP BY customer_id, date""")
step("e_positive", """
SELECT customer_id, date, CASE WHEN consumption_kwh >= 0 THEN consumption_kwh END AS consumption_kwh, fraud_label, copies
FROM e_merged""")
step("e_cap", "SELECT QUANTILE_CONT(consumption_kwh, 0.995) AS cap FROM e_positive")
step("e_median", "SELECT customer_id, MEDIAN(consumption_kwh) AS m FROM e_positive GROUP BY customer_id")
step("s_raw", """
SELECT CAST(l_suppkey AS VARCHAR) AS customer_id, CAST(l_shipdate AS DATE) AS date,
       SUM(CASE WHEN l_suppkey % 7 = 3 AND MONTH(l_shipdate) IN (2, 9) THEN 0
                WHEN l_suppkey % 11 = 5 AND YEAR(l_shipdate) >= 2000 THEN 12
                WHEN l_suppkey % 5 = 1 AND l_shipdate >= TIMESTAMP '2001-06-01' THEN FLOOR(l_quantity / 8)
                ELSE l_quantity END) AS consumption_kwh
FROM lineitem GROUP BY 1, 2""")
PAYMENT = """
       {k} % 13 AS payment_late_count_12m, {k} % 7 AS unpaid_bills, CAST({k} % 90 AS DOUBLE) AS avg_payment_delay_days,
       GREATEST(0.0, -{b}) * 100 AS arrears_amount_lek, {k} % 4 AS disconnections_12m,
       CAST({k} % 9 AS DOUBLE) AS months_since_last_payment,
       CASE {k} % 10 WHEN 0 THEN 'suspended' WHEN 1 THEN 'under_review' ELSE 'active' END AS account_status"""
step("s_dim", """
SELECT CAST(s_suppkey AS VARCHAR) AS customer_id,
       CASE s_suppkey % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' ELSE 'industrial' END AS customer_type,
       n_name AS area_id, 'TR_' || CAST(s_suppkey % 70 AS VARCHAR) AS transformer_id, n_name AS city,
       39.5::DOUBLE + (n_nationkey * 13 % 25) * 0.14::DOUBLE + (s_suppkey % 10) * 0.01::DOUBLE AS latitude,
       18.7::DOUBLE + (n_nationkey * 7 % 25) * 0.1::DOUBLE + (s_suppkey % 10) * 0.01::DOUBLE AS longitude,
       CAST(s_suppkey % 20 AS DOUBLE) AS meter_age, CAST(3 + s_suppkey % 30 AS DOUBLE) AS contract_power_kw,
       CASE WHEN s_acctbal < 0 THEN 1.0 ELSE 0.0 END AS fraud_label,""" + PAYMENT.format(k="s_suppkey", b="s_acctbal") + """
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
step("o_raw", """
SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS DATE) AS date,
       SUM(FLOOR(o_totalprice / 1000)) AS consumption_kwh
FROM orders GROUP BY 1, 2""")
step("o_dim", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS customer_type, n_name AS area_id,
       'TR_' || CAST(c_custkey % 70 AS VARCHAR) AS transformer_id, n_name AS city,
       CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END AS fraud_label,""" + PAYMENT.format(k="c_custkey", b="c_acctbal") + """
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
TEMPERATURE = """
       GREATEST(18 - temp_mean, 0) AS heating_degree_days, GREATEST(temp_mean - 24, 0) AS cooling_degree_days,
       CASE WHEN temp_mean < 10 THEN -1 WHEN temp_mean > 26 THEN 1 ELSE 0 END AS weather_class,
       CASE WHEN temp_mean < 10 THEN 1 ELSE 0 END AS is_cold, CASE WHEN temp_mean > 26 THEN 1 ELSE 0 END AS is_hot,
       CASE WHEN temp_mean < 10 OR temp_mean > 26 THEN 1 ELSE 0 END AS weather_demand_pressure"""
step("s_days", """
SELECT CAST(UNNEST(GENERATE_SERIES((SELECT CAST(MIN(l_shipdate) AS DATE) FROM lineitem),
                                   (SELECT CAST(MAX(l_shipdate) AS DATE) FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS date""")
step("w_temp", """
SELECT date, n_name AS city,
       ROUND(16 + n_nationkey % 5 + 11 * COS(2 * PI() * (DAYOFYEAR(date) - 200) / 365.25), 2) AS temp_mean
FROM s_days JOIN nation ON n_nationkey % 5 <> 4""")
step("w", "SELECT date, city, temp_mean," + TEMPERATURE + " FROM w_temp")
step("s_weather", """
SELECT s.customer_id, s.date, s.consumption_kwh, d.customer_type, d.area_id, d.transformer_id, d.city, d.latitude,
       d.longitude, d.meter_age, d.contract_power_kw, d.fraud_label, d.payment_late_count_12m, d.unpaid_bills,
       d.avg_payment_delay_days, d.arrears_amount_lek, d.disconnections_12m, d.months_since_last_payment, d.account_status,
       w.date IS NULL AS from_fallback,
       COALESCE(w.temp_mean, f.temp_mean, 18.0) AS temp_mean,
       COALESCE(w.heating_degree_days, f.heating_degree_days, 0.0) AS heating_degree_days,
       COALESCE(w.cooling_degree_days, f.cooling_degree_days, 0.0) AS cooling_degree_days,
       COALESCE(w.weather_class, f.weather_class, 0) AS weather_class, COALESCE(w.is_cold, f.is_cold, 0) AS is_cold,
       COALESCE(w.is_hot, f.is_hot, 0) AS is_hot,
       COALESCE(w.weather_demand_pressure, f.weather_demand_pressure, 0) AS weather_demand_pressure
FROM s_raw s LEFT JOIN s_dim d ON d.customer_id = s.customer_id
LEFT JOIN w ON w.date = s.date AND w.city = d.city
LEFT JOIN w f ON f.date = s.date AND f.city = 'NATION_0'""")

# ---------------------------------------------------------------- daily context of the S track
WINDOWED = """
SELECT *, CASE WHEN COUNT(*) OVER w7 >= 2 THEN AVG(consumption_kwh) OVER w7 END AS rolling_7d_mean,
       CASE WHEN COUNT(*) OVER w30 >= 7 THEN AVG(consumption_kwh) OVER w30 END AS rolling_30d_mean,
       CASE WHEN COUNT(*) OVER w30 >= 7 THEN STDDEV_SAMP(consumption_kwh) OVER w30 END AS rolling_30d_std,
       MEDIAN(consumption_kwh) OVER (PARTITION BY customer_id) AS own_median
FROM {source}
WINDOW w7 AS (PARTITION BY customer_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY customer_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
LAGGED = """
SELECT *, LAG(rolling_30d_mean, 7) OVER (PARTITION BY customer_id ORDER BY date) AS previous_30d_mean FROM {source}"""
FLAGGED = """
SELECT *, (previous_30d_mean - consumption_kwh) / NULLIF(previous_30d_mean, 0) AS drop_vs_previous_30d_pct,
       (consumption_kwh - previous_30d_mean) / NULLIF(previous_30d_mean, 0) AS spike_vs_previous_30d_pct,
       CASE WHEN (previous_30d_mean - consumption_kwh) / NULLIF(previous_30d_mean, 0) > 0.60 THEN 1 ELSE 0 END AS sudden_drop_flag,
       CASE WHEN (consumption_kwh - previous_30d_mean) / NULLIF(previous_30d_mean, 0) > 1.50 THEN 1 ELSE 0 END AS sudden_spike_flag,
       CASE WHEN consumption_kwh <= 0.05 THEN 1 ELSE 0 END AS zero_flag,
       CASE WHEN consumption_kwh < NULLIF(own_median, 0) * 0.25 THEN 1 ELSE 0 END AS low_relative_flag,
       CASE WHEN COALESCE(rolling_30d_std, 999) < 0.05 AND COALESCE(rolling_30d_mean, 0) > 0 THEN 1 ELSE 0 END AS flatline_flag
FROM {source}"""
step("s_windowed", WINDOWED.format(source="s_weather"))
step("s_lagged", LAGGED.format(source="s_windowed"))
step("s_flagged", FLAGGED.format(source="s_lagged"))
step("s_daily", """
SELECT *, CASE WHEN weather_demand_pressure = 1 AND consumption_kwh < NULLIF(own_median, 0) * 0.35 THEN 1 ELSE 0 END AS low_on_extreme_weather_flag,
       CASE WHEN weather_demand_pressure = 0 AND consumption_kwh > NULLIF(own_median, 0) * 2.25
                 AND COALESCE(previous_30d_mean, 0) > 0 THEN 1 ELSE 0 END AS high_on_normal_weather_flag,
       CASE WHEN (weather_demand_pressure = 1 AND consumption_kwh < NULLIF(own_median, 0) * 0.35)
              OR (weather_demand_pressure = 0 AND consumption_kwh > NULLIF(own_median, 0) * 2.25
                  AND COALESCE(previous_30d_mean, 0) > 0) THEN 1 ELSE 0 END AS weather_consumption_mismatch,
       ABS(temp_mean - 18) AS temperature_abs_deviation,
       CASE WHEN weather_demand_pressure = 1 THEN 1 ELSE 0 END AS weather_expected_high_usage
FROM s_flagged""")

# ---------------------------------------------------------------- customer features
PLACED = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date) AS rn,
       ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY date DESC) AS rn_desc FROM {source}"""
ISLANDS = """
SELECT customer_id, {flag} AS f, SUM(1 - {flag}) OVER (PARTITION BY customer_id ORDER BY date) AS island FROM {source}"""
STREAK = """
SELECT customer_id, MAX(n) AS longest FROM (SELECT customer_id, island, SUM(f) AS n FROM {source} GROUP BY 1, 2) GROUP BY 1"""
step("s_placed", PLACED.format(source="s_daily"))
for _short, _flag in (("z", "zero_flag"), ("l", "low_relative_flag"), ("m", "weather_consumption_mismatch")):
    step(f"s_island_{_short}", ISLANDS.format(flag=_flag, source="s_daily"))
    step(f"s_streak_{_short}", STREAK.format(source=f"s_island_{_short}"))
AGGREGATE = """
       SUM(consumption_kwh) AS total_consumption, AVG(consumption_kwh) AS avg_consumption,
       MEDIAN(consumption_kwh) AS median_consumption, COALESCE(STDDEV_SAMP(consumption_kwh), 0) AS std_consumption,
       MAX(consumption_kwh) AS max_consumption, MIN(consumption_kwh) AS min_consumption,
       COUNT(DISTINCT date) AS days_observed, SUM(zero_flag)::BIGINT AS zero_days, SUM(low_relative_flag)::BIGINT AS low_days,
       SUM(sudden_drop_flag)::BIGINT AS sudden_drop_count, SUM(sudden_spike_flag)::BIGINT AS sudden_spike_count,
       SUM(flatline_flag)::BIGINT AS flatline_days, MAX(date) AS last_date,
       AVG(consumption_kwh) FILTER (WHERE rn_desc <= 30) AS last_30_mean,
       AVG(consumption_kwh) FILTER (WHERE rn_desc BETWEEN 31 AND 120) AS previous_90_mean,
       AVG(consumption_kwh) FILTER (WHERE rn <= 90) AS first_90_mean,
       CASE WHEN COUNT(*) < 3 OR MAX(consumption_kwh) = MIN(consumption_kwh) THEN 0
            ELSE REGR_SLOPE(consumption_kwh, rn) END AS consumption_trend_slope"""
step("s_agg", "SELECT customer_id," + AGGREGATE + """,
       AVG(temp_mean) AS avg_temp_mean, AVG(heating_degree_days) AS avg_heating_degree_days,
       AVG(cooling_degree_days) AS avg_cooling_degree_days, AVG(weather_demand_pressure) AS avg_weather_demand_pressure,
       SUM(weather_consumption_mismatch)::BIGINT AS weather_mismatch_days,
       SUM(low_on_extreme_weather_flag)::BIGINT AS low_extreme_weather_days,
       SUM(high_on_normal_weather_flag)::BIGINT AS high_normal_weather_days,
       SUM(is_cold)::BIGINT AS cold_days, SUM(is_hot)::BIGINT AS hot_days
FROM s_placed GROUP BY customer_id""")
RATIOS = """
       COALESCE(std_consumption / NULLIF(avg_consumption, 0), 0) AS cv_consumption,
       COALESCE(GREATEST((COALESCE(previous_90_mean, first_90_mean) - last_30_mean) / NULLIF(COALESCE(previous_90_mean, first_90_mean), 0), 0), 0) AS recent_drop_pct,
       COALESCE(GREATEST((last_30_mean - COALESCE(previous_90_mean, first_90_mean)) / NULLIF(COALESCE(previous_90_mean, first_90_mean), 0), 0), 0) AS recent_spike_pct,
       COALESCE(zero_days / NULLIF(days_observed, 0)::DOUBLE, 0) AS zero_day_ratio,
       COALESCE(low_days / NULLIF(days_observed, 0)::DOUBLE, 0) AS low_day_ratio,
       COALESCE(flatline_days / NULLIF(days_observed, 0)::DOUBLE, 0) AS flatline_ratio"""
PAID = """
       LEAST(GREATEST((12.0 - payment_late_count_12m) / 12.0, 0), 1) AS payment_on_time_ratio,
       LEAST(GREATEST((0.30 * LEAST(payment_late_count_12m / 12.0, 1) + 0.22 * LEAST(unpaid_bills / 6.0, 1)
           + 0.16 * LEAST(avg_payment_delay_days / 60.0, 1) + 0.12 * LEAST(disconnections_12m / 3.0, 1)
           + 0.10 * LEAST(arrears_amount_lek / 100000.0, 1) + 0.10 * LEAST(months_since_last_payment / 6.0, 1)) * 100
           + 12 * CASE WHEN account_status LIKE '%suspend%' THEN 1.0 WHEN account_status LIKE '%review%' THEN 0.5 ELSE 0 END,
           0), 100) AS payment_risk_score"""
step("s_meta", "SELECT customer_id, ARG_MIN(temp_mean, date) AS temp_mean, ARG_MIN(weather_class, date) AS weather_class FROM s_daily GROUP BY 1")
step("s_features0", "SELECT a.*, d.* EXCLUDE (customer_id), z.longest AS longest_zero_streak, l.longest AS longest_low_streak, m.longest AS longest_weather_mismatch_streak," + RATIOS + "," + PAID + """,
       COALESCE(weather_mismatch_days / NULLIF(days_observed, 0)::DOUBLE, 0) AS weather_mismatch_ratio,
       COALESCE((cold_days + hot_days) / NULLIF(days_observed, 0)::DOUBLE, 0) AS extreme_weather_day_ratio
FROM s_agg a JOIN s_dim d ON d.customer_id = a.customer_id JOIN s_streak_z z ON z.customer_id = a.customer_id
JOIN s_streak_l l ON l.customer_id = a.customer_id JOIN s_streak_m m ON m.customer_id = a.customer_id""")
BANDED = """
SELECT *, CASE WHEN n = 1 THEN 1 ELSE GREATEST(1, (5 * (r - 1) + n - 2) // (n - 1)) END::INTEGER AS consumption_band
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY first_90_mean, customer_id) AS r, COUNT(*) OVER () AS n FROM {source})"""
step("s_banded", BANDED.format(source="s_features0"))
PEERS = """
SELECT customer_type, consumption_band, AVG(last_30_mean) AS peer_avg_last_30, MEDIAN(last_30_mean) AS peer_median_last_30,
       AVG(total_consumption) AS peer_avg_total, COUNT(*) AS peer_count FROM {source} GROUP BY 1, 2"""
step("s_peers", PEERS.format(source="s_banded"))
PEERED = """
SELECT f.*, p.peer_avg_last_30, p.peer_median_last_30, p.peer_avg_total, p.peer_count,
       COALESCE(GREATEST((p.peer_avg_last_30 - f.last_30_mean) / NULLIF(p.peer_avg_last_30, 0), 0), 0) AS peer_deviation_pct,
       COALESCE(f.last_30_mean / NULLIF(p.peer_avg_last_30, 0), 1) AS customer_vs_peer_ratio
FROM {source} f JOIN {peers} p USING (customer_type, consumption_band)"""
step("s_peered", PEERED.format(source="s_banded", peers="s_peers"))
step("s_features", """
SELECT *, (0.35 * LEAST(recent_drop_pct, 1) + 0.20 * LEAST(zero_day_ratio * 4, 1) + 0.20 * LEAST(low_day_ratio * 3, 1)
           + 0.15 * LEAST(flatline_ratio * 4, 1) + 0.10 * LEAST(sudden_drop_count / 20.0, 1)) * 100 AS sudden_behavior_score,
       (0.55 * LEAST(weather_mismatch_ratio * 5, 1) + 0.25 * LEAST(low_extreme_weather_days / 12.0, 1)
           + 0.20 * LEAST(longest_weather_mismatch_streak / 10.0, 1)) * 100 AS weather_context_raw,
       CAST(CAST(customer_id AS BIGINT) * 37 % 101 AS DOUBLE) AS ai_anomaly_score,
       CASE WHEN CAST(customer_id AS BIGINT) % 3 <> 0 THEN CAST(CAST(customer_id AS BIGINT) * 53 % 101 AS DOUBLE) END AS fraud_probability
FROM s_peered""")
step("o_windowed", WINDOWED.format(source="o_raw"))
step("o_lagged", LAGGED.format(source="o_windowed"))
step("o_flagged", FLAGGED.format(source="o_lagged"))
step("o_placed", PLACED.format(source="o_flagged"))
step("o_agg", "SELECT customer_id," + AGGREGATE + " FROM o_placed GROUP BY customer_id")
step("o_banded", BANDED.format(source="(SELECT a.*, d.customer_type FROM o_agg a LEFT JOIN o_dim d ON d.customer_id = a.customer_id)"))
step("o_peers", PEERS.format(source="(SELECT * FROM o_banded WHERE customer_type IS NOT NULL)"))
step("o_peered", PEERED.format(source="o_banded", peers="o_peers").replace("JOIN o_peers", "LEFT JOIN o_peers"))

# ---------------------------------------------------------------- risk of the S track
CLIP = "LEAST(GREATEST({0}, 0), 100)"
LEVEL = "CASE WHEN {0} <= 30 THEN 'Low' WHEN {0} <= 60 THEN 'Medium' WHEN {0} <= 80 THEN 'High' ELSE 'Critical' END"
step("s_components", f"""
SELECT * REPLACE (sudden_behavior_score AS sudden_behavior_score),
       {CLIP.format('55 * LEAST(recent_drop_pct, 1) + 20 * LEAST(low_day_ratio * 3, 1) + 15 * LEAST(zero_day_ratio * 4, 1) + 10 * LEAST(flatline_ratio * 4, 1)')} AS historical_deviation_score,
       {CLIP.format('100 * LEAST(peer_deviation_pct, 1)')} AS peer_deviation_score,
       {CLIP.format('sudden_behavior_score')} AS sudden_flags_score, 0.0 AS context_deviation_score,
       {CLIP.format('weather_context_raw')} AS weather_context_score, {CLIP.format('payment_risk_score')} AS payment_behavior_score,
       CASE WHEN fraud_probability IS NULL THEN ai_anomaly_score ELSE GREATEST(ai_anomaly_score, fraud_probability) END AS ai_combined_score
FROM s_features""")
step("s_prelim", f"""
SELECT *, {CLIP.format('0.32 * ai_combined_score + 0.28 * historical_deviation_score + 0.18 * peer_deviation_score + 0.14 * sudden_flags_score + 0.08 * weather_context_score')} AS preliminary_risk_score
FROM s_components""")


def place(key: str, score: str, high: int, critical: int, extra: str = "") -> str:
    return f"""SELECT {key}, COUNT(*) AS customers, SUM(CASE WHEN {score} >= {high} THEN 1 ELSE 0 END)::BIGINT AS high_risk_customers,
       SUM(CASE WHEN {score} >= {critical} THEN 1 ELSE 0 END)::BIGINT AS critical_customers, AVG({score}) AS mean_score{extra},
       AVG(latitude) AS latitude, AVG(longitude) AS longitude"""


STRETCH = "CASE WHEN MAX({0}) OVER () - MIN({0}) OVER () < 1e-9 THEN 0 ELSE ({0} - MIN({0}) OVER ()) / (MAX({0}) OVER () - MIN({0}) OVER ())::DOUBLE * 100 END"
step("a_pre0", place("area_id", "preliminary_risk_score", 65, 82, ", AVG(ai_anomaly_score) AS avg_ai_anomaly") + " FROM s_prelim GROUP BY 1")
step("a_pre1", f"SELECT *, high_risk_customers / customers::DOUBLE AS anomaly_density, {STRETCH.format('critical_customers')} AS c100 FROM a_pre0")
step("a_pre", f"""SELECT *, {CLIP.format('GREATEST(' + CLIP.format('0.50 * mean_score + 0.40 * anomaly_density * 100 + 0.10 * c100') + ', anomaly_density * 250)')} AS area_risk_score FROM a_pre1""")
step("t_pre0", place("transformer_id", "preliminary_risk_score", 65, 82) + " FROM s_prelim GROUP BY 1")
step("t_pre1", "SELECT *, high_risk_customers / customers::DOUBLE AS transformer_anomaly_density FROM t_pre0")
step("t_pre", f"""SELECT *, {CLIP.format('GREATEST(' + CLIP.format('0.60 * mean_score + 0.40 * transformer_anomaly_density * 100') + ', transformer_anomaly_density * 230)')} AS transformer_risk_score FROM t_pre1""")
step("s_geo", f"""
SELECT p.*, a.area_risk_score, a.anomaly_density, t.transformer_risk_score, t.transformer_anomaly_density,
       {CLIP.format('0.65 * a.area_risk_score + 0.35 * t.transformer_risk_score')} AS geographic_risk_score
FROM s_prelim p JOIN a_pre a USING (area_id) JOIN t_pre t USING (transformer_id)""")
step("s_base", f"""
SELECT *, {CLIP.format('0.26 * ai_combined_score + 0.21 * historical_deviation_score + 0.16 * peer_deviation_score + 0.13 * geographic_risk_score + 0.08 * sudden_flags_score + 0.08 * weather_context_score + 0.08 * payment_behavior_score')} AS base_risk
FROM s_geo""")
step("s_risk", f"""
SELECT *, {CLIP.format('CASE WHEN fraud_probability IS NULL THEN base_risk ELSE GREATEST(base_risk, 0.65 * fraud_probability + 0.35 * base_risk) END')} AS risk_score,
       CASE WHEN previous_90_mean - last_30_mean IS NOT NULL THEN GREATEST(previous_90_mean - last_30_mean, 0) * 30 END AS estimated_missing_kwh_30d,
       CASE WHEN customer_type LIKE '%resid%' AND last_30_mean * 30 <= 700 THEN 8.5 ELSE 9.5 END AS tariff
FROM s_base""")
step("s_scored", f"SELECT *, {LEVEL.format('risk_score')} AS risk_level, estimated_missing_kwh_30d * tariff AS estimated_loss_all_30d FROM s_risk")
PCT = "CAST(CAST(ROUND_EVEN(GREATEST({0}, 0) * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
ONE = "PRINTF('%.1f', ROUND_EVEN({0}, 1))"
INT = "CAST({0} AS VARCHAR)"
PAY_REASON = """CASE WHEN payment_risk_score > 55 OR unpaid_bills >= 3 THEN
    'Irregular billing/payment behavior: ' || CAST(payment_late_count_12m AS VARCHAR) || ' late payments and '
    || CAST(unpaid_bills AS VARCHAR) || ' unpaid bills in 12 months'
    || CASE WHEN arrears_amount_lek > 0 THEN ', arrears ' || FORMAT('{:,}', CAST(ROUND_EVEN(arrears_amount_lek, 0) AS BIGINT)) || ' Lek' ELSE '' END || '.'
  WHEN disconnections_12m >= 1 AND payment_risk_score > 35 THEN
    CAST(disconnections_12m AS VARCHAR) || ' non-payment disconnection(s) on record — verify reconnection and meter integrity.' END"""
step("s_reasoned", f"""
SELECT *, [x FOR x IN [
  CASE WHEN payment_risk_score >= 70 THEN {PAY_REASON} END,
  CASE WHEN recent_drop_pct > 0.45 THEN 'Recent consumption dropped ' || {PCT.format('recent_drop_pct')} || ' compared with the customer''s previous baseline.' END,
  CASE WHEN peer_deviation_pct > 0.35 THEN 'Customer consumes ' || {PCT.format('peer_deviation_pct')} || ' less than similar consumption profiles.' END,
  CASE WHEN zero_day_ratio > 0.08 OR longest_zero_streak >= 5 THEN 'Detected ' || {INT.format('zero_days')} || ' zero/near-zero consumption days, longest streak ' || {INT.format('CAST(longest_zero_streak AS BIGINT)')} || ' days.' END,
  CASE WHEN flatline_ratio > 0.08 OR flatline_days >= 10 THEN 'Detected flat or almost constant readings for ' || {INT.format('flatline_days')} || ' days.' END,
  CASE WHEN sudden_drop_count >= 5 THEN 'Detected ' || {INT.format('sudden_drop_count')} || ' sudden daily drop events.' END,
  CASE WHEN ai_anomaly_score > 75 THEN 'AI anomaly model assigned a high anomaly score of ' || {ONE.format('ai_anomaly_score')} || '/100.' END,
  CASE WHEN area_risk_score > 65 THEN 'Customer is located in a high-risk area with area risk ' || {ONE.format('area_risk_score')} || '/100.' END,
  CASE WHEN transformer_risk_score > 65 THEN 'Transformer zone shows concentrated anomalies with transformer risk ' || {ONE.format('transformer_risk_score')} || '/100.' END,
  CASE WHEN weather_mismatch_ratio > 0.08 OR weather_context_score > 55 THEN 'Weather context mismatch detected: ' || {INT.format('weather_mismatch_days')} || ' days where consumption did not match cold/hot demand expectations.' END,
  CASE WHEN payment_risk_score < 70 THEN {PAY_REASON} END
] IF x IS NOT NULL] AS found,
  CASE WHEN zero_day_ratio > 0.08 OR longest_zero_streak >= 5 THEN 'Verify physical meter reading, check disconnection/bypass possibility, inspect wiring and meter communication.'
       WHEN flatline_ratio > 0.08 THEN 'Inspect meter integrity and data reporting; verify whether readings are frozen, estimated, or manipulated.'
       WHEN recent_drop_pct > 0.45 AND peer_deviation_pct > 0.35 THEN 'Inspect meter seal, wiring, and possible bypass; compare physical reading with billing system.'
       WHEN weather_mismatch_ratio > 0.08 THEN 'Verify meter reading during recent cold/hot demand periods and compare with neighboring customers under the same weather conditions.'
       WHEN area_risk_score > 65 THEN 'Prioritize field inspection together with nearby high-risk customers in the same area/transformer zone.'
       WHEN payment_risk_score > 60 OR unpaid_bills >= 4 THEN 'Combine collection and inspection: cross-check billing/payment history against metered consumption and verify the meter during a collection visit.'
       ELSE 'Monitor customer and schedule verification if the pattern continues.' END AS recommended_action
FROM s_scored""")
step("c_all", """
SELECT *, CASE WHEN LEN(found) > 0 THEN found[1] ELSE 'No severe suspicious pattern detected; customer behavior is close to historical and peer baseline.' END AS main_reason,
       CASE WHEN LEN(found) > 0 THEN ARRAY_TO_STRING(found[1:6], ' | ') ELSE 'No severe suspicious pattern detected; customer behavior is close to historical and peer baseline.' END AS alert_explanation
FROM s_reasoned""")
step("a_fin0", place("area_id", "risk_score", 61, 81, ", AVG(ai_anomaly_score) AS avg_ai_anomaly, SUM(estimated_loss_all_30d) AS estimated_loss_all_30d") + " FROM c_all GROUP BY 1")
step("a_fin1", f"SELECT *, high_risk_customers / customers::DOUBLE AS anomaly_density, {STRETCH.format('critical_customers')} AS c100 FROM a_fin0")
step("a_fin2", f"""SELECT *, {CLIP.format('GREATEST(' + CLIP.format('0.50 * mean_score + 0.35 * anomaly_density * 100 + 0.15 * c100') + ', anomaly_density * 250)')} AS area_risk_score FROM a_fin1""")
step("a_all", f"SELECT *, {LEVEL.format('area_risk_score')} AS area_risk_level FROM a_fin2")
step("q_scored", f"""
SELECT *, {CLIP.format('0.55 * risk_score + 0.25 * loss100 + 0.20 * geographic_risk_score')} AS inspection_priority_score
FROM (SELECT *, {STRETCH.format('COALESCE(estimated_loss_all_30d, 0)')} AS loss100 FROM c_all)""")
step("q_all", """
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY inspection_priority_score DESC, customer_id) AS priority_rank FROM q_scored)
WHERE priority_rank <= 200""")

# ================================================================ queries: sources and detection
oracle_sql("src_3", f"SELECT user_id, {r('value')} AS value FROM events WHERE event_id % 3 <> 0")
step("invoices", """
SELECT CAST(l_suppkey AS VARCHAR) AS client_id, CAST(l_shipdate AS DATE) AS invoice_date, l_returnflag, l_linenumber,
       l_quantity AS level_1, l_quantity / 2 AS level_2 FROM lineitem""")
step("born", "SELECT s_suppkey, DATE '1990-01-01' + CAST(s_suppkey % 3000 AS INTEGER) AS created, s_nationkey, s_acctbal FROM supplier")
oracle_sql("invoice_to_readings", f"""
SELECT client_id AS customer_id, invoice_date AS date,
       {r('(level_1 + level_2) / CASE WHEN l_linenumber = 7 THEN 1 ELSE l_linenumber END')} AS consumption_kwh,
       CASE WHEN s_acctbal < 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fraud_label,
       'DISTRICT_' || CAST(s_nationkey AS VARCHAR) AS area_id, 'REGION_' || CAST(s_nationkey % 5 AS VARCHAR) AS transformer_id,
       'category_' || CAST(s_suppkey % 3 AS VARCHAR) AS customer_type,
       {r("GREATEST(DATE_DIFF('day', created, invoice_date) / 365.25, 0)")} AS meter_age
FROM invoices JOIN born ON CAST(s_suppkey AS VARCHAR) = client_id WHERE l_returnflag <> 'R'""")
oracle_sql("src_5", "SELECT client_id, COUNT(*) AS rows FROM invoices WHERE l_returnflag <> 'R' GROUP BY client_id")
step("customer_cells", """
SELECT 'c_custkey' AS "column", CAST(c_custkey AS VARCHAR) AS t FROM customer UNION ALL SELECT 'c_name', c_name FROM customer
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer""")
step("customer_cell_stats", """
SELECT "column", COUNT(DISTINCT t) / COUNT(*)::DOUBLE AS unique_ratio, AVG(LENGTH(t)) AS avg_length,
       AVG(CASE WHEN REGEXP_MATCHES(t, '[A-Za-z]') THEN 1.0 ELSE 0.0 END) AS letter_share,
       AVG(CASE WHEN TRY_CAST(t AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS number_share
FROM customer_cells GROUP BY "column\"""")
oracle_sql("infer_id_column", f"""
SELECT "column", {rounded('~unique_ratio, ~avg_length, ~letter_share, ~number_share')},
       {r('unique_ratio * 2 + LEAST(avg_length / 20, 1) + letter_share - number_share * 0.25')} AS score
FROM customer_cell_stats""")
step("event_cells", """
SELECT 'event_id' AS "column", CAST(event_id AS VARCHAR) AS t, event_id::DOUBLE AS v, FALSE AS is_day FROM events
UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), user_id::DOUBLE, FALSE FROM events
UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), NULL, TRUE FROM events
UNION ALL SELECT 'event_type', event_type, NULL, FALSE FROM events
UNION ALL SELECT 'value', CAST(value AS VARCHAR), value, FALSE FROM events
UNION ALL SELECT 'mark', CAST(user_id % 2 AS VARCHAR), (user_id % 2)::DOUBLE, FALSE FROM events""")
step("event_cell_stats", """
SELECT "column", COUNT(*) AS "values", COUNT(DISTINCT t) AS distinct_values, AVG(CASE WHEN is_day THEN 1.0 ELSE 0 END) AS date_share,
       AVG(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0 END) AS number_share, AVG(CASE WHEN v >= 0 THEN 1.0 ELSE 0 END) AS non_negative_share,
       AVG(CASE WHEN v = FLOOR(v) THEN 1.0 ELSE 0 END) AS whole_share, AVG(CASE WHEN v IN (0, 1) THEN 1.0 ELSE 0 END) AS zero_one_share
FROM event_cells GROUP BY "column\"""")
oracle_sql("infer_roles", f"""
SELECT "column", "values", distinct_values, {rounded('~date_share, ~number_share, ~non_negative_share, ~whole_share, ~zero_one_share')},
       {r('distinct_values / "values"::DOUBLE')} AS unique_ratio,
       CASE WHEN date_share >= 0.9 THEN 'date' WHEN zero_one_share = 1 AND distinct_values <= 2 THEN 'label'
            WHEN non_negative_share >= 0.9 AND whole_share < number_share THEN 'consumption'
            WHEN distinct_values = "values" OR (whole_share >= 0.9 AND non_negative_share >= 0.9) THEN 'id'
            WHEN number_share < 0.5 THEN 'category' ELSE 'other' END AS role
FROM event_cell_stats""")
step("profiled", """
SELECT user_id, event_type, CASE WHEN event_id % 53 <> 0 THEN FLOOR(value) END AS value, COUNT(*) AS n FROM events GROUP BY 1, 2, 3""")
oracle_sql("profile_table", f"""
SELECT SUM(n)::BIGINT AS rows, 3 AS columns, SUM(CASE WHEN value IS NULL THEN n ELSE 0 END)::BIGINT AS missing_cells,
       {r('ROUND(SUM(CASE WHEN value IS NULL THEN n ELSE 0 END) * 100.0 / (SUM(n) * 3), 2)')} AS missing_percent,
       SUM(n - 1)::BIGINT AS duplicate_rows, 0 AS detected_date_columns, 2 AS numeric_columns FROM profiled""")
oracle_sql("wide_to_long", f"""
SELECT customer_id, date, {r('ROUND(v, 2)')} AS consumption_kwh, fraud_label
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS customer_id, CASE WHEN user_id % 9 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fraud_label FROM events)
JOIN (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) ON TRUE
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(ts AS DATE) AS date, SUM(value) AS v FROM events GROUP BY 1, 2) USING (customer_id, date)""")
oracle("sch_8", "customer_id, date, ~consumption_kwh, ~fraud_label", "FROM e_raw")
oracle("cln_2", "customer_id, date, ~consumption_kwh, ~fraud_label", "FROM e_raw")

# ---------------------------------------------------------------- cleaning
oracle("cln_7", "customer_id, date, ~consumption_kwh", "FROM o_raw WHERE date >= (SELECT MAX(date) FROM o_raw) - 365")
oracle_sql("cln_8", "SELECT TRIM(customer_id) AS customer_id, COUNT(*) AS rows FROM e_raw WHERE LENGTH(TRIM(customer_id)) > 0 GROUP BY 1")
oracle_sql("cln_9", "SELECT date, COUNT(*) AS rows FROM e_raw WHERE LENGTH(TRIM(customer_id)) > 0 GROUP BY 1")
oracle("coerce_numeric", "sequence, ~consumption_kwh", "FROM e_raw")
oracle("merge_duplicates", "customer_id, date, ~consumption_kwh, ~fraud_label, copies", "FROM e_merged")
oracle_sql("cln_12", f"SELECT sequence, {r('CASE WHEN consumption_kwh >= 0 THEN consumption_kwh END')} AS consumption_kwh FROM e_typed")
step("e_capped", "SELECT customer_id, date, CASE WHEN consumption_kwh > cap THEN cap ELSE consumption_kwh END AS consumption_kwh FROM e_positive, e_cap")
oracle("cap_outliers", "customer_id, date, ~consumption_kwh", "FROM e_capped")
step("e_own", "SELECT p.customer_id, p.date, COALESCE(p.consumption_kwh, m) AS kwh FROM e_positive p JOIN e_median u ON u.customer_id = p.customer_id")
oracle_sql("fill_missing", f"SELECT customer_id, date, {r('COALESCE(kwh, (SELECT MEDIAN(kwh) FROM e_own), 0)')} AS consumption_kwh FROM e_own")
oracle_sql("cln_15", f"""
SELECT customer_id, date, {r('FIRST_VALUE(fraud_label IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS fraud_label
FROM e_positive""")
step("e_valid", "SELECT TRIM(customer_id) AS customer_id, date, consumption_kwh, sequence, fraud_label FROM e_raw WHERE LENGTH(TRIM(customer_id)) > 0")
step("e_first", """
SELECT customer_id, date, ARG_MIN(l, sequence) FILTER (WHERE l IS NOT NULL) AS l
FROM (SELECT *, CASE WHEN sequence % 4 = 0 THEN CASE WHEN sequence % 8 = 0 THEN 1.0 ELSE 0.0 END END AS l FROM e_valid WHERE date IS NOT NULL) GROUP BY 1, 2""")
oracle_sql("pipeline_labels", f"""
SELECT customer_id, date, {r('FIRST_VALUE(l IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS fraud_label FROM e_first""")
step("e_lab", "SELECT customer_id, date, ARG_MIN(fraud_label, sequence) FILTER (WHERE fraud_label IS NOT NULL) AS l FROM e_valid WHERE date IS NOT NULL GROUP BY 1, 2")
step("sampled", "SELECT customer_id FROM (SELECT DISTINCT customer_id FROM o_raw) ORDER BY MD5(customer_id || ':42'), customer_id LIMIT 100")
oracle("sample_customers", "customer_id, date, ~consumption_kwh", "FROM o_raw SEMI JOIN sampled USING (customer_id)")
oracle_sql("stratified_split", f"""
SELECT {r('l')} AS fraud_label, h AS is_holdout, COUNT(*) AS rows
FROM (SELECT l, n <= ROUND(0.25 * COUNT(*) OVER (PARTITION BY l)) AS h
      FROM (SELECT fraud_label AS l, ROW_NUMBER() OVER (PARTITION BY fraud_label ORDER BY customer_id) AS n FROM o_dim)) GROUP BY 1, 2""")
step("clients", """
SELECT CAST(s_suppkey AS VARCHAR) AS client_id, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS target, s_nationkey AS disrict, s_nationkey % 5 AS region,
       s_suppkey % 3 AS client_catg, STRFTIME(DATE '1990-01-01' + CAST(s_suppkey % 3000 AS INTEGER), '%d/%m/%Y') AS creation_date FROM supplier""")
step("client_order", "SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY MD5(client_id || ':42'), client_id) AS place FROM clients")
step("client_pool", "SELECT *, CASE WHEN target = 1 AND place <= 14 THEN 0 WHEN target = 0 THEN 1 ELSE 2 END AS choice FROM client_order")
step("client_sample", "SELECT client_id, target, disrict, region, client_catg, creation_date FROM client_pool ORDER BY choice, place, client_id LIMIT 40")
oracle_sql("sample_balanced", "SELECT * FROM client_sample")
oracle_sql("jn_10", "SELECT * FROM clients ANTI JOIN client_sample USING (client_id)")
step("e_vm", "SELECT customer_id, date, AVG(consumption_kwh) AS kwh, COUNT(*) AS copies FROM e_valid WHERE date IS NOT NULL GROUP BY 1, 2")
step("e_vp", "SELECT *, CASE WHEN kwh >= 0 THEN kwh END AS kept FROM e_vm")
step("e_vc", "SELECT QUANTILE_CONT(kept, 0.995) AS cap FROM e_vp")
step("e_vf", """
SELECT p.customer_id, p.date, COALESCE(CASE WHEN cap > 0 AND kept > cap THEN cap ELSE kept END, MEDIAN(CASE WHEN cap > 0 AND kept > cap THEN cap ELSE kept END) OVER (PARTITION BY p.customer_id)) AS kwh
FROM e_vp p, e_vc""")
oracle_sql("cln_16", f"""
SELECT f.customer_id, f.date, {r('COALESCE(kwh, (SELECT MEDIAN(kwh) FROM e_vf), 0)')} AS consumption_kwh,
       {r('FIRST_VALUE(l IGNORE NULLS) OVER (PARTITION BY f.customer_id ORDER BY f.date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS fraud_label
FROM e_vf f JOIN e_lab b ON b.customer_id = f.customer_id AND b.date = f.date""")
step("e_counts", """
SELECT (SELECT COUNT(*) FROM e_raw) AS initial_rows, (SELECT COUNT(*) FROM e_valid WHERE date IS NULL) AS invalid_dates_removed,
       COUNT(*) AS clean_rows, COUNT(DISTINCT customer_id) AS customers, MIN(date) AS date_min, MAX(date) AS date_max,
       (SUM(copies) - COUNT(*))::BIGINT AS duplicate_customer_date_readings_merged,
       COUNT(*) FILTER (WHERE kwh < 0) AS negative_values_replaced, COUNT(*) FILTER (WHERE kept IS NULL) AS missing_consumption_filled,
       COUNT(*) FILTER (WHERE kept > (SELECT cap FROM e_vc)) AS extreme_values_capped, (SELECT cap FROM e_vc) AS cap_value_99_5_percentile,
       (SELECT MEDIAN(n) FROM (SELECT COUNT(DISTINCT date) AS n FROM e_vm GROUP BY customer_id)) AS median_history_days_per_customer
FROM e_vp""")
oracle_sql("readiness_report", f"""
SELECT * REPLACE ({r('cap_value_99_5_percentile')} AS cap_value_99_5_percentile,
                  {r('median_history_days_per_customer')} AS median_history_days_per_customer),
       {r('''ROUND((0.30 * (1 - LEAST(missing_consumption_filled / initial_rows::DOUBLE, 1)) + 0.25 * (1 - LEAST(invalid_dates_removed / initial_rows::DOUBLE, 1))
       + 0.20 * (1 - LEAST(duplicate_customer_date_readings_merged / initial_rows::DOUBLE, 1))
       + 0.25 * LEAST(median_history_days_per_customer / 90.0, 1)) * 100, 1)''')} AS data_readiness_score
FROM e_counts""")

# ---------------------------------------------------------------- joins
oracle_sql("jn_1", f"""
SELECT 'DISTRICT_' || CAST(s_nationkey AS VARCHAR) AS area_id, 'REGION_' || CAST(s_nationkey % 5 AS VARCHAR) AS transformer_id,
       {r('SUM(level_1)')} AS kwh, COUNT(*) AS rows FROM invoices JOIN born ON CAST(s_suppkey AS VARCHAR) = client_id GROUP BY 1, 2""")
oracle_sql("attach_metadata", f"""
SELECT o.customer_id, date, {r('consumption_kwh')} AS consumption_kwh, customer_type, area_id, transformer_id, {r('fraud_label')} AS fraud_label
FROM o_raw o LEFT JOIN o_dim d ON d.customer_id = o.customer_id""")
WEATHER = "customer_id, date, city, ~temp_mean, ~heating_degree_days, ~cooling_degree_days, weather_class, is_cold, is_hot, weather_demand_pressure"
oracle("attach_weather", WEATHER, "FROM s_weather")
oracle("jn_4", WEATHER, "FROM s_weather WHERE from_fallback")
NORMAL = """CASE city WHEN 'Tirana' THEN 16.2 ELSE 16.2 END + 10.7 * COS(2 * PI() * (DAYOFYEAR(date) - 200) / 365.25)"""
step("s_normal", f"""
SELECT date, city, ROUND({NORMAL}, 2) AS temp_mean
FROM (SELECT DISTINCT city FROM s_dim WHERE customer_id IN (SELECT customer_id FROM s_raw)) JOIN s_days ON TRUE""")
step("s_extended", "SELECT date, city, temp_mean FROM w UNION ALL SELECT date, city, temp_mean FROM s_normal n WHERE NOT EXISTS (SELECT 1 FROM w_temp x WHERE x.city = n.city AND x.date = n.date)")
oracle_sql("extend_weather_duplicates", f"""
SELECT d.city, COUNT(*) AS readings, {r('AVG(x.temp_mean)')} AS temp_mean
FROM s_raw s JOIN s_dim d ON d.customer_id = s.customer_id JOIN s_extended x ON x.city = d.city AND x.date = s.date GROUP BY 1""")
oracle_sql("jn_5", f"SELECT date, city, {r('temp_mean')} AS temp_mean, CASE WHEN temp_mean < 10 THEN -1 WHEN temp_mean > 26 THEN 1 ELSE 0 END AS weather_class FROM s_extended")
oracle("jn_6", "customer_id, ~last_30_mean, ~avg_temp_mean, longest_low_streak::INTEGER AS longest_low_streak, ~consumption_trend_slope, area_id, ~meter_age, account_status", "FROM s_features0")
PEER = "customer_type, consumption_band, ~peer_avg_last_30, ~peer_median_last_30, ~peer_avg_total, peer_count"
oracle("peer_stats", PEER, "FROM o_peers")
oracle("agg_12", PEER, "FROM s_peers")
oracle("geo_risk", "customer_id, ~area_risk_score, ~anomaly_density, ~transformer_risk_score, ~transformer_anomaly_density, ~geographic_risk_score", "FROM s_geo")
oracle("jn_9", "customer_id, date, ~consumption_kwh", "FROM o_raw WHERE customer_id IN (SELECT customer_id FROM o_dim WHERE fraud_label = 1)")
oracle_sql("jn_11", f"SELECT {r('fraud_label')} AS fraud_label, COUNT(*) AS rows, {r('SUM(consumption_kwh)')} AS kwh FROM s_raw s LEFT JOIN s_dim d ON d.customer_id = s.customer_id GROUP BY fraud_label")

# ---------------------------------------------------------------- daily context
oracle_sql("calendar", """
SELECT customer_id, date, MONTH(date)::INTEGER AS month, (ISODOW(date) - 1)::INTEGER AS day_of_week,
       CASE WHEN MONTH(date) IN (12, 1, 2) THEN 'winter' WHEN MONTH(date) IN (3, 4, 5) THEN 'spring'
            WHEN MONTH(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM s_raw""")
for _name, _columns in {
    "rolling_7": "~rolling_7d_mean", "rolling_30": "~rolling_30d_mean", "rolling_std_30": "~rolling_30d_std",
    "lag_baseline": "~previous_30d_mean",
    "drop_spike": "~drop_vs_previous_30d_pct, ~spike_vs_previous_30d_pct, sudden_drop_flag, sudden_spike_flag",
    "zero_flag": "zero_flag", "low_relative": "low_relative_flag", "flatline": "flatline_flag",
    "day_10": "~temperature_abs_deviation, weather_expected_high_usage", "low_extreme": "low_on_extreme_weather_flag",
    "high_normal": "high_on_normal_weather_flag", "weather_mismatch": "weather_consumption_mismatch",
}.items():
    oracle(_name, "customer_id, date, " + _columns, "FROM s_daily")
oracle_sql("day_14", f"""
SELECT 0 AS weather_demand_pressure, 0 AS weather_class, {r('0.0')} AS temperature_abs_deviation, {r('0.0')} AS heating_degree_days,
       0 AS is_cold, 0 AS weather_consumption_mismatch, COUNT(*) AS rows FROM o_raw""")
oracle("classify_weather", "date, city, ~temp_mean, weather_class", "FROM w")
oracle("degree_days", "date, city, ~temp_mean, ~heating_degree_days, ~cooling_degree_days, weather_class, is_cold, is_hot, weather_demand_pressure", "FROM w")
oracle_sql("climatology", f"""
SELECT date, city, {r('t')} AS temp_mean, {r('GREATEST(18 - t, 0)')} AS heating_degree_days
FROM (SELECT date, city, ROUND(base + amplitude * COS(2 * PI() * (DAYOFYEAR(date) - 200) / 365.25), 2) AS t
      FROM (VALUES ('Tirana', 16.2, 10.7), ('Durres', 16.7, 9.5), ('Shkoder', 15.8, 10.1), ('Vlore', 17.4, 9.1), ('Elbasan', 16.0, 11.2),
                   ('Fier', 16.8, 10.0), ('Korce', 11.9, 12.0), ('Kukes', 11.6, 12.4)) v(city, base, amplitude)
      JOIN (SELECT CAST(UNNEST(GENERATE_SERIES((SELECT CAST(MIN(o_orderdate) AS DATE) FROM orders),
                        (SELECT CAST(MAX(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date) ON TRUE)""")

# ---------------------------------------------------------------- customer features
oracle("customer_agg", "customer_id, ~total_consumption, ~avg_consumption, ~median_consumption, ~std_consumption, ~max_consumption, ~min_consumption, days_observed, zero_days, low_days, sudden_drop_count, sudden_spike_count, flatline_days, last_date", "FROM s_agg")
oracle("cv", "customer_id, ~cv_consumption", "FROM s_features0")
oracle("recent_change", "customer_id, ~recent_drop_pct, ~recent_spike_pct", "FROM s_features0")
oracle("day_ratios", "customer_id, ~zero_day_ratio, ~low_day_ratio, ~flatline_ratio", "FROM s_features0")
oracle("period_means", "customer_id, ~last_30_mean, ~previous_90_mean, ~first_90_mean", "FROM s_agg")
oracle("weather_agg", "customer_id, days_observed, ~avg_temp_mean, ~avg_heating_degree_days, ~avg_cooling_degree_days, ~avg_weather_demand_pressure, weather_mismatch_days, low_extreme_weather_days, high_normal_weather_days, cold_days, hot_days, ~weather_mismatch_ratio, ~extreme_weather_day_ratio", "FROM s_features0")
oracle_sql("longest_streak", """
SELECT z.customer_id, z.longest::INTEGER AS longest_zero_streak, l.longest::INTEGER AS longest_low_streak, m.longest::INTEGER AS longest_weather_mismatch_streak
FROM s_streak_z z JOIN s_streak_l l USING (customer_id) JOIN s_streak_m m USING (customer_id)""")
oracle("trend_slope", "customer_id, ~consumption_trend_slope", "FROM s_agg")
oracle_sql("first_meta", f"""
SELECT {rounded('customer_id, customer_type, area_id, transformer_id, ~latitude, ~longitude, city, ~meter_age, ~contract_power_kw, ~fraud_label')},
       {rounded('~temp_mean, weather_class, payment_late_count_12m::INTEGER AS payment_late_count_12m, unpaid_bills::INTEGER AS unpaid_bills, ~avg_payment_delay_days, ~arrears_amount_lek')},
       {rounded('disconnections_12m::INTEGER AS disconnections_12m, ~months_since_last_payment, account_status')}
FROM s_dim JOIN s_meta USING (customer_id)""")
oracle_sql("payment_risk", f"SELECT customer_id, {rounded('~payment_on_time_ratio, ~payment_risk_score')} FROM (SELECT customer_id,{PAID} FROM o_dim)")
oracle("consumption_band", "customer_id, ~first_90_mean, consumption_band", "FROM o_banded")
oracle("peer_deviation", "customer_id, ~peer_deviation_pct, ~customer_vs_peer_ratio", "FROM o_peered")
oracle("sudden_score", "customer_id, ~sudden_behavior_score", "FROM s_features")
oracle_sql("weather_score", f"SELECT customer_id, {r('weather_context_raw')} AS weather_context_score FROM s_features")

# ---------------------------------------------------------------- quality of scores
step("so", "SELECT o_orderkey AS id, FLOOR(o_totalprice / 1000) AS score, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS y FROM orders")
step("so_ranked", "SELECT y, score, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM so")
oracle_sql("roc_auc", f"""
SELECT {r('(SUM(mid * y) - SUM(y) * (SUM(y) + 1) / 2.0) / (SUM(y) * (COUNT(*) - SUM(y)))')} AS roc_auc FROM so_ranked""")
step("so_steps", "SELECT score, SUM(y) AS ones, SUM(SUM(y)) OVER (ORDER BY score DESC) AS ones_to, SUM(COUNT(*)) OVER (ORDER BY score DESC) AS n_to FROM so GROUP BY score")
oracle_sql("average_precision", f"SELECT {r('SUM(ones * ones_to / n_to::DOUBLE) / SUM(ones)')} AS average_precision FROM so_steps")
step("so_top", "SELECT y, ROW_NUMBER() OVER (ORDER BY score DESC, id) <= GREATEST(1, CEIL(0.1 * (SELECT COUNT(*) FROM so))) AS top FROM so")
oracle_sql("topk_metrics", f"""
SELECT {r('AVG(y) FILTER (WHERE top)')} AS precision_at_top_10_percent, {r('SUM(y) FILTER (WHERE top) / GREATEST(SUM(y), 1)::DOUBLE')} AS recall_at_top_10_percent,
       {r('AVG(y)')} AS holdout_positive_rate FROM so_top""")
oracle_sql("mae", f"SELECT {r('AVG(ABS(l_quantity - l_extendedprice / 3000))')} AS mae FROM lineitem")
oracle_sql("r2", f"""
SELECT {r('1 - SUM(POW(l_quantity - l_extendedprice / 3000, 2)) / (COUNT(*) * VAR_POP(l_quantity))')} AS r2 FROM lineitem""")

# ---------------------------------------------------------------- risk
oracle_sql("minmax_100", f"SELECT c_custkey, {r(STRETCH.format('c_acctbal'))} AS scaled FROM customer")
oracle("tariff", "customer_id, ~tariff", "FROM s_risk")
oracle("prelim_risk", "customer_id, ~historical_deviation_score, ~peer_deviation_score, ~sudden_flags_score, ~context_deviation_score, ~weather_context_score, ~payment_behavior_score, ~ai_combined_score, ~preliminary_risk_score", """
FROM (SELECT customer_id, historical_deviation_score, peer_deviation_score, sudden_flags_score, context_deviation_score, weather_context_score,
      payment_behavior_score, ai_combined_score, preliminary_risk_score FROM s_prelim)""")
oracle_sql("area_risk_pre", f"""
SELECT area_id, customers, high_risk_customers, critical_customers, {r('mean_score')} AS avg_preliminary_risk,
       {rounded('~avg_ai_anomaly, ~latitude, ~longitude, ~anomaly_density, ~area_risk_score')}, {LEVEL.format('area_risk_score')} AS area_risk_level FROM a_pre""")
oracle_sql("transformer_risk", f"""
SELECT transformer_id, customers, high_risk_customers, {r('mean_score')} AS avg_preliminary_risk,
       {rounded('~latitude, ~longitude, ~transformer_anomaly_density, ~transformer_risk_score')} FROM t_pre""")
oracle("final_risk", "customer_id, ~geographic_risk_score, ~risk_score, risk_level", "FROM s_scored")
oracle_sql("risk_level", f"SELECT o_orderkey, {LEVEL.format('o_totalprice / 5000')} AS risk_level FROM orders")
oracle("estimated_loss", "customer_id, ~estimated_missing_kwh_30d, ~estimated_loss_all_30d", "FROM s_scored")
oracle("inspection_priority", "priority_rank::INTEGER AS priority_rank, customer_id, ~risk_score, risk_level, ~inspection_priority_score, area_id, transformer_id, ~latitude, ~longitude, ~estimated_loss_all_30d, ~weather_context_score, ~weather_mismatch_ratio, main_reason, recommended_action", "FROM q_all")
oracle_sql("area_risk", f"""
SELECT area_id, customers, high_risk_customers, critical_customers, {r('mean_score')} AS avg_risk_score,
       {rounded('~avg_ai_anomaly, ~estimated_loss_all_30d, ~latitude, ~longitude, ~anomaly_density, ~area_risk_score, area_risk_level')} FROM a_all""")
step("c_high", "SELECT customer_id FROM c_all WHERE risk_score >= 61 ORDER BY risk_score DESC, customer_id LIMIT 500")
step("c_best", "SELECT customer_id FROM c_all ORDER BY risk_score DESC, customer_id LIMIT 30")
step("c_chosen", "SELECT customer_id FROM c_high UNION SELECT customer_id FROM c_best WHERE (SELECT COUNT(*) FROM c_high) < 30")
oracle("daily_subset", "customer_id, date, ~consumption_kwh", "FROM s_raw SEMI JOIN c_chosen USING (customer_id)")
oracle("rsk_12", "customer_id, ~preliminary_risk_score, ~geographic_risk_score, ~risk_score, risk_level, ~estimated_missing_kwh_30d, ~estimated_loss_all_30d, main_reason, recommended_action, alert_explanation", "FROM c_all")
oracle_sql("register_kpis", f"SELECT COUNT(*) AS customers, {r('AVG(risk_score)')} AS average_risk, {r('COALESCE(SUM(estimated_loss_all_30d), 0)')} AS estimated_loss FROM c_all")

# ---------------------------------------------------------------- explanations and maps
oracle("reasons", "customer_id, main_reason", "FROM c_all")
oracle_sql("exp_2", f"SELECT customer_id, {PAY_REASON} AS payment_reason FROM (SELECT *,{PAID} FROM o_dim)")
oracle("action", "customer_id, recommended_action", "FROM c_all")
oracle("exp_4", "customer_id, alert_explanation", "FROM c_all")
ON_MAP = "latitude BETWEEN 39.60 AND 42.75 AND longitude BETWEEN 18.80 AND 21.10 AND NOT (longitude < 19.30 AND latitude BETWEEN 39.70 AND 42.30)"
COLOR = "CASE WHEN {0} >= 81 THEN 'red' WHEN {0} >= 61 THEN 'orange' WHEN {0} >= 31 THEN 'yellow' ELSE 'green' END"
oracle("valid_geo", "customer_id, ~latitude, ~longitude", f"FROM s_dim WHERE {ON_MAP}")
oracle_sql("risk_color", f"SELECT o_orderkey, {COLOR.format('o_totalprice / 5000')} AS color FROM orders")
oracle_sql("customer_geojson", f"""
SELECT {rounded('customer_id, ~longitude, ~latitude')}, {r('ROUND(risk_score, 2)')} AS risk_score, risk_level, area_id, transformer_id,
       {COLOR.format('risk_score')} AS color FROM c_all WHERE risk_score >= 30 AND {ON_MAP}""")
oracle_sql("area_geojson", f"""
SELECT {rounded('area_id, ~longitude, ~latitude')}, {r('ROUND(area_risk_score, 2)')} AS area_risk_score, area_risk_level, customers,
       high_risk_customers, critical_customers, {r('ROUND(anomaly_density, 3)')} AS anomaly_density, {COLOR.format('area_risk_score')} AS color
FROM a_all WHERE {ON_MAP}""")
step("stops", f"SELECT longitude, latitude, ROW_NUMBER() OVER (ORDER BY priority_rank) AS stop FROM q_all WHERE {ON_MAP}")
oracle_sql("inspection_route", f"""
SELECT (SELECT COUNT(*) FROM stops WHERE stop <= 25)::INTEGER AS points, stop::INTEGER AS stop, {rounded('~longitude, ~latitude')}
FROM stops WHERE stop <= 25 AND (SELECT COUNT(*) FROM stops) >= 2""")
oracle_sql("heat_weights", f"""
SELECT {rounded('~latitude, ~longitude')}, {r(f'risk_score / GREATEST((SELECT MAX(risk_score) FROM c_all WHERE {ON_MAP}), 1)')} AS weight FROM c_all WHERE {ON_MAP}""")
oracle_sql("geo_7", f"SELECT {r('MEDIAN(latitude)')} AS latitude, {r('MEDIAN(longitude)')} AS longitude FROM s_dim WHERE {ON_MAP}")
oracle_sql("geo_8", f"SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE NOT ({ON_MAP})) AS off_map FROM s_dim")
oracle("top_points", "customer_id, ~latitude, ~longitude, ~risk_score, risk_level, main_reason", f"""
FROM (SELECT * FROM c_all WHERE {ON_MAP} ORDER BY risk_score DESC, customer_id LIMIT 500)""")

# ---------------------------------------------------------------- forecast and audit
step("ev", """
SELECT date, AVG(consumption_kwh) AS average_consumption, SUM(zero_flag)::DOUBLE AS zero_events, SUM(sudden_drop_flag)::DOUBLE AS sudden_drop_events,
       SUM(flatline_flag)::DOUBLE AS flatline_events, SUM(weather_consumption_mismatch)::DOUBLE AS weather_mismatch_events
FROM s_daily GROUP BY date""")
oracle("daily_events", "date, ~average_consumption, ~zero_events, ~sudden_drop_events, ~flatline_events, ~weather_mismatch_events", "FROM ev")
AGED = "SELECT series, date, value, ROW_NUMBER() OVER (PARTITION BY series ORDER BY date DESC) AS age FROM {source}"
LEVELS = """
SELECT series, n, last_date, median_all, spread, level,
       LEAST(GREATEST((level - COALESCE(previous, level)) / 14.0, -0.08 * GREATEST(level, 1)), 0.08 * GREATEST(level, 1)) AS trend,
       GREATEST(0, q05 * 0.45) AS low, GREATEST(q95 * 1.55, level * 1.8, 1) AS high
FROM (SELECT series, COUNT(*) AS n, MAX(date) AS last_date, MEDIAN(value) AS median_all, STDDEV_POP(value) AS spread,
             MEDIAN(value) FILTER (WHERE age <= 14) AS level, MEDIAN(value) FILTER (WHERE age BETWEEN 15 AND 28) AS previous,
             QUANTILE_CONT(value, 0.05) FILTER (WHERE age <= 56) AS q05, QUANTILE_CONT(value, 0.95) FILTER (WHERE age <= 56) AS q95
      FROM {source} GROUP BY series)"""
WEEKDAY = "SELECT series, ISODOW(date) - 1 AS weekday, MEDIAN(value) AS seasonal FROM {source} WHERE age <= 56 GROUP BY 1, 2"
AHEAD = """
SELECT l.series, l.step, l.date, CASE WHEN n < 10 OR spread < 1e-9 THEN median_all
       ELSE LEAST(GREATEST(0.56 * COALESCE(seasonal, level) + 0.34 * level + 0.10 * (level + trend * l.step), low), high) END AS forecast
FROM (SELECT *, CAST(last_date + CAST(step AS INTEGER) AS DATE) AS date FROM {levels} JOIN (SELECT UNNEST(RANGE(1, 31)) AS step) ON TRUE) l
LEFT JOIN {weekday} w ON w.series = l.series AND w.weekday = ISODOW(l.date) - 1"""
step("c_series", "SELECT customer_id AS series, date, consumption_kwh AS value FROM s_raw")
step("c_aged", AGED.format(source="c_series"))
step("c_levels", LEVELS.format(source="c_aged"))
step("c_weekday", WEEKDAY.format(source="c_aged"))
step("c_ahead", AHEAD.format(levels="c_levels", weekday="c_weekday"))
oracle("forecast_levels", "series, n, last_date, ~level, ~trend, ~low, ~high", "FROM c_levels")
oracle_sql("fc_3", f"SELECT series, weekday::INTEGER AS weekday, {r('seasonal')} AS seasonal FROM c_weekday")
oracle("weekly_forecast", "series, step::INTEGER AS step, date, ~forecast", "FROM c_ahead")
step("base_loss", """
SELECT COALESCE(SUM(GREATEST(previous_90_mean - last_30_mean, 0) * 30 * CASE WHEN customer_type LIKE '%resid%' AND last_30_mean * 30 <= 700 THEN 8.5 ELSE 9.5 END), 0) AS total
FROM s_features0""")


def loss_steps(tag: str, events: str, base: str) -> None:
    """Steps of the loss forecast over a table of daily events and a one-row current loss."""
    step(f"{tag}_press", f"SELECT *, 0.95 * zero_events + 0.80 * sudden_drop_events + 0.35 * flatline_events + 0.25 * weather_mismatch_events AS event_pressure, ROW_NUMBER() OVER (ORDER BY date DESC) AS age FROM {events}")
    step(f"{tag}_ref", f"SELECT (SELECT total FROM {base}) AS current_loss, SUM(event_pressure) FILTER (WHERE age <= 30) AS recent, GREATEST(MEDIAN(event_pressure) FILTER (WHERE age <= 30), 1) AS usual FROM {tag}_press")
    step(f"{tag}_hist", f"SELECT p.*, CASE WHEN recent > 1e-9 AND current_loss > 0 THEN event_pressure * current_loss / recent END AS daily_loss FROM {tag}_press p, {tag}_ref")
    step(f"{tag}_series", f"""
SELECT date, 'average_consumption' AS series, average_consumption AS value FROM {tag}_hist UNION ALL SELECT date, 'zero_events', zero_events FROM {tag}_hist
UNION ALL SELECT date, 'sudden_drop_events', sudden_drop_events FROM {tag}_hist UNION ALL SELECT date, 'flatline_events', flatline_events FROM {tag}_hist
UNION ALL SELECT date, 'weather_mismatch_events', weather_mismatch_events FROM {tag}_hist UNION ALL SELECT date, 'money', COALESCE(daily_loss, 0) FROM {tag}_hist""")
    step(f"{tag}_aged", AGED.format(source=f"{tag}_series"))
    step(f"{tag}_levels", LEVELS.format(source=f"{tag}_aged"))
    step(f"{tag}_weekday", WEEKDAY.format(source=f"{tag}_aged"))
    step(f"{tag}_ahead", AHEAD.format(levels=f"{tag}_levels", weekday=f"{tag}_weekday"))
    step(f"{tag}_wide", f"""
SELECT step, date, {', '.join(f"MAX(CASE WHEN series = '{c}' THEN forecast END) AS {c}" for c in ('average_consumption', 'zero_events', 'sudden_drop_events', 'flatline_events', 'weather_mismatch_events', 'money'))}
FROM {tag}_ahead GROUP BY step, date""")
    step(f"{tag}_facts", f"SELECT COUNT(daily_loss) >= 10 AND COALESCE(SUM(daily_loss), 0) > 0 AS by_money, QUANTILE_CONT(daily_loss, 0.98) AS top FROM {tag}_hist")
    step(f"{tag}_raw", f"""
SELECT w.*, by_money, top, current_loss / 30.0 AS base, CASE WHEN by_money THEN 0.78 * money + 0.22 * current_loss / 30.0
  ELSE current_loss / 30.0 * (0.72 + 0.28 * LEAST(GREATEST((0.95 * zero_events + 0.80 * sudden_drop_events + 0.35 * flatline_events + 0.25 * weather_mismatch_events) / usual, 0.35), 2.25))
       * (1 + 0.05 * SIN(2 * PI() * (step - 1) / 7.0)) END AS loss
FROM {tag}_wide w, {tag}_ref, {tag}_facts""")
    step(f"{tag}_loss", f"""
SELECT *, LEAST(GREATEST(loss, 0), CASE WHEN by_money THEN GREATEST(top, base * 2.5, 1) ELSE GREATEST(base * 2, MAX(loss) OVER (), 1) END) AS final FROM {tag}_raw""")
    step(f"{tag}_table", f"""
SELECT date, ROUND(average_consumption, 3) AS predicted_average_consumption, ROUND(sudden_drop_events, 2) AS predicted_sudden_drop_events,
       ROUND(zero_events, 2) AS predicted_zero_consumption_events, ROUND(flatline_events, 2) AS predicted_flatline_events,
       ROUND(weather_mismatch_events, 2) AS predicted_weather_mismatch_events,
       ROUND(zero_events + sudden_drop_events + flatline_events + weather_mismatch_events, 2) AS predicted_total_events,
       ROUND(final, 2) AS predicted_loss_all, ROUND(SUM(final) OVER (ORDER BY date), 2) AS cumulative_predicted_loss,
       ROUND(final * 0.82, 2) AS forecast_lower_loss, ROUND(final * 1.18, 2) AS forecast_upper_loss,
       'Capacity-planning signal; requires field verification before fraud decision.' AS planning_note
FROM {tag}_loss""")


loss_steps("fb", "ev", "base_loss")
step("ev_quiet", "SELECT date, average_consumption, 0.0 AS zero_events, 0.0 AS sudden_drop_events, 0.0 AS flatline_events, 0.0 AS weather_mismatch_events FROM ev")
loss_steps("fq", "ev_quiet", "base_loss")
step("c_loss", "SELECT SUM(COALESCE(estimated_loss_all_30d, 0)) AS total FROM c_all")
loss_steps("fs", "ev", "c_loss")
oracle("loss_history", "date, ~event_pressure, ~daily_loss", "FROM fb_hist")
LOSS = "date, ~predicted_average_consumption, ~predicted_total_events, ~predicted_loss_all"
FULL = LOSS + ", ~predicted_sudden_drop_events, ~predicted_zero_consumption_events, ~predicted_flatline_events, ~predicted_weather_mismatch_events, ~cumulative_predicted_loss, ~forecast_lower_loss, ~forecast_upper_loss, planning_note"
oracle("loss_forecast", LOSS, "FROM fb_table")
oracle("fc_7", LOSS, "FROM fq_table")
oracle("fc_9", FULL, "FROM fb_table")
oracle("fc_13", FULL, "FROM fs_table")
TOP = "{0} / GREATEST(MAX({0}) OVER (), 1)::DOUBLE * 100"
step("af", f"""
SELECT *, ROUND({CLIP.format('0.54 * area_risk_score + 24 * LEAST(anomaly_density, 1) + 0.12 * ' + TOP.format('high_risk_customers') + ' + 0.07 * ' + TOP.format('critical_customers') + ' + 0.03 * ' + TOP.format('estimated_loss_all_30d'))}, 2) AS forecasted_area_risk_next_30d
FROM a_all""")
step("af_ranked", "SELECT *, ROW_NUMBER() OVER (ORDER BY forecasted_area_risk_next_30d DESC, area_id) AS forecast_priority FROM af")
oracle("area_forecast", "forecast_priority, area_id, ~forecasted_area_risk_next_30d", "FROM af_ranked")
step("cf", f"""
SELECT *, ROUND({CLIP.format('''0.68 * risk_score + 0.24 * (0.24 * LEAST(recent_drop_pct, 1) * 100 + 0.20 * LEAST(zero_day_ratio, 1) * 100 + 0.16 * LEAST(flatline_ratio, 1) * 100
  + 0.16 * (''' + TOP.format('sudden_drop_count') + ''') + 0.12 * LEAST(weather_mismatch_ratio, 1) * 100 + 0.12 * payment_risk_score) + 0.08 * ''' + TOP.format('COALESCE(estimated_loss_all_30d, 0)'))}, 2) AS forecasted_customer_risk_next_30d
FROM c_all""")
step("cf_ranked", "SELECT *, ROW_NUMBER() OVER (ORDER BY forecasted_customer_risk_next_30d DESC, customer_id) AS forecast_priority FROM cf")
oracle("customer_forecast", "forecast_priority, customer_id, ~forecasted_customer_risk_next_30d, risk_level", "FROM cf_ranked")
step("kpi", "SELECT SUM(predicted_loss_all) AS projected_loss, (SELECT total FROM c_loss) AS last_30d_loss FROM fs_table")
oracle_sql("forecast_kpis", f"""
SELECT {rounded('~projected_loss, ~last_30d_loss')}, (SELECT date FROM fs_table ORDER BY predicted_loss_all DESC, date LIMIT 1) AS peak_day,
       {r('CASE WHEN last_30d_loss > 0 THEN (projected_loss - last_30d_loss) / last_30d_loss * 100 ELSE 0 END')} AS delta_pct,
       CASE WHEN last_30d_loss <= 0 THEN 'stay about flat' WHEN (projected_loss - last_30d_loss) / last_30d_loss * 100 > 4 THEN 'rise'
            WHEN (projected_loss - last_30d_loss) / last_30d_loss * 100 < -4 THEN 'fall' ELSE 'stay about flat' END AS direction,
       (SELECT area_id FROM af_ranked WHERE forecast_priority = 1) AS top_forecast_area FROM kpi""")
oracle_sql("pipeline_summary", f"""
SELECT COUNT(*) AS customers_analyzed, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_customers,
       COUNT(*) FILTER (WHERE risk_level = 'Critical') AS critical_customers, {r('SUM(COALESCE(estimated_loss_all_30d, 0))')} AS estimated_loss_all_30d,
       (SELECT COUNT(*) FROM s_daily) AS records_analyzed, (SELECT MIN(date) FROM s_daily) AS date_min, (SELECT MAX(date) FROM s_daily) AS date_max,
       {r('(SELECT AVG(temp_mean) FROM s_daily)')} AS avg_weather_temperature,
       (SELECT COUNT(*) FROM s_daily WHERE weather_demand_pressure = 1) AS weather_extreme_days,
       (SELECT COUNT(*) FROM a_all WHERE area_risk_level IN ('High', 'Critical')) AS high_risk_areas,
       (SELECT area_id FROM a_all ORDER BY area_risk_score DESC, area_id DESC LIMIT 1) AS top_area,
       {r('(SELECT SUM(predicted_loss_all) FROM fs_table)')} AS forecast_30d_loss_all,
       (SELECT area_id FROM af_ranked WHERE forecast_priority = 1) AS top_forecast_area, TRUE AS weather_context_enabled
FROM c_all""")
step("audit_facts", """
SELECT COUNT(*) AS n, AVG(CASE WHEN risk_level IN ('High', 'Critical') THEN 100.0 ELSE 0 END) AS rate, SUM(COALESCE(estimated_loss_all_30d, 0)) AS loss,
       COUNT(fraud_label) AS labels, (SELECT COUNT(DISTINCT date) FROM s_raw) AS days FROM c_all""")
oracle_sql("operational_audit", """
SELECT 'GIS integration' AS audit_area, 'Some customer coordinates are missing or synthetic.' AS finding, 'Maps and field routing may be inaccurate.' AS operational_impact,
       'Connect meter registry, address database, transformer GIS and OpenStreetMap geocoding.' AS recommended_improvement, 'High' AS priority
UNION ALL SELECT 'Feedback loop', 'Confirmed theft / false alarm labels are limited or missing.', 'The supervised fraud probability model cannot learn from field outcomes.',
       'Save inspection results from Case Management and feed them back into the model every month.', 'High' FROM audit_facts WHERE labels <= 20
UNION ALL SELECT 'Inspection capacity', 'High/Critical queue is large (' || PRINTF('%.1f', ROUND_EVEN(rate, 1)) || '% of customers).', 'Field teams may not handle all alerts.',
       'Use forecast priority, area clustering, estimated loss and route planning to narrow the daily queue.', 'High' FROM audit_facts WHERE rate > 25
UNION ALL SELECT 'Model sensitivity', 'High/Critical queue is very small (' || PRINTF('%.1f', ROUND_EVEN(rate, 1)) || '% of customers).', 'The model may be too strict for exploratory detection.',
       'Review score thresholds and compare with known inspection outcomes.', 'Medium' FROM audit_facts WHERE rate < 1
UNION ALL SELECT 'Historical depth', 'Only ' || CAST(days AS VARCHAR) || ' days are available in the dashboard sample.', 'Seasonal and trend detection may be weak.',
       'Use at least 6-12 months of meter readings for production NTL detection.', 'High' FROM audit_facts WHERE days < 60
UNION ALL SELECT 'Data quality', 'Missing-cell rate is ' || PRINTF('%.2f', pct) || '%.', 'Missing readings can create false anomalies.',
       'Add missing-reading reason codes, meter communication status and billing correction flags.', 'Medium'
       FROM (SELECT ROUND(SUM(CASE WHEN value IS NULL THEN n ELSE 0 END) * 100.0 / (SUM(n) * 3), 2) AS pct FROM profiled) WHERE pct > 2
UNION ALL SELECT 'Financial impact', 'Estimated loss is missing or zero.', 'Managers cannot compare inspection value by case.',
       'Add tariff class, contract power, customer category and historical billing amount.', 'Medium' FROM audit_facts WHERE loss <= 0""")

# ---------------------------------------------------------------- units and buildings
step("u0", """
SELECT s.customer_id AS unit_id, date, consumption_kwh, 'B' || CAST(CAST(s.customer_id AS BIGINT) % 20 AS VARCHAR) AS building_id,
       (CAST(s.customer_id AS BIGINT) % 7)::DOUBLE AS floor, (40 + CAST(s.customer_id AS BIGINT) % 60)::DOUBLE AS area_sqm,
       (1 + CAST(s.customer_id AS BIGINT) % 5)::DOUBLE AS household_size, d.city, CASE WHEN CAST(s.customer_id AS BIGINT) % 4 = 0 THEN 'Village' ELSE 'City' END AS location_type,
       CASE WHEN CAST(s.customer_id AS BIGINT) % 6 = 0 THEN 'Shop' ELSE 'Apartment' END AS unit_type, fraud_label::INTEGER AS fraud_label,
       ROUND(16.2 + 10.7 * COS(2 * PI() * (DAYOFYEAR(date) - 200) / 365.25), 2) AS temp_mean
FROM s_raw s JOIN s_dim d ON d.customer_id = s.customer_id""")
step("u1", "SELECT *," + TEMPERATURE + """, 'Residential' AS building_type, 'TR-' || UPPER(city[1:3]) AS transformer_id, 41.3275 AS latitude, 19.8187 AS longitude,
       CASE WHEN fraud_label = 1 THEN 'uploaded_positive_label' ELSE 'unknown' END AS anomaly_type FROM u0""")
step("u2", """
SELECT *, 1.45 + household_size * 1.05 + area_sqm * 0.037 + floor * 0.12 + heating_degree_days * 0.24 + cooling_degree_days * 0.38 AS expected_kwh,
       LAG(consumption_kwh) OVER (PARTITION BY unit_id ORDER BY date) AS prev_kwh FROM u1""")
step("u", """
SELECT *, (expected_kwh - consumption_kwh) / NULLIF(expected_kwh, 0) AS consumption_gap_pct,
       CASE WHEN weather_demand_pressure >= 1 AND consumption_kwh < expected_kwh * 0.35 THEN 1 ELSE 0 END AS weather_low_mismatch,
       CASE WHEN weather_demand_pressure = 0 AND consumption_kwh > expected_kwh * 1.85 THEN 1 ELSE 0 END AS normal_high_mismatch,
       CASE WHEN consumption_kwh <= 0.05 THEN 1 ELSE 0 END AS zero_flag, CASE WHEN consumption_kwh < expected_kwh * 0.25 THEN 1 ELSE 0 END AS low_expected_flag,
       CASE WHEN prev_kwh > 2 AND consumption_kwh < prev_kwh * 0.28 THEN 1 ELSE 0 END AS sudden_drop_flag,
       CASE WHEN ABS(consumption_kwh - prev_kwh) < 0.04 THEN 1 ELSE 0 END AS small_change FROM u2""")
oracle("building_standardize", "unit_id, date, building_id, ~consumption_kwh, ~floor, ~area_sqm, ~household_size, city, location_type, unit_type, building_type, transformer_id, ~latitude, ~longitude, ~temp_mean, fraud_label, anomaly_type", "FROM u1")
oracle_sql("bld_2", "SELECT building_id, GREATEST(MAX(floor)::INTEGER, 1) AS floors, COUNT(*) AS rows FROM u1 GROUP BY 1")
oracle("expected_kwh", "unit_id, date, ~expected_kwh", "FROM u2")
oracle("unit_daily_flags", "unit_id, date, ~consumption_gap_pct, weather_low_mismatch, normal_high_mismatch, zero_flag, low_expected_flag", "FROM u")
oracle("unit_lag_flags", "unit_id, date, ~prev_kwh, sudden_drop_flag, small_change", "FROM u")
step("ub", "SELECT building_id, GREATEST(MAX(floor)::INTEGER, 1) AS floors FROM u1 GROUP BY 1")
step("ua", """
SELECT unit_id, ANY_VALUE(u.building_id) AS building_id, ANY_VALUE(city) AS city, ANY_VALUE(location_type) AS location_type, ANY_VALUE(building_type) AS building_type,
       ANY_VALUE(unit_type) AS unit_type, ANY_VALUE(transformer_id) AS transformer_id, ANY_VALUE(floor) AS floor, ANY_VALUE(floors) AS floors,
       ANY_VALUE(area_sqm) AS area_sqm, ANY_VALUE(household_size) AS household_size, COUNT(*) AS readings, AVG(consumption_kwh) AS avg_consumption,
       MEDIAN(consumption_kwh) AS median_consumption, COALESCE(STDDEV_SAMP(consumption_kwh), 0) AS std_consumption, SUM(consumption_kwh) AS total_consumption,
       AVG(expected_kwh) AS avg_expected_kwh, SUM(expected_kwh) AS total_expected_kwh, SUM(zero_flag)::BIGINT AS zero_days, SUM(low_expected_flag)::BIGINT AS low_expected_days,
       SUM(sudden_drop_flag)::BIGINT AS sudden_drop_days, SUM(small_change)::BIGINT AS flatline_days, SUM(weather_low_mismatch)::BIGINT AS weather_low_mismatch_days,
       SUM(normal_high_mismatch)::BIGINT AS normal_high_mismatch_days, AVG(temp_mean) AS avg_temp_mean, AVG(weather_demand_pressure) AS avg_weather_demand_pressure,
       MAX(fraud_label) AS fraud_label, ANY_VALUE(anomaly_type) AS anomaly_type
FROM u JOIN ub ON ub.building_id = u.building_id GROUP BY unit_id""")
oracle("unit_agg", "unit_id, building_id, city, location_type, building_type, unit_type, transformer_id, ~floor, floors, ~area_sqm, ~household_size, readings, ~avg_consumption, ~median_consumption, ~std_consumption, ~total_consumption, ~avg_expected_kwh, ~total_expected_kwh, zero_days, low_expected_days, sudden_drop_days, flatline_days, weather_low_mismatch_days, normal_high_mismatch_days, ~avg_temp_mean, ~avg_weather_demand_pressure, fraud_label, anomaly_type", "FROM ua")
step("ur", """
SELECT *, zero_days / readings::DOUBLE AS zero_ratio, flatline_days / readings::DOUBLE AS flatline_ratio, low_expected_days / readings::DOUBLE AS low_expected_ratio,
       (weather_low_mismatch_days + normal_high_mismatch_days) / readings::DOUBLE AS weather_mismatch_ratio,
       (avg_expected_kwh - avg_consumption) / NULLIF(avg_expected_kwh, 0) AS expected_gap_pct, avg_consumption / NULLIF(area_sqm, 0) AS kwh_per_sqm,
       avg_consumption / NULLIF(household_size, 0) AS kwh_per_person, std_consumption / NULLIF(avg_consumption, 0) AS cv_consumption,
       GREATEST(0, avg_expected_kwh - avg_consumption) * 30 AS estimated_missing_kwh_30d, GREATEST(0, avg_expected_kwh - avg_consumption) * 30 * 13.5 AS estimated_loss_lek_30d
FROM ua""")
oracle("unit_ratios", "unit_id, ~zero_ratio, ~flatline_ratio, ~low_expected_ratio, ~weather_mismatch_ratio, ~expected_gap_pct, ~kwh_per_sqm, ~kwh_per_person, ~cv_consumption", "FROM ur")
step("up", """
SELECT *, MEDIAN(avg_consumption) OVER (PARTITION BY city, location_type, unit_type) AS peer_avg_consumption FROM ur""")
step("uf", "SELECT *, COALESCE(GREATEST((peer_avg_consumption - avg_consumption) / NULLIF(peer_avg_consumption, 0), 0), 0) AS peer_low_gap_pct FROM up")
oracle("unit_peer", "unit_id, ~peer_avg_consumption, ~peer_low_gap_pct", "FROM uf")
oracle("unit_loss", "unit_id, ~estimated_missing_kwh_30d, ~estimated_loss_lek_30d", "FROM uf")
U01 = STRETCH.format("estimated_loss_lek_30d")
oracle_sql("bld_12", f"SELECT unit_id, {r('(' + U01 + ') / 100')} AS scaled FROM uf")
step("uc", f"""
SELECT *, ROUND(LEAST(GREATEST(expected_gap_pct, 0), 1.2) / 1.2 * 100, 2) AS consumption_deviation_score, ROUND(LEAST(peer_low_gap_pct, 1) * 100, 2) AS peer_deviation_score,
       ROUND({CLIP.format('zero_ratio * 42 + flatline_ratio * 34 + LEAST(sudden_drop_days, 12) / 12.0 * 24')}, 2) AS meter_behavior_score,
       ROUND(LEAST(weather_mismatch_ratio, 1) * 100, 2) AS weather_context_score, ROUND({U01}, 2) AS loss_impact_score FROM uf""")
oracle("unit_components", "unit_id, ~consumption_deviation_score, ~peer_deviation_score, ~meter_behavior_score, ~weather_context_score, ~loss_impact_score", "FROM uc")
step("us0", f"""
SELECT *, ROUND({CLIP.format('0.22 * consumption_deviation_score + 0.18 * peer_deviation_score + 0.17 * meter_behavior_score + 0.12 * weather_context_score + 0.08 * loss_impact_score')}, 2) AS risk_score,
       GREATEST(consumption_deviation_score, peer_deviation_score, meter_behavior_score, weather_context_score, 0, loss_impact_score) AS strongest FROM uc""")
ULEVEL = "CASE WHEN {0} >= 82 THEN 'Critical' WHEN {0} >= 64 THEN 'High' WHEN {0} >= 38 THEN 'Medium' ELSE 'Low' END"
UPCT = "CAST(CAST(ROUND_EVEN({0} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
step("us", f"""
SELECT *, ROUND(1 / (1 + EXP(-(risk_score - 55) / 12)), 4) AS fraud_probability, {ULEVEL.format('risk_score')} AS risk_level,
       CASE WHEN consumption_deviation_score = strongest THEN 'below expected consumption' WHEN peer_deviation_score = strongest THEN 'below similar units'
            WHEN meter_behavior_score = strongest THEN 'meter flatline/drop/zero behavior' WHEN weather_context_score = strongest THEN 'weather-consumption mismatch'
            WHEN 0 = strongest THEN 'AI outlier behavior' ELSE 'estimated loss impact' END AS main_reason,
       ROW_NUMBER() OVER (ORDER BY risk_score DESC, unit_id) AS priority_rank FROM us0""")
oracle("unit_risk", "unit_id, ~risk_score, ~fraud_probability", "FROM us")
oracle_sql("unit_level", f"SELECT o_orderkey, {ULEVEL.format('o_totalprice / 5000')} AS risk_level FROM orders")
oracle_sql("top_driver", f"""
SELECT unit_id, main_reason, CASE WHEN risk_level IN ('High', 'Critical') THEN 'Prioritize meter inspection, compare common-area meter, and verify illegal shared connections.'
       ELSE 'Monitor trend and inspect only if risk persists or neighboring units also become suspicious.' END AS recommended_action,
       unit_id || ' in ' || building_id || ' is ' || risk_level || ' risk because the strongest signal is ' || main_reason || '. Expected gap: ' || {UPCT.format('expected_gap_pct')}
       || ', peer low gap: ' || {UPCT.format('peer_low_gap_pct')} || ', weather mismatch: ' || {UPCT.format('weather_mismatch_ratio')} || '.' AS alert_explanation FROM us""")
oracle("bld_17", "priority_rank, unit_id, ~risk_score, risk_level", "FROM us")
step("bs0", """
SELECT building_id, ARG_MIN(city, priority_rank) AS city, ARG_MIN(location_type, priority_rank) AS location_type, 'Residential' AS building_type,
       ARG_MIN(transformer_id, priority_rank) AS transformer_id, COUNT(*) AS units, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_units,
       COUNT(*) FILTER (WHERE risk_level = 'Critical') AS critical_units, AVG(risk_score) AS avg_risk_score, MAX(risk_score) AS max_risk_score,
       QUANTILE_CONT(risk_score, 0.9) AS p90_risk_score, AVG(fraud_probability) AS avg_fraud_probability, SUM(estimated_loss_lek_30d) AS estimated_loss_lek_30d
FROM us GROUP BY building_id""")
step("bs_reason", """
SELECT building_id, main_reason AS top_reason FROM (SELECT building_id, main_reason, ROW_NUMBER() OVER (PARTITION BY building_id ORDER BY COUNT(*) DESC, main_reason) AS k
FROM us GROUP BY 1, 2) WHERE k = 1""")
step("bs1", f"SELECT *, ROUND({CLIP.format('0.55 * p90_risk_score + 0.30 * avg_risk_score + 0.15 * LEAST(high_risk_units / units::DOUBLE * 100, 100)')}, 2) AS risk_score FROM bs0 JOIN bs_reason USING (building_id)")
step("bs", f"SELECT *, {ULEVEL.format('risk_score')} AS risk_level, ROW_NUMBER() OVER (ORDER BY risk_score DESC, building_id) AS priority_rank FROM bs1")
oracle("building_scores", "priority_rank, building_id, city, location_type, building_type, transformer_id, units, high_risk_units, critical_units, ~avg_risk_score, ~max_risk_score, ~p90_risk_score, ~avg_fraud_probability, ~estimated_loss_lek_30d, top_reason, ~risk_score, risk_level", "FROM bs")
oracle_sql("floor_scores", f"""
SELECT building_id, {r('floor')} AS floor, ARG_MIN(city, priority_rank) AS city, COUNT(*) AS units, {r('AVG(risk_score)')} AS avg_risk_score, {r('MAX(risk_score)')} AS max_risk_score,
       COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_units, {r('SUM(estimated_loss_lek_30d)')} AS estimated_loss_lek_30d
FROM us GROUP BY building_id, us.floor""")
oracle_sql("building_daily", f"""
SELECT date, {r('SUM(consumption_kwh)')} AS total_consumption_kwh, {r('SUM(expected_kwh)')} AS expected_consumption_kwh, SUM(weather_low_mismatch)::BIGINT AS weather_mismatch_events,
       SUM(zero_flag)::BIGINT AS zero_events, SUM(sudden_drop_flag)::BIGINT AS sudden_drop_events, {r('AVG(temp_mean)')} AS avg_temperature,
       {r('GREATEST(SUM(expected_kwh) - SUM(consumption_kwh), 0)')} AS estimated_missing_kwh FROM u GROUP BY date""")
step("us_ranked", "SELECT fraud_label, RANK() OVER (ORDER BY risk_score) + (COUNT(*) OVER (PARTITION BY risk_score) - 1) / 2.0 AS mid FROM us")
step("us_steps", "SELECT SUM(fraud_label) AS ones, SUM(SUM(fraud_label)) OVER (ORDER BY risk_score DESC) AS ones_to, SUM(COUNT(*)) OVER (ORDER BY risk_score DESC) AS n_to FROM us GROUP BY risk_score")
oracle_sql("unit_anomaly_type", """
SELECT unit_id, COALESCE(MAX(kind) FILTER (WHERE place = 1), 'unknown') AS anomaly_type
FROM (SELECT unit_id, kind, ROW_NUMBER() OVER (PARTITION BY unit_id ORDER BY (kind IS NULL)::INTEGER, n DESC, kind) AS place
      FROM (SELECT unit_id, CASE WHEN DAY(date) % 3 = 0 THEN 'normal' WHEN MONTH(date) % 2 = 0 THEN 'theft_' || CAST(CAST(unit_id AS BIGINT) % 4 AS VARCHAR)
                                 WHEN DAY(date) % 2 = 0 THEN 'bypass' END AS kind, COUNT(*) AS n FROM u0 GROUP BY 1, 2)) GROUP BY 1""")
for key, table_ in (("bld_10", "us"), ("bld_11", "us"), ("expected_consumption", "s_features"), ("anomaly_score", "s_features"), ("fraud_probability", "s_features")):
    oracle_sql(key, f"SELECT COUNT(*) AS rows, 0::BIGINT AS missing, 0::BIGINT AS out_of_range, TRUE AS varies FROM {table_}")
oracle_sql("building_metrics", f"""
SELECT COUNT(*) AS units, SUM(fraud_label)::BIGINT AS positive_units, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_units,
       COUNT(*) FILTER (WHERE risk_level = 'Critical') AS critical_units, {r('SUM(estimated_loss_lek_30d)')} AS estimated_loss_lek_30d,
       (SELECT COUNT(*) FROM u1) AS records, (SELECT MIN(date) FROM u1) AS date_min, (SELECT MAX(date) FROM u1) AS date_max,
       (SELECT COUNT(*) FROM bs) AS buildings, (SELECT COUNT(*) FROM bs WHERE risk_level IN ('High', 'Critical')) AS high_risk_buildings,
       (SELECT {r('(SUM(mid * fraud_label) - SUM(fraud_label) * (SUM(fraud_label) + 1) / 2.0) / (SUM(fraud_label) * (COUNT(*) - SUM(fraud_label)))')} FROM us_ranked) AS fraud_classifier_roc_auc,
       (SELECT {r('SUM(ones * ones_to / n_to::DOUBLE) / SUM(ones)')} FROM us_steps) AS fraud_classifier_average_precision FROM us""")
oracle_sql("city_exposure", f"""
SELECT city, location_type, {r('AVG(risk_score)')} AS risk_score, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_risk_buildings, COUNT(*) AS buildings FROM bs GROUP BY 1, 2""")
oracle("bld_25", "priority_rank, unit_id, building_id, ~risk_score, risk_level", """
FROM (SELECT * FROM us WHERE location_type = 'City' AND risk_level IN ('Low', 'Medium') AND risk_score >= 5 ORDER BY priority_rank LIMIT 300)""")

# ---------------------------------------------------------------- operations
step("economics", """
SELECT SUM(last_30_mean * 30 * tariff + COALESCE(estimated_loss_all_30d, 0)) AS expected, SUM(last_30_mean * 30 * tariff) AS actual, SUM(COALESCE(estimated_loss_all_30d, 0)) AS loss,
       SUM(COALESCE(estimated_missing_kwh_30d, 0)) AS missing_kwh, COUNT(*) FILTER (WHERE estimated_loss_all_30d > 0) AS customers_with_loss FROM c_all""")
oracle_sql("loss_economics", f"SELECT {rounded('~expected, ~actual, ~loss, ~missing_kwh, customers_with_loss')}, {r('loss / expected * 100')} AS leakage_pct FROM economics")
oracle("top_loss_areas", "area_id, ~estimated_loss_all_30d", "FROM (SELECT * FROM a_all ORDER BY estimated_loss_all_30d DESC, area_id LIMIT 8)")
step("headline", """
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_or_critical, COUNT(*) FILTER (WHERE risk_level = 'Critical') AS critical,
       SUM(COALESCE(estimated_loss_all_30d, 0)) AS estimated_loss_all_30d, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) * 100.0 / COUNT(*) AS pct_high FROM c_all""")
oracle_sql("headline_kpis", f"""
SELECT customers, high_or_critical, critical, {rounded('~estimated_loss_all_30d, ~pct_high')}, (SELECT COUNT(*) FROM a_all WHERE area_risk_level IN ('High', 'Critical')) AS high_risk_areas,
       (SELECT area_id FROM a_all ORDER BY area_risk_score DESC, area_id LIMIT 1) AS top_area,
       CASE WHEN pct_high >= 15 THEN 'Critical' WHEN pct_high >= 7 THEN 'High' WHEN pct_high >= 3 THEN 'Medium' ELSE 'Low' END AS status_level FROM headline""")
oracle_sql("risk_histogram", f"SELECT LEAST(FLOOR(risk_score * 35 / 100), 34)::INTEGER AS bin, COUNT(*) AS customers, {r('LEAST(FLOOR(risk_score * 35 / 100), 34) * 100.0 / 35')} AS bin_start FROM c_all GROUP BY 1, 3")
oracle_sql("level_counts", """
SELECT level_order, v.risk_level, COUNT(c.customer_id) AS rows FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High'), (3, 'Critical')) v(level_order, risk_level)
LEFT JOIN c_all c ON c.risk_level = v.risk_level GROUP BY 1, 2""")
oracle("top_areas", "area_id, ~area_risk_score, area_risk_level", "FROM (SELECT * FROM a_all ORDER BY area_risk_score DESC, area_id LIMIT 10)")
oracle_sql("daily_trend", f"SELECT date, {r('AVG(consumption_kwh)')} AS average_consumption, SUM(sudden_drop_flag)::BIGINT AS sudden_drop_events FROM s_daily GROUP BY date")
oracle_sql("weather_trend", f"""
SELECT date, {r('AVG(consumption_kwh)')} AS average_consumption, {r('AVG(temp_mean)')} AS average_temperature, SUM(weather_consumption_mismatch)::BIGINT AS weather_mismatch_events FROM s_daily GROUP BY date""")
oracle_sql("weather_kpis", f"""
SELECT {r('AVG(temp_mean)')} AS avg_temperature, COUNT(*) FILTER (WHERE weather_demand_pressure = 1) AS extreme_weather_days, SUM(weather_consumption_mismatch)::BIGINT AS mismatch_events,
       (SELECT COUNT(*) FROM c_all WHERE weather_context_score > 40) AS customers_with_weather_risk FROM s_daily""")
oracle("risk_register", "customer_id, ~risk_score, risk_level, area_id, ~estimated_loss_all_30d, main_reason", """
FROM c_all WHERE risk_score >= 30 AND LOWER(customer_id) LIKE '%1%' AND risk_level IN ('Medium', 'High', 'Critical')""")
oracle("customer_timeline", "customer_id, date, ~consumption_kwh, ~rolling_30d_mean", "FROM s_daily WHERE customer_id = '7'")
step("drivers", """
SELECT customer_id, 'AI anomaly' AS driver, ai_anomaly_score AS score FROM c_all UNION ALL SELECT customer_id, 'Historical deviation', historical_deviation_score FROM c_all
UNION ALL SELECT customer_id, 'Similar profile deviation', peer_deviation_score FROM c_all UNION ALL SELECT customer_id, 'Geographic risk', geographic_risk_score FROM c_all
UNION ALL SELECT customer_id, 'Sudden behavior', sudden_flags_score FROM c_all UNION ALL SELECT customer_id, 'Weather context', weather_context_score FROM c_all
UNION ALL SELECT customer_id, 'Payment behavior', payment_risk_score FROM c_all""")
oracle("driver_breakdown", "customer_id, driver, ~score", "FROM drivers")
oracle_sql("indicators", f"""
SELECT indicator, {r('value')} AS value, meaning FROM (
SELECT 'Mean customer consumption' AS indicator, AVG(avg_consumption) AS value, 'Average daily consumption across customers.' AS meaning FROM c_all
UNION ALL SELECT 'Median customer consumption', MEDIAN(median_consumption), 'Typical customer consumption level.' FROM c_all
UNION ALL SELECT 'Consumption volatility', AVG(std_consumption), 'Average instability in consumption.' FROM c_all
UNION ALL SELECT 'Mean risk score', AVG(risk_score), 'Average suspicious behavior score.' FROM c_all
UNION ALL SELECT 'High-risk customer rate', AVG(CASE WHEN risk_level IN ('High', 'Critical') THEN 100.0 ELSE 0 END), 'Share of customers classified as High or Critical.' FROM c_all
UNION ALL SELECT 'Critical customer rate', AVG(CASE WHEN risk_level = 'Critical' THEN 100.0 ELSE 0 END), 'Share requiring urgent verification.' FROM c_all
UNION ALL SELECT 'Total estimated 30-day loss', SUM(estimated_loss_all_30d), 'Estimated suspicious under-recorded value.' FROM c_all)""")
CORRELATED = ["risk_score", "fraud_probability", "ai_anomaly_score", "historical_deviation_score", "peer_deviation_score", "geographic_risk_score",
              "sudden_flags_score", "recent_drop_pct", "zero_day_ratio", "flatline_ratio", "sudden_drop_count", "payment_risk_score", "unpaid_bills",
              "arrears_amount_lek", "estimated_loss_all_30d"]
oracle_sql("correlation", "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN ISNAN(CORR({a}, {b})) THEN NULL ELSE {r(f'ROUND(CORR({a}, {b}), 2)')} END AS correlation FROM c_all" for a in CORRELATED for b in CORRELATED))
step("case0", """
SELECT 'NTL-' || LPAD(CAST(priority_rank AS VARCHAR), 5, '0') AS case_id, priority_rank, customer_id, risk_score, risk_level, area_id, transformer_id, estimated_loss_all_30d,
       main_reason, recommended_action, 'New' AS status, 'Inspection Team ' || CAST((priority_rank - 1) % 3 + 1 AS VARCHAR) AS assigned_team, 'Pending' AS inspection_result, '' AS field_notes
FROM q_all WHERE priority_rank <= 75""")
oracle("create_cases", "case_id, priority_rank::INTEGER AS priority_rank, customer_id, ~risk_score, risk_level, area_id, transformer_id, ~estimated_loss_all_30d, main_reason, recommended_action, status, assigned_team, inspection_result, field_notes", "FROM case0")
oracle_sql("dispatch", "SELECT case_id, 'Inspection Team 2' AS assigned_team, 'Assigned' AS status FROM case0 ORDER BY risk_score DESC, case_id LIMIT 5")
step("case_events", """
SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS k FROM (
SELECT 'NTL-' || LPAD(CAST(user_id % 60 + 1 AS VARCHAR), 5, '0') AS case_id, ts, event_id,
       CASE event_type WHEN 'click' THEN 'Assigned' WHEN 'view' THEN 'In Field' WHEN 'signup' THEN 'Inspected' WHEN 'purchase' THEN 'Confirmed NTL' ELSE 'False Alarm' END AS status,
       'Inspection Team ' || CAST(event_id % 3 + 1 AS VARCHAR) AS assigned_team, event_type, props FROM events)""")
step("case_live", """
SELECT c.case_id, c.customer_id, c.risk_score, c.risk_level, c.area_id, c.transformer_id, c.estimated_loss_all_30d, COALESCE(e.status, c.status) AS status,
       COALESCE(e.assigned_team, c.assigned_team) AS assigned_team, COALESCE(e.event_type, c.inspection_result) AS inspection_result, COALESCE(e.props, c.field_notes) AS field_notes
FROM case0 c LEFT JOIN (SELECT * FROM case_events WHERE k = 1) e ON e.case_id = c.case_id""")
oracle("case_state", "case_id, customer_id, status, assigned_team, inspection_result, field_notes", "FROM case_live")
oracle_sql("team_summary", """
SELECT assigned_team, COUNT(*) AS total, COUNT(*) FILTER (WHERE status <> 'New') AS dispatched, COUNT(*) FILTER (WHERE status = 'Confirmed NTL') AS confirmed,
       COUNT(*) FILTER (WHERE status NOT IN ('Confirmed NTL', 'False Alarm', 'New')) AS open FROM case_live GROUP BY 1""")
oracle_sql("case_kpis", f"""
SELECT COUNT(*) FILTER (WHERE status NOT IN ('Confirmed NTL', 'False Alarm')) AS open_cases, COUNT(*) FILTER (WHERE status = 'Confirmed NTL') AS confirmed,
       COUNT(*) FILTER (WHERE status = 'False Alarm') AS false_alarms, COUNT(*) FILTER (WHERE status <> 'New') AS dispatched,
       COUNT(*) FILTER (WHERE status IN ('New', 'Assigned', 'In Field')) AS in_view, {r('SUM(COALESCE(estimated_loss_all_30d, 0))')} AS potential_loss FROM case_live""")
step("board", "SELECT * FROM case_live WHERE assigned_team = 'Inspection Team 2' AND status <> 'New'")
oracle("team_board", "case_id, customer_id, ~risk_score, status", "FROM board")
oracle_sql("board_kpis", f"""
SELECT COUNT(*) AS dispatched, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_or_critical, {r('COALESCE(SUM(estimated_loss_all_30d), 0)')} AS potential_loss,
       COUNT(*) FILTER (WHERE status NOT IN ('Confirmed NTL', 'False Alarm')) AS still_open FROM board""")
oracle_sql("team_scope", """
SELECT 'customer' AS kind, customer_id AS id FROM board UNION ALL SELECT DISTINCT 'area', area_id FROM board UNION ALL SELECT DISTINCT 'transformer', transformer_id FROM board""")
oracle_sql("activity_feed", "SELECT event_id, CAST(user_id AS VARCHAR) AS actor, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
step("req", "SELECT 'REQ-' || CAST(event_id % 4001 AS VARCHAR) AS request_id, event_type = 'purchase' AS is_answer, ts, event_id, CAST(user_id AS VARCHAR) AS actor, event_type, props FROM events")
step("req_state", """
SELECT q.request_id, q.actor AS requested_by, q.event_type AS topic, CASE WHEN a.request_id IS NULL THEN 'Pending' ELSE 'Answered' END AS status, a.actor AS answered_by, a.props AS response
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS k FROM req WHERE NOT is_answer) q
LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ts, event_id) AS k FROM req WHERE is_answer) a ON a.request_id = q.request_id AND a.k = 1
WHERE q.k = 1""")
oracle("request_state", "request_id, requested_by, topic, status, answered_by, response", "FROM req_state")
oracle_sql("pending_requests", "SELECT COUNT(*) FILTER (WHERE status <> 'Answered') AS pending, COUNT(*) FILTER (WHERE status = 'Answered') AS answered FROM req_state")
oracle_sql("top_lists", f"""
SELECT list, place::INTEGER AS place, id, {r('score')} AS score FROM (
SELECT 'attention' AS list, ROW_NUMBER() OVER (ORDER BY risk_score DESC, customer_id) AS place, customer_id AS id, risk_score AS score, 15 AS n FROM c_all
UNION ALL SELECT 'weather', ROW_NUMBER() OVER (ORDER BY weather_context_score DESC, customer_id), customer_id, weather_context_score, 50 FROM c_all
UNION ALL SELECT 'transformers', ROW_NUMBER() OVER (ORDER BY transformer_risk_score DESC, transformer_id), transformer_id, transformer_risk_score, 80 FROM t_pre
UNION ALL SELECT 'area_forecast', forecast_priority, area_id, forecasted_area_risk_next_30d, 30 FROM af_ranked
UNION ALL SELECT 'customer_forecast', forecast_priority, customer_id, forecasted_customer_risk_next_30d, 50 FROM cf_ranked) WHERE place <= n""")


# ---------------------------------------------------------------- model inputs
_MODEL = """avg_consumption std_consumption cv_consumption last_30_mean previous_90_mean recent_drop_pct recent_spike_pct zero_day_ratio low_day_ratio
flatline_ratio sudden_drop_count sudden_spike_count longest_zero_streak longest_low_streak consumption_trend_slope peer_deviation_pct customer_vs_peer_ratio
meter_age contract_power_kw sudden_behavior_score avg_temp_mean avg_heating_degree_days avg_cooling_degree_days avg_weather_demand_pressure
weather_mismatch_ratio extreme_weather_day_ratio weather_context_score low_extreme_weather_days high_normal_weather_days payment_late_count_12m unpaid_bills
avg_payment_delay_days arrears_amount_lek disconnections_12m months_since_last_payment payment_on_time_ratio payment_risk_score""".split()
step("vector_input", "SELECT customer_id, " + ", ".join(
    f"CAST({'weather_context_raw' if f == 'weather_context_score' else f} AS DOUBLE) AS {f}" for f in _MODEL) + " FROM s_features")
oracle_sql("feature_vector", f"""
SELECT customer_id, feature, {r('COALESCE(CASE WHEN value IS NULL THEN MEDIAN(value) OVER (PARTITION BY feature) ELSE value END, 0)')} AS value
FROM (SELECT * FROM vector_input UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_MODEL)})))""")
oracle_sql("feature_importance", f"SELECT {len(_MODEL)}::BIGINT AS rows, 1.0::DOUBLE AS total, 0::BIGINT AS negative")

# ---------------------------------------------------------------- forecast without history, snapshot
step("nh_totals", """
SELECT AVG(COALESCE(avg_consumption, 0)) AS average_consumption, SUM(COALESCE(sudden_drop_count, 0)) / 30.0 AS sudden_drop_events,
       SUM(COALESCE(zero_days, 0)) / 30.0 AS zero_events, SUM(COALESCE(flatline_days, 0)) / 30.0 AS flatline_events,
       0.0 AS weather_mismatch_events, SUM(COALESCE(estimated_loss_all_30d, 0)) / 30.0 AS base FROM c_all""")
step("nh_raw", """
SELECT *, DATE '2024-01-31' + CAST(step AS INTEGER) AS date, base * (0.72 + 0.28 * LEAST(GREATEST((0.95 * zero_events + 0.80 * sudden_drop_events + 0.35 * flatline_events)
       / GREATEST(sudden_drop_events + zero_events + flatline_events, 1), 0.35), 2.25)) * (1 + 0.05 * SIN(2 * PI() * (step - 1) / 7.0)) AS loss
FROM nh_totals, (SELECT UNNEST(GENERATE_SERIES(1, 30)) AS step)""")
step("nh_loss", "SELECT *, LEAST(GREATEST(loss, 0), GREATEST(base * 2, MAX(loss) OVER (), 1)) AS final FROM nh_raw")
step("nh_table", STEPS["fb_table"].replace("fb_loss", "nh_loss"))
oracle("fc_8", FULL, "FROM nh_table")
oracle_sql("context_snapshot", f"""
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE risk_level IN ('High', 'Critical')) AS high_or_critical, COUNT(*) FILTER (WHERE risk_level = 'Critical') AS critical,
       {r('ROUND(COALESCE(SUM(estimated_loss_all_30d), 0), 0)')} AS loss, (SELECT customer_id FROM c_all ORDER BY risk_score DESC, customer_id LIMIT 1) AS first_customer,
       (SELECT area_id FROM a_all ORDER BY area_risk_score DESC, area_id LIMIT 1) AS first_area, (SELECT LEAST(COUNT(*), 15) FROM q_all) AS queue_rows,
       (SELECT {r('ROUND(SUM(predicted_loss_all), 0)')} FROM fs_table) AS forecast FROM c_all""")

# ---------------------------------------------------------------- deliveries, and results that are read back
oracle_sql("src_1", """
SELECT CASE WHEN event_id % 17 = 0 THEN 'skipped' WHEN event_id % 13 = 0 THEN 'repaired' ELSE 'row' END AS fate,
       CASE WHEN event_id % 17 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN event_type WHEN event_id % 11 = 0 THEN event_type || CHR(10) || 'line two'
            WHEN event_id % 7 = 0 THEN 'say "' || event_type || '", twice' ELSE event_type END AS event_type,
       CASE WHEN event_id % 17 <> 0 THEN CAST(user_id AS VARCHAR) END AS user_id FROM events""")
oracle_sql("cln_18", f"SELECT customer_id, date, {r('COALESCE(kwh, (SELECT MEDIAN(kwh) FROM e_vf), 0)')} AS consumption_kwh FROM e_vf")
oracle("src_6", "date, city, ~temp_mean", "FROM w")
oracle_sql("snk_3", "SELECT COUNT(*) AS records, 0::BIGINT AS repaired_records, 0::BIGINT AS skipped_records, 'long' AS schema_type, 'customer_id' AS customer_col FROM events")
oracle("ops_29", "priority_rank::VARCHAR AS priority_rank, customer_id, risk_level, main_reason", "FROM q_all")
for name, same in (("snk_1", "inspection_priority"), ("src_8", "area_risk"), ("snk_2", "area_forecast")):
    ORACLE[name] = ORACLE[same]
oracle_sql("choose_id_column", """
SELECT (SELECT "column" FROM customer_cell_stats ORDER BY unique_ratio * 2 + LEAST(avg_length / 20, 1) + letter_share - number_share * 0.25 DESC, "column" DESC LIMIT 1) AS chosen,
       c_name AS id FROM customer""")
oracle_sql("choose_roles", """
SELECT 'lineitem' AS "table", c AS "column", r AS role, (SELECT COUNT(*) FROM lineitem) AS n
FROM (VALUES ('l_orderkey', 'id'), ('l_returnflag', 'category'), ('l_shipdate', 'date'), ('odd', 'label')) x(c, r)
UNION ALL SELECT 'lineitem', 'l_quantity', CASE WHEN COUNT(*) FILTER (WHERE l_quantity <> FLOOR(l_quantity)) > 0 THEN 'consumption' ELSE 'id' END, COUNT(*) FROM lineitem
UNION ALL SELECT 'events', 'event_key', CASE WHEN COUNT(DISTINCT event_id) = COUNT(*) THEN 'id' ELSE 'category' END, COUNT(*) FROM events
UNION ALL SELECT 'events', 'user_key', CASE WHEN COUNT(DISTINCT user_id) = COUNT(*) THEN 'id' ELSE 'category' END, COUNT(*) FROM events""")
