"""Names, thresholds, weights and texts that results depend on."""

# --- header names accepted for each role, in order of preference (fixed values) ---
ID_HEADERS = [
    "customer_id", "cust_id", "client_id", "consumer_id", "cons_no", "consno", "cons no",
    "contract_no", "contract", "account_no", "account", "subscriber_id", "meter_id", "meter_no", "id",
]
DATE_HEADERS = ["date", "reading_date", "timestamp", "day", "datetime", "reading day"]
CONSUMPTION_HEADERS = [
    "consumption_kwh", "consumption", "kwh", "usage", "electricity_consumption",
    "energy", "reading", "meter_reading", "daily_consumption", "value",
]
LABEL_HEADERS = [
    "flag", "label", "fraud_label", "is_fraud", "target", "theft", "isstealer", "is_stealer", "stealer",
]
UNIT_HEADERS = {
    "date": ["date", "reading_date", "invoice_date", "month", "time", "timestamp"],
    "building_id": ["building_id", "building", "block", "property_id", "site_id"],
    "unit_id": ["unit_id", "apartment_id", "flat_id", "customer_id", "client_id", "meter_id"],
    "consumption_kwh": ["consumption_kwh", "kwh", "energy_kwh", "consumption", "quantity", "reading"],
    "floor": ["floor", "storey", "level"],
    "area_sqm": ["area_sqm", "sqm", "surface", "m2", "apartment_area"],
    "household_size": ["household_size", "residents", "people", "occupants"],
    "city": ["city", "municipality", "area", "zone", "district"],
    "location_type": ["location_type", "urban_rural", "settlement_type"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng"],
    "fraud_label": ["fraud_label", "is_fraud", "target", "label", "is_stealer", "theft"],
    "expected_kwh": ["expected_kwh", "expected_consumption", "baseline_kwh"],
}
NULL_TOKENS = ["", "nan", "None", "NULL", "-"]

# --- date formats besides ISO, tried in order: year first, month first, day first (fixed values) ---
DATE_FORMATS = ["yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy"]
HEADER_YEARS = (2000, 2100)
# --- day headers that are picked by hand, besides the strict forms ---
MAPPED_DAY_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%y", "%Y%m%d",
                      "%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y", "%d-%b-%Y", "%d-%b-%y"]

# --- columns that travel with a customer ---
LOCATION_COLUMNS = ["area_id", "transformer_id", "latitude", "longitude", "customer_type", "city",
                    "meter_age", "contract_power_kw"]
PAYMENT_COLUMNS = ["payment_late_count_12m", "unpaid_bills", "avg_payment_delay_days", "arrears_amount_lek",
                   "disconnections_12m", "months_since_last_payment", "payment_method", "account_status"]
CUSTOMER_COLUMNS = LOCATION_COLUMNS + PAYMENT_COLUMNS
INVOICE_LEVELS = ["consommation_level_1", "consommation_level_2", "consommation_level_3", "consommation_level_4"]

# --- cleaning ---
CAP_QUANTILE = 0.995
READINESS_WEIGHTS = {"completeness": 0.30, "dates": 0.25, "duplicates": 0.20, "history": 0.25}
READINESS_DAYS = 90.0

# --- weather: annual mean, amplitude, longitude, latitude per city (fixed values) ---
DEFAULT_CITY = "Tirana"
CITY_CLIMATE = {
    "Tirana": (16.2, 10.7, 19.8187, 41.3275),
    "Durres": (16.7, 9.5, 19.4414, 41.3231),
    "Shkoder": (15.8, 10.1, 19.5033, 42.0693),
    "Vlore": (17.4, 9.1, 19.4914, 40.4661),
    "Elbasan": (16.0, 11.2, 20.0822, 41.1125),
    "Fier": (16.8, 10.0, 19.5561, 40.7239),
    "Korce": (11.9, 12.0, 20.7808, 40.6186),
    "Kukes": (11.6, 12.4, 20.4217, 42.0767),
}
COLD_BELOW, HOT_ABOVE = 10.0, 26.0
HEATING_BASE, COOLING_BASE = 18.0, 24.0
WEATHER_DEFAULTS = {
    "temp_mean": 18.0, "temp_min": 12.0, "temp_max": 24.0, "precipitation_mm": 0.0,
    "heating_degree_days": 0.0, "cooling_degree_days": 0.0, "weather_class": 0,
    "is_cold": 0, "is_hot": 0, "weather_demand_pressure": 0,
}

# --- daily flags ---
ZERO_KWH = 0.05
DROP_SHARE, SPIKE_SHARE = 0.60, 1.50
LOW_SHARE = 0.25
FLAT_STD = 0.05
COLD_HOT_LOW_SHARE, NORMAL_HIGH_SHARE = 0.35, 2.25

# --- model inputs (fixed values) ---
MODEL_FEATURES = [
    "avg_consumption", "std_consumption", "cv_consumption", "last_30_mean", "previous_90_mean",
    "recent_drop_pct", "recent_spike_pct", "zero_day_ratio", "low_day_ratio", "flatline_ratio",
    "sudden_drop_count", "sudden_spike_count", "longest_zero_streak", "longest_low_streak",
    "consumption_trend_slope", "peer_deviation_pct", "customer_vs_peer_ratio", "meter_age",
    "contract_power_kw", "sudden_behavior_score", "avg_temp_mean", "avg_heating_degree_days",
    "avg_cooling_degree_days", "avg_weather_demand_pressure", "weather_mismatch_ratio",
    "extreme_weather_day_ratio", "weather_context_score", "low_extreme_weather_days",
    "high_normal_weather_days", "payment_late_count_12m", "unpaid_bills", "avg_payment_delay_days",
    "arrears_amount_lek", "disconnections_12m", "months_since_last_payment", "payment_on_time_ratio",
    "payment_risk_score",
]
EXPECTED_FEATURES = [
    "previous_90_mean", "first_90_mean", "avg_consumption", "std_consumption", "cv_consumption",
    "peer_avg_last_30", "contract_power_kw", "meter_age", "avg_heating_degree_days",
    "avg_cooling_degree_days", "avg_weather_demand_pressure",
]
UNIT_FEATURES = [
    "avg_consumption", "std_consumption", "zero_ratio", "flatline_ratio", "low_expected_ratio",
    "sudden_drop_days", "weather_mismatch_ratio", "expected_gap_pct", "peer_low_gap_pct", "kwh_per_sqm",
    "kwh_per_person", "cv_consumption", "avg_weather_demand_pressure", "area_sqm", "household_size",
    "floor", "contracted_power_kw",
]

# --- risk ---
TARIFF_LOW, TARIFF_HIGH, TARIFF_LIMIT_KWH = 8.5, 9.5, 700.0
UNIT_TARIFF = 13.5
LEVELS = ["Low", "Medium", "High", "Critical"]
CUSTOMER_LEVEL_EDGES = (30.0, 60.0, 80.0)      # right-closed: 30 is Low, 60.5 is High
UNIT_LEVEL_EDGES = (38.0, 64.0, 82.0)          # left-closed: 38 is Medium
COLOR_EDGES = ((81.0, "red"), (61.0, "orange"), (31.0, "yellow"))
PRELIM_HIGH, PRELIM_CRITICAL = 65, 82
FINAL_HIGH, FINAL_CRITICAL = 61, 81
QUEUE_SIZE = 200
PRIORITY_COLUMNS = [
    "priority_rank", "customer_id", "risk_score", "risk_level", "inspection_priority_score", "area_id",
    "transformer_id", "latitude", "longitude", "estimated_loss_all_30d", "weather_context_score",
    "weather_mismatch_ratio", "main_reason", "recommended_action",
]
CORRELATION_COLUMNS = [
    "risk_score", "fraud_probability", "ai_anomaly_score", "historical_deviation_score",
    "peer_deviation_score", "geographic_risk_score", "sudden_flags_score", "recent_drop_pct",
    "zero_day_ratio", "flatline_ratio", "sudden_drop_count", "expected_deviation_pct",
    "payment_risk_score", "unpaid_bills", "arrears_amount_lek", "estimated_loss_all_30d",
]

# --- map envelopes: latitude range, longitude range ---
MAP_LATITUDE, MAP_LONGITUDE = (39.60, 42.75), (18.80, 21.10)
SEA_WEST_OF, SEA_LATITUDE = 19.30, (39.70, 42.30)
BUILDING_LATITUDE, BUILDING_LONGITUDE = (39.65, 42.65), (19.28, 21.05)
HOME_LATITUDE, HOME_LONGITUDE = 41.3275, 19.8189

# --- inspection cases ---
CASE_COLUMNS = ["priority_rank", "customer_id", "risk_score", "risk_level", "area_id", "transformer_id",
                "estimated_loss_all_30d", "main_reason", "recommended_action"]
CASE_COUNT = 75
CLOSED_STATUSES = ["Confirmed NTL", "False Alarm"]
FEED_SIZE = 300

# --- texts shown to the field teams (fixed values) ---
NO_REASON = "No severe suspicious pattern detected; customer behavior is close to historical and peer baseline."
ACTIONS = {
    "zero": "Verify physical meter reading, check disconnection/bypass possibility, inspect wiring and meter communication.",
    "flat": "Inspect meter integrity and data reporting; verify whether readings are frozen, estimated, or manipulated.",
    "drop": "Inspect meter seal, wiring, and possible bypass; compare physical reading with billing system.",
    "weather": "Verify meter reading during recent cold/hot demand periods and compare with neighboring customers under the same weather conditions.",
    "area": "Prioritize field inspection together with nearby high-risk customers in the same area/transformer zone.",
    "payment": "Combine collection and inspection: cross-check billing/payment history against metered consumption and verify the meter during a collection visit.",
    "monitor": "Monitor customer and schedule verification if the pattern continues.",
}
UNIT_DRIVERS = {
    "consumption_deviation_score": "below expected consumption",
    "peer_deviation_score": "below similar units",
    "meter_behavior_score": "meter flatline/drop/zero behavior",
    "weather_context_score": "weather-consumption mismatch",
    "building_ai_anomaly_score": "AI outlier behavior",
    "loss_impact_score": "estimated loss impact",
}
UNIT_ACTION_URGENT = "Prioritize meter inspection, compare common-area meter, and verify illegal shared connections."
UNIT_ACTION_MONITOR = "Monitor trend and inspect only if risk persists or neighboring units also become suspicious."
PLANNING_NOTE = "Capacity-planning signal; requires field verification before fraud decision."
DRIVER_LABELS = {
    "ai_anomaly_score": "AI anomaly",
    "historical_deviation_score": "Historical deviation",
    "peer_deviation_score": "Similar profile deviation",
    "geographic_risk_score": "Geographic risk",
    "sudden_flags_score": "Sudden behavior",
    "weather_context_score": "Weather context",
    "payment_risk_score": "Payment behavior",
}
