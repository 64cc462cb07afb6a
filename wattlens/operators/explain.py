"""Reasons and recommended actions in words, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattlens import constants as K
from wattlens.functions.columns import num_or


def percent(share: Column) -> Column:
    """Whole percent, halves to even."""
    whole = F.bround(F.greatest(share, F.lit(0.0)) * 100, 0).cast("long")
    return F.concat(whole.cast("string"), F.lit("%"))


def whole(value: Column) -> Column:
    return value.cast("long").cast("string")


def tenths(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(value, 1))


def payment_reason(df: DataFrame) -> Column:
    """Billing behaviour in words, or NULL when it is unremarkable."""
    risk, unpaid, arrears = num_or(df, "payment_risk_score"), num_or(df, "unpaid_bills"), num_or(df, "arrears_amount_lek")
    late, cuts = num_or(df, "payment_late_count_12m"), num_or(df, "disconnections_12m")
    arrears_text = F.when(arrears > 0, F.concat(F.lit(", arrears "), F.format_number(arrears, 0), F.lit(" Lek"))).otherwise("")
    irregular = F.concat(F.lit("Irregular billing/payment behavior: "), whole(late), F.lit(" late payments and "),
                         whole(unpaid), F.lit(" unpaid bills in 12 months"), arrears_text, F.lit("."))
    cut_off = F.concat(whole(cuts), F.lit(" non-payment disconnection(s) on record — verify reconnection and meter integrity."))
    return F.when((risk > 55) | (unpaid >= 3), irregular).when((cuts >= 1) & (risk > 35), cut_off)


def reasons(df: DataFrame) -> Column:
    """All reasons that apply, strongest signals first. A dominant payment problem leads the list."""
    def v(name: str) -> Column:
        return num_or(df, name)

    # fixed values: thresholds and wording
    rules = [
        (v("recent_drop_pct") > 0.45,
         [F.lit("Recent consumption dropped "), percent(v("recent_drop_pct")),
          F.lit(" compared with the customer's previous baseline.")]),
        (v("peer_deviation_pct") > 0.35,
         [F.lit("Customer consumes "), percent(v("peer_deviation_pct")), F.lit(" less than similar consumption profiles.")]),
        ((v("zero_day_ratio") > 0.08) | (v("longest_zero_streak") >= 5),
         [F.lit("Detected "), whole(v("zero_days")), F.lit(" zero/near-zero consumption days, longest streak "),
          whole(v("longest_zero_streak")), F.lit(" days.")]),
        ((v("flatline_ratio") > 0.08) | (v("flatline_days") >= 10),
         [F.lit("Detected flat or almost constant readings for "), whole(v("flatline_days")), F.lit(" days.")]),
        (v("sudden_drop_count") >= 5,
         [F.lit("Detected "), whole(v("sudden_drop_count")), F.lit(" sudden daily drop events.")]),
        (v("ai_anomaly_score") > 75,
         [F.lit("AI anomaly model assigned a high anomaly score of "), tenths(v("ai_anomaly_score")), F.lit("/100.")]),
        (v("area_risk_score") > 65,
         [F.lit("Customer is located in a high-risk area with area risk "), tenths(v("area_risk_score")), F.lit("/100.")]),
        (v("transformer_risk_score") > 65,
         [F.lit("Transformer zone shows concentrated anomalies with transformer risk "),
          tenths(v("transformer_risk_score")), F.lit("/100.")]),
        (v("expected_deviation_pct") > 0.35,
         [F.lit("Actual recent consumption is "), percent(v("expected_deviation_pct")),
          F.lit(" below expected consumption model output.")]),
        ((v("weather_mismatch_ratio") > 0.08) | (v("weather_context_score") > 55),
         [F.lit("Weather context mismatch detected: "), whole(v("weather_mismatch_days")),
          F.lit(" days where consumption did not match cold/hot demand expectations.")]),
    ]
    payment, dominant = payment_reason(df), v("payment_risk_score") >= 70
    listed = F.array_compact(F.array(F.when(dominant, payment), *[F.when(c, F.concat(*t)) for c, t in rules],
                                     F.when(~dominant, payment)))
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(K.NO_REASON)))


def action(df: DataFrame) -> Column:
    """First field action whose condition holds."""
    def v(name: str) -> Column:
        return num_or(df, name)

    return (F.when((v("zero_day_ratio") > 0.08) | (v("longest_zero_streak") >= 5), K.ACTIONS["zero"])
            .when(v("flatline_ratio") > 0.08, K.ACTIONS["flat"])
            .when((v("recent_drop_pct") > 0.45) & (v("peer_deviation_pct") > 0.35), K.ACTIONS["drop"])
            .when(v("weather_mismatch_ratio") > 0.08, K.ACTIONS["weather"])
            .when(v("area_risk_score") > 65, K.ACTIONS["area"])
            .when((v("payment_risk_score") > 60) | (v("unpaid_bills") >= 4), K.ACTIONS["payment"])
            .otherwise(K.ACTIONS["monitor"]))


def add_explanations(df: DataFrame) -> DataFrame:
    """Main reason, up to six reasons joined by a bar, and the recommended action."""
    out = df.withColumn("_reasons", reasons(df)).withColumn("recommended_action", action(df))
    return out.withColumns({"main_reason": F.element_at("_reasons", 1),
                            "alert_explanation": F.array_join(F.slice("_reasons", 1, 6), " | ")}).drop("_reasons")
