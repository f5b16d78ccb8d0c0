"""Business indicators, their dictionary and the recommendations derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom import playbooks
from churnloom.errors import KPICalculationError, require_columns
from churnloom.functions import percent, round_even
from churnloom.operators.tidy import rows_from

INPUTS = (
    "CustomerID", "Churn", "SatisfactionScore", "Complain", "HourSpendOnApp", "CashbackAmount",
    "OrderCount", "is_high_engagement", "is_loyal", "is_mobile_first", "is_discount_seeker",
    "is_frequent_buyer", "is_champion", "is_at_risk", "is_high_value", "is_complaint_prone",
    "RFM_Sum", "RFM_Segment", "RawHealthIndex", "AppExposure", "CustomerLoyaltyScore",
)
# Indicator groups; names refer to the dictionary in ``playbooks.KPI_TEXTS``.
GROUPS = {
    "customer_base": ("total_customers", "active_customers", "churned_customers", "churn_rate_pct",
                      "retention_rate_pct"),
    "engagement": ("avg_satisfaction_score", "complaint_rate_pct", "avg_app_usage_hours",
                   "avg_cashback_amount", "avg_order_count"),
    "behavior": ("high_engagement_pct", "high_loyalty_pct", "mobile_first_pct", "discount_seeker_pct",
                 "frequent_buyer_pct"),
    "segmentation": ("champions_pct", "loyal_customers_pct", "at_risk_pct", "high_value_pct",
                     "complaint_prone_pct"),
    "rfm": ("avg_rfm_sum", "top_rfm_segment", "weakest_rfm_segment"),
    "health_indices": ("customer_health_index", "engagement_index", "satisfaction_index_pct",
                       "loyalty_index"),
}
_MEANS = ("SatisfactionScore", "HourSpendOnApp", "OrderCount", "RFM_Sum", "RawHealthIndex",
          "AppExposure", "CustomerLoyaltyScore")
_FLAGS = ("is_high_engagement", "is_loyal", "is_mobile_first", "is_discount_seeker",
          "is_frequent_buyer", "is_champion", "is_at_risk", "is_high_value", "is_complaint_prone")


def calculate_kpis(df: DataFrame) -> DataFrame:
    """All 27 indicators in one row.

    One grouping by segment yields partial sums and the segment sizes; a second, over the
    handful of segments, combines them. The table is read once.
    """
    require_columns(df, INPUTS, KPICalculationError, "indicators")
    cents = F.rint(F.col("CashbackAmount") * 10000.0).cast("bigint")
    partial = df.groupBy("RFM_Segment").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("Churn") == 0).alias("active"), F.count_if(F.col("Churn") == 1).alias("churned"),
        F.count_if(F.col("Complain") == 1).alias("complaints"),
        F.sum(cents).alias("cents"), F.count(cents).alias("cents_n"),
        *[F.sum(F.col(m).cast("double")).alias(f"sum_{m}") for m in _MEANS],
        *[F.count(m).alias(f"n_{m}") for m in _MEANS],
        *[F.sum(f).alias(f) for f in _FLAGS])
    summed = ["n", "active", "churned", "complaints", "cents", "cents_n", *_FLAGS]
    summed += [f"{p}_{m}" for m in _MEANS for p in ("sum", "n")]
    # Ties: the larger segment first, equal sizes by name.
    size, segment = F.col("n"), F.col("RFM_Segment")
    totals = partial.agg(
        *[F.sum(s).alias(f"t_{s}") for s in summed],
        F.min_by(segment, F.struct(-size, segment)).alias("top"),
        F.min_by(segment, F.struct(size, segment)).alias("weakest"))

    total = F.coalesce("t_n", F.lit(0).cast("bigint"))
    mean = lambda m: F.try_divide(F.col(f"t_sum_{m}"), F.col(f"t_n_{m}"))
    share = lambda f: round_even(percent(f"t_{f}", total), 2)
    whole = lambda s: F.coalesce(f"t_{s}", F.lit(0).cast("bigint"))
    values = {
        "total_customers": total,
        "active_customers": whole("active"),
        "churned_customers": whole("churned"),
        "churn_rate_pct": share("churned"),
        "retention_rate_pct": share("active"),
        "avg_satisfaction_score": round_even(mean("SatisfactionScore"), 2),
        "complaint_rate_pct": share("complaints"),
        "avg_app_usage_hours": round_even(mean("HourSpendOnApp"), 2),
        "avg_cashback_amount": round_even(
            F.try_divide(F.col("t_cents").cast("double"), F.col("t_cents_n")) / 10000.0, 2),
        "avg_order_count": round_even(mean("OrderCount"), 2),
        "high_engagement_pct": share("is_high_engagement"),
        "high_loyalty_pct": share("is_loyal"),
        "mobile_first_pct": share("is_mobile_first"),
        "discount_seeker_pct": share("is_discount_seeker"),
        "frequent_buyer_pct": share("is_frequent_buyer"),
        "champions_pct": share("is_champion"),
        "loyal_customers_pct": share("is_loyal"),
        "at_risk_pct": share("is_at_risk"),
        "high_value_pct": share("is_high_value"),
        "complaint_prone_pct": share("is_complaint_prone"),
        "avg_rfm_sum": round_even(mean("RFM_Sum"), 2),
        "top_rfm_segment": F.coalesce("top", F.lit("None")),
        "weakest_rfm_segment": F.coalesce("weakest", F.lit("None")),
        "customer_health_index": round_even(mean("RawHealthIndex"), 2),
        "engagement_index": round_even(mean("AppExposure"), 2),
        "satisfaction_index_pct": round_even(mean("SatisfactionScore") / 5.0 * 100.0, 2),
        "loyalty_index": round_even(mean("CustomerLoyaltyScore"), 2),
    }
    return totals.select(*[v.alias(name) for name, v in values.items()])


def kpi_group(kpis: DataFrame, group: str) -> DataFrame:
    """The indicators of one group, still one row."""
    return kpis.select(*GROUPS[group])


def kpi_dictionary(kpis: DataFrame) -> DataFrame:
    """One row per indicator: group, key, title, meaning and value as text."""
    group_of = {name: g for g, names in GROUPS.items() for name in names}
    return rows_from(kpis, [
        {"kpi_group": F.lit(group_of[name]), "kpi": F.lit(name), "title": F.lit(title),
         "description": F.lit(meaning), "value": F.col(name).cast("string")}
        for name, (title, meaning) in playbooks.KPI_TEXTS.items()])


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def recommendations(kpis: DataFrame) -> DataFrame:
    """The rule-based recommendations, numbered in rule order.

    The wording is fixed: it is what readers of the report expect.
    """
    shown = lambda name: F.col(name).cast("string")
    churn, csat, complaints = (
        F.col("churn_rate_pct"), F.col("avg_satisfaction_score"), F.col("complaint_rate_pct"))
    # The wording of the recommendations and their limits.
    advice = [
        F.when(churn > 15.0, _text(
            "CRITICAL: Churn rate is elevated at ", shown("churn_rate_pct"),
            "%. Immediately activate the At-Risk cohort retention campaigns and check for coupon "
            "usage anomalies."))
        .otherwise(_text(
            "STABLE: Churn rate is within threshold at ", shown("churn_rate_pct"),
            "%. Focus on expanding LTV across high-value segments.")),
        F.when((csat < 3.5) | (complaints > 20.0), _text(
            "CX WARNING: CSAT rating is ", shown("avg_satisfaction_score"),
            "/5.0 and complaint rate is high at ", shown("complaint_rate_pct"),
            "%. Audit warehouse operations, shipping intervals, and delivery distance bottlenecks."))
        .otherwise(_text(
            "HEALTHY: Customer sentiment is strong (CSAT = ", shown("avg_satisfaction_score"),
            "/5.0). Maintain operational SLA targets.")),
        F.when(F.col("discount_seeker_pct") > 50.0, _text(
            "MARGIN RISK: ", shown("discount_seeker_pct"),
            "% of the customer base are Discount Seekers. Transition from straight discount coupons "
            "to purchase bundles and loyalty points to protect gross margins.")),
        F.when(F.col("mobile_first_pct") > 60.0, _text(
            "CHANNEL STRATEGY: Mobile-first users dominate the base (", shown("mobile_first_pct"),
            "%). Prioritize mobile app feature updates and deploy cart recovery push notifications.")),
        F.when(F.col("customer_health_index") < 2.0, _text(
            "HEALTH ALERT: Overall customer health index is low (", shown("customer_health_index"),
            "). Execute service recovery campaigns for dissatisfied customers.")),
    ]
    return kpis.select(F.posexplode(F.array_compact(F.array(*advice)))).select(
        (F.col("pos") + 1).alias("position"), F.col("col").alias("recommendation"))
