"""Twelve overlapping segment flags and the cohort summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom import playbooks
from churnloom.errors import KPICalculationError, require_columns
from churnloom.functions import flag, quote
from churnloom.operators.tidy import rows_from

INPUTS = (
    "CustomerID", "SatisfactionScore", "Complain", "DaySinceLastOrder", "OrderCount",
    "CashbackAmount", "PreferredLoginDevice", "CouponUsed", "RFM_Segment", "TenureGroup",
    "AppExposure", "RuleBasedChurnIndicator",
)


# An OR holds when one side surely holds, whatever is unknown about the other.
RULES = {
    "is_champion": "RFM_Segment = 'Champions'",
    "is_loyal": "RFM_Segment = 'Loyal Customers'",
    "is_high_value": "CashbackAmount >= 220",
    "is_growth": "TenureGroup = '6-12m' AND Complain = 0",
    "is_frequent_buyer": "OrderCount >= 5",
    "is_discount_seeker": "CouponUsed >= 3 OR CashbackAmount / (OrderCount + 1.0D) >= 60",
    "is_mobile_first": "PreferredLoginDevice IN ('Mobile Phone', 'Phone')",
    "is_high_engagement": "AppExposure >= 15",
    "is_at_risk": "RFM_Segment = 'At Risk' OR RuleBasedChurnIndicator = 1",
    "is_dissatisfied": "SatisfactionScore <= 2",
    "is_complaint_prone": "Complain = 1",
    "is_inactive": "DaySinceLastOrder >= 10",
}


def flag_columns() -> dict[str, Column]:
    """Flag name and rule; an unknown condition counts as not met."""
    return {name: flag(rule) for name, rule in RULES.items()}


def flag_segments(df: DataFrame) -> DataFrame:
    """Append the twelve flags in one projection."""
    require_columns(df, INPUTS, KPICalculationError, "segment flags")
    return df.withColumns(flag_columns())


def cohort_summary(df: DataFrame) -> DataFrame:
    """Size, share, churn and strategy of every cohort, empty ones included; one pass."""
    members = [F.expr(f"coalesce(sum({f}), 0L) AS n_{f}") for f in c.FLAG_LABELS]
    churn = [F.expr(f"coalesce(avg(CASE WHEN {f} = 1 THEN Churn END), 0.0D) AS churn_{f}")
             for f in c.FLAG_LABELS]
    rows = []
    for name, label in c.FLAG_LABELS.items():
        texts = dict(zip(playbooks.COHORT_FIELDS, playbooks.COHORT_TEXTS[label]))
        rows.append({
            "cohort": quote(label), "flag": quote(name), "customer_count": f"n_{name}",
            "percentage":
                f"CASE WHEN total > 0 THEN rint(n_{name} / total * 100.0D * 100.0D) / 100.0D ELSE 0.0D END",
            "segment_churn_rate_pct": f"rint(churn_{name} * 100.0D * 100.0D) / 100.0D",
            **{key: quote(text) for key, text in texts.items()}})
    return rows_from(df.agg(F.count("*").alias("total"), *members, *churn), rows)
