"""Customer health: four component scores, the weighted score, bands and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom import playbooks
from churnloom.errors import KPICalculationError, require_columns
from churnloom.functions import clip, cut, exact_mean, number, percent, round_even
from churnloom.plans.stages import literal_table

INPUTS = ("SatisfactionScore", "Complain", "DaySinceLastOrder", "AppExposure", "Tenure")


def service_quality() -> Column:
    """Satisfaction on a 0..100 scale, 40 points less after a complaint."""
    return clip("SatisfactionScore / 5.0D * 100.0D - Complain * 40.0D", 0.0, 100.0)


def purchase_momentum() -> Column:
    """100 on the day of an order, falling to 0 after 30 days."""
    return clip("(1.0D - DaySinceLastOrder / 30.0D) * 100.0D", 0.0, 100.0)


def app_engagement() -> Column:
    """App exposure relative to 20."""
    return clip("AppExposure / 20.0D * 100.0D", 0.0, 100.0)


def tenure_loyalty() -> Column:
    """Tenure relative to 48 months."""
    return clip("Tenure / 48.0D * 100.0D", 0.0, 100.0)


def score_health(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Append the component scores, the health score and its three bands."""
    require_columns(df, INPUTS, KPICalculationError, "health scoring")
    w = c.HEALTH_WEIGHTS if weights is None else weights
    if abs(sum(w.values()) - 1.0) > 0.01:
        raise KPICalculationError(f"health weights add up to {sum(w.values())}, not 1")
    parts = {
        "service_quality": "Service_Quality_Score",
        "purchase_momentum": "Purchase_Momentum_Score",
        "app_engagement": "App_Engagement_Score",
        "tenure_loyalty": "Tenure_Loyalty_Score",
    }
    scored = df.withColumns({
        "Service_Quality_Score": service_quality(),
        "Purchase_Momentum_Score": purchase_momentum(),
        "App_Engagement_Score": app_engagement(),
        "Tenure_Loyalty_Score": tenure_loyalty(),
    })
    weighted = " + ".join(f"{column} * {number(w[key])}" for key, column in parts.items())
    scored = scored.withColumn("CustomerHealthScore", round_even(weighted, 2))
    return scored.withColumns({
        "Health_Category": cut("CustomerHealthScore", c.HEALTH_EDGES, c.HEALTH_CATEGORIES),
        "Health_Grade": cut("CustomerHealthScore", c.HEALTH_EDGES, c.HEALTH_GRADES),
        "Risk_Level": cut("CustomerHealthScore", c.HEALTH_EDGES, c.HEALTH_RISKS),
    })


def category_summary(df: DataFrame) -> DataFrame:
    """All five categories, best first, with averages and playbook; empty ones are zero."""
    stats = df.groupBy("Health_Category").agg(
        F.count("*").alias("customers"),
        F.avg("Churn").alias("churn"),
        F.avg("SatisfactionScore").alias("csat"),
        F.avg("Complain").alias("complain"),
        F.avg("DaySinceLastOrder").alias("recency"),
        F.avg("Tenure").alias("tenure"))
    from pyspark.sql import Window as W

    # At most six rows remain here: five categories and the unscored.
    stats = stats.withColumn("total", F.sum("customers").over(W.partitionBy(F.lit(1))))
    names = list(reversed(c.HEALTH_CATEGORIES))
    risks = dict(zip(c.HEALTH_CATEGORIES, c.HEALTH_RISKS))
    categories = literal_table(df.sparkSession, {
        "Health_Category": names,
        "risk_level": [risks[n] for n in names],
        "description": [playbooks.HEALTH_TEXTS[n][0] for n in names],
        "playbook_action": [playbooks.HEALTH_TEXTS[n][1] for n in names],
    })

    def shown(value, digits):
        return round_even(F.coalesce(value, F.lit(0.0)), digits)

    return categories.join(stats, "Health_Category", "left").select(
        "Health_Category",
        F.coalesce("customers", F.lit(0).cast("bigint")).alias("customer_count"),
        shown(F.col("customers") / F.col("total") * 100.0, 2).alias("percentage"),
        shown(F.col("churn") * 100.0, 2).alias("churn_rate_pct"),
        shown(F.col("csat"), 2).alias("csat"),
        shown(F.col("complain") * 100.0, 2).alias("complaint_rate_pct"),
        shown(F.col("recency"), 1).alias("recency_days"),
        shown(F.col("tenure"), 1).alias("tenure_months"),
        "risk_level", "description", "playbook_action")


def overall_summary(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: customers evaluated, mean score, healthy and critical shares, weights."""
    w = c.HEALTH_WEIGHTS if weights is None else weights
    totals = df.agg(
        F.count("*").alias("n"), exact_mean("CustomerHealthScore", 2).alias("mean"),
        F.count_if(F.col("CustomerHealthScore") >= 75.0).alias("healthy"),
        F.count_if(F.col("CustomerHealthScore") < 40.0).alias("critical"))
    return totals.select(
        F.col("n").alias("total_customers_evaluated"),
        round_even("mean", 2).alias("average_health_score"),
        round_even(percent("healthy", "n"), 2).alias("healthy_percentage"),
        round_even(percent("critical", "n"), 2).alias("critical_percentage"),
        *[F.lit(float(v)).alias(f"weight_{k}") for k, v in w.items()])
