"""Report tables over the scored mart. Each is one grouping or one top-k over few columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import KPICalculationError
from churnloom.functions import cut, exact_mean, percent, round_even
from churnloom.operators.tidy import rows_from
from churnloom.plans.stages import literal_table

# Bins of the report histograms.
SCORE_LABELS = ("0-20", "21-40", "41-60", "61-80", "81-100")
QUALITY_EDGES = (0, 20, 40, 60, 80, 101)
SCORE_EDGES = (-1, 20, 40, 60, 80, 101)
PROBABILITY_EDGES = (-0.01, 0.20, 0.40, 0.60, 0.80, 1.01)
PROBABILITY_LABELS = ("0-20%", "21-40%", "41-60%", "61-80%", "81-100%")
CONFIDENCE_EDGES = (0.49, 0.60, 0.70, 0.80, 0.90, 1.01)
CONFIDENCE_LABELS = ("50-60%", "61-70%", "71-80%", "81-90%", "91-100%")
TIER_ORDER = ("Low", "Medium", "High", "Critical")
GRADE_ORDER = ("A", "B", "C", "D", "E", "F")
RISK_ORDER = ("Low Risk", "Medium Risk", "High Risk", "Critical Risk")
# The per-flag averages leave one flag out.
AVERAGED_FLAGS = tuple(f for f in c.FLAG_LABELS if f != "is_dissatisfied")


def counts(df: DataFrame, column: str) -> DataFrame:
    """Customers per value of a column."""
    return df.groupBy(column).agg(F.count("*").alias("count"))


def counts_in_order(df: DataFrame, column: str, order) -> DataFrame:
    """Customers per value in a fixed order; values nobody has count zero."""
    sizes = counts(df, column)
    values = literal_table(df.sparkSession, {column: list(order), "position": list(range(len(order)))},
                           {"position": "int"})
    return values.join(sizes, column, "left").select(
        column, "position", F.coalesce("count", F.lit(0).cast("bigint")).alias("count")).orderBy("position")


def histogram(df: DataFrame, column: str, edges, labels) -> DataFrame:
    """Customers per bin, every bin listed; values outside all bins are left out."""
    return counts_in_order(df.select(cut(column, edges, labels).alias("bin")), "bin", labels)


def flag_penetration(df: DataFrame) -> DataFrame:
    """Customers and share per segment flag, in one pass."""
    sums = df.agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in c.FLAG_LABELS])
    none = F.lit(0).cast("bigint")
    return rows_from(sums, [
        {"flag": F.lit(f), "count": F.coalesce(F.col(f), none),
         "percentage": round_even(percent(F.coalesce(F.col(f), none), "n"), 2)} for f in c.FLAG_LABELS])


def churn_by_complaint(df: DataFrame) -> DataFrame:
    """Predicted churn in percent without and with a complaint."""
    rates = df.agg(*[
        F.avg(F.when(F.col("Complain") == k, F.col("Churn_Prediction"))).alias(f"r{k}") for k in (0, 1)])
    return rows_from(rates, [
        {"complaint": F.lit(label),
         "predicted_churn_rate_pct": round_even(F.coalesce(F.col(f"r{k}"), F.lit(0.0)) * 100.0, 2)}
        for k, label in ((0, "No Complaint"), (1, "Complaint Logged"))])


def satisfaction_distribution(df: DataFrame) -> DataFrame:
    return counts(df.where("SatisfactionScore IS NOT NULL"), "SatisfactionScore").orderBy("SatisfactionScore")


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    return counts(df, score).orderBy(score)


def attention_list(scored: DataFrame, size: int = 10) -> DataFrame:
    """The unhealthiest customers of the two highest risk tiers; a top-k, not a sort."""
    return (
        scored.where(F.col("Prediction_Risk_Level").isin("High", "Critical"))
        .select("CustomerID", "CustomerHealthScore", "Health_Grade", "Risk_Level", "Churn_Probability",
                "Prediction_CRM_Action")
        .orderBy(F.asc_nulls_last("CustomerHealthScore"), "CustomerID").limit(size))


def mean_rfm_sum(df: DataFrame) -> DataFrame:
    return df.agg(round_even(F.avg("RFM_Sum"), 4).alias("avg_rfm_sum"))


def mean_rfm_sum_by_segment(df: DataFrame) -> DataFrame:
    return df.groupBy("RFM_Segment").agg(round_even(F.avg("RFM_Sum"), 4).alias("avg_rfm_sum"))


def flag_averages(scored: DataFrame) -> DataFrame:
    """Predicted churn, health, satisfaction and cashback of each flag's members; one pass."""
    def member(f, column):
        return F.when(F.col(f) == 1, F.col(column))

    aggregates, rows = [], []
    for f in AVERAGED_FLAGS:
        aggregates += [
            F.avg(member(f, "Churn_Prediction")).alias(f"churn_{f}"),
            exact_mean(member(f, "CustomerHealthScore"), 2).alias(f"health_{f}"),
            F.avg(member(f, "SatisfactionScore")).alias(f"csat_{f}"),
            exact_mean(member(f, "CashbackAmount"), 4).alias(f"cash_{f}")]
        shown = lambda name, factor=1.0: round_even(
            F.coalesce(F.col(name), F.lit(0.0)) * factor, 2)
        rows.append({
            "segment": F.lit(f.removeprefix("is_")),
            "predicted_churn_pct": shown(f"churn_{f}", 100.0), "avg_health_score": shown(f"health_{f}"),
            "avg_satisfaction": shown(f"csat_{f}"), "avg_cashback": shown(f"cash_{f}")})
    return rows_from(scored.agg(*aggregates), rows)


def largest_cohort(df: DataFrame) -> DataFrame:
    """The flag with most members; equal sizes go by name."""
    best = F.struct((-F.col("count")).alias("rank"), "flag", "count")
    return flag_penetration(df).agg(F.min(best).alias("best")).select(
        F.col("best.flag").alias("flag"), F.col("best.count").alias("count"))


def scored_totals(scored: DataFrame) -> DataFrame:
    """Customers predicted to churn and to stay, mean probability and confidence."""
    return scored.agg(
        F.count("*").alias("total_scored"),
        F.count_if(F.col("Churn_Prediction") == 1).alias("predicted_churn"),
        (F.count("*") - F.count_if(F.col("Churn_Prediction") == 1)).alias("predicted_retained"),
        round_even(exact_mean("Churn_Probability", 4), 4).alias("avg_probability"),
        round_even(exact_mean("Prediction_Confidence", 4), 4).alias("avg_confidence"))


def averages_by_tier(scored: DataFrame) -> DataFrame:
    """Mean health and satisfaction of each risk tier."""
    return scored.groupBy("Prediction_Risk_Level").agg(
        round_even(exact_mean("CustomerHealthScore", 2), 2).alias("avg_health_score"),
        round_even(F.avg("SatisfactionScore"), 2).alias("avg_satisfaction"))


def probability_by_segment(scored: DataFrame) -> DataFrame:
    """Mean churn probability in percent of each segment."""
    return scored.groupBy("RFM_Segment").agg(
        round_even(exact_mean("Churn_Probability", 4) * 100.0, 2).alias("avg_churn_prob_pct"))


def audit_grid(scored: DataFrame, threshold: float = 0.5, tier: str | None = None) -> DataFrame:
    """Customers at or above a probability, optionally of one tier, under report headings."""
    rows = scored.where(F.col("Churn_Probability") >= threshold)
    if tier is not None:
        rows = rows.where(F.col("Prediction_Risk_Level") == tier)
    # Headings of the grid.
    return rows.select(
        F.col("CustomerID").alias("Customer ID"),
        F.col("Churn_Probability").alias("Churn Prob"),
        F.col("Prediction_Confidence").alias("Certainty"),
        F.col("Prediction_Risk_Level").alias("Risk Level"),
        F.col("CustomerHealthScore").alias("Health Score"),
        F.col("Prediction_CRM_Action").alias("CS Playbook Campaign Play"))


def top_drivers(importance: DataFrame, size: int = 12) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(size)


def dashboard_summary(kpis: DataFrame, health: DataFrame, tiers: DataFrame) -> DataFrame:
    """Ten headline figures. The inputs are one-row tables, joined on a constant."""
    one = F.lit(1).alias("one")
    risk = tiers.agg(
        F.sum(F.when(F.col("risk_tier") == "Critical", F.col("count"))).alias("critical_risk_count"),
        F.sum(F.when(F.col("risk_tier") == "High", F.col("count"))).alias("high_risk_count"))
    head = kpis.select(
        one, "total_customers", "active_customers", "churned_customers", "churn_rate_pct",
        "retention_rate_pct", F.col("avg_satisfaction_score").alias("average_satisfaction"),
        "complaint_rate_pct")
    return (
        head.join(health.select(one, "average_health_score"), "one")
        .join(risk.select(one, "critical_risk_count", "high_risk_count"), "one").drop("one"))


def customer_profiles(scored: DataFrame) -> DataFrame:
    """Everything known about each customer, grouped into structs."""
    def group(**fields):
        return F.struct(*[F.col(column).alias(name) for name, column in fields.items()])

    return scored.select(
        "CustomerID",
        group(customer_id="CustomerID", gender="Gender", marital_status="MaritalStatus",
              city_tier="CityTier", preferred_login_device="PreferredLoginDevice",
              preferred_payment_mode="PreferredPaymentMode",
              preferred_order_category="PreferedOrderCat").alias("profile"),
        group(tenure_months="Tenure", days_since_last_order="DaySinceLastOrder",
              order_count="OrderCount", hour_spend_on_app="HourSpendOnApp",
              number_of_device_registered="NumberOfDeviceRegistered",
              number_of_address="NumberOfAddress", complain_logged="Complain",
              satisfaction_score="SatisfactionScore", cashback_amount="CashbackAmount",
              coupon_used="CouponUsed").alias("activity_metrics"),
        group(recency_score="Recency_Score", frequency_score="Frequency_Score",
              monetary_score="Monetary_Score", composite_rfm_score="RFM_Score", rfm_sum="RFM_Sum",
              rfm_segment="RFM_Segment", crm_recommendation="RFM_Recommendation").alias("rfm"),
        group(health_score="CustomerHealthScore", health_category="Health_Category",
              health_grade="Health_Grade", risk_level="Risk_Level",
              service_quality_score="Service_Quality_Score",
              purchase_momentum_score="Purchase_Momentum_Score",
              app_engagement_score="App_Engagement_Score",
              tenure_loyalty_score="Tenure_Loyalty_Score").alias("health"),
        group(predicted_churn="Churn_Prediction", churn_probability="Churn_Probability",
              confidence_score="Prediction_Confidence", prediction_risk_tier="Prediction_Risk_Level",
              crm_retention_action="Prediction_CRM_Action", model_version="Prediction_Model_Version",
              prediction_timestamp="Prediction_Timestamp").alias("predictions"))


def customer_profile(scored: DataFrame, customer_id: int, explanations: DataFrame | None = None) -> DataFrame:
    """The profile of one customer, with the explanation of the prediction if given."""
    found = customer_profiles(scored.where(F.col("CustomerID") == customer_id))
    if found.isEmpty():
        raise KPICalculationError(f"customer {customer_id} is not in the mart")
    if explanations is None:
        return found
    own = explanations.where(F.col("CustomerID") == customer_id)
    columns = [n for n in own.columns if n != "CustomerID"]
    return found.join(own.select("CustomerID", F.struct(*columns).alias("explainability")), "CustomerID", "left")


def run_metadata(df: DataFrame, source: str) -> DataFrame:
    """One row about a pipeline run."""
    return df.agg(F.count("*").alias("processed_records_count")).select(
        F.lit("ONLINE").alias("service_status"),
        F.current_timestamp().alias("pipeline_last_run_timestamp"),
        F.lit(source).alias("data_source_filepath"), "processed_records_count")
