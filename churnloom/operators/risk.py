"""From a churn probability to tiers, actions and batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom import __version__, playbooks
from churnloom import contract as c
from churnloom.functions import lookup, percent, round_even
from churnloom.operators.tidy import rows_from


def risk_tier(probability) -> Column:
    """Low below .50, Medium from .50, High from .75, Critical from .90."""
    p = F.col(probability) if isinstance(probability, str) else probability
    tier = F.lit(None).cast("string")
    for name, lowest in reversed(c.RISK_TIERS):
        at_least = p.isNotNull() if lowest == 0.0 else p >= lowest
        tier = F.when(at_least, F.lit(name)).otherwise(tier)
    return tier


def with_risk(df: DataFrame, probability: str, prediction: str | None = None,
              version: str = __version__) -> DataFrame:
    """Append prediction, rounded probability, confidence, tier, action, time and version."""
    p = F.col(probability)
    predicted = (p > 0.5).cast("int") if prediction is None else F.col(prediction).cast("int")
    scored = df.withColumns({
        "Churn_Prediction": predicted,
        "Churn_Probability": round_even(p, 4),
        "Prediction_Confidence": round_even(F.when(predicted == 1, p).otherwise(1.0 - p), 4),
        "Prediction_Risk_Level": risk_tier(p),
    })
    return scored.withColumns({
        "Prediction_CRM_Action": lookup("Prediction_Risk_Level", playbooks.CRM_ACTIONS),
        "Prediction_Timestamp": F.current_timestamp(),
        "Prediction_Model_Version": F.lit(version),
    })


def tier_counts(scored: DataFrame) -> DataFrame:
    """Customers and share per tier, empty tiers included; one pass."""
    names = [name for name, _ in c.RISK_TIERS]
    counts = scored.agg(F.count("*").alias("n"), *[
        F.count_if(F.col("Prediction_Risk_Level") == name).alias(name) for name in names])
    return rows_from(counts, [
        {"risk_tier": F.lit(name), "count": F.col(name),
         "percentage": round_even(percent(name, "n"), 2)} for name in names])


def batch_statistics(scored: DataFrame, probability: str = "Churn_Probability",
                     algorithm: str = "Unknown", version: str = __version__) -> DataFrame:
    """One row: customers scored, mean probability, model."""
    return scored.agg(
        F.count("*").alias("total_predictions"),
        round_even(F.avg(probability), 4).alias("average_churn_probability")).withColumns({
            "model_version": F.lit(version), "algorithm_used": F.lit(algorithm)})
