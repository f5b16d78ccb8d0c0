"""Twelve behavioural features, all row-local column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import FeatureEngineeringError, require_columns
from churnloom.functions import cut, flag, number

INPUTS = (
    "Tenure", "WarehouseToHome", "OrderCount", "DaySinceLastOrder", "HourSpendOnApp",
    "NumberOfDeviceRegistered", "CashbackAmount", "Complain", "SatisfactionScore",
    "NumberOfAddress",
)


def tenure_group(edges=c.TENURE_EDGES, labels=c.TENURE_LABELS) -> Column:
    """Tenure band; tenures beyond the last edge fall into the last band."""
    capped = f"CASE WHEN Tenure IS NOT NULL THEN least(Tenure, {number(edges[-1] - 0.1)}) END"
    return cut(capped, edges, labels, include_lowest=True)


def feature_columns() -> dict[str, Column]:
    """Name and expression of every feature, in output order."""
    return {
        "TenureGroup": tenure_group(),
        "WarehouseDistanceBucket": cut(
            "WarehouseToHome", c.DISTANCE_EDGES, c.DISTANCE_LABELS, include_lowest=True),
        "OrderVelocity": F.expr("OrderCount / (DaySinceLastOrder + 1.0D)"),
        "AppExposure": F.expr("HourSpendOnApp * NumberOfDeviceRegistered"),
        "CashbackEfficiency": F.expr("CashbackAmount / (OrderCount + 1.0D)"),
        "ComplaintFrictionIndex": F.expr(
            "try_divide(CAST(Complain AS DOUBLE), CAST(SatisfactionScore AS DOUBLE))"),
        "OrderFrequencyTier": cut(
            "OrderCount", c.FREQUENCY_EDGES, c.FREQUENCY_LABELS, include_lowest=True),
        "CustomerLoyaltyScore": F.expr("Tenure * SatisfactionScore"),
        "AddressStabilityIndex": F.expr("NumberOfAddress / (Tenure + 1.0D)"),
        "TenureOrderRatio": F.expr("OrderCount / (Tenure + 1.0D)"),
        "RawHealthIndex": F.expr("SatisfactionScore - 2.0D * Complain + HourSpendOnApp / 5.0D"),
        "RuleBasedChurnIndicator": flag("Complain = 1 AND SatisfactionScore <= 2"),
    }


def build_features(df: DataFrame) -> DataFrame:
    """Append the twelve features in one projection."""
    require_columns(df, INPUTS, FeatureEngineeringError, "feature building")
    return df.withColumns(feature_columns())


def feature_registry(df: DataFrame) -> DataFrame:
    """Each feature with its type, meaning and number of known values in ``df``."""
    from churnloom.operators.tidy import rows_from

    kinds = dict(df.dtypes)
    known = df.agg(*[F.count(n).alias(n) for n in c.FEATURE_TYPES])
    return rows_from(known, [
        {"feature": F.lit(n), "dtype": F.lit(kinds[n]), "description": F.lit(c.FEATURE_TEXT[n]),
         "known_values": F.col(n)} for n in c.FEATURE_TYPES])
