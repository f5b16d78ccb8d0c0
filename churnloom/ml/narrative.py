"""Drivers and wording of explanations, computed for all customers at once.

Input is one row per customer with ``contributions``, an array of (feature, value,
contribution). The arrays have one entry per model input, so they stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom.functions import round_even
from churnloom.operators.risk import risk_tier

DRIVERS = 5
NAMED = 3
NEGLIGIBLE = 0.001


def _ranked(contributions: Column, sign: int) -> Column:
    """The strongest drivers of one direction, ties by feature name."""
    strong = F.filter(contributions, lambda d: d["contribution"] * sign > NEGLIGIBLE)
    keyed = F.transform(strong, lambda d: F.struct(
        (d["contribution"] * -sign).alias("rank"), d["feature"].alias("feature"),
        d["value"].alias("value"), d["contribution"].alias("contribution")))
    top = F.slice(F.array_sort(keyed), 1, DRIVERS)
    return F.transform(top, lambda d: F.struct(
        d["feature"].alias("feature"), d["value"].alias("value"),
        d["contribution"].alias("contribution")))


def local_explanations(df: DataFrame, probability: str = "Churn_Probability") -> DataFrame:
    """CustomerID, probability, tier, drivers in both directions and the summary text.

    The wording is fixed: it is what readers of the report expect.
    """
    p = F.col(probability)
    drivers = df.select(
        "CustomerID", p.alias("p"), _ranked(F.col("contributions"), 1).alias("positive_drivers"),
        _ranked(F.col("contributions"), -1).alias("negative_drivers"))
    share = F.format_string("%.1f%%", round_even(F.col("p") * 100.0, 1))
    who = F.format_string("Customer %s", F.col("CustomerID").cast("string"))

    def lines(drivers_column, template):
        return F.transform(F.slice(drivers_column, 1, NAMED), lambda d: F.format_string(
            template, F.replace(d["feature"], F.lit("_"), F.lit(" ")),
            round_even(d["contribution"], 2)))

    # The wording of the summary.
    risky = F.concat(
        F.array(F.concat(who, F.lit(" is flagged at Churn Risk ("), share, F.lit(") driven primarily by:"))),
        lines("positive_drivers", "  - High %s (Impact: +%.2f)"))
    calm = F.concat(
        F.array(F.concat(who, F.lit(" is classified as Low Churn Risk ("), share,
                         F.lit("). Active indicators include:"))),
        lines("negative_drivers", "  - Positive %s (Impact: %.2f)"))
    return drivers.select(
        "CustomerID", round_even("p", 4).alias("churn_probability"), risk_tier("p").alias("risk_level"),
        "positive_drivers", "negative_drivers",
        F.array_join(F.when(F.col("p") >= 0.5, risky).otherwise(calm), "\n").alias("executive_summary"))


def driver_rows(explanations: DataFrame) -> DataFrame:
    """One row per driver: customer, direction, position, feature, value, contribution."""
    united = None
    for direction in ("positive", "negative"):
        rows = explanations.select(
            "CustomerID", F.lit(direction).alias("direction"),
            F.posexplode(f"{direction}_drivers").alias("position", "driver")).select(
            "CustomerID", "direction", (F.col("position") + 1).alias("position"), "driver.*")
        united = rows if united is None else united.unionByName(rows)
    return united


def global_importance(df: DataFrame) -> DataFrame:
    """Mean absolute contribution of every feature over all given customers."""
    each = df.select(F.explode("contributions").alias("d")).select("d.feature", "d.contribution")
    return each.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
