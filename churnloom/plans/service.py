"""Report tables of a mart, written once under fixed names and read by dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnloom.operators import health, kpi, rfm, risk, segments
from churnloom.plans.mart import CustomerMart
from churnloom.sources.files import write_table


def report_tables(mart: CustomerMart, scored: DataFrame | None = None,
                  importance: DataFrame | None = None) -> dict[str, DataFrame]:
    """Indicators, health, cohorts and segments; tiers and importance if a model was used."""
    tables = {
        "kpis": kpi.calculate_kpis(mart.table),
        "health_overall": health.overall_summary(mart.table),
        "health_categories": health.category_summary(mart.table),
        "cohorts": segments.cohort_summary(mart.table),
        "rfm_segments": rfm.segment_statistics(mart.table),
    }
    if scored is not None:
        tables["risk_tiers"] = risk.tier_counts(scored)
    if importance is not None:
        tables["global_importance"] = importance
    return tables


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")
