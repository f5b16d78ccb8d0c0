"""The mart's rows are put in order before they are widened."""

import pytest
from pyspark.sql import functions as F

from churnloom.plans.mart import CustomerMart, enrich
from churnloom.sources.files import in_order, write_mart


@pytest.fixture
def raw(dirty):
    """All columns that features, scores and flags are made of."""
    numbers = {n: F.col("CustomerID") % 5 + 1.0 for n in ("HourSpendOnApp", "NumberOfDeviceRegistered", "NumberOfAddress", "CityTier")}
    return dirty.withColumns(numbers | {"Gender": F.lit("Female"), "MaritalStatus": F.lit("Single")})


def test_the_order_is_made_of_cleaned_rows(spark, raw, tmp_path):
    """Sorted by customer and the same as widened first; what is shuffled for the order has no derived column."""
    mart = CustomerMart(raw, "raw")
    plan = enrich(in_order(mart.cleaned.df), mart.cuts)._jdf.queryExecution().optimizedPlan().toString()
    # Projections over the order, the order over what fills and clips.
    assert plan.startswith("Project [src_seq") and plan.index("Sort [CustomerID") < plan.index("RepartitionByExpression [CustomerID")
    assert plan.index("RepartitionByExpression") < plan.index("Join LeftOuter")
    path = str(tmp_path / "mart")
    write_mart(enrich(mart.cleaned.df, mart.cuts), path)
    widened_first = spark.read.schema(mart.table.schema).parquet(path)
    assert sorted(map(str, mart.table.collect())) == sorted(map(str, widened_first.collect()))
    files = mart.table.groupBy(F.input_file_name()).agg(
        F.collect_list("CustomerID").alias("found"), F.min("CustomerID").alias("low"), F.max("CustomerID").alias("high")).orderBy("low").collect()
    assert all(r.found == sorted(r.found) for r in files)
    assert all(a.high <= b.low for a, b in zip(files, files[1:]))


def test_the_stage_is_written_in_that_order(raw, monkeypatch):
    from churnloom.plans import mart as marts

    seen = []
    monkeypatch.setattr(marts, "in_order", lambda df: seen.append(df.columns) or in_order(df))
    mart = CustomerMart(raw, "raw")
    assert mart.table.count() == 6 and seen == [mart.cleaned.df.columns]
