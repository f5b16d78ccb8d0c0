import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnloom.errors import KPICalculationError
from churnloom.operators import order_stats, rfm
from churnloom.plans.stages import literal_table


def values(kind, n):
    rng = random.Random(n)
    if kind == "distinct":
        return [rng.random() * 1e6 for _ in range(n)]
    if kind == "hot":  # a third of the rows share one value
        return [5.0 if i % 3 == 0 else rng.random() * 10 for i in range(n)]
    return [float(rng.randint(0, 4)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["distinct", "hot", "few"])
@pytest.mark.parametrize("exact_rows", [10**6, 200, 2])
def test_quantiles_agree_with_numpy(spark, kind, exact_rows):
    data = {"a": values(kind, 5001), "b": values(kind, 700)}
    df = literal_table(spark, {
        "k": ["a"] * 5001 + ["b"] * 700, "value": data["a"] + data["b"]}).repartition(7)
    probabilities = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = order_stats.quantiles(df, ["k"], "value", probabilities, exact_rows=exact_rows).collect()
    assert len(found) == 2
    for row in found:
        for name, p in probabilities.items():
            assert row[name] == pytest.approx(np.quantile(data[row["k"]], p), rel=1e-12)


def test_a_missed_bracket_is_repaired(spark, monkeypatch):
    bracket = order_stats._bracket
    monkeypatch.setattr(order_stats, "_bracket", lambda grid, pos, size, margin=2: (
        bracket(grid, pos, size, margin) if margin > 2 else (F.lit(1e9), F.lit(2e9))))
    df = literal_table(spark, {"k": ["a"] * 100, "value": [float(i) for i in range(100)]})
    row = order_stats.quantiles(df, ["k"], "value", {"m": 0.5}, exact_rows=5).first()
    assert row["m"] == 49.5


def expected_quintiles(series, ascending):
    ranked = pd.Series(series).rank(method="first", ascending=ascending)
    return pd.qcut(ranked, 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


def scored(spark, metric, better, exact_rows=10**6):
    df = literal_table(spark, {"CustomerID": list(range(len(metric))), "m": metric}).repartition(5)
    cuts = rfm.fit_quintiles(df, (("S", "m", better),), exact_rows=exact_rows)
    return [r["S"] for r in df.select("CustomerID", cuts["S"].score().alias("S")).orderBy("CustomerID").collect()]


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 13, 22, 30])
@pytest.mark.parametrize("better", [True, False])
def test_quintiles_agree_with_ranked_cut(spark, n, better):
    metric = [float((i * 7) % 4) for i in range(n)]
    assert scored(spark, metric, better) == expected_quintiles(metric, better)


@pytest.mark.parametrize("exact_rows", [10**6, 50])
def test_quintiles_with_a_hot_value(spark, exact_rows):
    rng = random.Random(3)
    metric = [0.0 if i % 3 == 0 else float(rng.randint(0, 60)) for i in range(1503)]
    for better in (True, False):
        assert scored(spark, metric, better, exact_rows) == expected_quintiles(metric, better)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=5, max_size=40))
def test_quintile_sizes_differ_by_one_at_most(spark, metric):
    sizes = pd.Series(scored(spark, [float(v) for v in metric], True)).value_counts()
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1


def test_missing_metric_counts_as_median(spark):
    metric = [1.0, None, 3.0, 2.0, 9.0, 8.0, None]
    filled = pd.Series(metric, dtype=float)
    assert scored(spark, metric, True) == expected_quintiles(filled.fillna(filled.median()), True)


def test_one_customer_has_no_quintile(spark):
    with pytest.raises(KPICalculationError):
        scored(spark, [1.0], True)


def test_tied_customers_are_split_by_arrival(spark):
    df = literal_table(spark, {"CustomerID": [1] * 10, "src_seq": list(range(10)), "m": [1.0] * 10})
    cuts = rfm.fit_quintiles(df, (("S", "m", True),))
    got = [r["S"] for r in df.select("src_seq", cuts["S"].score().alias("S")).orderBy("src_seq").collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_scoring_needs_no_shuffle(mart):
    plan = rfm.score(mart.table.select("CustomerID", "src_seq", "DaySinceLastOrder", "OrderCount",
                                       "CashbackAmount"), mart.cuts)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Window" not in text and "Sort" not in text


def test_rows_that_agree_are_parted_by_their_place_in_the_file(spark, tmp_path):
    """Arrival order is a struct when it is stamped by the reader."""
    from churnloom.operators import rfm
    from churnloom.sources.files import read_customers

    path = str(tmp_path / "same")
    spark.range(20).selectExpr(
        "7L AS CustomerID", "4.0D AS DaySinceLastOrder", "2.0D AS OrderCount", "id * 1.0D AS CashbackAmount"
    ).coalesce(1).write.parquet(path)
    scored = rfm.compute_rfm_scores(read_customers(spark, path))
    for name in ("Recency_Score", "Frequency_Score", "Monetary_Score"):
        assert sorted(r[0] for r in scored.select(name).collect()) == [s for s in range(1, 6) for _ in range(4)]
