"""Recency, frequency and monetary quintiles, segments and segment statistics.

A quintile needs only four cut rows of the total order, not the rank of every row. The
cut rows are found exactly by selection (``order_stats``) and each row is then scored by
comparing itself with them, so no row of the table is sorted or moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom import contract as c
from churnloom import playbooks
from churnloom.errors import KPICalculationError, require_columns
from churnloom.functions import exact_mean, lookup, number, round_even
from churnloom.operators.order_stats import EXACT_ROWS, order_statistics, quantiles, unpivot_numeric
from churnloom.plans.stages import literal_table


@dataclass
class QuintileCuts:
    """The four cut rows of one metric. ``tiebreak`` holds the SQL terms that follow the metric in the order."""

    column: str
    larger_is_better: bool
    fill: float | None
    tiebreak: tuple[str, ...]
    cuts: list[tuple]

    def metric(self) -> str:
        value = f"CAST({self.column} AS DOUBLE)"
        if self.fill is not None:
            value = f"coalesce({value}, {number(self.fill)})"
        return value if self.larger_is_better else f"(0.0D - {value})"

    def score(self) -> Column:
        """1 plus the number of cut rows that come before this row."""
        terms = [self.metric(), *self.tiebreak]
        passed = []
        for row in self.cuts:
            after = "false"
            for depth in reversed(range(len(row))):
                value = number(row[0]) if depth == 0 else f"{row[depth]}L"
                after = f"({terms[depth]} > {value} OR ({terms[depth]} = {value} AND {after}))"
            passed.append(f" + CAST({after} AS INT)")
        return F.expr(f"CASE WHEN {self.metric()} IS NOT NULL THEN 1{''.join(passed)} END")


def fit_quintiles(df: DataFrame, metrics=c.RFM_METRICS, tiebreak=None,
                  exact_rows: int = EXACT_ROWS) -> dict[str, QuintileCuts]:
    """Find the cut rows of every metric in shared passes.

    Rows are ordered by (metric, customer, arrival); a missing metric counts as the median.
    """
    if tiebreak is None:
        tiebreak = _order_terms(df)
    terms = {f"_order{i}": F.expr(term) for i, term in enumerate(tiebreak)}
    columns = [column for _, column, _ in metrics]
    fills, rows = _fills(df, columns, exact_rows)
    models = {
        score: QuintileCuts(column, better, fills.get(column), tuple(tiebreak), [])
        for score, column, better in metrics}
    series = df.select(*[term.alias(name) for name, term in terms.items()],
                       *[F.expr(m.metric()).alias(score) for score, m in models.items()])
    names = list(terms)
    long = unpivot_numeric(series, list(models), keep=names)

    found = order_statistics(
        long, ["series"], "value",
        lambda n: F.array(*[F.floor(s * (n - 1) / F.lit(5)).cast("bigint") for s in range(1, 5)]),
        exact_rows, rows).collect()
    for row in found:
        if row["n"] < 2:
            raise KPICalculationError("quintiles need at least two customers")
    cuts = {(r["series"], r["slot"]): ([r["value"]], r["pos"] - r["before"], r["ties"]) for r in found}
    for depth, name in enumerate(names):
        if all(ties == 1 for _, _, ties in cuts.values()):
            break
        cuts = _break_ties(long, names[:depth], name, cuts, exact_rows, rows)
    for (score, _), (prefix, _, _) in sorted(cuts.items()):
        models[score].cuts.append(tuple(prefix))
    return models


def _order_terms(df) -> list[str]:
    """Customer, then arrival; files follow each other by a hash of their names."""
    terms = []
    for name in (c.PRIMARY_KEY, c.SEQUENCE):
        kind = df.schema[name].dataType if name in df.columns else None
        if isinstance(kind, T.IntegralType):
            terms.append(name)
        elif isinstance(kind, T.StructType):
            terms += [f"{name}.{f.name}" if isinstance(f.dataType, T.IntegralType) else f"xxhash64({name}.{f.name})"
                      for f in kind.fields]
    return terms


def _fills(df, columns, exact_rows):
    gaps = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(n).isNull()).alias(n) for n in columns]).first()
    gappy = [n for n in columns if gaps[n]]
    if not gappy:
        return {}, gaps["_rows"]
    medians = quantiles(
        unpivot_numeric(df, gappy), ["series"], "value", {"median": 0.5}, exact_rows, gaps["_rows"])
    return {r["series"]: r["median"] for r in medians.collect()}, gaps["_rows"]


def _break_ties(long, fixed, name, cuts, exact_rows, rows):
    """Extend each cut row by the next order column, selecting among its tied rows."""
    spark = long.sparkSession
    keys = list(cuts)
    names = ["value", *fixed]
    table = {"series": [k[0] for k in keys], "cut": [k[1] for k in keys],
             "slot": [0] * len(keys), "pos": [cuts[k][1] for k in keys]}
    for i, column in enumerate(names):
        table[f"_{column}"] = [cuts[k][0][i] for k in keys]
    targets = F.broadcast(literal_table(spark, table))  # four rows per metric
    same = [F.col(column) == F.col(f"_{column}") for column in names]
    tied = long.withColumnRenamed("series", "_series").join(
        targets, [F.col("_series") == F.col("series"), *same]).select("series", "cut", name)
    found = order_statistics(tied, ["series", "cut"], name, targets, exact_rows, rows).collect()
    return {
        (r["series"], r["cut"]): (
            cuts[r["series"], r["cut"]][0] + [r[name]], r["pos"] - r["before"], r["ties"])
        for r in found}


def score(df: DataFrame, cuts: dict[str, QuintileCuts]) -> DataFrame:
    """Append the three scores, their text and their sum; a projection."""
    parts = list(cuts)
    scored = df.withColumns({name: model.score() for name, model in cuts.items()})
    return scored.withColumns({
        "RFM_Score": F.expr(f"concat({', '.join(parts)})"),
        "RFM_Sum": F.expr(" + ".join(parts)),
    })


def compute_rfm_scores(df: DataFrame, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """Fit the quintiles of this table and score it."""
    require_columns(df, [column for _, column, _ in c.RFM_METRICS], KPICalculationError, "RFM scoring")
    return score(df, fit_quintiles(df, exact_rows=exact_rows))


def assign_segments(df: DataFrame, segments=None, default=c.RFM_DEFAULT_SEGMENT) -> DataFrame:
    """Name the segment of each score and the action recommended for it."""
    require_columns(df, ["RFM_Score"], KPICalculationError, "segment naming")
    named = df.withColumn("RFM_Segment", lookup("RFM_Score", segments or c.RFM_SEGMENTS, default))
    return named.withColumn(
        "RFM_Recommendation",
        lookup("RFM_Segment", playbooks.RFM_ACTIONS, playbooks.RFM_DEFAULT_ACTION))


def segment_statistics(df: DataFrame) -> DataFrame:
    """Size, share, mean metrics and churn of each segment.

    The share comes from a window over the few aggregated rows, not over customers.
    """
    from pyspark.sql import Window as W

    by_segment = df.groupBy("RFM_Segment").agg(
        F.count("*").alias("customer_count"),
        round_even(F.avg("DaySinceLastOrder"), 1).alias("average_recency_days"),
        round_even(F.avg("OrderCount"), 1).alias("average_frequency_orders"),
        round_even(exact_mean("CashbackAmount", 4), 2).alias("average_monetary_cashback"),
        round_even(F.avg("Churn") * 100.0, 2).alias("churn_rate_percentage"))
    # Fixed number of segments: at most one row per name in the segment map.
    total = F.sum("customer_count").over(W.partitionBy(F.lit(1)))
    return by_segment.select(
        "RFM_Segment", "customer_count",
        round_even(F.col("customer_count") / total * 100.0, 2).alias("percentage"),
        "average_recency_days", "average_frequency_orders", "average_monetary_cashback",
        "churn_rate_percentage",
        lookup("RFM_Segment", playbooks.RFM_ACTIONS, playbooks.RFM_DEFAULT_ACTION)
        .alias("recommendation"))


def analyze_rfm(df: DataFrame, cuts=None):
    """Scores and segments of every customer, with the segment statistics."""
    scored = compute_rfm_scores(df) if cuts is None else score(df, cuts)
    named = assign_segments(scored)
    return named, segment_statistics(named)
