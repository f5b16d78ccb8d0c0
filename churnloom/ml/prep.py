"""From the mart to model inputs: split, folds, weights, encoding and scaling."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import ModelInferenceError, ModelTrainingError, require_columns
from churnloom.functions import number
from churnloom.operators.order_stats import order_statistics, quantiles, unpivot_numeric

FEATURES = "features"
SCALED = "scaled"


def model_inputs(df: DataFrame, target: str | None = c.TARGET) -> DataFrame:
    """Customer, model inputs and label; everything else is left behind.

    Numbers become double so that the schema does not depend on the source.
    """
    error = ModelInferenceError if target is None else ModelTrainingError
    require_columns(df, [c.PRIMARY_KEY, *c.MODEL_NUMERIC, *c.MODEL_CATEGORICAL,
                         *([target] if target else [])], error, "model input")
    label = [F.col(target).cast("double").alias("label")] if target else []
    return df.select(
        c.PRIMARY_KEY, *[F.col(n).cast("double").alias(n) for n in c.MODEL_NUMERIC],
        *c.MODEL_CATEGORICAL, *label)


def _draw(seed: int) -> Column:
    return F.xxhash64(F.col(c.PRIMARY_KEY), F.lit(seed))


def _cuts(df: DataFrame, seed: int, positions) -> dict[float, list[int]]:
    """Hash values at the given positions of every label's hash order."""
    found = order_statistics(df.select("label", _draw(seed).alias("draw")), ["label"], "draw", positions)
    cuts: dict[float, list[int]] = {}
    for row in found.orderBy("label", "slot").collect():
        cuts.setdefault(row["label"], []).append(row["draw"])
    return cuts


def _passed(cuts: dict[float, list[int]], seed: int, beyond) -> Column:
    """How many cut values of its label a row has passed."""
    total = F.lit(0)
    for label, values in cuts.items():
        for value in values:
            total = total + (
                (F.col("label") == label) & beyond(_draw(seed), F.lit(value))).cast("int")
    return total


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Append ``is_test``: the share of every label with the lowest hashes of the customer.

    The share is exact per label and depends neither on partitioning nor on row order.
    Only the hash at the border is looked up; no label is ranked in one task.
    """
    share = F.lit(float(test_share))
    cuts = _cuts(df, seed, lambda n: F.array((F.ceil(round_up_guard(share * n)) - 1).cast("bigint")))
    return df.withColumn("is_test", _passed(cuts, seed, lambda d, v: d <= v) == 1)


def round_up_guard(value: Column) -> Column:
    """Drop the rounding noise of a product, so that 0.2 * 15 is 3 before rounding up."""
    return F.round(value, 9)


def stratified_folds(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Append ``fold``: equal parts of every label in hash order."""
    if folds < 2:
        return df.withColumn("fold", F.lit(0))
    cuts = _cuts(df, seed + 1, lambda n: F.array(*[
        F.floor(n * F.lit(i) / F.lit(folds)).cast("bigint") for i in range(1, folds)]))
    return df.withColumn("fold", _passed(cuts, seed + 1, lambda d, v: d >= v))


def class_balance(df: DataFrame) -> DataFrame:
    """One row: rows, positives, negatives and negatives per positive."""
    sums = df.agg(F.count("*").alias("rows"), F.sum("label").cast("bigint").alias("positives"))
    negatives = F.col("rows") - F.col("positives")
    return sums.select(
        "rows", "positives", negatives.alias("negatives"),
        F.coalesce(F.try_divide(negatives, F.col("positives")), F.lit(1.0)).alias("ratio"))


def fit_preprocessor(df: DataFrame) -> PipelineModel:
    """Exact median for missing numbers, one-hot text (unknown values become all zeros), scaling.

    ``features`` holds plain numbers for tree models, ``scaled`` standardised ones for the
    linear model; the encoded part is the same in both.
    """
    medians = quantiles(
        unpivot_numeric(df, c.MODEL_NUMERIC), ["series"], "value", {"median": 0.5}, rows=df.count())
    fills = dict.fromkeys(c.MODEL_NUMERIC, 0.0)
    fills.update({r["series"]: r["median"] for r in medians.collect()})
    filled = ", ".join(
        f"coalesce(nanvl({n}, NULL), {number(fill)}) AS _num_{n}" for n, fill in fills.items())
    numeric = [f"_num_{n}" for n in c.MODEL_NUMERIC]
    indexed = [f"_idx_{n}" for n in c.MODEL_CATEGORICAL]
    encoded = [f"_hot_{n}" for n in c.MODEL_CATEGORICAL]
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        StringIndexer(inputCols=list(c.MODEL_CATEGORICAL), outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=numeric, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_standard", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_numbers", *encoded], outputCol=FEATURES),
        VectorAssembler(inputCols=["_standard", *encoded], outputCol=SCALED),
    ]).fit(df)


def encode(stages: PipelineModel, df: DataFrame, keep=()) -> DataFrame:
    """Model input vectors of the given rows; the work columns are dropped."""
    return stages.transform(df).select(*keep, FEATURES, SCALED)


def feature_names(stages: PipelineModel) -> list[str]:
    """Names of the encoded inputs, in vector order."""
    indexer = next(s for s in stages.stages if hasattr(s, "labelsArray"))
    encoded = [f"{column}_{label}" for column, labels in zip(c.MODEL_CATEGORICAL, indexer.labelsArray)
               for label in labels]
    return [*c.MODEL_NUMERIC, *encoded]


def encoded_totals(stages: PipelineModel, df: DataFrame) -> DataFrame:
    """Every encoded input with its number of non-zero rows."""
    names = F.array(*[F.lit(n) for n in feature_names(stages)])
    cells = encode(stages, df).select(F.posexplode(vector_to_array(FEATURES)).alias("position", "value"))
    return cells.groupBy("position").agg(F.count_if(F.col("value") != 0).alias("non_zero")).select(
        F.get(names, "position").alias("feature"), "position", "non_zero")
