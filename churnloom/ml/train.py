"""Training, cross validation and comparison of four churn classifiers.

The fits of a candidate, on all training rows and on those outside each fold, are made together (see ``fits`` and
``linear``), and so are all tree candidates.
"""

from __future__ import annotations

import pickle
import sys
import time
from dataclasses import dataclass, field
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import ModelTrainingError
from churnloom.functions import round_even
from churnloom.ml import models as kinds
from churnloom.ml import prep
from churnloom.ml.fits import Fit, binned, fit_bins, fit_models
from churnloom.ml.grow import Growth
from churnloom.ml.linear import fit_linear
from churnloom.ml.models import LinearModel, scorer_of
from churnloom.plans.stages import cut, literal_table, shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_FEATURES = 20
# Equal parts of the range of scores in which ranks are counted.
SCORE_PARTS = 4096


@dataclass
class Settings:
    """Sizes of the candidates. The defaults are the full-size models."""

    trees: int = 300
    boosted_trees: int | None = None  # as many as the forest has
    forest_depth: int | None = None  # until nodes are pure
    boosted_depth: int = 6
    leaves: int = 31  # of a tree that grows leaf by leaf
    step_size: float = 0.05
    max_iter: int = 1000
    folds: int = 5
    test_share: float = 0.2
    seed: int = 42


def candidates(settings: Settings, inputs: int) -> dict[str, Growth | None]:
    """Name to how its trees grow; None for the linear model.

    Forest nodes look at the square root of the inputs. The first boosted model grows level by level with a penalty on
    leaf values, the second best leaf first with at least 20 rows in each.
    """
    rounds, seed = settings.boosted_trees or settings.trees, settings.seed
    boosted = {"rounds": rounds, "depth": settings.boosted_depth, "step": settings.step_size, "seed": seed}
    return {
        "LogisticRegression": None,
        "RandomForest": Growth(settings.trees, settings.forest_depth, tries=max(1, isqrt(inputs)), seed=seed),
        "GradientBoosting": Growth(**boosted, l2=1.0, least_hessian=1.0),
        "LeafwiseBoosting": Growth(**boosted, leaves=settings.leaves, least_hessian=1e-3, least_rows=20),
    }


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows of every (label, prediction); at most four groups."""
    return predictions.groupBy("label", "prediction").agg(F.count("*").alias("rows"))


def rates(predictions: DataFrame, *by: str) -> DataFrame:
    """The four cells, accuracy, precision, recall and F1 of class 1: one row, or one for each value of ``by``."""
    def cell(label, prediction):
        return F.count_if((F.col("label") == label) & (F.col("prediction") == prediction))

    cells = predictions.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                         cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    col, zero = F.col, F.lit(0.0)
    divide = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    precision = divide(col("tp"), col("tp") + col("fp"))
    recall = divide(col("tp"), col("tp") + col("fn"))
    accuracy = divide(col("tp") + col("tn"), col("tp") + col("tn") + col("fp") + col("fn"))
    f1 = divide(2 * col("tp"), 2 * col("tp") + col("fp") + col("fn"))
    return cells.select(
        *by, "tn", "fp", "fn", "tp", round_even(accuracy, 4).alias("accuracy"),
        round_even(precision, 4).alias("precision"), round_even(recall, 4).alias("recall"),
        round_even(f1, 4).alias("f1"))


def areas(scored: DataFrame) -> DataFrame:
    """``fit, roc_auc``: the exact area under each receiver operating characteristic of ``fit, label, score`` (0 to 1).

    The share of (positive, negative) pairs that are in order, ties counting half. Equal scores are tallied first, parts
    of the range of scores are summed, and ranks are counted inside each part: no fit is sorted in one task.
    Null without rows of both classes.
    """
    tallies = scored.groupBy("fit", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    tallies = tallies.withColumn("part", F.floor(F.col("score") * SCORE_PARTS))
    below = W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    whole = tallies.groupBy("fit", "part").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    whole = whole.select("fit", "part", F.sum("sp").over(W.partitionBy("fit")).alias("np"), F.sum("sq").over(W.partitionBy("fit")).alias("nq"),
                         F.coalesce(F.sum("sq").over(W.partitionBy("fit").orderBy("part").rowsBetween(W.unboundedPreceding, -1)),
                                    F.lit(0)).alias("before"))
    inside = tallies.withColumn("inside", F.coalesce(F.sum("q").over(below.partitionBy("fit", "part")), F.lit(0)))
    pairs = F.sum(F.col("p").cast("decimal(38,0)") * (2 * (F.col("before") + F.col("inside")) + F.col("q")))
    return (inside.join(whole, ["fit", "part"]).groupBy("fit")
            .agg(pairs.cast("double").alias("twice"), F.first("np").alias("np"), F.first("nq").alias("nq"))
            .select("fit", F.try_divide(F.col("twice"), 2.0 * F.col("np") * F.col("nq")).alias("roc_auc")))


@dataclass
class Trained:
    """The winner, ready to score raw mart rows, with how it was chosen."""

    algorithm: str
    stages: PipelineModel
    results: dict[str, dict[str, float]]
    names: list[str]
    balance: dict[str, float]
    models: dict = field(default_factory=dict)
    folds: list[dict] = field(default_factory=list)

    @property
    def model(self):
        return self.models[self.algorithm]

    def leaderboard(self, spark) -> DataFrame:
        """One row per candidate, best first."""
        order = sorted(self.results, key=lambda n: (-self.results[n]["f1"], n))
        columns = {"algorithm": order, "is_best": [n == self.algorithm for n in order]}
        for key in next(iter(self.results.values())):
            columns[key] = [self.results[n][key] for n in order]
        return literal_table(spark, columns, {"cv_f1_mean": "double", "cv_f1_std": "double"})

    def fold_table(self, spark) -> DataFrame:
        """Cells and F1 of every candidate in every fold."""
        keys = ("algorithm", "fold", "tn", "fp", "fn", "tp", "f1")
        kinds = dict(zip(keys, ("string", "int", *["long"] * 4, "double"), strict=True))
        return literal_table(spark, {k: [f[k] for f in self.folds] for k in keys}, kinds)

    def importance(self, spark) -> DataFrame:
        return importance(spark, self.model, self.names)


def importance(spark, model, names) -> DataFrame:
    """Shares in the gain of splits, or coefficients of a linear model, by encoded input."""
    return literal_table(spark, {"feature": list(names), "importance": [float(w) for w in model.weights]})


def top_features(table: DataFrame, size: int = TOP_FEATURES) -> DataFrame:
    return table.orderBy(F.desc("importance"), "feature").limit(size).withColumn(
        "importance", round_even("importance", 6))


def _fits(names, settings: Settings, growths, counts, ratio: float) -> list[Fit]:
    """All fits of the given candidates; ``counts`` are rows by (fold, label) of the training rows."""
    fits = []
    for name in names:
        for holdout in (-1, *range(settings.folds if settings.folds > 1 else 0)):
            growth = growths[name]
            if growth is None or growth.leaves is None and growth.tries is not None:
                # Both classes weigh half of the rows of the fit.
                n = [sum(v for (fold, label), v in counts.items() if fold != holdout and label == y) for y in (0, 1)]
                weights = tuple(sum(n) / (2.0 * v) if v else 1.0 for v in n)
            else:
                weights = (1.0, ratio)
            fits.append(Fit(len(fits), name, growth, growth is not None and growth.tries is not None, holdout, weights))
    return fits


def _scores(encoded: DataFrame, fits: list[Fit], models: dict) -> DataFrame:
    """``fit, label, score`` of the rows each fit has not seen: the test rows for a full fit, its fold for the others.

    A task holds one model, that of its rows.
    """
    scored = [_scores_of(encoded.where(F.col("fold") == fit.holdout), fit.number, models[fit.number]) for fit in fits]
    return reduce(DataFrame.unionAll, scored)


def _scores_of(rows: DataFrame, number: int, model) -> DataFrame:
    linear, spark = isinstance(model, LinearModel), rows.sparkSession
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model)) if linear else model.sent(spark)

    def run(batches):
        model = pickle.loads(sent.value) if linear else scorer_of(sent.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept))) if linear else model.scores(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), number, np.int32)), batch.column(0), pa.array(score)],
                                             ["fit", "label", "score"])

    x = vector_to_array(prep.SCALED if linear else prep.FEATURES).alias("x")
    return rows.select("label", x).mapInArrow(run, "fit int, label double, score double")


def train(df: DataFrame, settings: Settings | None = None, target: str = c.TARGET,
          only=None) -> Trained:
    """Split, encode, fit and compare the candidates (or those named in ``only``); the best test F1 wins.

    The encoded rows are written once and read by every fit, so no fit repeats the encoding. Encoding and scaling are fitted
    on the training rows. ``training_seconds`` is the time of the job that fitted a candidate, with its folds and, for trees,
    the other tree candidates beside it.
    """
    settings = settings or Settings()
    shared_folder(df.sparkSession)
    inputs = prep.stratified_split(prep.model_inputs(df, target), settings.test_share, settings.seed)
    balance = prep.class_balance(inputs.where("NOT is_test")).first().asDict()
    if not balance["positives"] or not balance["negatives"]:
        raise ModelTrainingError("training needs customers of both classes")
    folded = prep.stratified_folds(inputs.where("NOT is_test"), settings.folds, settings.seed)
    rows = folded.unionByName(inputs.where("is_test").withColumn("fold", F.lit(-1)))
    stages = prep.fit_preprocessor(inputs.where("NOT is_test"))
    encoded = cut(prep.encode(stages, rows, keep=[c.PRIMARY_KEY, "label", "is_test", "fold"]), "encoded")
    training = encoded.where("NOT is_test")
    counts = {(r["fold"], int(r["label"])): r["count"] for r in training.groupBy("fold", "label").count().collect()}
    names = prep.feature_names(stages)
    growths = candidates(settings, len(names))
    fits = _fits([n for n in growths if only is None or n in only], settings, growths, counts, balance["ratio"])

    fitted, seconds = {}, {}
    for trees in (False, True):
        mine = [f for f in fits if (f.growth is not None) == trees]
        if not mine:
            continue
        start = time.perf_counter()
        if trees:
            bins = fit_bins(training, len(c.MODEL_NUMERIC), len(names))
            fitted |= fit_models(binned(encoded, bins), bins, mine)
        else:
            fitted |= fit_linear(encoded, mine, len(names), settings.max_iter)
        seconds |= dict.fromkeys((f.name for f in mine), time.perf_counter() - start)

    results, models, by_fold = {}, {}, []
    for name in dict.fromkeys(f.name for f in fits):
        mine = [f for f in fits if f.name == name]
        scored = cut(_scores(encoded, mine, {f.number: fitted[f.number] for f in mine}), "scores")
        measured = {r.pop("fit"): r for r in (r.asDict() for r in rates(
            scored.withColumn("prediction", (F.col("score") > 0.5).cast("double")), "fit").collect())}
        area = areas(scored.where(F.col("fit") == mine[0].number)).first()
        by_fold += [{"algorithm": name, "fold": f.holdout, **measured[f.number]} for f in mine[1:] if f.number in measured]
        folds = [measured[f.number]["f1"] for f in mine[1:] if f.number in measured]
        mean = sum(folds) / len(folds) if folds else None
        spread = (sum((s - mean) ** 2 for s in folds) / len(folds)) ** 0.5 if folds else None
        results[name] = {
            **measured[mine[0].number], "roc_auc": None if area is None or area["roc_auc"] is None else round(area["roc_auc"], 4),
            "cv_f1_mean": None if mean is None else round(mean, 4), "cv_f1_std": None if spread is None else round(spread, 4),
            "training_seconds": round(seconds[name], 4)}
        models[name] = fitted[mine[0].number]
    winner = min(results, key=lambda n: (-results[n]["f1"], n))
    return Trained(winner, stages, results, names, balance, models, by_fold)


def save(spark, trained: Trained, path: str) -> None:
    """Write the encoding, the winning model and what is known about it."""
    trained.stages.write().overwrite().save(f"{path}/stages")
    kinds.save(spark, trained.model, f"{path}/model")
    board = trained.leaderboard(spark).withColumn("saved_at", F.current_timestamp())
    board.write.mode("overwrite").json(f"{path}/leaderboard")
    top_features(trained.importance(spark)).write.mode("overwrite").json(f"{path}/importance")
