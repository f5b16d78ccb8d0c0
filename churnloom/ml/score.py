"""Loading a trained model and scoring customers."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom import __version__
from churnloom import contract as c
from churnloom.errors import ModelInferenceError
from churnloom.ml import models, prep
from churnloom.operators.risk import with_risk

log = logging.getLogger(__name__)


class ChurnPredictor:
    """Scores mart rows from their plain columns: the encoding, then the model."""

    def __init__(self, stages: PipelineModel, model, algorithm: str = "Unknown", version: str = __version__):
        self.stages = stages
        self.model = model
        self.algorithm = algorithm
        self.version = version

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ChurnPredictor:
        """Read a saved model; its leaderboard is optional."""
        try:
            stages, model = PipelineModel.load(f"{path}/stages"), models.load(spark, f"{path}/model")
        except (Py4JJavaError, PySparkException) as error:
            raise ModelInferenceError(f"no model can be read from {path}") from error
        algorithm = "Unknown"
        try:
            algorithm = spark.read.json(f"{path}/leaderboard").where("is_best").first()["algorithm"]
        except (PySparkException, TypeError, KeyError):
            log.warning("no leaderboard beside the model in %s", path)
        return cls(stages, model, algorithm)

    def transform(self, df: DataFrame, keep=()) -> DataFrame:
        """Customer, input vectors, prediction and probability ``p`` of every row."""
        inputs = prep.model_inputs(df, target=None)
        scored = self.stages.transform(inputs).withColumn("p", self.model.probability())
        return scored.select(c.PRIMARY_KEY, prep.FEATURES, prep.SCALED, (F.col("p") > 0.5).cast("double").alias("prediction"), "p", *keep)

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with prediction, probability, confidence, tier, action and model version.

        A projection: the original columns travel beside the model's work columns, so no
        join is needed to bring them back together.
        """
        added = set(df.columns)
        prep.model_inputs(df, target=None)
        kept = df.withColumn("_row", F.struct(*df.columns))
        numbers = {n: F.col(n).cast("double") for n in c.MODEL_NUMERIC}
        encoded = self.stages.transform(
            kept.withColumns(numbers).select("_row", *c.MODEL_NUMERIC, *c.MODEL_CATEGORICAL))
        scored = encoded.select("_row", self.model.probability().alias("p"))
        flat = scored.select("_row.*", (F.col("p") > 0.5).cast("double").alias("prediction"), "p")
        return with_risk(flat, "p", "prediction", self.version).drop(
            *[n for n in ("prediction", "p") if n not in added])
