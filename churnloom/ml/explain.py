"""Contributions of every input to every prediction.

A linear model contributes coefficient times distance from the mean, an array expression
in the JVM. Tree ensembles use the path-dependent Shapley values of Lundberg et al.
(2018), see ``shapley``. A model of one shard is broadcast; a larger one is a table of
shards that slices of the rows are joined to, so that no broadcast grows with the model.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import ModelInferenceError
from churnloom.ml import narrative, prep
from churnloom.ml.models import Nodes, StoredEnsemble, TreeEnsemble
from churnloom.ml.score import ChurnPredictor
from churnloom.ml.shapley import SHARD_BYTES, Leaf, Shard, expected, leaves, shards
from churnloom.plans.stages import cut

# Workers get the functions of this module with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Rows of a slice, which meets one shard of the model in one task.
SLICE_ROWS = 1 << 16
# Leaves in the order of trees; ``before`` are the bytes of a tree's leaves before this one.
LEAF = "tree int, before long, bytes long, value double, features array<int>, shares array<double>, low array<double>, high array<double>"


def _broadcast_shard(spark, shard: list[Leaf], inputs: int):
    """A function of the input array. The shard is bounded by ``shapley.SHARD_BYTES``; as bytes, since workers may not have this package."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(shard))

    @F.pandas_udf("array<double>")
    def contributions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prepared = Shard(pickle.loads(shared.value), inputs)
        for features in batches:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, inputs))
            yield pd.Series(list(prepared.contributions(x)))

    return contributions


def _leaves_of_tree(tree: pa.Table) -> pa.Table:
    tree = tree.sort_by("node")
    col = {n: tree.column(n).to_numpy() for n in tree.schema.names}
    start = col["node"][0]
    found = list(leaves(Nodes(np.zeros(1, np.int64), col["feature"], col["threshold"], col["left"] - start, col["right"] - start,
                              col["value"], col["cover"], np.empty(0))))
    sizes = np.array([leaf.bytes for leaf in found], np.int64)
    kinds = {"features": pa.int32(), "shares": pa.float64(), "low": pa.float64(), "high": pa.float64()}
    return pa.table([
        pa.array(np.full(len(found), col["tree"][0]), pa.int32()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
        pa.array([leaf.value for leaf in found], pa.float64()),
        *(pa.array([getattr(leaf, n) for leaf in found], pa.list_(kind)) for n, kind in kinds.items())],
        ["tree", "before", "bytes", "value", *kinds])


def _leaf_table(spark, model: TreeEnsemble, size: int) -> tuple[DataFrame, int]:
    """All leaves as a stage, with their shards, and the number of these. Tasks follow the paths of a tree each; one number a tree reaches the driver."""
    found = cut(model.table(spark).drop("gain").groupBy("tree").applyInArrow(_leaves_of_tree, LEAF), "leaves")
    sizes = {r["tree"]: r["size"] for r in found.groupBy("tree").agg(F.sum("bytes").alias("size")).collect()}
    at = np.cumsum([0, *(sizes.get(tree, 0) for tree in range(max(sizes, default=-1) + 1))]).tolist()
    starts = spark.createDataFrame(list(enumerate(at[:-1])), "tree int, start long")
    dealt = found.join(F.broadcast(starts), "tree").withColumn("shard", F.floor((F.col("start") + F.col("before")) / size).cast("int"))
    return dealt.drop("start", "bytes"), max(1, -(-at[-1] // size))


def _joined_shards(rows: DataFrame, found: DataFrame, count: int, inputs: int) -> DataFrame:
    """Rows of (row, contributions): every slice of rows meets every shard in a task of its own, sums follow by row.

    ``rows`` holds (row, x) with distinct ``row``.
    """
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    numbers = F.sequence(F.lit(0), F.lit(count - 1))
    dealt = rows.select("row", "x", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), F.explode(numbers).alias("shard"))
    copies = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def meet(part: pa.Table, model: pa.Table) -> pa.Table:
        columns = model.sort_by([("tree", "ascending"), ("before", "ascending")]).to_pydict()
        shard = Shard([Leaf(v, *map(np.array, rest)) for v, *rest in zip(
            *(columns[n] for n in ("value", "features", "shares", "low", "high")), strict=True)], inputs)
        x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs)
        added = shard.contributions(x)
        lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * inputs, added.reshape(-1))
        return pa.table({"row": part.column("row"), "shard": part.column("shard"), "added": lists})

    parts = dealt.groupBy("slice", "shard").cogroup(copies.groupBy("slice", "shard")).applyInArrow(
        meet, "row long, shard int, added array<double>")
    # In the order of shards, so that sums do not depend on the order of tasks.
    listed = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("shard", "added"))).alias("parts"))
    return listed.select("row", F.aggregate(
        "parts", F.array_repeat(F.lit(0.0), inputs), lambda total, part: F.zip_with(total, part["added"], lambda a, b: a + b)).alias("_c"))


def encoded_pairs(stages, df: DataFrame) -> DataFrame:
    """Customer and encoded inputs as (feature, value) pairs in vector order; needs the encoding, not a model."""
    inputs = prep.model_inputs(df, target=None)
    names = F.array(*[F.lit(n) for n in prep.feature_names(stages)])
    return prep.encode(stages, inputs, keep=[c.PRIMARY_KEY]).select(
        c.PRIMARY_KEY, F.arrays_zip(names.alias("feature"), vector_to_array(prep.FEATURES).alias("value")).alias("inputs"))


class ChurnExplainer:
    """Explains the predictions of a model for all customers, or for one."""

    def __init__(self, predictor: ChurnPredictor, shard_bytes: int = SHARD_BYTES):
        self.predictor = predictor
        self.names = prep.feature_names(predictor.stages)
        self.shard_bytes = shard_bytes
        self._prepared = self._average = None

    @classmethod
    def load(cls, spark, path: str) -> ChurnExplainer:
        return cls(ChurnPredictor.load(spark, path))

    def _trees(self, spark):
        """The function of the one shard of the model, or the table of its shards and their number; prepared once per explainer."""
        if self._prepared is None:
            model = self.predictor.model
            if isinstance(model, StoredEnsemble):
                self._prepared = _leaf_table(spark, model, self.shard_bytes)
            elif len(first := list(islice(shards(leaves(model.nodes), self.shard_bytes), 2))) == 1:
                self._prepared = _broadcast_shard(spark, first[0], len(self.names)), 1
            else:
                self._prepared = _leaf_table(spark, model, self.shard_bytes)
        return self._prepared

    def _expected(self) -> float:
        if self._average is None:
            self._average = expected(self.predictor.model.pieces())
        return self._average

    def encoded(self, df: DataFrame) -> DataFrame:
        """Customer and encoded inputs as (feature, value) pairs in vector order."""
        return encoded_pairs(self.predictor.stages, df)

    def contributions(self, df: DataFrame, background: DataFrame | None = None):
        """Rows of (CustomerID, p, contributions) and the expected output.

        ``background`` gives the means a linear model is compared with; by default the
        rows themselves.
        """
        spark, model = df.sparkSession, self.predictor.model
        scored = self.predictor.transform(df)
        values = vector_to_array(prep.FEATURES)
        if hasattr(model, "coefficients"):
            base = self.predictor.transform(background) if background is not None else scored
            means = base.agg(Summarizer.mean(F.col(prep.SCALED)).alias("m")).first()["m"].toArray()
            weights = model.coefficients
            model_expected = float(model.intercept + weights @ means)
            pairs = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(a)).alias("a"))
                              for w, a in zip(weights, means)])
            found = F.zip_with(vector_to_array(prep.SCALED), pairs, lambda x, p: p["w"] * (x - p["a"]))
        else:
            model_expected, (trees, count) = self._expected(), self._trees(spark)
            if isinstance(trees, DataFrame):
                rows = cut(scored.select(F.monotonically_increasing_id().alias("row"), c.PRIMARY_KEY, "p", values.alias("_x")), "encoded-rows")
                found = _joined_shards(rows.select("row", F.col("_x").alias("x")), trees, count, len(self.names))
                return self._named(rows.join(found, "row")), model_expected
            found = trees(values)
        return self._named(scored.select(c.PRIMARY_KEY, "p", values.alias("_x"), found.alias("_c"))), model_expected

    def _named(self, listed: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.names])
        return listed.select(
            c.PRIMARY_KEY, "p", F.transform(
                F.arrays_zip(names.alias("feature"), F.col("_x").alias("value"),
                             F.col("_c").alias("contribution")), lambda d: d).alias("contributions"))

    def global_importance(self, df: DataFrame, sample: int | None = None) -> DataFrame:
        """Mean absolute contribution per input over all rows, or over a hashed sample."""
        rows = df if sample is None else df.orderBy(F.xxhash64(c.PRIMARY_KEY, F.lit(42))).limit(sample)
        return narrative.global_importance(self.contributions(rows)[0])

    def explain(self, df: DataFrame) -> DataFrame:
        """Drivers and summary text of every customer."""
        return narrative.local_explanations(self.contributions(df)[0], "p")

    def explain_customer(self, df: DataFrame, customer_id: int) -> DataFrame:
        """The explanation of one customer, found by filtering the mart first."""
        if c.PRIMARY_KEY not in df.columns:
            raise ModelInferenceError(f"the table has no {c.PRIMARY_KEY}")
        found = df.where(F.col(c.PRIMARY_KEY) == customer_id)
        if found.isEmpty():
            raise ModelInferenceError(f"customer {customer_id} is not in the table")
        return narrative.local_explanations(self.contributions(found, background=df)[0], "p")
