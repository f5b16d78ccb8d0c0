"""Fitted models: how they score rows, what their inputs weigh, how they are kept."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom.ml import prep
from churnloom.ml.grow import Bins, Tree, sigmoid
from churnloom.plans.stages import literal_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows scored at once.
CHUNK = 2048
# Nodes that the driver holds at once: larger models stay where they are stored, and are fetched in pieces of some trees.
IN_DRIVER_NODES = 1 << 18
NODE = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class LinearModel:
    """Log odds as a weighted sum of the scaled inputs; scoring is an expression."""

    coefficients: np.ndarray
    intercept: float

    @property
    def weights(self) -> np.ndarray:
        return self.coefficients

    def probability(self) -> Column:
        parts = F.zip_with(vector_to_array(prep.SCALED), _array(self.coefficients), lambda x, w: x * w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(parts, F.lit(float(self.intercept)), lambda a, b: a + b)))

    def table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, {"position": list(range(-1, len(self.coefficients))),
                                     "weight": [float(self.intercept), *map(float, self.coefficients)]})

    @classmethod
    def of(cls, table: DataFrame) -> LinearModel:
        rows = [r["weight"] for r in table.orderBy("position").collect()]
        return cls(np.array(rows[1:]), rows[0])


@dataclass
class Nodes:
    """All nodes of an ensemble in arrays; children count from the start of all, a leaf's are itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree."""
        node = np.tile(self.roots, len(x))
        cells, start = np.ravel(x), np.repeat(np.arange(len(x)) * x.shape[1], len(self.roots))
        going = np.flatnonzero(self.feature[node] >= 0)
        while len(going):
            at = node[going]
            left = cells[start[going] + self.feature[at]] <= self.threshold[at]
            node[going] = at = np.where(left, self.left[at], self.right[at])
            going = going[self.feature[at] >= 0]
        return node.reshape(len(x), len(self.roots))

    def totals(self, x: np.ndarray) -> np.ndarray:
        chunks = [x[i:i + CHUNK] for i in range(0, len(x), CHUNK)]
        return np.concatenate([self.value[self.leaves_of(part)].sum(1) for part in chunks]) if chunks else np.empty(0)


@dataclass
class TreeEnsemble:
    """A sum of trees: log odds if boosted, probabilities if a forest (values are already divided by the number of trees)."""

    nodes: Nodes
    features: int
    is_forest: bool

    @classmethod
    def grown(cls, trees: list[Tree], bins: Bins, is_forest: bool, of: int | None = None) -> TreeEnsemble:
        """The model of the given trees, which may be some ``of`` more."""
        sizes = [len(t.feature) for t in trees]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.empty(0, np.int64)
        feature, at, value, cover, gain = (np.concatenate([np.asarray(getattr(t, n)) for t in trees]) for n in (
            "feature", "at", "value", "cover", "gain"))
        own = np.arange(len(feature), dtype=np.int32)
        left, right = (np.concatenate([np.asarray(getattr(t, n)) + s for t, s in zip(trees, starts, strict=True)]).astype(np.int32)
                       for n in ("left", "right"))
        edges, first = np.concatenate(bins.edges), np.cumsum([0, *map(len, bins.edges)])
        threshold = np.where(feature >= 0, edges[np.where(feature >= 0, first[feature] + at, 0)], 0.0)
        nodes = Nodes(starts, feature, threshold, np.where(feature < 0, own, left), np.where(feature < 0, own, right),
                      value / (of or len(trees)) if is_forest else value, cover, gain)
        return cls(nodes, len(bins.edges), is_forest)

    def pieces(self) -> Iterator[Nodes]:
        """Nodes of consecutive trees, counted from the first of them."""
        yield self.nodes

    @property
    def weights(self) -> np.ndarray:
        """Share of each input in the gain of all splits."""
        gain = np.zeros(self.features)
        for nodes in self.pieces():
            split = nodes.feature >= 0
            np.add.at(gain, nodes.feature[split], nodes.gain[split])
        return gain / gain.sum() if gain.sum() else gain

    def scorer(self) -> TreeEnsemble:
        """The same without what only explanations need, to be sent around."""
        none = np.empty(0)
        return replace(self, nodes=replace(self.nodes, cover=none, gain=none))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = self.nodes.totals(x)
        return np.clip(total, 0, 1) if self.is_forest else sigmoid(total)

    def sent(self, spark: SparkSession):
        """Broadcast what scoring needs, as plain arrays that are written out one by one; ``scorer_of`` makes a model of it."""
        n = self.nodes
        return spark.sparkContext.broadcast((n.roots, n.feature, n.threshold, n.left, n.right, n.value, self.features, self.is_forest))

    def probability(self) -> Column:
        """A function of the inputs on Arrow batches; the model itself is broadcast."""
        sent = self.sent(SparkSession.getActiveSession())

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = scorer_of(sent.value)
            for inputs in batches:
                yield pd.Series(model.scores(np.stack(inputs.to_numpy())) if len(inputs) else np.empty(0))

        return score(vector_to_array(prep.FEATURES))

    def table(self, spark: SparkSession) -> DataFrame:
        kinds = dict(f.split() for f in NODE.split(", "))
        return literal_table(spark, node_columns(self.nodes), kinds)

    @classmethod
    def of(cls, table: DataFrame, features: int, is_forest: bool) -> TreeEnsemble:
        t = table.orderBy("node").toArrow()
        col = {n: t.column(n).to_numpy() for n in t.schema.names}
        roots = np.flatnonzero(np.r_[True, col["tree"][1:] != col["tree"][:-1]])
        nodes = Nodes(roots, *(col[n] for n in ("feature", "threshold", "left", "right", "value", "cover", "gain")))
        return cls(nodes, features, is_forest)


class StoredEnsemble(TreeEnsemble):
    """A tree model with more nodes than the driver is to hold, in a table of ``NODE``; ``sizes`` are nodes by tree."""

    def __init__(self, table: DataFrame, sizes: np.ndarray, features: int, is_forest: bool):
        self._table, self.sizes, self.features, self.is_forest = table, np.asarray(sizes), features, is_forest
        self._weights = None

    def pieces(self) -> Iterator[Nodes]:
        starts, first = np.cumsum([0, *self.sizes]), 0
        while first < len(self.sizes):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + IN_DRIVER_NODES, "right")) - 1)
            yield self._fetched(starts[first:last], first, last)
            first = last

    def _fetched(self, starts: np.ndarray, first: int, last: int) -> Nodes:
        t = self._table.where(F.col("tree").between(first, last - 1)).toArrow().sort_by("node")
        col = {n: t.column(n).to_numpy() for n in t.schema.names}
        return Nodes(starts - starts[0], col["feature"], col["threshold"], col["left"] - starts[0], col["right"] - starts[0],
                     col["value"], col["cover"], col["gain"])

    @property
    def weights(self) -> np.ndarray:
        if self._weights is None:
            self._weights = super().weights
        return self._weights

    def _whole(self, *names: str) -> Nodes:
        """All nodes, the named columns only."""
        kinds = {"feature": np.int32, "left": np.int32, "right": np.int32}
        columns = {n: np.empty(self.sizes.sum() if n in names else 0, kinds.get(n, float))
                   for n in ("feature", "threshold", "left", "right", "value", "cover", "gain")}
        start = 0
        for nodes in self.pieces():
            for n in names:
                values = getattr(nodes, n)
                columns[n][start:start + len(values)] = values + start if n in ("left", "right") else values
            start += len(nodes.feature)
        return Nodes(np.cumsum([0, *self.sizes])[:-1], **columns)

    @property
    def nodes(self) -> Nodes:
        """All of them, in the driver's memory."""
        return self._whole("feature", "threshold", "left", "right", "value", "cover", "gain")

    def scorer(self) -> TreeEnsemble:
        return self

    def sent(self, spark: SparkSession):
        return TreeEnsemble(self._whole("feature", "threshold", "left", "right", "value"), self.features, self.is_forest).sent(spark)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return TreeEnsemble(self.nodes, self.features, self.is_forest).scores(x)

    def table(self, spark: SparkSession) -> DataFrame:
        return self._table


def scorer_of(sent: tuple) -> TreeEnsemble:
    *arrays, features, is_forest = sent
    return TreeEnsemble(Nodes(*arrays, np.empty(0), np.empty(0)), features, is_forest)


def node_columns(n: Nodes, tree: int = 0, start: int = 0) -> dict[str, np.ndarray]:
    """Columns of ``NODE`` for nodes of which the first has the number ``start`` and is in tree ``tree``."""
    sizes = np.diff(np.r_[n.roots, len(n.feature)])
    return {"tree": tree + np.repeat(np.arange(len(n.roots)), sizes), "node": start + np.arange(len(n.feature)), "feature": n.feature,
            "threshold": n.threshold, "left": start + n.left, "right": start + n.right, "value": n.value, "cover": n.cover, "gain": n.gain}


def stored(table: DataFrame, features: int, is_forest: bool) -> TreeEnsemble:
    """The model of a table of nodes, in the driver's memory if it is small."""
    sizes = [r["n"] for r in table.groupBy("tree").agg(F.count("*").alias("n")).orderBy("tree").collect()]
    small = sum(sizes) <= IN_DRIVER_NODES
    return TreeEnsemble.of(table, features, is_forest) if small else StoredEnsemble(table, sizes, features, is_forest)


def save(spark: SparkSession, model, path: str) -> None:
    kind = "linear" if isinstance(model, LinearModel) else "forest" if model.is_forest else "boosted"
    model.table(spark).write.mode("overwrite").parquet(f"{path}/weights")
    literal_table(spark, {"kind": [kind], "inputs": [len(model.weights)]}).write.mode("overwrite").json(f"{path}/kind")


def load(spark: SparkSession, path: str):
    about = spark.read.json(f"{path}/kind").first()
    table = spark.read.parquet(f"{path}/weights")
    return LinearModel.of(table) if about["kind"] == "linear" else stored(table, about["inputs"], about["kind"] == "forest")
