"""The customer mart: all stages composed, each built once and then only read."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.errors import ModelInferenceError
from churnloom.ml import train
from churnloom.ml.explain import ChurnExplainer
from churnloom.ml.score import ChurnPredictor
from churnloom.operators import clean, features, health, rfm, risk, segments
from churnloom.plans.manifest import Manifest
from churnloom.plans.stages import new_path
from churnloom.sources.files import in_order, read_customers, write_table
from churnloom.sources.landing import TABLES, customer_table


# Models of the registered queries: full size, all four.
QUERY_SETTINGS = train.Settings()
# Customers per file of the stored explanations; a lookup opens one file.
EXPLAINED_ROWS = 1 << 18


def enrich(cleaned: DataFrame, cuts: dict[str, rfm.QuintileCuts]) -> DataFrame:
    """Features, scores, segments, flags and health of cleaned rows; projections only."""
    scored = rfm.assign_segments(rfm.score(features.build_features(cleaned), cuts))
    return health.score_health(segments.flag_segments(scored))


class CustomerMart:
    """Lazily built stages over one raw customer table.

    Two stages are written: the prepared rows (duplicates removed), which the parameter
    passes read, and the finished mart, which every report reads. Everything between them
    is a projection with fitted parameters. With a manifest, stages that any application has
    built from the same sources are read instead of built.
    """

    def __init__(self, raw: DataFrame, source: str, manifest: Manifest | None = None):
        self.raw = raw
        self.source = source
        self.manifest = manifest
        self.gate: dict[str, DataFrame] = {}  # reports of the ingestion gate, if it was run

    def _stage(self, name: str, make, write=lambda df, path: df.write.parquet(path), **about) -> DataFrame:
        """The published stage of this name, or what ``make`` returns, written and published."""
        spark = self.raw.sparkSession
        found = self.manifest.table(name) if self.manifest else None
        if found is not None:
            return found
        df, path = make(), new_path(spark, name)
        write(df, path)
        if self.manifest:
            return self.manifest.read(self.manifest.publish(name, path, schema=df.schema.json(), **about))
        return spark.read.schema(df.schema).parquet(path)

    @cached_property
    def prepared(self) -> DataFrame:
        return self._stage("prepared", lambda: clean.prepare(self.raw))

    @cached_property
    def cleaned(self) -> clean.Cleaned:
        return clean.clean(self.raw, prepared=self.prepared)

    @cached_property
    def featured(self) -> DataFrame:
        return features.build_features(self.cleaned.df)

    @cached_property
    def cuts(self) -> dict[str, rfm.QuintileCuts]:
        return rfm.fit_quintiles(self.featured)

    @cached_property
    def table(self) -> DataFrame:
        """Every customer with features, scores, segments, flags and health.

        Sorted by customer, so that the report of one customer skips all other row groups. Rows are put in order before they are
        widened: what follows are projections, which the sample for the order need not work out and the shuffle need not carry.
        """
        return self._stage("mart", lambda: enrich(in_order(self.cleaned.df), self.cuts))

    @cached_property
    def scored(self) -> DataFrame:
        """The mart with a stand-in probability, for reports that need one but no model."""
        stand_in = F.pmod(F.col("CustomerID") * 37, F.lit(1000)) / F.lit(1000.0)
        return risk.with_risk(self.table.withColumn("p", stand_in), "p").drop("p")

    @cached_property
    def trained(self) -> train.Trained:
        """Models of every kind, compared on this mart."""
        return train.train(self.table, QUERY_SETTINGS)

    def trained_only(self, name: str) -> train.Trained:
        """One candidate on this mart, by itself unless all are trained already."""
        return self.__dict__.get("trained") or train.train(self.table, QUERY_SETTINGS, only=[name])

    @property
    def _model(self) -> str:
        return "model-" + hashlib.sha256(repr(QUERY_SETTINGS).encode()).hexdigest()[:16]

    @cached_property
    def predictor(self) -> ChurnPredictor:
        """The winner, written and read back; one that was published is not trained again."""
        spark = self.raw.sparkSession
        entry = self.manifest.find(self._model) if self.manifest else None
        if entry is None:
            path = new_path(spark, "model")
            train.save(spark, self.trained, path)
            entry = self.manifest.publish(self._model, path) if self.manifest else {"path": path}
        return ChurnPredictor.load(spark, entry["path"])

    @cached_property
    def explainer(self) -> ChurnExplainer:
        return ChurnExplainer(self.predictor)

    @cached_property
    def _buckets(self) -> int:
        return max(1, -(-self.table.count() // EXPLAINED_ROWS))

    def _bucket(self, customer):
        return F.pmod(F.xxhash64(customer.cast("long")), F.lit(self._buckets)).cast("int")

    @cached_property
    def explanations(self) -> DataFrame:
        """The explanation of every customer, stored in buckets and sorted by customer within each."""
        def make():
            return self.explainer.explain(self.table).withColumn("bucket", self._bucket(F.col(c.PRIMARY_KEY)))

        def write(df: DataFrame, path: str):
            df.repartition(self._buckets, "bucket").sortWithinPartitions("bucket", c.PRIMARY_KEY).write.partitionBy("bucket").parquet(path)

        return self._stage(f"explanations-{self._model}-{self._buckets}", make, write)

    def explanation_of(self, customer_id: int) -> DataFrame:
        """The stored explanation of one customer: one bucket is listed, one row group read."""
        mine = F.col(c.PRIMARY_KEY) == customer_id
        return self.explanations.where(mine & (F.col("bucket") == self._bucket(F.lit(customer_id)))).drop("bucket")

    def explain_customer(self, customer_id: int) -> DataFrame:
        """As ``explanation_of``, fetched; fails if the customer is unknown."""
        asked = self.explanation_of(customer_id)
        rows = asked.take(1)
        if not rows:
            raise ModelInferenceError(f"customer {customer_id} is not in the table")
        return asked.sparkSession.createDataFrame(rows, asked.schema)


_MARTS: dict[tuple[str, str], CustomerMart] = {}


def mart_for(spark: SparkSession, folder: str) -> CustomerMart:
    """The mart over the order data in ``folder`` as it is now.

    Within an application the same object is returned while the sources stay as they are; across
    applications stages are found through the manifest.
    """
    folder = folder.rstrip("/")
    key = (spark.sparkContext.applicationId, folder)
    manifest = Manifest.of(spark, folder, [f"{folder}/{name}.parquet" for name in TABLES])
    if key not in _MARTS or _MARTS[key].manifest.fingerprint != manifest.fingerprint:
        _MARTS[key] = build(spark, folder, manifest)
    return _MARTS[key]


def build(spark: SparkSession, folder: str, manifest: Manifest | None = None) -> CustomerMart:
    """A mart with its customer table written; without a manifest nothing is shared with earlier ones."""
    entry = manifest.find("landing") if manifest else None
    if entry is None:
        path = new_path(spark, "landing")
        write_table(customer_table(spark, folder), path)
        entry = manifest.publish("landing", path) if manifest else {"path": path}
    return CustomerMart(read_customers(spark, entry["path"]), entry["path"], manifest)


def forget(spark: SparkSession, folder: str) -> None:
    """Drop the remembered mart of this application."""
    _MARTS.pop((spark.sparkContext.applicationId, folder.rstrip("/")), None)
