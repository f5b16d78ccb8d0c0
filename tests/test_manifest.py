import os
import shutil
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from churnloom.errors import ModelInferenceError
from churnloom.ml import train
from churnloom.plans import manifest
from churnloom.plans import mart as marts
from churnloom.plans import stages as written
from churnloom.plans.stages import shared_folder
from churnloom.sources.landing import TABLES

from .conftest import ROOT, SMALL

QUICK = train.Settings(trees=3, forest_depth=4, boosted_depth=3, step_size=0.3, max_iter=30, folds=2)


@pytest.fixture
def folder(tmp_path):
    for name in TABLES:
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path)
    return str(tmp_path)


def stages(spark):
    place = f"{shared_folder(spark)}/stages"
    return set(os.listdir(place)) if os.path.exists(place) else set()


def test_a_second_application_builds_nothing(spark, folder, monkeypatch):
    first = marts.mart_for(spark, folder)
    rows, names = first.table.count(), first.table.columns
    before = stages(spark)
    marts.forget(spark, folder)
    for name in ("enrich", "customer_table"):
        monkeypatch.setattr(marts, name, lambda *a: pytest.fail("built again"))
    again = marts.mart_for(spark, folder)
    assert again is not first and again.table.count() == rows and again.table.columns == names
    assert stages(spark) == before
    assert marts.mart_for(spark, folder) is again


def test_another_process_finds_the_mart(spark, folder):
    rows = marts.mart_for(spark, folder).table.count()
    before = stages(spark)
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "from churnloom.plans import mart\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.checkpoint.dir', sys.argv[2]).getOrCreate()\n"
        "print('rows', mart.mart_for(s, sys.argv[3]).table.count())\n")
    out = subprocess.run([sys.executable, "-c", code, ROOT, shared_folder(spark), folder], capture_output=True, text=True, timeout=240)
    assert f"rows {rows}" in out.stdout, out.stderr[-2000:]
    assert stages(spark) == before


def test_a_changed_source_is_built_anew_and_the_old_state_swept(spark, folder, monkeypatch, tmp_path_factory):
    own = str(tmp_path_factory.mktemp("swept"))  # the stages of other tests stay
    for module in (manifest, written):
        monkeypatch.setattr(module, "shared_folder", lambda session: own)
    old = marts.mart_for(spark, folder)
    customers, old_path = old.table.count(), old.manifest.find("mart")["path"]
    extra = spark.read.parquet(f"{SMALL}/customer.parquet").where("c_custkey % 2 = 0").toPandas()
    extra.to_parquet(f"{folder}/customer.parquet")
    new = marts.mart_for(spark, folder)
    assert new.manifest.fingerprint != old.manifest.fingerprint and new.table.count() < customers
    assert manifest.sweep(spark, older_than=3600) == []
    time.sleep(1.1)
    removed = manifest.sweep(spark, older_than=1)
    gone = {path.rsplit("/", 1)[-1] for path in removed}
    assert old_path.rsplit("/", 1)[-1] in gone and old.manifest.find("mart") is None
    assert not os.path.exists(old_path) and new.table.count() > 0
    assert not gone & {new.manifest.find(n)["path"].rsplit("/", 1)[-1] for n in ("landing", "prepared", "mart")}


def test_the_first_of_two_publishers_counts(spark, tmp_path):
    mine = manifest.Manifest(spark, "somewhere", "f" * 64)
    paths = [str(tmp_path / n) for n in "ab"]
    for path in paths:
        spark.range(3).write.parquet(path)
    assert mine.find("x") is None and mine.table("x") is None
    schema = spark.range(0).schema.json()
    assert mine.publish("x", paths[0], schema=schema)["path"] == paths[0]
    assert mine.publish("x", paths[1], schema=schema)["path"] == paths[0]
    assert mine.table("x").count() == 3
    shutil.rmtree(paths[0])
    assert mine.find("x") is None
    assert mine.publish("x", paths[1], schema=schema)["path"] == paths[1]


def test_stored_explanations(spark, folder, monkeypatch):
    monkeypatch.setattr(marts, "QUERY_SETTINGS", QUICK)
    monkeypatch.setattr(marts, "EXPLAINED_ROWS", 32)
    mart = marts.mart_for(spark, folder)
    total = mart.explanations.count()
    assert total == mart.table.count() and mart._buckets > 2
    customer = mart.table.agg(F.max("CustomerID")).first()[0]
    assert mart.explain_customer(customer).first() == mart.explainer.explain_customer(mart.table, customer).first()
    with pytest.raises(ModelInferenceError):
        mart.explain_customer(-5)
    asked = mart.explanation_of(customer)
    assert asked.count() == 1
    plan = asked._jdf.queryExecution().executedPlan()
    asked._jdf.collectToPython()
    metrics = plan.collectLeaves().apply(0).metrics()
    assert metrics.apply("numFiles").value() == 1
    assert metrics.apply("numOutputRows").value() <= total // 2
    # Neither the model nor the explanations are made again.
    marts.forget(spark, folder)
    monkeypatch.setattr(train, "train", lambda *a, **k: pytest.fail("trained again"))
    assert marts.mart_for(spark, folder).explain_customer(customer).count() == 1
