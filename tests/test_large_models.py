"""Models with more nodes than the driver is to hold: the same rows, fetched in pieces."""

import numpy as np
import pytest

from churnloom.ml import fits as ff
from churnloom.ml import models, train
from churnloom.ml.explain import ChurnExplainer
from churnloom.ml.score import ChurnPredictor
from churnloom.ml.shapley import expected

SETTINGS = train.Settings(trees=5, forest_depth=5, boosted_depth=3, step_size=0.3, max_iter=30, folds=2)


@pytest.fixture(scope="module")
def whole(mart):
    return train.train(mart.table, SETTINGS, only=["RandomForest", "GradientBoosting"])


@pytest.fixture
def few(monkeypatch):
    """The driver holds 9 nodes at most, or one tree."""
    for module in (models, ff):
        monkeypatch.setattr(module, "IN_DRIVER_NODES", 9)


def test_large_models_are_trained_saved_and_scored_as_small_ones(spark, mart, whole, few, tmp_path, monkeypatch):
    # No tree reaches the driver packed.
    monkeypatch.setattr(ff, "_trees_of", None)
    parts = train.train(mart.table, SETTINGS, only=["RandomForest", "GradientBoosting"])
    times = {"training_seconds": 0}
    assert {n: r | times for n, r in parts.results.items()} == {n: r | times for n, r in whole.results.items()} and parts.folds == whole.folds
    for name, model in whole.models.items():
        stored = parts.models[name]
        assert isinstance(stored, models.StoredEnsemble) and stored.scorer() is stored
        models.save(spark, stored, str(tmp_path / name))
        again = models.load(spark, str(tmp_path / name))
        assert isinstance(again, models.StoredEnsemble)
        for kept in (stored, again):
            sizes = [len(nodes.feature) for nodes in kept.pieces()]
            assert len(sizes) > 1 and sum(sizes) == len(model.nodes.feature)
            assert all(n <= 9 or len(nodes.roots) == 1 for n, nodes in zip(sizes, kept.pieces(), strict=True))
            for n in ("roots", "feature", "threshold", "left", "right", "value", "cover", "gain"):
                assert (getattr(kept.nodes, n) == getattr(model.nodes, n)).all()
            assert (kept.weights == model.weights).all()
            assert expected(kept.pieces()) == expected([model.nodes])
        one, other = (sorted(ChurnPredictor(whole.stages, m).transform(mart.table).select("CustomerID", "p").collect()) for m in (model, again))
        assert one == other


def test_large_models_are_explained_as_small_ones(spark, mart, whole, few, tmp_path, monkeypatch):
    from churnloom.ml import explain

    some = mart.table.where("CustomerID < 50100")
    for name, model in whole.models.items():
        one, base = ChurnExplainer(ChurnPredictor(whole.stages, model, name)).contributions(some)
        one = {r["CustomerID"]: [d["contribution"] for d in r["contributions"]] for r in one.collect()}
        models.save(spark, model, str(tmp_path / name))
        with monkeypatch.context() as patched:
            # Paths to leaves are followed in tasks only.
            patched.setattr(explain, "shards", None)
            for size in (3000, 1 << 26):
                explainer = ChurnExplainer(ChurnPredictor(whole.stages, models.load(spark, str(tmp_path / name)), name), size)
                other, same = explainer.contributions(some)
                other = {r["CustomerID"]: [d["contribution"] for d in r["contributions"]] for r in other.collect()}
                assert same == base and one.keys() == other.keys() and all(np.allclose(one[k], other[k], atol=1e-12) for k in one)
                assert (explainer._trees(spark)[1] > 1) == (size == 3000)
