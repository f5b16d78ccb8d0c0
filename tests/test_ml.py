import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnloom.errors import ModelInferenceError, ModelTrainingError
from churnloom.ml import models, prep, train
from churnloom.ml.explain import ChurnExplainer
from churnloom.ml.score import ChurnPredictor
from churnloom.operators import risk
from churnloom.plans import modes
from churnloom.sources import files


@pytest.fixture(scope="module")
def trained(mart):
    return train.train(mart.table, train.Settings(
        trees=3, forest_depth=4, boosted_depth=3, step_size=0.3, max_iter=30, folds=2))


def predictors(trained):
    return {n: ChurnPredictor(trained.stages, m, n) for n, m in trained.models.items()}


def test_split_is_exact_and_repeatable(mart):
    inputs = prep.model_inputs(mart.table)
    a = {r[0] for r in prep.stratified_split(inputs).where("is_test").select("CustomerID").collect()}
    b = {r[0] for r in prep.stratified_split(inputs.repartition(13)).where("is_test").select("CustomerID").collect()}
    assert a == b
    sizes = inputs.groupBy("label").count().collect()
    assert len(a) == sum(-(-r["count"] // 5) for r in sizes)
    assert prep.stratified_split(inputs, seed=7).where("is_test").count() == len(a)


def test_folds_have_equal_sizes(mart):
    folds = prep.stratified_folds(prep.model_inputs(mart.table), 5).groupBy("label", "fold").count().collect()
    assert len(folds) == 10
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in folds if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1


def test_unknown_category_encodes_to_zeros_and_gaps_are_filled(mart):
    inputs = prep.model_inputs(mart.table)
    stages = prep.fit_preprocessor(inputs)
    names = prep.feature_names(stages)
    strange = inputs.limit(1).withColumn("Gender", F.lit("unheard of")).withColumn(
        "Tenure", F.lit(None).cast("double"))
    row = dict(zip(names, prep.encode(stages, strange).select(vector_to_array("features")).first()[0]))
    assert row["Gender_Male"] == 0.0 and row["Gender_Female"] == 0.0 and row["Tenure"] >= 0


def test_leaderboard(spark, trained):
    board = trained.leaderboard(spark).collect()
    assert len(board) == 4 and [r["is_best"] for r in board] == [True, False, False, False]
    assert board[0]["f1"] == max(r["f1"] for r in board)
    for r in board:
        assert 0 <= r["roc_auc"] <= 1 and r["tn"] + r["fp"] + r["fn"] + r["tp"] > 0
    assert train.top_features(trained.importance(spark), 5).count() == 5


def test_contributions_add_up(spark, mart, trained):
    for name, predictor in predictors(trained).items():
        rows, expected = ChurnExplainer(predictor).contributions(mart.table)
        got = rows.collect()
        total = np.array([sum(d["contribution"] for d in r["contributions"]) for r in got]) + expected
        p = np.array([r["p"] for r in got])
        assert np.allclose(total if name == "RandomForest" else 1 / (1 + np.exp(-total)), p, atol=1e-9), name


def test_tree_contributions_agree_with_the_definition(spark, mart, trained):
    """Brute force over all subsets of the inputs of one small tree."""
    from itertools import combinations
    from math import factorial

    nodes = trained.models["RandomForest"].nodes
    predictor = predictors(trained)["RandomForest"]
    rows = ChurnExplainer(predictor).contributions(mart.table.where("CustomerID < 50004"))[0].collect()
    ends = [*nodes.roots[1:], len(nodes.feature)]

    def expectation(node, x, known):
        f, left, right = nodes.feature[node], nodes.left[node], nodes.right[node]
        if f < 0:
            return nodes.value[node]
        if f in known:
            return expectation(left if x[f] <= nodes.threshold[node] else right, x, known)
        return sum(nodes.cover[k] / nodes.cover[node] * expectation(k, x, known) for k in (left, right))

    for row in rows:
        x = [d["value"] for d in row["contributions"]]
        total = np.zeros(len(x))
        for root, end in zip(nodes.roots, ends):
            used = sorted({int(f) for f in nodes.feature[root:end] if f >= 0})
            m = len(used)
            for f in used:
                others = [u for u in used if u != f]
                for size in range(m):
                    weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                    for subset in combinations(others, size):
                        total[f] += weight * (expectation(root, x, {*subset, f}) - expectation(root, x, set(subset)))
        assert np.allclose(total, [d["contribution"] for d in row["contributions"]], atol=1e-9)


def test_a_model_in_shards_explains_as_one_in_one_piece(spark, mart, trained, monkeypatch):
    from churnloom.ml import explain

    monkeypatch.setattr(explain, "SLICE_ROWS", 40)
    for name in ("RandomForest", "LeafwiseBoosting"):
        predictor = predictors(trained)[name]
        whole, expected = ChurnExplainer(predictor).contributions(mart.table)
        small = ChurnExplainer(predictor, shard_bytes=4000)
        parts, same = small.contributions(mart.table)
        assert small._trees(spark)[1] > 1 and same == expected
        # Rows that share a customer stay apart.
        assert small.contributions(mart.table.unionByName(mart.table))[0].count() == 2 * mart.table.count()
        one, other = ({r["CustomerID"]: [d["contribution"] for d in r["contributions"]] for r in t.collect()} for t in (whole, parts))
        assert one.keys() == other.keys()
        assert all(np.allclose(one[k], other[k], atol=1e-12) for k in one)


def test_long_paths_agree_with_listed_ones(monkeypatch):
    from churnloom.ml import shapley

    draw = np.random.default_rng(5)
    found = [shapley.Leaf(draw.normal(), draw.permutation(9)[:m], draw.uniform(.1, .9, m), np.full(m, -np.inf), draw.normal(size=m))
             for m in (1, 2, 3, 5, 7) for _ in range(4)]
    x = draw.normal(size=(300, 9))
    listed = shapley.Shard(found, 9).contributions(x)
    monkeypatch.setattr(shapley, "LISTED", 0)
    assert np.allclose(listed, shapley.Shard(found, 9).contributions(x), atol=1e-12)
    assert shapley.Shard([], 9).contributions(x).any() == False and [*shapley.shards([])] == [[]]  # noqa: E712


def test_explanations(spark, mart, trained):
    explainer = ChurnExplainer(predictors(trained)["GradientBoosting"])
    row = explainer.explain_customer(mart.table, 50003).first()
    assert "50003" in row["executive_summary"]
    for d in row["positive_drivers"]:
        assert d["contribution"] > 0.001
    assert len(row["positive_drivers"]) <= 5 and len(row["negative_drivers"]) <= 5
    with pytest.raises(ModelInferenceError):
        explainer.explain_customer(mart.table, -5)
    with pytest.raises(ModelInferenceError):
        explainer.explain_customer(mart.table.drop("CustomerID"), 1)
    assert explainer.global_importance(mart.table, sample=50).count() == len(explainer.names)


def test_modes_save_and_load(spark, mart, tmp_path):
    source, model = str(tmp_path / "in"), str(tmp_path / "model")
    files.write_table(mart.raw.drop("src_seq"), source)
    trained = modes.run_full(spark, source, model, settings=train.Settings(
        trees=2, forest_depth=3, boosted_depth=2, max_iter=10, folds=0))
    scored, stats = modes.run_predict_only(spark, source, model)
    assert stats.first()["algorithm_used"] == trained.algorithm
    assert scored.count() == mart.table.count()
    assert sum(r["count"] for r in risk.tier_counts(scored).collect()) == scored.count()
    assert modes.run_data_only(spark, source, str(tmp_path / "out")).count() == scored.count()
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == scored.count()


def test_missing_model_and_missing_columns(spark, mart, tmp_path, trained):
    with pytest.raises(ModelInferenceError):
        ChurnPredictor.load(spark, str(tmp_path / "none"))
    trained.stages.write().overwrite().save(str(tmp_path / "bare/stages"))
    models.save(spark, trained.model, str(tmp_path / "bare/model"))
    assert ChurnPredictor.load(spark, str(tmp_path / "bare")).algorithm == "Unknown"
    with pytest.raises(ModelInferenceError):
        ChurnPredictor.load(spark, str(tmp_path / "bare")).predict(mart.table.drop("Tenure"))
    with pytest.raises(ModelTrainingError):
        train.train(mart.table.drop("Churn"))
    with pytest.raises(ModelTrainingError):
        train.train(mart.table.where("Churn = 0"))


def test_scoring_is_a_projection(mart, trained):
    scored = predictors(trained)["GradientBoosting"].predict(mart.table)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_queries_train_full_size_models(spark):
    from churnloom.plans.mart import QUERY_SETTINGS

    assert QUERY_SETTINGS == train.Settings()
    growths = train.candidates(QUERY_SETTINGS, 49)
    assert growths["LogisticRegression"] is None
    for name in ("GradientBoosting", "LeafwiseBoosting"):
        assert (growths[name].rounds, growths[name].step, growths[name].depth) == (300, 0.05, 6)
    assert growths["RandomForest"].rounds == 300 and growths["RandomForest"].depth is None and QUERY_SETTINGS.folds == 5
    assert growths["RandomForest"].tries == 7 and growths["LeafwiseBoosting"].leaves == 31
