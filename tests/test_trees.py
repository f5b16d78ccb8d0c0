"""Trees of shared passes against a booster and a forest written out plainly, and the two ways of growing against each other."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from churnloom.ml import fits as ff
from churnloom.ml import grow, linear, train
from churnloom.ml.fits import Fit
from churnloom.ml.grow import SCALE, Bins, Growth
from churnloom.ml.models import LinearModel, TreeEnsemble

FLAT = ("feature", "at", "left", "right", "value", "cover", "gain")


def data(rows=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.hstack([np.round(rng.standard_normal((rows, 4)), 1), rng.integers(0, 2, (rows, 3))])
    label = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(rows) < 0.1)).astype(float)
    return x, label, rng.integers(0, 3, rows).astype(np.int32)


def bins_of(x, numeric=4):
    return Bins([np.unique(x[:, j])[:-1] for j in range(numeric)] + [np.zeros(1)] * (x.shape[1] - numeric))


def plain_split(raw, g, h, growth, features, rows):
    """The best (gain, feature, bin) of a node, every bin of every input tried."""
    def score(keep):
        return (g[keep].sum() / SCALE) ** 2 / (h[keep].sum() / SCALE + growth.l2)

    best, parent = None, score(rows)
    looked = 0
    for f in features:
        mine = None
        for t in np.unique(raw[rows, f])[:-1]:
            left, right = rows[raw[rows, f] <= t], rows[raw[rows, f] > t]
            if min(len(left), len(right)) < growth.least_rows or min(h[left].sum(), h[right].sum()) < growth.least_hessian * SCALE:
                continue
            gain = score(left) + score(right) - parent
            if gain > grow.NOISE * max(1.0, parent) and (mine is None or gain > mine[0]):
                mine = (gain, f, t)
        looked += mine is not None
        if mine is not None and (best is None or mine[0] > best[0] or mine[0] == best[0] and f < best[1]):
            best = mine
        if growth.tries and looked == growth.tries:
            break
    return best


def plain_tree(raw, g, h, growth, key):
    """Nested (feature, bin, left, right) or a leaf's value; best first if the number of leaves is bounded."""
    def node(rows, key, depth):
        return {"rows": rows, "key": key, "depth": depth, "value": grow.leaf_value(int(g[rows].sum()), int(h[rows].sum()), growth)}

    def split_of(n):
        if growth.depth is not None and n["depth"] >= growth.depth:
            return None
        order = grow.feature_order(np.array([n["key"]], np.uint64), raw.shape[1])[0] if growth.tries else range(raw.shape[1])
        return plain_split(raw, g, h, growth, order, n["rows"])

    root = node(np.arange(len(raw)), key, 0)
    open_, leaves = [(root, split_of(root))], 1
    while any(s for _, s in open_) and (growth.leaves is None or leaves < growth.leaves):
        i = max((i for i, (_, s) in enumerate(open_) if s), key=lambda i: open_[i][1][0])
        n, (_, f, t) = open_.pop(i)
        left = raw[n["rows"], f] <= t
        n["split"] = (int(f), int(t))
        n["kids"] = [node(n["rows"][left], grow.mixed(2 * n["key"]), n["depth"] + 1),
                     node(n["rows"][~left], grow.mixed(2 * n["key"] + 1), n["depth"] + 1)]
        open_ += [(k, split_of(k)) for k in n["kids"]]
        leaves += 1
    return root


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return round(float(tree.value[node]), 12)
    return (int(tree.feature[node]), int(tree.at[node]), nested(tree, tree.left[node]), nested(tree, tree.right[node]))


def plainly(n):
    return (*n["split"], *map(plainly, n["kids"])) if "kids" in n else round(n["value"], 12)


@pytest.mark.parametrize("growth", [
    Growth(8, 4, 0.3, l2=1.0, least_hessian=1.0), Growth(8, 5, 0.3, leaves=7, least_rows=20, least_hessian=1e-3), Growth(3, None, 1.0)])
def test_boosting_is_that_of_a_plain_booster(growth):
    x, label, _ = data()
    bins, fit = bins_of(x), Fit(0, "b", growth, False, -1, (1.0, 1.7))
    raw = bins.of(x)
    trees = ff._boost(fit, bins, label, raw)
    margin = np.zeros(len(x))
    for number, tree in enumerate(trees):
        g, h = grow.boosting_stats(margin, label, fit.weight(label))
        assert nested(tree) == plainly(plain_tree(raw, g, h, growth, grow.tree_key(growth, 0, number)))
        margin += np.asarray(tree.value)[tree.route(raw)]
    assert ((margin > 0) == (label > 0)).mean() > 0.8


def test_forest_is_that_of_a_plain_one():
    x, label, _ = data(150)
    growth = Growth(4, None, tries=2)
    bins, fit = bins_of(x), Fit(3, "f", growth, True, -1, (0.8, 1.3))
    raw, row = bins.of(x), np.arange(len(x))
    for number, tree in enumerate(ff._forest(fit, bins, row, label, raw, range(4))):
        key = grow.tree_key(growth, 3, number)
        g, h = grow.forest_stats(row, label, fit.weight(label), key)
        drawn = h > 0
        assert nested(tree) == plainly(plain_tree(raw[drawn], g[drawn], h[drawn], growth, key))
        assert 0.5 < drawn.mean() < 0.75


def test_best_first_trees_differ_and_are_bounded():
    x, label, _ = data()
    bins = bins_of(x)
    raw = bins.of(x)
    stats = grow.boosting_stats(np.zeros(len(x)), label, np.ones(len(x)))
    whole = grow.grow(bins, raw + bins.starts, raw, stats, Growth(1, 6), 1)
    few = whole.best_first(6)
    assert sum(f < 0 for f in few.feature) == 6 < sum(f < 0 for f in whole.feature)
    assert max(few.depth) > 3  # a balanced tree of six leaves has three levels


@pytest.fixture(scope="module")
def binned(spark):
    x, label, fold = data(300, 5)
    bins = bins_of(x)
    fold[::9] = -1  # test rows
    rows = [(int(i) * 7919, float(y), int(k), r.tobytes()) for i, (y, k, r) in enumerate(zip(label, fold, bins.of(x)))]
    df = spark.createDataFrame(rows, "row long, label double, fold int, bins binary")
    return df.repartition(3), bins


def some_fits():
    forest, boosted = Growth(5, None, tries=2), Growth(13, 3, 0.3, l2=1.0, least_hessian=1.0)
    leafwise = replace(boosted, rounds=11, depth=4, leaves=5, least_rows=5)
    return [Fit(i, n, g, n == "f", holdout, (0.9, 1.2)) for i, (n, g, holdout) in enumerate(
        [("f", forest, -1), ("b", boosted, -1), ("l", leafwise, -1), ("f", forest, 1), ("b", boosted, 0), ("l", leafwise, 2)])]


def same(a, b):
    assert a.keys() == b.keys()
    for number in a:
        assert len(a[number]) == len(b[number])
        for s, t in zip(a[number], b[number], strict=True):
            assert nested(s) == nested(t)


def test_trees_do_not_depend_on_the_way_or_the_partitions(binned, monkeypatch):
    """In a task, by levels to the end, and by levels down to small nodes."""
    df, bins = binned
    fits = some_fits()
    in_task = ff.fit_trees(df, bins, fits)
    assert [len(in_task[f.number]) for f in fits] == [f.growth.rounds for f in fits]
    same(in_task, ff.fit_trees(df.repartition(7), bins, fits))
    monkeypatch.setattr(ff, "ROUNDS_KEPT", 4)
    monkeypatch.setattr(ff, "TREES_AT_ONCE", 6)
    boosted = [f for f in fits if not f.is_forest]
    same({f.number: in_task[f.number] for f in boosted}, ff.boost_by_levels(df, bins, boosted))
    forests = [f for f in fits if f.is_forest]
    for rows in (0, 40):
        monkeypatch.setattr(ff, "IN_TASK_ROWS", rows)
        same({f.number: in_task[f.number] for f in forests}, ff.forest_by_levels(df, bins, forests))


def test_a_table_without_a_split_gives_lone_leaves(spark):
    rows = [(i, float(i % 2), i % 3, bytes([0, 0])) for i in range(12)]
    df = spark.createDataFrame(rows, "row long, label double, fold int, bins binary")
    bins, fits = Bins([np.zeros(1)] * 2), [Fit(0, "b", Growth(2, 3, 0.5), False, -1, (1.0, 3.0))]
    a, b = ff.in_tasks(df, bins, fits), ff.boost_by_levels(df, bins, fits)
    same(a, b)
    assert a[0][0].feature.tolist() == [-1] and a[0][0].value[0] > 0


def test_a_model_survives_saving(spark, tmp_path):
    from churnloom.ml import models

    x, label, _ = data()
    bins = bins_of(x)
    for is_forest, growth in ((True, Growth(4, None, tries=2)), (False, Growth(4, 3, 0.3))):
        fit = Fit(0, "m", growth, is_forest, -1, (1.0, 1.0))
        raw = bins.of(x)
        trees = ff._forest(fit, bins, np.arange(len(x)), label, raw, range(4)) if is_forest else ff._boost(fit, bins, label, raw)
        model = TreeEnsemble.grown(trees, bins, is_forest)
        by_bins = sum(np.asarray(t.value)[t.route(raw)] for t in trees)
        assert np.allclose(model.scores(x), by_bins / 4 if is_forest else grow.sigmoid(by_bins), atol=1e-12)
        models.save(spark, model, str(tmp_path / str(is_forest)))
        again = models.load(spark, str(tmp_path / str(is_forest)))
        assert (again.scores(x) == model.scores(x)).all() and again.weights.sum() == pytest.approx(1)
    models.save(spark, LinearModel(np.array([1.0, -2.0]), 0.5), str(tmp_path / "linear"))
    again = models.load(spark, str(tmp_path / "linear"))
    assert again.coefficients.tolist() == [1.0, -2.0] and again.intercept == 0.5


def test_linear_fits_are_at_their_minimum(spark):
    x, label, fold = data()
    rows = [(float(y), int(k), [float(v) for v in r]) for y, k, r in zip(label, fold, x)]
    df = spark.createDataFrame(rows, "label double, fold int, v array<double>").select(
        "label", "fold", array_to_vector("v").alias("scaled")).repartition(3)
    fits = [Fit(i, "m", None, False, h, (0.7, 1.4)) for i, h in enumerate((-1, 0, 2))]
    found = linear.fit_linear(df, fits, x.shape[1], 100)
    for fit in fits:
        keep, model = fold != fit.holdout, found[fit.number]
        p = grow.sigmoid(x[keep] @ model.coefficients + model.intercept)
        off = fit.weight(label[keep]) * (p - label[keep])
        assert np.abs(x[keep].T @ off + model.coefficients).max() < 1e-7 and abs(off.sum()) < 1e-7


def test_linear_model_is_that_of_the_library(spark):
    from pyspark.ml.classification import LogisticRegression

    x, label, _ = data(200, 3)
    rows = [(float(y), 0, [float(v) for v in r]) for y, r in zip(label, x)]
    df = spark.createDataFrame(rows, "label double, fold int, v array<double>").select(
        "label", "fold", array_to_vector("v").alias("scaled"))
    ours = linear.fit_linear(df, [Fit(0, "m", None, False, -1, (1.0, 1.0))], x.shape[1], 100)[0]
    theirs = LogisticRegression(maxIter=1000, regParam=1 / 200, standardization=False, featuresCol="scaled", tol=1e-12).fit(df)
    assert np.allclose(ours.coefficients, theirs.coefficients.toArray(), atol=1e-6)
    assert ours.intercept == pytest.approx(theirs.intercept, abs=1e-6)


def test_areas_count_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(rng.integers(0, 2)), float(np.round(rng.random(), d))) for k, d in ((0, 1), (1, 2), (2, 9)) for _ in range(150)]
    rows += [(3, 1.0, 0.5), (3, 1.0, 1.0), (4, 0.0, 0.0), (4, 1.0, 1.0)]
    found = {r.fit: r.roc_auc for r in train.areas(spark.createDataFrame(rows, "fit int, label double, score double")).collect()}
    for k in range(5):
        positive, negative = ([s for f, y, s in rows if f == k and y == v] for v in (1.0, 0.0))
        pairs = [(a > b) + (a == b) / 2 for a in positive for b in negative]
        assert found[k] == (pytest.approx(sum(pairs) / len(pairs), abs=1e-12) if pairs else None)


@pytest.mark.parametrize("growth", [
    Growth(3, 6, 0.3, l2=1.0, least_hessian=1.0), Growth(3, 6, 0.3, leaves=7, least_rows=20, least_hessian=1e-3), Growth(3, None, tries=2)])
@pytest.mark.parametrize("together", [1, 1 << 12])
def test_nodes_counted_by_themselves_split_like_those_side_by_side(growth, together, monkeypatch):
    """Joint columns, the larger child as what the smaller one leaves, and margins from the nodes that rows end in."""
    x, label, _ = data(700, 8)
    bins, fit = bins_of(x), Fit(1, "m", growth, growth.tries is not None, -1, (0.9, 1.4))
    raw, row = bins.of(x), np.arange(len(x))
    trees = {}
    monkeypatch.setattr(grow, "JOINT_CELLS", together)
    for wide in (2, 100, 1 << 30):
        monkeypatch.setattr(grow, "WIDE_ROWS", wide)
        trees[wide] = ff._forest(fit, bins, row, label, raw, range(3)) if fit.is_forest else ff._boost(fit, bins, label, raw)
    same({0: trees[2]}, {0: trees[100]})
    same({0: trees[2]}, {0: trees[1 << 30]})
    assert len(trees[2][0].feature) > 7


def test_inputs_are_counted_together_in_fewer_passes():
    x, _, _ = data(500)
    bins = bins_of(x)
    joint, raw = grow.Joint(bins, bins.of(x)), bins.of(x)
    assert len(joint.columns) < len(bins.edges)
    rows, weight = np.arange(0, 500, 3), np.arange(500.0)
    sums = joint.count(rows, [weight, None])
    codes = (raw + bins.starts)[rows]
    for i, v in enumerate((weight[rows], np.ones(len(rows)))):
        assert sums[i].tolist() == np.bincount(codes.ravel(), np.repeat(v, codes.shape[1]), bins.cells).tolist()


def test_a_task_scores_with_one_model(spark):
    """Every fit is sent by itself: rows of a fold see its model, test rows the full one."""
    rows = [(float(i % 2), i % 3 - 1, [float(i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "label double, fold int, v array<double>").select("label", "fold", array_to_vector("v").alias("features"))
    fits = [Fit(i, "m", Growth(1, 2), False, h, (1.0, 1.0)) for i, h in enumerate((-1, 0, 1))]
    bins = Bins([np.array([9.0]), np.zeros(1)])
    tree = grow.Tree(feature=[0, -1, -1], at=[0, 0, 0], left=[1, -1, -1], right=[2, -1, -1], value=[0.0, -2.0, 2.0], cover=[0.0] * 3, gain=[1.0, 0.0, 0.0])
    models = {f.number: TreeEnsemble.grown([tree] * (f.number + 1), bins, False) for f in fits}
    for f in fits:
        one = train._scores_of(df.where(f"fold = {f.holdout}"), f.number, models[f.number])
        found = sorted((r.label, r.score) for r in one.collect())
        assert found == sorted((y, float(grow.sigmoid((2.0 if v[0] > 9 else -2.0) * (f.number + 1)))) for y, k, v in rows if k == f.holdout)
    assert train._scores(df, fits, models).count() == 30 and len(models[0].scorer().nodes.cover) == 0


def test_rows_without_gradient_are_not_looked_at_for_sums():
    """Nodes counted side by side and by themselves, with zero gradients first or not at all, against plain sums."""
    x, label, _ = data(500, 4)
    bins = bins_of(x)
    raw = bins.of(x)
    rng = np.random.default_rng(1)
    g, h = np.where(label > 0, -rng.integers(1, 9, 500), 0).astype(float), rng.integers(1, 9, 500).astype(float)
    rows = np.concatenate([np.flatnonzero(g == 0), np.flatnonzero(g)])
    zeros = int((g == 0).sum())
    joint = grow.Joint(bins, raw)
    read = joint.count(rows, [np.where(g == 0, np.nan, g), h], zeros)  # what is not looked at may be anything
    assert np.array_equal(read, joint.count(np.arange(500), [g, h]))
    assert all(np.array_equal(read[i, s:s + len(e) + 1], np.bincount(raw[:, f], v, len(e) + 1))
               for i, v in enumerate((g, h)) for f, (s, e) in enumerate(zip(bins.starts, bins.edges, strict=True)))
    node, tried = np.sort(rng.integers(0, 3, 500)), np.array([[0, 5], [6, 1], [3, 2]])
    cells = {(int(a), int(f), int(at)): v for a, f, at, *v in zip(*grow.tried_cells(bins, raw, rows, node, tried, [g[rows], h[rows], None]), strict=True)}
    for a in range(3):
        mine = rows[node == a]
        for f in tried[a]:
            for at in np.unique(raw[mine, f]):
                here = mine[raw[mine, f] == at]
                assert cells.pop((a, int(f), int(at))) == [g[here].sum(), h[here].sum(), len(here)]
    assert not cells


def test_trees_do_not_depend_on_the_width_of_nodes(monkeypatch):
    """Forest trees whose nodes are all counted by themselves equal those counted side by side."""
    x, label, _ = data(600, 5)
    bins = bins_of(x)
    raw, row = bins.of(x), np.arange(600) * 7919
    fit = Fit(0, "f", Growth(3, None, tries=2), True, -1, (0.8, 1.3))
    grown = []
    for width in (1, 1 << 20):
        monkeypatch.setattr(grow, "WIDE_ROWS", width)
        grown.append(ff._forest(fit, bins, row, label, raw, range(3)))
    assert all(np.array_equal(getattr(a, n), getattr(b, n)) for a, b in zip(*grown, strict=True) for n in FLAT)


def exclusive(rows=900, seed=9):
    """Bins of three inputs of which one follows from another, and of two texts in one-hot inputs."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, 2)).round(1)
    texts = [rng.integers(0, n, rows)[:, None] == np.arange(n) for n in (8, 6)]
    x = np.hstack([x, np.floor(x[:, :1]), *texts]).astype(float)
    label = ((x[:, 0] + x[:, 4] > 0.5) ^ (rng.random(rows) < 0.2)).astype(float)
    return bins_of(x, 3), x, label


@pytest.mark.parametrize("most", [1 << 16, 12])
def test_patterns_that_occur_are_counted_in_fewer_passes(most, monkeypatch):
    """Inputs that exclude each other share a column; ``most`` is also less than the sample lets expect."""
    monkeypatch.setattr(grow, "JOINT_CELLS", 64)
    monkeypatch.setattr(grow, "PATTERNS", 64)
    monkeypatch.setattr(grow, "MOST_PATTERNS", most)
    monkeypatch.setattr(grow, "PATTERN_ROWS", 200)
    monkeypatch.setattr(grow, "BLOCK", 128)
    bins, x, _ = exclusive()
    raw = bins.of(x)
    joint = grow.Joint(bins, raw)
    if most > 64:
        assert len(joint.patterns.columns) < len(joint.columns)
    weight = np.arange(900.0)
    for rows in (np.arange(900), np.arange(0, 900, 3), np.arange(5, 150)):
        sums = joint.count(rows, [weight, None])
        codes = (raw + bins.starts)[rows]
        for i, v in enumerate((weight[rows], np.ones(len(rows)))):
            assert sums[i].tolist() == np.bincount(codes.ravel(), np.repeat(v, codes.shape[1]), bins.cells).tolist()


def test_a_row_is_looked_at_for_gradient_or_weight(monkeypatch):
    """Where gradients are the negative weight or 0, weights of rows with gradient are not read."""
    bins, x, label = exclusive()
    weight = np.random.default_rng(2).integers(1, 9, 900).astype(float)
    gradient, rows, zeros = -weight * label, np.argsort(label, kind="stable"), int((label == 0).sum())
    plain = grow.Joint(bins, bins.of(x)).count(rows, [gradient, weight], zeros)
    for size in (1, 1 << 30):
        monkeypatch.setattr(grow, "PATTERN_ROWS", size)
        read = [np.where(label == 0, np.nan, gradient), np.where(label == 0, weight, np.nan)]
        assert np.array_equal(grow.Joint(bins, bins.of(x)).count(rows, read, zeros, opposite=True), plain)


@pytest.mark.parametrize("growth", [
    Growth(3, 6, 0.3, l2=1.0, least_hessian=1.0), Growth(3, 6, 0.3, leaves=7, least_rows=20, least_hessian=1e-3), Growth(3, None, tries=2)])
def test_trees_do_not_depend_on_patterns_and_blocks(growth, monkeypatch):
    bins, x, label = exclusive()
    fit, raw, row = Fit(1, "m", growth, growth.tries is not None, -1, (0.9, 1.4)), bins.of(x), np.arange(900) * 7919
    grown = []
    for wide, patterns, block in ((1 << 30, 1 << 30, 1 << 14), (30, 1 << 30, 64), (30, 60, 64), (2, 2, 50)):
        for name, v in (("WIDE_ROWS", wide), ("PATTERN_ROWS", patterns), ("BLOCK", block), ("ROWS", block // 2)):
            monkeypatch.setattr(grow, name, v)
        grown.append(ff._forest(fit, bins, row, label, raw, range(3)) if fit.is_forest else ff._boost(fit, bins, label, raw))
    for other in grown[1:]:
        assert all(np.array_equal(getattr(a, n), getattr(b, n)) for a, b in zip(grown[0], other, strict=True) for n in FLAT)
    assert len(grown[0][0].feature) > 7
