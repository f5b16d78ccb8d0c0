"""Trees of many fits at once, over one table of quantile-binned rows.

All fits (candidates, the full one and the folds of each) read the same rows; a fold is a mask. Two ways lead to the same
trees, since histograms are sums of whole numbers:

* By levels. One aggregate per level sums the histograms of every growing tree of every fit by (tree, node, input,
  bin), first within each task, then by a shuffle; a second step picks the split of every node from its histogram. What comes
  back is one row per node. Margins of boosted fits are written every few rounds; in between they follow from the latest trees.
* In a task. Rows that fit into one task (``IN_TASK_ROWS``) need no shuffle per level: a fit's rows, or the rows of a
  forest's node once it has no more than that, are handed to one task, which grows all that is left.
"""

from __future__ import annotations

import pickle
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom import contract as c
from churnloom.ml import grow, prep
from churnloom.ml.grow import Bins, Growth, Tree
from churnloom.ml.models import IN_DRIVER_NODES, NODE, StoredEnsemble, TreeEnsemble, node_columns
from churnloom.plans.stages import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that one task may hold: some 200 bytes each with all that growing needs.
IN_TASK_ROWS = 1 << 20
MOST_BINS = 255
# Boosting rounds between two writes of the margins.
ROUNDS_KEPT = 10
# Trees of a forest that grow by levels at once, and that one task grows in memory.
TREES_AT_ONCE = 16
TREES_PER_TASK = 38


@dataclass(frozen=True)
class Fit:
    """One model to fit: the rows outside fold ``holdout``, with a weight for each label."""

    number: int
    name: str
    growth: Growth
    is_forest: bool
    holdout: int
    weights: tuple[float, float]

    def mask(self, fold):
        return fold != self.holdout

    def weight(self, label):
        return np.where(label > 0, self.weights[1], self.weights[0])


def fit_bins(training: DataFrame, numeric: int, total: int) -> Bins:
    """Up to 255 edges for each of the first ``numeric`` inputs at equal shares of rows, exact for short tables; 0 for one-hot inputs."""
    shares = F.array(*[F.lit((i + 1) / (MOST_BINS + 1)) for i in range(MOST_BINS)])
    x = vector_to_array(prep.FEATURES)
    found = training.select(*[F.percentile_approx(x[j], shares, F.lit(20_000)).alias(f"e{j}") for j in range(numeric)]).first()
    return Bins([np.unique(np.array(e if e is not None else [0.0], float)) for e in found] + [np.zeros(1)] * (total - numeric))


def binned(encoded: DataFrame, bins: Bins) -> DataFrame:
    """``row, label, fold, bins`` of encoded rows, one byte per input; written, as every pass reads them."""
    sent = encoded.sparkSession.sparkContext.broadcast(cloudpickle.dumps(bins))

    def run(batches):
        bins = pickle.loads(sent.value)
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(bins.edges))
            rows = [r.tobytes() for r in bins.of(x)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], ["row", "label", "fold", "bins"])

    rows = encoded.select(F.xxhash64(c.PRIMARY_KEY).alias("row"), "label", "fold", vector_to_array(prep.FEATURES).alias("x"))
    return cut(rows.mapInArrow(run, "row long, label double, fold int, bins binary"), "binned")


def _arrays(batch, width):
    row, label, fold = (batch.column(i).to_numpy() for i in range(3))
    raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, width)
    return row, label, fold, raw


def _packed(tree: Tree) -> bytes:
    return zlib.compress(cloudpickle.dumps(tree), 1)


def _unpacked(raw: bytes) -> Tree:
    return pickle.loads(zlib.decompress(raw))


# In a task

def _boost(fit: Fit, bins: Bins, label, raw) -> list[Tree]:
    joint, margin, weight, trees = grow.Joint(bins, raw), np.zeros(len(label)), fit.weight(label), []
    leaf = np.zeros(len(label), np.int32)
    for number in range(fit.growth.rounds):
        stats = grow.boosting_stats(margin, label, weight)
        tree = grow.grow(bins, None, raw, stats, fit.growth, grow.tree_key(fit.growth, fit.number, number), joint=joint, leaf=leaf)
        few = tree.best_first(fit.growth.leaves) if fit.growth.leaves else tree
        trees.append(few.sealed())
        margin += grow.leaf_values(tree, few)[leaf]
    return trees


def _forest(fit: Fit, bins: Bins, row, label, raw, numbers) -> list[Tree]:
    joint, weight, trees = grow.Joint(bins, raw), fit.weight(label), []
    for number in numbers:
        key = grow.tree_key(fit.growth, fit.number, number)
        stats = grow.forest_stats(row, label, weight, key)
        drawn = np.flatnonzero(stats[1] > 0)
        trees.append(grow.grow(bins, None, raw, stats, fit.growth, key, joint=joint, rows=drawn).sealed())
    return trees


def _grown_in_tasks(table: DataFrame, bins: Bins, fits: list[Fit]) -> DataFrame:
    """``fit, number, nodes, tree``: all trees of all fits, each fit (or some trees of a forest) in a task that holds its rows."""
    tasks = [(f, range(f.growth.rounds)) for f in fits if not f.is_forest]
    for f in fits:
        if f.is_forest:
            tasks += [(f, range(i, min(i + TREES_PER_TASK, f.growth.rounds))) for i in range(0, f.growth.rounds, TREES_PER_TASK)]
    sent = table.sparkSession.sparkContext.broadcast(cloudpickle.dumps((bins, tasks)))
    masks = F.array(*[F.struct(F.lit(i).alias("task"), F.lit(f.holdout).alias("holdout")) for i, (f, _) in enumerate(tasks)])
    sown = (table.where("fold >= 0").withColumn("t", F.explode(masks)).where("fold <> t.holdout")
            .select("row", "label", "fold", "bins", F.col("t.task").alias("task")).repartitionById(len(tasks), F.col("task")))

    def run(batches):
        bins, tasks = pickle.loads(sent.value)
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        (fit, numbers), width = tasks[held[0].column(4)[0].as_py()], len(bins.edges)
        row, label, _, raw = (np.concatenate(v) for v in zip(*(_arrays(b, width) for b in held), strict=True))
        # Rows arrive in any order; sums do not depend on it.
        trees = _forest(fit, bins, row, label, raw, numbers) if fit.is_forest else _boost(fit, bins, label, raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array([fit.number] * len(trees), pa.int32()), pa.array(list(numbers), pa.int32()),
             pa.array([len(t.feature) for t in trees], pa.int64()), pa.array([_packed(t) for t in trees], pa.binary())],
            ["fit", "number", "nodes", "tree"])

    return sown.mapInArrow(run, "fit int, number int, nodes long, tree binary")


def _trees_of(found: DataFrame) -> list[Tree]:
    rows = sorted(found.select("number", "tree").toArrow().to_pylist(), key=lambda r: r["number"])
    return [_unpacked(r.pop("tree")) for r in rows]


def in_tasks(table: DataFrame, bins: Bins, fits: list[Fit]) -> dict[int, list[Tree]]:
    """All trees of all fits."""
    found = cut(_grown_in_tasks(table, bins, fits), "trees")
    return {f.number: _trees_of(found.where(F.col("fit") == f.number)) for f in fits}


# By levels

@dataclass
class Job:
    """A tree that grows: ``recent`` are the trees since the margins were written."""

    fit: Fit
    key: int
    tree: Tree
    frontier: list[int]
    recent: list[Tree]

    def stats(self, row, label, raw, margins):
        weight = self.fit.weight(label)
        if self.fit.is_forest:
            return grow.forest_stats(row, label, weight, self.key)
        margin = margins[:, self.fit.number].copy()
        for tree in self.recent:
            margin += np.asarray(tree.value)[tree.route(raw)]
        return grow.boosting_stats(margin, label, weight)


def _rows_of(jobs: list[Job], batch, bins: Bins):
    """For each job its rows of a batch: the place of the row's node in the job's frontier, stats, bins."""
    row, label, fold, raw = _arrays(batch, len(bins.edges))
    margins = np.array(batch.column(4).to_pylist(), float) if batch.num_columns > 4 else None
    for number, job in enumerate(jobs):
        place = np.full(len(job.tree.feature), -1)
        place[job.frontier] = np.arange(len(job.frontier))
        node, mask = place[job.tree.route(raw)], job.fit.mask(fold)
        stats = job.stats(row, label, raw, margins)
        rows = np.flatnonzero((node >= 0) & mask & (stats[1] > 0))
        yield number, node[rows], [v[rows] for v in stats], raw[rows]


def _histograms(sent, offsets):
    def run(batches):
        bins, jobs = pickle.loads(sent.value)
        for batch in batches:
            for number, node, stats, raw in _rows_of(jobs, batch, bins):
                if len(node):
                    nodes, feature, at, g, h, n = grow.cells_of(bins, raw + bins.starts, node, len(jobs[number].frontier), stats)
                    cell = (nodes + offsets[number]) * bins.cells + bins.starts[feature] + at
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cell, g, h, n)], ["cell", "g", "h", "n"])

    return run


def _choices(sent, keys, growths, cells):
    """The split of one node from its summed cells."""
    names = ("feature", "at", "gain", "gl", "hl", "cl", "g", "h", "c")

    def run(key, group):
        bins, _ = pickle.loads(sent.value)
        place = key[0].as_py()
        cell, g, h, n = (group.column(i).to_numpy() for i in range(1, 5))
        by = np.argsort(cell)
        code, g, h, n = cell[by] % cells, g[by], h[by], n[by]
        feature = bins.feature_of[code]
        first = feature == feature[0]
        totals = [np.array([v[first].sum()]) for v in (g, h, n)]
        found = grow.candidates(np.zeros(len(code), np.int64), feature, code - bins.starts[feature], g, h, n, totals, growths[place])
        found[:3] = [v.astype(np.int64) for v in found[:3]]
        order, growth = None, growths[place]
        if growth.tries is not None and growth.tries < len(bins.edges):
            order = grow.places(grow.feature_order(np.array([keys[place]], np.uint64), len(bins.edges)))
        split = grow.splits_of(found, grow.pick(found, 1, order, growth), totals)[0]
        values = [[getattr(split, k)] for k in names]
        return pa.table([pa.array([place], pa.int64()), *(pa.array(v, pa.float64() if k == "gain" else pa.int64())
                                                         for k, v in zip(names, values, strict=True))], ["node", *names])

    return run


def _level(table: DataFrame, bins: Bins, jobs: list[Job]) -> list[list[grow.Split | None]]:
    """One aggregate for a level of all jobs; per job the split of each node of its frontier, None for one without rows."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((bins, jobs)))
    offsets = np.concatenate([[0], np.cumsum([len(j.frontier) for j in jobs])]).tolist()
    keys = [j.tree.key[n] for j in jobs for n in j.frontier]
    growths = [j.fit.growth for j in jobs for _ in j.frontier]
    sums = (table.mapInArrow(_histograms(sent, offsets), "cell long, g long, h long, n long").groupBy("cell")
            .agg(*[F.sum(v).alias(v) for v in "ghn"]))
    chosen = (sums.withColumn("node", F.floor(F.col("cell") / bins.cells)).groupBy("node").applyInArrow(
        lambda key, group: _choices(sent, keys, growths, bins.cells)(key, group.select(["node", "cell", "g", "h", "n"])),
        "node long, feature long, at long, gain double, gl long, hl long, cl long, g long, h long, c long"))
    found: list = [None] * offsets[-1]
    for r in chosen.toArrow().to_pylist():
        place = r.pop("node")
        found[place] = grow.Split(**r)
    sent.unpersist()
    return [found[a:b] for a, b in zip(offsets, offsets[1:])]


def _take(job: Job, splits) -> dict[int, int]:
    """Grow a job's tree by a level; rows of the new nodes."""
    following, sizes = [], {}
    for node, split in zip(job.frontier, splits, strict=True):
        if split is not None and node == 0:
            job.tree.value[0], job.tree.cover[0] = grow.leaf_value(split.g, split.h, job.fit.growth), split.h / grow.SCALE
        if split is None or split.feature < 0:
            continue
        left, right = job.tree.split(node, split, job.fit.growth)
        sizes |= {left: split.cl, right: split.c - split.cl}
        following += [left, right]
    job.frontier = following
    return sizes


def boost_by_levels(table: DataFrame, bins: Bins, fits: list[Fit]) -> dict[int, list[Tree]]:
    """All boosted fits round by round; every level of a round is one aggregate for all of them."""
    numbers = max(f.number for f in fits) + 1
    state = table.where("fold >= 0").withColumn("margins", F.array_repeat(F.lit(0.0), numbers))
    trees: dict[int, list[Tree]] = {f.number: [] for f in fits}
    recent: dict[int, list[Tree]] = {f.number: [] for f in fits}
    for number in range(max(f.growth.rounds for f in fits)):
        jobs = [Job(f, k := grow.tree_key(f.growth, f.number, number), Tree(key=[k]), [0], recent[f.number])
                for f in fits if number < f.growth.rounds]
        active, depth = jobs, 0
        while active:
            for job, splits in zip(active, _level(state, bins, active), strict=True):
                _take(job, splits)
            depth += 1
            active = [j for j in active if j.frontier and (j.fit.growth.depth is None or depth < j.fit.growth.depth)]
        for job in jobs:
            tree = (job.tree.best_first(job.fit.growth.leaves) if job.fit.growth.leaves else job.tree).sealed()
            trees[job.fit.number].append(tree)
            recent[job.fit.number].append(tree)
        if (number + 1) % ROUNDS_KEPT == 0:
            state = cut(_with_margins(state, bins, recent), "margins")
            recent = {f: [] for f in recent}
    return trees


def _with_margins(state: DataFrame, bins: Bins, recent: dict[int, list[Tree]]) -> DataFrame:
    sent = state.sparkSession.sparkContext.broadcast(cloudpickle.dumps((bins, recent)))

    def run(batches):
        bins, recent = pickle.loads(sent.value)
        for batch in batches:
            *_, raw = _arrays(batch, len(bins.edges))
            margins = np.array(batch.column(4).to_pylist(), float).reshape(len(raw), -1)
            for number, trees in recent.items():
                for tree in trees:
                    margins[:, number] += np.asarray(tree.value)[tree.route(raw)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(margins), pa.list_(pa.float64()))], batch.schema.names)

    return state.mapInArrow(run, state.schema)


def forest_by_levels(table: DataFrame, bins: Bins, fits: list[Fit]) -> dict[int, list[Tree]]:
    """Forests some trees at a time: by levels down to nodes that fit into a task, which grow on there."""
    rows = table.where("fold >= 0")
    todo = [(f, n) for f in fits for n in range(f.growth.rounds)]
    trees: dict[int, list[Tree]] = {f.number: [] for f in fits}
    for first in range(0, len(todo), TREES_AT_ONCE):
        jobs = [Job(f, k := grow.tree_key(f.growth, f.number, n), Tree(key=[k]), [0], []) for f, n in todo[first:first + TREES_AT_ONCE]]
        active, small = jobs, [{} for _ in jobs]
        depth = 0
        while active:
            for job, splits in zip(active, _level(rows, bins, active), strict=True):
                sizes = _take(job, splits)
                if job.fit.growth.depth is not None and depth + 1 >= job.fit.growth.depth:
                    job.frontier = []
                mine = small[jobs.index(job)]
                mine.update({n: True for n in job.frontier if sizes[n] <= IN_TASK_ROWS})
                job.frontier = [n for n in job.frontier if n not in mine]
            depth += 1
            active = [j for j in active if j.frontier]
        _finish(rows, bins, jobs, small)
        for job in jobs:
            trees[job.fit.number].append(job.tree.sealed())
    return trees


def _finish(rows: DataFrame, bins: Bins, jobs: list[Job], small: list[dict]) -> None:
    """Grow what is below the given nodes, the rows of each in one task."""
    for job, nodes in zip(jobs, small, strict=True):
        job.frontier = sorted(nodes)
    if not any(j.frontier for j in jobs):
        return
    sent = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps((bins, jobs)))

    def sow(batches):
        bins, jobs = pickle.loads(sent.value)
        for batch in batches:
            for number, node, stats, raw in _rows_of(jobs, batch, bins):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), number, np.int32)), pa.array(node.astype(np.int32)),
                     *(pa.array(v.astype(np.int64)) for v in stats), pa.array([r.tobytes() for r in raw], pa.binary())],
                    ["job", "node", "g", "h", "bins"])

    def reap(key, group):
        bins, jobs = pickle.loads(sent.value)
        job, node = jobs[key[0].as_py()], key[1].as_py()
        raw = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint8).reshape(-1, len(bins.edges))
        stats = [group.column(n).to_numpy().astype(float) for n in "gh"]
        at = job.frontier[node]
        tree = grow.grow(bins, None, raw, stats, job.fit.growth, job.tree.key[at], depth=job.tree.depth[at])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([at], pa.int64()), pa.array([_packed(tree)], pa.binary())],
                        ["job", "node", "tree"])

    sown = rows.mapInArrow(sow, "job int, node int, g long, h long, bins binary")
    for r in sown.groupBy("job", "node").applyInArrow(reap, "job int, node long, tree binary").toArrow().to_pylist():
        _graft(jobs[r["job"]].tree, r["node"], _unpacked(r["tree"]))


def _graft(tree: Tree, node: int, branch: Tree) -> None:
    """Put a tree in the place of a leaf."""
    at = {0: node}
    for i in range(1, len(branch.feature)):
        at[i] = tree.child(branch.key[i], branch.depth[i], branch.value[i], branch.cover[i])
    for i, mine in at.items():
        if branch.feature[i] >= 0:
            tree.feature[mine], tree.at[mine], tree.gain[mine] = branch.feature[i], branch.at[i], branch.gain[i]
            tree.left[mine], tree.right[mine] = at[branch.left[i]], at[branch.right[i]]


def fit_trees(table: DataFrame, bins: Bins, fits: list[Fit]) -> dict[int, list[Tree]]:
    """The trees of every fit, by its number. The number of training rows decides the way, not the trees."""
    if table.where("fold >= 0").count() <= IN_TASK_ROWS:
        return in_tasks(table, bins, fits)
    trees = {}
    for is_forest, way in ((False, boost_by_levels), (True, forest_by_levels)):
        if mine := [f for f in fits if f.is_forest == is_forest]:
            trees |= way(table, bins, mine)
    return trees


def fit_models(table: DataFrame, bins: Bins, fits: list[Fit]) -> dict[int, TreeEnsemble]:
    """The model of every fit, by its number. The nodes of a large one stay in a stage."""
    if table.where("fold >= 0").count() > IN_TASK_ROWS:
        trees = fit_trees(table, bins, fits)
        models = {f.number: TreeEnsemble.grown(trees.pop(f.number), bins, f.is_forest) for f in fits}
    else:
        found = cut(_grown_in_tasks(table, bins, fits), "trees")
        sizes: dict[int, list[int]] = {f.number: [] for f in fits}
        for r in found.select("fit", "number", "nodes").orderBy("fit", "number").collect():
            sizes[r["fit"]].append(r["nodes"])
        models, large = {}, [f for f in fits if sum(sizes[f.number]) > IN_DRIVER_NODES]
        nodes = cut(_nodes_of(found, bins, large, sizes), "nodes") if large else None
        for f in fits:
            mine = F.col("fit") == f.number
            models[f.number] = (StoredEnsemble(nodes.where(mine).drop("fit"), sizes[f.number], len(bins.edges), f.is_forest) if f in large
                                else TreeEnsemble.grown(_trees_of(found.where(mine)), bins, f.is_forest))
    return {f.number: models[f.number] if f.holdout < 0 else models[f.number].scorer() for f in fits}


def _nodes_of(found: DataFrame, bins: Bins, fits: list[Fit], sizes: dict[int, list[int]]) -> DataFrame:
    """``fit`` and the columns of ``NODE``: the trees of the given fits, taken apart in tasks."""
    starts = {f.number: (f.is_forest, np.cumsum([0, *sizes[f.number]]).tolist()) for f in fits}
    sent = found.sparkSession.sparkContext.broadcast(cloudpickle.dumps((bins, starts)))
    kinds = {"int": pa.int32(), "double": pa.float64()}
    names = [f.split() for f in NODE.split(", ")]

    def run(batches):
        bins, starts = pickle.loads(sent.value)
        for batch in batches:
            for fit, number, tree in zip(*(batch.column(i) for i in range(3)), strict=True):
                is_forest, at = starts[fit.as_py()]
                nodes = TreeEnsemble.grown([_unpacked(tree.as_py())], bins, is_forest, len(at) - 1).nodes
                columns = node_columns(nodes, number.as_py(), at[number.as_py()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(nodes.feature), fit.as_py()), pa.int32()), *(pa.array(columns[n], kinds[kind]) for n, kind in names)],
                    ["fit", *(n for n, _ in names)])

    rows = found.where(F.col("fit").isin([f.number for f in fits])).select("fit", "number", "tree")
    return rows.mapInArrow(run, f"fit int, {NODE}")
