"""Growing one level of trees from histograms of quantile-binned inputs, in numpy.

Inputs are bytes (bins); ``Bins.codes`` numbers every (input, bin). Gradients and hessians are whole numbers of
``1 / SCALE``, so sums do not depend on their order: a tree is the same whether its histograms were added up in one task or
by a shuffle over many. Boosted trees and forests differ only in what they hand in: a forest's gradient
is the negative weighted label, its hessian the weight, and second-order gain without penalty is then the gain in variance,
which for labels 0 and 1 is half that in Gini impurity.
"""

from __future__ import annotations

import heapq
import sys
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1 << 20
# Gain below this share of the parent's score is rounding.
NOISE = 1e-10
# Cells of a dense histogram at once.
DENSE = 1 << 22
# Inputs tried per step for nodes that look at some inputs only.
SLOTS = 12
# Cells of inputs that are counted together (a column of them is 16 bits wide).
JOINT_CELLS = 4096
# Nodes of as many rows are counted by themselves, smaller ones side by side.
WIDE_ROWS = 2048
# Nodes of as many rows are counted in columns of the patterns that occur; a sample shows no more than so many in a column.
PATTERN_ROWS = 1 << 16
PATTERNS = 1 << 14
# Patterns that a column holds at most, as it is 16 bits wide.
MOST_PATTERNS = 1 << 16
# Rows counted at once, few enough for a processor's cache.
BLOCK = 1 << 16
# Rows of nodes side by side, fetched at once.
ROWS = 1 << 14


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` bounds them best first, ``tries`` is the number of usable inputs a node looks at."""

    rounds: int
    depth: int | None
    step: float = 1.0
    l2: float = 0.0
    least_hessian: float = 0.0
    least_rows: int = 1
    leaves: int | None = None
    tries: int | None = None
    seed: int = 42


@dataclass
class Bins:
    """Upper edges of the bins of each input; ``x <= edges[t]`` means bin ``t`` or lower."""

    edges: list[np.ndarray]
    starts: np.ndarray = field(init=False)
    cells: int = field(init=False)

    def __post_init__(self):
        sizes = [len(e) + 1 for e in self.edges]
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.cells = int(sum(sizes))
        self.feature_of = np.repeat(np.arange(len(sizes)), sizes)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of input values, as bytes."""
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1."""

    feature: list = field(default_factory=lambda: [-1])
    at: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    key: list = field(default_factory=lambda: [0])
    depth: list = field(default_factory=lambda: [0])

    def child(self, key: int, depth: int, value: float, cover: float) -> int:
        for name, v in zip(("feature", "at", "left", "right", "value", "cover", "gain", "key", "depth"),
                           (-1, 0, -1, -1, value, cover, 0.0, key, depth), strict=True):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def split(self, node: int, s: Split, growth: Growth) -> tuple[int, int]:
        """Split a node; its two children."""
        rest = (s.g - s.gl, s.h - s.hl)
        self.feature[node], self.at[node], self.gain[node] = s.feature, s.at, s.gain
        depth = self.depth[node] + 1
        self.left[node] = self.child(mixed(2 * self.key[node]), depth, leaf_value(s.gl, s.hl, growth), s.hl / SCALE)
        self.right[node] = self.child(mixed(2 * self.key[node] + 1), depth, leaf_value(*rest, growth), rest[1] / SCALE)
        return self.left[node], self.right[node]

    def split_level(self, nodes: np.ndarray, s: Splits, growth: Growth, depth: int) -> np.ndarray:
        """Split the nodes that have a split, in the order of their numbers; for each node its left child (the right one is the next), else -1."""
        kids, split = np.full(len(nodes), -1), np.flatnonzero(s.feature >= 0)
        split = split[np.argsort(nodes[split], kind="stable")]
        kids[split] = len(self.feature) + 2 * np.arange(len(split))
        feature, at, gain, gl, hl, _, g, h, _ = (v[split] for v in s)
        keys = np.array([self.key[n] for n in nodes[split].tolist()], np.uint64) * np.uint64(2)
        g, h = np.stack([gl, g - gl], 1).ravel(), np.stack([hl, h - hl], 1).ravel()
        for name, column in (("feature", feature), ("at", at), ("gain", gain), ("left", kids[split]), ("right", kids[split] + 1)):
            mine = getattr(self, name)
            for node, v in zip(nodes[split].tolist(), column.tolist(), strict=True):
                mine[node] = v
        for name, v in (("feature", -1), ("at", 0), ("left", -1), ("right", -1), ("gain", 0.0), ("depth", depth)):
            getattr(self, name).extend([v] * len(g))
        self.value.extend(leaf_values_of(g, h, growth).tolist())
        self.cover.extend((h / SCALE).tolist())
        self.key.extend(mixed(np.stack([keys, keys + np.uint64(1)], 1).ravel()).tolist())
        return kids

    def route(self, bins: np.ndarray, start=None) -> np.ndarray:
        """The node every row of bins ends in."""
        feature, at, left, right = map(np.asarray, (self.feature, self.at, self.left, self.right))
        node = np.zeros(len(bins), np.int64) if start is None else start.copy()
        rows = np.flatnonzero(feature[node] >= 0)
        while len(rows):
            n = node[rows]
            node[rows] = np.where(bins[rows, feature[n]] <= at[n], left[n], right[n])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def sealed(self) -> Tree:
        """The finished tree as arrays, without what only growing needs."""
        kinds = {"feature": np.int32, "at": np.int32, "left": np.int32, "right": np.int32, "value": float, "cover": float, "gain": float}
        return Tree(**{n: np.array(getattr(self, n), k) for n, k in kinds.items()}, key=[], depth=[])

    def best_first(self, leaves: int) -> Tree:
        """The same tree grown leaf by leaf, best gain first, up to a number of leaves.

        A node's split depends on its rows alone, so leaf-wise growth picks from the splits that level-wise growth finds.
        """
        open_, chosen = ([(-self.gain[0], 0)] if self.feature[0] >= 0 else []), set()
        while open_ and len(chosen) + 1 < leaves:
            _, node = heapq.heappop(open_)
            chosen.add(node)
            for child in (self.left[node], self.right[node]):
                if self.feature[child] >= 0:
                    heapq.heappush(open_, (-self.gain[child], child))
        new, pending = Tree(), [(0, 0)]
        new.value[0], new.cover[0], new.key[0] = self.value[0], self.cover[0], self.key[0]
        while pending:
            old, mine = pending.pop(0)
            if old in chosen:
                new.feature[mine], new.at[mine], new.gain[mine] = self.feature[old], self.at[old], self.gain[old]
                kids = [new.child(self.key[k], self.depth[k], self.value[k], self.cover[k]) for k in (self.left[old], self.right[old])]
                new.left[mine], new.right[mine] = kids
                pending += [(self.left[old], kids[0]), (self.right[old], kids[1])]
        return new


@dataclass
class Split:
    feature: int
    at: int
    gain: float
    gl: int
    hl: int
    cl: int
    g: int
    h: int
    c: int


class Splits(NamedTuple):
    """The splits of many nodes, as arrays; feature is -1 where a node has none."""

    feature: np.ndarray
    at: np.ndarray
    gain: np.ndarray
    gl: np.ndarray
    hl: np.ndarray
    cl: np.ndarray
    g: np.ndarray
    h: np.ndarray
    c: np.ndarray


def mixed(key: int) -> int:
    """A 64-bit number that looks random, for numbers and (wrapping) arrays alike."""
    if isinstance(key, np.ndarray):
        with np.errstate(over="ignore"):
            z = key.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))
    z = (key + 0x9E3779B97F4A7C15) % (1 << 64)
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return z ^ (z >> 31)


def leaf_value(g: int, h: int, growth: Growth) -> float:
    below = h / SCALE + growth.l2
    return -growth.step * (g / SCALE) / below if below > 0 else 0.0


def leaf_values_of(g: np.ndarray, h: np.ndarray, growth: Growth) -> np.ndarray:
    """As ``leaf_value``, of many nodes."""
    below = h / SCALE + growth.l2
    return np.divide(-growth.step * (g / SCALE), below, out=np.zeros(len(below)), where=below > 0)


def feature_order(keys: np.ndarray, features: int) -> np.ndarray:
    """For each node key all inputs in an order of their own."""
    draws = mixed(mixed(keys)[:, None] + np.arange(features, dtype=np.uint64)[None, :])
    return np.argsort(draws, axis=1, kind="stable")


def candidates(node, feature, at, g, h, c, totals, growth: Growth):
    """The best split of every (node, input): arrays ``node, feature, at, gain, gl, hl, cl`` of those that can be split.

    The cells are sorted by node, input and bin; ``totals`` holds g, h, c of the nodes.
    """
    if not len(node):
        return [np.empty(0)] * 7
    first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])])
    sizes = np.diff(np.r_[first, len(node)])
    before = [np.cumsum(v) - v for v in (g, h, c)]
    gl, hl, cl = (np.cumsum(v) - np.repeat(b[first], sizes) for v, b in zip((g, h, c), before, strict=True))
    gt, ht, ct = (t[node] for t in totals)
    gr, hr, cr = gt - gl, ht - hl, ct - cl
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda a, b: (a / SCALE) ** 2 / (b / SCALE + growth.l2)
        parent = score(gt, ht)
        gain = score(gl, hl) + score(gr, hr) - parent
    least = growth.least_hessian * SCALE
    valid = ((cl >= growth.least_rows) & (cr >= max(1, growth.least_rows)) & (hl >= least) & (hr >= least)
             & (hl > 0) & (hr > 0) & (gain > NOISE * np.maximum(1.0, parent)))
    gain = np.where(valid, gain, -np.inf)
    best = np.maximum.reduceat(gain, first)
    # The lowest of equally good bins.
    where = np.where(gain == np.repeat(best, sizes), np.arange(len(gain)), len(gain))
    where = np.minimum.reduceat(where, first)[best > -np.inf]
    return [v[where] for v in (node, feature, at, gain, gl, hl, cl)]


def pick(found, nodes: int, order, growth: Growth):
    """Per node the place of its best candidate, -1 without one; ties go to the lowest input.

    ``order`` are the places of the inputs in the nodes' own orders, None if nodes look at all.
    """
    node, feature, _, gain, *_ = found
    out = np.full(nodes, -1, np.int64)
    if not len(node):
        return out
    allowed = np.ones(len(node), bool)
    if order is not None:
        place = order[node, feature]
        by = np.lexsort((place, node))
        starts = np.searchsorted(node[by], node[by], "left")
        allowed[by] = np.arange(len(by)) - starts < growth.tries
    use = np.flatnonzero(allowed)
    by = use[np.lexsort((feature[use], -gain[use], node[use]))]
    firsts = np.r_[True, node[by][1:] != node[by][:-1]]
    out[node[by][firsts]] = by[firsts]
    return out


def places(order: np.ndarray) -> np.ndarray:
    """Where each input stands in the orders."""
    return np.argsort(order, axis=1, kind="stable")


def cells_of(bins: Bins, codes: np.ndarray, node: np.ndarray, nodes: int, stats):
    """Sorted non-empty cells ``node, feature, at, g, h, c`` of a level."""
    out, step = [], max(1, DENSE // bins.cells)
    for low in range(0, nodes, step):
        high = min(low + step, nodes)
        rows = slice(None) if low == 0 and high == nodes else np.flatnonzero((node >= low) & (node < high))
        mine = node[rows] - low
        part = codes[rows]
        keys = (mine[:, None] * bins.cells + part).ravel()
        size, width = (high - low) * bins.cells, part.shape[1]
        count = np.bincount(keys, minlength=size)
        at = np.flatnonzero(count)
        # Whole numbers below 2 ** 53: exact as doubles.
        g, h = (np.bincount(keys, np.repeat(v[rows], width), size)[at].astype(np.int64) for v in stats)
        code = at % bins.cells
        feature = bins.feature_of[code]
        out.append((at // bins.cells + low, feature, code - bins.starts[feature], g, h, count[at]))
    return [np.concatenate(v) for v in zip(*out, strict=True)]


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Values at places that are known to exist."""
    return values.take(places, mode="clip")


def _parted(rows: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """The rows that go left and the others."""
    return [rows.compress(left), rows.compress(~left)]


def tried_cells(bins: Bins, raw, rows, node, tried, stats):
    """As ``cells_of`` for nodes that look at the inputs ``tried`` (node, slot), straight from the rows' bytes.

    ``node`` ascends. Statistics are two or, if rows are counted as well, three. Cells without weight are left out; rows without
    gradient, two thirds of a forest's where a third of the labels is 1, add nothing to its sums and are not looked at for them.
    """
    nodes, width = len(tried), raw.shape[1]
    out, step = [], max(1, DENSE // bins.cells)
    for low in range(0, nodes, step):
        high = min(low + step, nodes)
        begin, end = np.searchsorted(node, [low, high])
        inputs = np.ascontiguousarray(tried[low:high].T)
        starts = np.arange(high - low) * bins.cells + bins.starts[inputs]
        sums = np.zeros((len(stats), (high - low) * bins.cells))
        for a in range(begin, end, ROWS):
            part = slice(a, min(a + ROWS, end))
            # Rows lie far apart, so they are fetched whole.
            held, mine = raw.take(rows[part], axis=0, mode="clip").reshape(-1), node[part] - low
            first, weights = np.arange(len(mine)) * width, [_weighing(None if v is None else v[part]) for v in stats]
            for f, start in zip(inputs, starts, strict=True):
                keys = _at(held, first + _at(f, mine)) + _at(start, mine)
                for total, (some, v) in zip(sums, weights, strict=True):
                    # Whole numbers below 2 ** 53: exact as doubles.
                    np.add.at(total, keys if some is None else _at(keys, some), v)
        at = np.flatnonzero(sums[-1])
        code = at % bins.cells
        feature = bins.feature_of[code]
        g, h, c = (sums[i][at].astype(np.int64) for i in (0, 1, -1))
        out.append((at // bins.cells + low, feature, code - bins.starts[feature], g, h, c))
    return [np.concatenate(v) for v in zip(*out, strict=True)]


def _weighing(v):
    """Places of the rows that add to a statistic (None for all of them) and what they add; without statistic each row adds 1."""
    if v is None:
        return None, 1.0
    some = None if v.all() else np.flatnonzero(v)
    return some, v if some is None else _at(v, some)


def level(bins: Bins, raw, rows, node, keys, stats, growth: Growth) -> Splits:
    """The split of every node of a level; ``node`` numbers the nodes of ``rows`` from 0 and ascends, ``keys`` are the nodes' keys.

    ``stats`` are those of the rows, with None at the end if they are counted as well.
    """
    nodes, width = len(keys), raw.shape[1]
    totals = [np.bincount(node, v, nodes).astype(np.int64) for v in stats[:2]]
    if growth.tries is None or growth.tries >= width:
        totals.append(np.bincount(node, minlength=nodes))
        found = candidates(*cells_of(bins, raw[rows] + bins.starts, node, nodes, stats[:2]), totals, growth)
        return chosen_of(found, pick(found, nodes, None, growth), totals)
    totals.append(totals[1] if len(stats) < 3 else np.bincount(node, minlength=nodes))
    order = feature_order(np.asarray(keys, np.uint64), width)
    found, have, pending = [], np.zeros(nodes, np.int64), np.arange(nodes)
    for first in range(0, width, SLOTS):
        of = np.full(nodes, -1)
        of[pending] = np.arange(len(pending))
        left = None if len(pending) == nodes else np.flatnonzero(_at(of, node) >= 0)
        of_left = lambda v: v if v is None or left is None else _at(v, left)
        part = candidates(*tried_cells(bins, raw, of_left(rows), _at(of, of_left(node)), order[pending, first:first + SLOTS],
                                       [of_left(v) for v in stats]), [t[pending] for t in totals], growth)
        part[0] = pending[part[0].astype(np.int64)]
        found.append(part)
        have += np.bincount(part[0], minlength=nodes)
        pending = pending[have[pending] < growth.tries]
        if not len(pending):
            break
    found = [np.concatenate(v) for v in zip(*found, strict=True)]
    found[:3] = [v.astype(np.int64) for v in found[:3]]
    return chosen_of(found, pick(found, nodes, places(order), growth), totals)


def chosen_of(found, chosen, totals) -> Splits:
    """For each node its split, with feature -1 where it has none."""
    has, out = np.flatnonzero(chosen >= 0), []
    for v, none, kind in zip(found[1:], (-1, 0, 0.0, 0, 0, 0), (np.int64, np.int64, float, np.int64, np.int64, np.int64), strict=True):
        column = np.full(len(chosen), none, kind)
        column[has] = v[chosen[has]]
        out.append(column)
    return Splits(*out, *(np.asarray(t, np.int64) for t in totals))


def splits_of(found, chosen, totals) -> list[Split]:
    """As ``chosen_of``, one by one."""
    return [Split(*values) for values in zip(*(v.tolist() for v in chosen_of(found, chosen, totals)), strict=True)]


class Patterns:
    """As the columns of ``Joint``, numbering only the patterns of bins that occur: inputs that exclude each other or go together cost little.

    A sample of the rows decides which inputs share a column; the patterns are those of all rows.
    """

    def __init__(self, sizes: list[int], starts, lines: np.ndarray):
        self.columns, self.sizes, self.spreads, self.starts = [], [], [], starts
        step, groups = max(1, lines.shape[1] // BLOCK), []
        for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
            seen, best = lines[f, ::step].astype(np.intp), None
            for i, (_, code, count) in enumerate(groups):
                joint = code * sizes[f] + seen
                found = _occurring(joint, count * sizes[f])
                if len(found) <= PATTERNS and (best is None or len(found) < best[0] * count):
                    best = len(found) / count, i, joint, found
            if best is None:
                groups.append(([f], seen, sizes[f]))
            else:
                _, i, joint, found = best
                groups[i] = ([*groups[i][0], f], _numbers(found)[joint], len(found))
        for group, *_ in groups:
            self._code(group, sizes, lines)

    def _code(self, group: list[int], sizes: list[int], lines: np.ndarray) -> None:
        first, *rest = group
        code, mine, patterns = lines[first].astype(np.int32), [first], [np.arange(sizes[first])]
        for i, f in enumerate(rest):
            size = len(patterns[0]) * sizes[f]
            joint = code * np.int32(sizes[f]) + lines[f]
            found = _occurring(joint, size)
            if len(found) > MOST_PATTERNS:  # more than the sample showed
                self._code(rest[i:], sizes, lines)
                break
            code, patterns = _numbers(found).astype(np.int32)[joint], [*(p[found // sizes[f]] for p in patterns), found % sizes[f]]
            mine.append(f)
        self.columns.append(code.astype(np.uint16))
        self.sizes.append(len(patterns[0]))
        self.spreads.append(self._halved([(f, sizes[f], p) for f, p in zip(mine, patterns, strict=True)]))

    def _halved(self, inputs: list) -> list:
        """How sums by pattern are summed by the patterns of either half of the inputs, and these on in the same way, down to single inputs."""
        found, half = [], len(inputs) // 2
        for mine in (inputs[:half], inputs[half:]) if half else (inputs,):
            if len(mine) == 1:
                (f, size, bins), rest = mine[0], None
                found.append((bins, size, slice(int(self.starts[f]), int(self.starts[f]) + size), rest))
                continue
            code = mine[0][2]
            for _, size, bins in mine[1:]:
                code = np.unique(code * size + bins, return_inverse=True)[1]
            _, first = np.unique(code, return_index=True)
            found.append((code, len(first), None, self._halved([(f, size, bins[first]) for f, size, bins in mine])))
        return found

    def spread(self, number: int, sums: np.ndarray, out: np.ndarray) -> None:
        """Sums of a column's patterns by the bins of its inputs."""
        pending = [(sums, self.spreads[number])]
        while pending:
            sums, parts = pending.pop()
            for codes, size, where, rest in parts:
                less = np.stack([np.bincount(codes, v, size) for v in sums])
                if rest is None:
                    out[:, where] = less
                else:
                    pending.append((less, rest))


def _occurring(codes: np.ndarray, size: int) -> np.ndarray:
    seen = np.zeros(size, bool)
    seen[codes] = True
    return np.flatnonzero(seen)


def _numbers(found: np.ndarray) -> np.ndarray:
    """Where each code stands among those found."""
    place = np.zeros(found[-1] + 1, np.intp)
    place[found] = np.arange(len(found))
    return place


class Joint:
    """Rows laid out for counting: narrow inputs share a column that numbers their bins together.

    The bins of one input are then sums over those of its column, so a node is counted in a quarter of the passes and without
    mixing nodes. ``bins`` holds the rows input by input, for splitting. Nodes of many rows are counted by ``Patterns``, in fewer still.
    """

    def __init__(self, bins: Bins, raw: np.ndarray):
        sizes, self.cells, self.starts = [len(e) + 1 for e in bins.edges], bins.cells, bins.starts
        self.groups: list[list[int]] = []
        for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
            for group in self.groups:
                if np.prod([sizes[i] for i in group], dtype=float) * sizes[f] <= JOINT_CELLS:
                    group.append(f)
                    break
            else:
                self.groups.append([f])
        shapes = [[sizes[f] for f in group] for group in self.groups]
        self.firsts = [(slice(int(self.starts[group[0]]), int(self.starts[group[0]]) + shape[0]), shape[0])
                       for group, shape in zip(self.groups, shapes, strict=True)]
        self.sizes = [int(np.prod(shape)) for shape in shapes]
        self.rests = [self._rest(group, shape) for group, shape in zip(self.groups, shapes, strict=True)]
        self.raw, self.bins = raw, np.ascontiguousarray(raw.T)
        self.columns = np.zeros((len(self.groups), len(raw)), np.int16)
        for column, group in zip(self.columns, self.groups, strict=True):
            for f in group:
                column *= sizes[f]
                column += self.bins[f]
        # The same row by row, for rows that lie far apart.
        self.lines = np.ascontiguousarray(self.columns.T)
        self.patterns = Patterns(sizes, self.starts, self.bins) if len(raw) >= PATTERN_ROWS else None

    def _rest(self, group: list[int], shape: list[int]):
        """Cells of all inputs of a column but the first, and the 0/1 matrix that sums their shares of what they count together."""
        if len(group) < 2:
            return None
        where = np.concatenate([self.starts[f] + np.arange(size) for f, size in zip(group[1:], shape[1:], strict=True)])
        bins = np.unravel_index(np.arange(int(np.prod(shape[1:]))), shape[1:])
        return where, np.concatenate([b[:, None] == np.arange(size) for b, size in zip(bins, shape[1:], strict=True)], axis=1).astype(float)

    def spread(self, number: int, sums: np.ndarray, out: np.ndarray) -> None:
        """Sums of a column's cells by the bins of its inputs."""
        (where, first), rest = self.firsts[number], self.rests[number]
        table = sums.reshape(len(sums), first, -1)
        out[:, where] = table @ np.ones(table.shape[2])
        if rest is not None:
            out[:, rest[0]] = np.ones(first) @ table @ rest[1]

    def count(self, rows: np.ndarray, stats: list, zeros: int = 0, opposite: bool = False) -> np.ndarray:
        """Sums of every statistic by cell over the given rows, the first ``zeros`` of which have no gradient; None counts the rows.

        ``opposite`` gradients are the negative weight wherever they are not 0, so each row is looked at for one of both.
        """
        laid = self.patterns if self.patterns and len(rows) >= PATTERN_ROWS else self
        held = self.lines.take(rows, axis=0, mode="clip") if laid is self and len(rows) <= ROWS else None
        spans = [(zeros, len(rows)), (0, zeros)] if opposite else [(zeros, len(rows)), *[(0, len(rows))] * (len(stats) - 1)]
        picked = [None if v is None else _at(v, rows[low:high]) for v, (low, high) in zip(stats, spans, strict=True)]
        out = np.empty((len(stats), self.cells))
        for number, (column, size) in enumerate(zip(laid.columns, laid.sizes, strict=True)):
            sums = np.zeros((len(stats), size))
            for start in range(0, len(rows), BLOCK):
                at = (_at(column, rows[start:start + BLOCK]) if held is None else held[start:start + BLOCK, number]).astype(np.intp)
                for mine, v, (low, high) in zip(sums, picked, spans, strict=True):
                    a, b = max(low, start), min(high, start + len(at))
                    if a < b and v is None:
                        mine += np.bincount(at[a - start:b - start], minlength=size)
                    elif a < b:
                        # Whole numbers below 2 ** 53: exact as doubles.
                        np.add.at(mine, at[a - start:b - start], v[a - low:b - low])
            laid.spread(number, sums, out)
        if opposite:
            out[1] -= out[0]
        return out


def _counted(stats, growth: Growth, rows) -> list:
    """What is summed by cell. Where every row weighs something and one row is enough, weights tell what counts would."""
    g, h = stats
    return [g, h] if growth.least_rows <= 1 and len(rows) and h[rows].min() > 0 else [g, h, None]


def _dense_level(bins: Bins, sums: np.ndarray, keys, growth: Growth) -> Splits:
    """The split of every node from its summed cells, (nodes, statistics, cells)."""
    nodes = len(sums)
    first = slice(int(bins.starts[0]), int(bins.starts[0]) + len(bins.edges[0]) + 1)
    totals = [sums[:, i, first].sum(1).astype(np.int64) for i in (0, 1, -1)]
    node, code = np.nonzero(sums[:, -1])
    feature = bins.feature_of[code]
    g, h, n = (sums[node, i, code].astype(np.int64) for i in (0, 1, -1))
    found = candidates(node, feature, code - bins.starts[feature], g, h, n, totals, growth)
    found[:3] = [v.astype(np.int64) for v in found[:3]]
    order = None
    if growth.tries is not None and growth.tries < len(bins.edges):
        order = places(feature_order(np.asarray(keys, np.uint64), len(bins.edges)))
    return chosen_of(found, pick(found, nodes, order, growth), totals)


def _by_node(rows: np.ndarray, node: np.ndarray):
    """Numbers of the nodes that have rows, how many, and the rows node by node."""
    if not len(rows):
        return node, node, rows
    low = node.min()
    place = node - low
    # Short numbers are sorted by their digits.
    by = np.argsort(place.astype(np.uint16) if place.max() < 1 << 16 else place, kind="stable")
    sizes = np.bincount(place)
    some = np.flatnonzero(sizes)
    return some + low, sizes[some], rows[by]


def grow(bins: Bins, codes, raw, stats, growth: Growth, key: int, tree: Tree | None = None, depth: int = 0,
         joint: Joint | None = None, rows: np.ndarray | None = None, leaf: np.ndarray | None = None) -> Tree:
    """A whole tree over the given rows (``raw`` are their bins), level by level.

    ``joint`` is their layout if it was made before, ``rows`` are those the tree sees, ``leaf`` receives the node each of them ends
    in. Of two children only the smaller one is counted; the other is what is left of their parent. Nodes of fewer rows than cells
    are counted and split together.
    """
    joint = Joint(bins, raw) if joint is None else joint
    rows = np.arange(joint.bins.shape[1]) if rows is None else rows
    if tree is None:
        tree, total = Tree(key=[key], depth=[depth]), [int(v[rows].sum()) for v in stats]
        tree.value[0] = leaf_value(*total, growth)
        tree.cover[0] = total[1] / SCALE
    counted = _counted(stats, growth, rows)
    # Rows without gradient come first, in every node.
    none = stats[0][rows] == 0
    zeros = int(np.count_nonzero(none))
    rows = np.concatenate(_parted(rows, none)) if zeros else rows
    opposite = len(counted) == 2 and growth.tries is not None and np.array_equal(stats[0][rows[zeros:]], -stats[1][rows[zeros:]])
    flat, width = joint.raw.reshape(-1), joint.raw.shape[1]
    root = np.zeros(len(rows), np.int64)
    wide = [(0, rows, zeros, joint.count(rows, counted, zeros, opposite))] if len(rows) >= WIDE_ROWS else []
    slim, sizes, theirs = _by_node(rows[:0], root[:0]) if wide else _by_node(rows, root)
    while (wide or len(slim)) and (growth.depth is None or depth < growth.depth):
        depth += 1
        last = growth.depth is not None and depth >= growth.depth
        nodes = np.array([*(node for node, *_ in wide), *slim.tolist()], np.int64)
        keys, parts = np.array([tree.key[n] for n in nodes.tolist()], np.uint64), []
        of = np.repeat(np.arange(len(slim)), sizes)
        if wide:
            parts.append(_dense_level(bins, np.stack([sums for *_, sums in wide]), keys[:len(wide)], growth))
        if len(slim):
            parts.append(level(bins, joint.raw, theirs, of, keys[len(wide):], [v if v is None else _at(v, theirs) for v in counted], growth))
        splits = Splits(*map(np.concatenate, zip(*parts, strict=True)))
        kids = tree.split_level(nodes, splits, growth, depth)
        done = np.full((len(nodes), 2), last)
        if growth.tries is not None and not growth.l2:
            # Without a penalty, rows of one label and weight per label have nothing to gain.
            for side, g, h in ((0, splits.gl, splits.hl), (1, splits.g - splits.gl, splits.h - splits.hl)):
                done[:, side] |= (g == 0) | (g == -h)
        following, small = [], []
        for i, (node, part, zeros, sums) in enumerate(wide):
            kid = int(kids[i])
            if kid < 0:
                if leaf is not None:
                    leaf[part] = node
                continue
            left = _at(joint.bins[splits.feature[i]], part) <= splits.at[i]
            pair, zero = _parted(part, left), int(np.count_nonzero(left[:zeros]))
            zero, counts = [zero, zeros - zero], [None, None]
            less = int(len(pair[1]) < len(pair[0]))
            large = [not done[i, side] and len(pair[side]) >= WIDE_ROWS for side in (0, 1)]
            if any(large):
                counts[less] = joint.count(pair[less], counted, zero[less], opposite)
                counts[1 - less] = sums - counts[less] if large[1 - less] else None
            for side in (0, 1):
                if large[side]:
                    following.append((kid + side, pair[side], zero[side], counts[side]))
                elif not done[i, side]:
                    small.append((pair[side], np.full(len(pair[side]), kid + side)))
                elif leaf is not None:
                    leaf[pair[side]] = kid + side
        if len(slim):
            mine = slice(len(wide), None)
            right = _at(flat, theirs * width + _at(np.maximum(splits.feature[mine], 0), of)) > _at(splits.at[mine], of)
            # Where the rows of each node go to the left and to the right, and whether they go on there.
            side = 2 * of + right
            kid = np.where(kids[mine] < 0, nodes[mine], kids[mine])
            to = _at(np.stack([kid, np.where(kids[mine] < 0, kid, kid + 1)], 1).ravel(), side)
            on = _at(((kids[mine] >= 0)[:, None] & ~done[mine]).ravel(), side)
            if leaf is not None:
                leaf[theirs.compress(~on)] = to.compress(~on)
            small.append((theirs.compress(on), to.compress(on)))
        wide = following
        theirs, of = map(np.concatenate, zip(*small, strict=True)) if small else (rows[:0], root[:0])
        slim, sizes, theirs = _by_node(theirs, of)
    if leaf is not None:
        for node, part, *_ in wide:
            leaf[part] = node
        leaf[theirs] = np.repeat(slim, sizes)
    return tree


def leaf_values(whole: Tree, few: Tree) -> np.ndarray:
    """For each node of a tree the value of the leaf that its rows reach in ``few``, the same tree with fewer splits."""
    out, pending = np.zeros(len(whole.feature)), [(0, 0)]
    while pending:
        old, new = pending.pop()
        out[old] = few.value[new]
        if whole.feature[old] >= 0:
            kids = (few.left[new], few.right[new]) if few.feature[new] >= 0 else (new, new)
            pending += [(whole.left[old], kids[0]), (whole.right[old], kids[1])]
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def boosting_stats(margin, label, weight):
    """Whole gradients and hessians of the log loss; weights are at most a few units."""
    p = sigmoid(margin)
    return np.rint((p - label) * weight * SCALE), np.rint(np.maximum(p * (1 - p), 1e-6) * weight * SCALE)


# Cumulative Poisson probabilities: how often a row is drawn into a tree's sample.
_DRAWN = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def forest_stats(row, label, weight, tree_key: int):
    """Rows drawn with replacement by their number and the tree; a row drawn nowhere weighs 0."""
    share = (mixed(row.astype(np.uint64) ^ np.uint64(tree_key)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    times = sum((share >= least).astype(np.int8) for least in _DRAWN)
    w = np.rint(times * weight * SCALE)
    return -w * label, w


def tree_key(growth: Growth, fit: int, number: int) -> int:
    return mixed(mixed(growth.seed * 1009 + fit) + number)
