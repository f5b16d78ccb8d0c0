"""Path-dependent Shapley values of tree ensembles (Lundberg et al., 2018) in NumPy.

Every path to a leaf is one small record. What a leaf adds to an input depends only on which of its tests a row
passes, so all patterns of tests of a short path are worked out once, and rows look theirs up by its bits.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Paths with more inputs have too many patterns to list; for these only the patterns that occur are worked out.
LISTED = 7
# Leaves of a shard, with their patterns, take no more bytes than this, however large the model.
SHARD_BYTES = 64 << 20
# (row, leaf) pairs looked at together, few enough for a processor's cache.
CELLS = 1 << 18


@dataclass
class Leaf:
    """The path to one leaf, reduced to one test per input."""

    value: float
    features: np.ndarray   # inputs on the path
    shares: np.ndarray     # share of the training weight that goes the leaf's way
    low: np.ndarray        # the leaf's way is low < x <= high
    high: np.ndarray

    @property
    def bytes(self) -> int:
        m = len(self.features)
        return 200 + 32 * m + (8 * m << m if m <= LISTED else 0)


def leaves(nodes) -> Iterator[Leaf]:
    """All leaves that lie below at least one test, tree by tree."""
    feature, threshold, left, right, value, cover = (
        getattr(nodes, n).tolist() for n in ("feature", "threshold", "left", "right", "value", "cover"))
    for root in nodes.roots.tolist():
        pending = [(root, {})]
        while pending:
            node, tests = pending.pop()
            f = feature[node]
            if f < 0:
                if tests:
                    share, low, high = zip(*tests.values())
                    yield Leaf(value[node], np.array(list(tests)), np.array(share), np.array(low), np.array(high))
                continue
            for child, is_left in ((left[node], True), (right[node], False)):
                share, low, high = tests.get(f, (1.0, -np.inf, np.inf))
                share *= cover[child] / cover[node]
                low, high = (low, min(high, threshold[node])) if is_left else (max(low, threshold[node]), high)
                pending.append((child, {**tests, f: (share, low, high)}))


def expected(pieces: Iterable) -> float:
    """What the ensemble gives on average: every leaf by its share of the training weight. Given are its nodes, in one or more pieces of whole trees."""
    total = 0.0
    for nodes in pieces:
        for start, end in zip(nodes.roots, [*nodes.roots[1:], len(nodes.feature)], strict=True):
            leaf = np.flatnonzero(nodes.feature[start:end] < 0) + start
            cover = nodes.cover[start]
            total += float(nodes.value[leaf] @ (nodes.cover[leaf] / cover if cover else np.ones(len(leaf))))
    return total


def shards(found: Iterable[Leaf], size: int = SHARD_BYTES) -> Iterator[list[Leaf]]:
    """Leaves in runs of bounded size; one empty run if there are none."""
    run, used, first = [], 0, True
    for leaf in found:
        if run and used + leaf.bytes > size:
            yield run
            run, used, first = [], 0, False
        run.append(leaf)
        used += leaf.bytes
    if run or first:
        yield run


def _gains(passes: np.ndarray, shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Contributions by (leaf, pattern, input) for the given patterns (pattern, input) of leaves with equally long paths."""
    m = passes.shape[1]
    weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
    passed, shares = passes[None].astype(float), shares[:, None, :]
    # Coefficients of the product of (share + passed * t) over all inputs.
    product = np.zeros((len(shares), len(passes), m + 1))
    product[..., 0] = 1.0
    for j in range(m):
        shifted = product[..., :-1] * passed[..., [j]]
        product *= shares[..., [j]]
        product[..., 1:] += shifted
    # Each input's own factor is divided out again, from the highest power down. Without share and pass there is no gain.
    others, total = np.zeros(product.shape[:2] + (m,)), np.zeros(product.shape[:2] + (m,))
    inverse = np.divide(1.0, shares, out=np.zeros_like(shares), where=shares > 0)
    for k in reversed(range(m)):
        others = np.where(passes[None], product[..., [k + 1]] - shares * others, product[..., [k]] * inverse)
        total += others * weights[k]
    return values[:, None, None] * (passed - shares) * total


class Paths:
    """Leaves of one shard whose paths test the same number of inputs, stacked."""

    def __init__(self, found: list[Leaf]):
        self.features, self.low, self.high, shares = (
            np.stack([getattr(leaf, n) for leaf in found]) for n in ("features", "low", "high", "shares"))
        values = np.array([leaf.value for leaf in found])
        count, m = self.features.shape
        patterns = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(bool)
        step = max(1, CELLS // (len(patterns) * (m + 1)))
        tables = [_gains(patterns, shares[i:i + step], values[i:i + step]) for i in range(0, count, step)]
        self.tables = np.ascontiguousarray(np.concatenate(tables).reshape(-1, m).T)
        self.start = (np.arange(count, dtype=np.int32) << m)[:, None]
        # Per position on the path: leaves in order of the input tested there, where each input begins, and which it is.
        self.orders = []
        for f in self.features.T:
            order = np.argsort(f, kind="stable")
            which, begins = np.unique(f[order], return_index=True)
            self.orders.append((order, begins, which))

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add the contributions to ``out``; both hold one line per input, as lines are copied faster than columns."""
        step = max(1, CELLS // len(self.features))
        for i in range(0, x.shape[1], step):
            rows = x[:, i:i + step]
            place = np.tile(self.start, (1, rows.shape[1]))
            for j, f in enumerate(self.features.T):
                seen = rows[f]
                place += ((seen > self.low[:, [j]]) & (seen <= self.high[:, [j]])).astype(np.int32) << j
            for table, (order, begins, which) in zip(self.tables, self.orders, strict=True):
                out[which, i:i + step] += np.add.reduceat(np.take(table, place[order]), begins, axis=0)


def _add_long(leaf: Leaf, x: np.ndarray, out: np.ndarray) -> None:
    """One leaf behind many inputs. Rows that pass the same tests share the result."""
    seen, m = x[:, leaf.features], len(leaf.features)
    passed = (seen > leaf.low) & (seen <= leaf.high)
    bits = passed @ (1 << np.arange(m, dtype=object if m > 62 else np.int64))
    _, first, which = np.unique(bits, return_index=True, return_inverse=True)
    out[:, leaf.features] += _gains(passed[first], leaf.shares[None], np.array([leaf.value]))[0][which.reshape(-1)]


class Shard:
    """Leaves ready to be applied to rows."""

    def __init__(self, found: list[Leaf], inputs: int):
        by_length = defaultdict(list)
        for leaf in found:
            by_length[len(leaf.features)].append(leaf)
        self.inputs = inputs
        self.listed = [Paths(same) for m, same in sorted(by_length.items()) if m <= LISTED]
        self.long = [leaf for m, same in sorted(by_length.items()) if m > LISTED for leaf in same]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.inputs))
        if self.listed and len(x):
            lines = np.ascontiguousarray(x.T)
            sums = np.zeros(lines.shape)
            for paths in self.listed:
                paths.add(lines, sums)
            out += sums.T
        for leaf in self.long if len(x) else ():
            _add_long(leaf, x, out)
        return out
