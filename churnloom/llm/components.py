"""Connected components of links that may form very large groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.common import ship
from churnloom.plans.stages import cut

MOST_ROUNDS = 60


def stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a link matrix the number of the component they are in; big where they have no link."""
    none = np.iinfo(np.int64).max
    rows = np.where(linked.any(1), np.arange(linked.shape[0]), none)
    columns = np.full(linked.shape[1], none)
    while True:
        columns_now = np.minimum(columns, np.where(linked, rows[:, None], none).min(0, initial=none))
        rows_now = np.minimum(rows, np.where(linked, columns_now, none).min(1, initial=none))
        if (rows_now == rows).all() and (columns_now == columns).all():
            return rows, columns
        rows, columns = rows_now, columns_now


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each first node the smallest node among it and its second ones."""
    return cut(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``, integers); the component is its smallest node.

    Alternates two steps until nothing changes: each node hands its larger neighbours, then its smaller ones,
    to the smallest node it knows. Groups turn into stars about their smallest node in few rounds, whatever
    their size. Every step is a sum per node and a join that adaptive execution can split; each round is
    written, so that a lost executor costs one round at most.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours b of a go to the smallest that a knows.
        large = both.join(_nearest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct(), "links")
        # All smaller neighbours of a, and a itself, go to the smallest of them.
        small = large.join(_nearest(large), "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


ship(__name__)
