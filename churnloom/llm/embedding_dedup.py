"""Near-duplicate vectors by a cover tree and its dual traversal.

For unit vectors a cosine of at least c is a distance of at most sqrt(2 - 2c). The vectors of a label form a tree: below a
node lie centres, picked from its vectors further apart than a radius that halves from level to level, the node's own
centre first among them, and every vector belongs to the nearest. A node is bounded by the exact largest distance of
its vectors to its centre (the covering radius), so that vectors which no centre within the radius covers are
bounded as well. Nodes of few vectors are leaves, as are all nodes below the last radius. The traversal
goes down with pairs of nodes, first a root with itself: the children of a pair meet, and a pair stays if centres and
covering radii do not keep it apart. Pairs of leaves are compared exactly, in blocks of bounded size.

Levels, nodes and pairs are tables, and a step is a join: none of them passes through the driver. Centres decide speed only.
Equal vectors are one vector with a number of copies. A block pair reports link counts, and its links
as stars, never as pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from churnloom.llm.common import parts, ship
from churnloom.llm.components import components, stars
from churnloom.plans.stages import cut

COSINE = 0.98
LEAF = 2048  # most vectors of a leaf above the last level
BLOCK = 2048  # vectors compared at once, and dealt to centres at once
SAMPLE = 512  # vectors that the centres below a node are picked from
FAN = 48  # most centres below a node
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-7  # of the bounds, for rounding


def unit(packed: list[bytes], kind: str) -> np.ndarray:
    found = np.stack([np.frombuffer(x, kind) for x in packed]).astype(np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors; the square root loses digits near 0, which the slack allows for."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _net(radius: float, kind: str):
    """Centres below one node, from a sample of its vectors; two for each leaf that they will fill, at most ``FAN``."""
    def run(key, group):
        fan = max(2, min(FAN, 2 * group.column("n")[0].as_py() // LEAF))
        order = np.lexsort((group.column("rep").to_numpy(), group.column("draw").to_numpy()))
        packed = group.column("vector").take(pa.array(order)).to_pylist()
        own = group.column("centre")[0].as_py()
        packed = ([own] if own is not None else []) + packed
        x = unit(packed, kind)
        picked, free = [], np.ones(len(x), bool)
        while free.any() and len(picked) < fan:
            picked.append(int(free.argmax()))
            free &= distances(x, x[picked[-1:]])[:, 0] > radius
        n = len(picked)
        return pa.table({"tree": pa.array([key[0].as_py()] * n), "node": pa.array([key[1].as_py()] * n),
                         "child": pa.array([f"{key[1].as_py()}.{i}" for i in range(n)]), "centre": pa.array([packed[i] for i in picked], pa.binary())})

    return run


def _nearest(kind: str):
    """The nearest centre of each vector of a part of a node."""
    def run(points, centres):
        if not points.num_rows:
            return pa.table({"tree": pa.array([], pa.string()), "node": pa.array([], pa.string()), "rep": pa.array([], pa.int64()),
                             "copies": pa.array([], pa.int64()), "vector": pa.array([], pa.binary()), "far": pa.array([], pa.float64())})
        away = distances(unit(points.column("vector").to_pylist(), kind), unit(centres.column("centre").to_pylist(), kind))
        nearest = away.argmin(1)
        return pa.table({"tree": points.column("tree"), "node": centres.column("child").take(pa.array(nearest)), "rep": points.column("rep"),
                         "copies": points.column("copies"), "vector": points.column("vector"), "far": pa.array(away[np.arange(len(away)), nearest])})

    return run


def _apart(limit: float, kind: str):
    """Drops pairs of nodes that their centres and covering radii keep apart."""
    def run(batches):
        for batch in parts(batches):
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sides = [at[c].to_pylist() for c in ("centre_a", "centre_b")]
            between = np.zeros(batch.num_rows)
            for length in set(map(len, sides[0])):  # trees differ in length
                rows = [i for i, x in enumerate(sides[0]) if len(x) == length]
                a, b = (unit([side[i] for i in rows], kind) for side in sides)
                between[rows] = np.sqrt(np.maximum(2 - 2 * (a * b).sum(1), 0))
            keep = between - at["radius_a"].to_numpy() - at["radius_b"].to_numpy() <= limit + SLACK
            yield pa.RecordBatch.from_arrays([at[c].filter(pa.array(keep)) for c in ("tree", "a", "b")], ["tree", "a", "b"])

    return run


def cover_tree(points: DataFrame, limit: float, kind: str) -> tuple[DataFrame, list[DataFrame]]:
    """Points with the leaf (``node``) they are in, and a table of nodes for each level: ``tree, parent, node, centre, radius``.

    A leaf stays in the tables of the levels below it, as its own only child.
    """
    active = points.withColumn("node", F.lit("")).withColumn("far", F.lit(2.0))
    centre_of = points.select("tree").distinct().select("tree", F.lit("").alias("node"), F.lit(None).cast("binary").alias("centre"))
    done, levels, kept = [], [], None
    for radius in RADII:
        sizes = cut(active.groupBy("tree", "node").agg(F.count("*").alias("n"), F.max("far").alias("radius")), "node-sizes")
        # Vectors of a node this narrow are all linked; splitting it would keep nothing apart.
        is_big = (F.col("n") > LEAF) & (2 * F.col("radius") > limit)
        big = sizes.where(is_big)
        done.append(active.join(sizes.where(~is_big).select("tree", "node"), ["tree", "node"]).select("tree", "node", "rep", "copies", "vector"))
        if big.isEmpty():
            break
        active = active.join(big.select("tree", "node", "n"), ["tree", "node"])
        order = W.partitionBy("tree", "node").orderBy("draw", "rep")
        sample = (active.withColumn("draw", F.xxhash64("rep")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)
                  .select("tree", "node", "n", "rep", "draw", "vector").join(centre_of, ["tree", "node"]))
        centres = cut(sample.groupBy("tree", "node").applyInArrow(_net(radius, kind), "tree string, node string, child string, centre binary"),
                      "centres")
        # The vectors of a node are dealt to its centres in parts of bounded size.
        share = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = active.withColumn("part", F.pmod(F.xxhash64("rep"), share).cast("int"))
        copies = centres.join(big.select("tree", "node", F.explode(F.sequence(F.lit(0), share - 1)).alias("part")), ["tree", "node"])
        active = cut(dealt.groupBy("tree", "node", "part").cogroup(copies.groupBy("tree", "node", "part")).applyInArrow(
            _nearest(kind), "tree string, node string, rep long, copies long, vector binary, far double"), "assigned")
        covered = active.groupBy("tree", "node").agg(F.max("far").alias("radius"))
        found = centres.select("tree", F.col("node").alias("parent"), F.col("child").alias("node"), "centre").join(covered, ["tree", "node"])
        found = found.select("tree", "parent", "node", "centre", "radius")
        if kept is not None:
            leaves = kept.join(big.select("tree", "node"), ["tree", "node"], "left_anti").select(
                "tree", F.col("node").alias("parent"), "node", "centre", "radius")
            found = found.unionAll(leaves)
        roots = points.select("tree").distinct().join(big.select("tree").distinct(), "tree", "left_anti") if kept is None else None
        kept = cut(found, "nodes")
        levels.append((kept, roots))
        centre_of = kept.select("tree", "node", "centre")
    else:
        done.append(active.select("tree", "node", "rep", "copies", "vector"))
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionAll(part)
    return cut(leaves, "leaves"), levels


def meeting_leaves(points: DataFrame, levels: list, limit: float, kind: str) -> DataFrame:
    """``tree, a, b``: pairs of leaves that nothing keeps apart, a leaf with itself among them; found level by level."""
    pairs = points.select("tree").distinct().select("tree", F.lit("").alias("a"), F.lit("").alias("b"))
    lone = None
    for nodes, roots in levels:
        if roots is not None:  # trees that are one leaf
            lone = roots.select("tree", F.lit("").alias("a"), F.lit("").alias("b"))
        side = lambda k: nodes.select("tree", F.col("parent").alias(k), F.col("node").alias(f"{k}_child"),
                                      F.col("centre").alias(f"centre_{k}"), F.col("radius").alias(f"radius_{k}"))
        met = pairs.join(side("a"), ["tree", "a"]).join(side("b"), ["tree", "b"])
        # The children of a node meet each other once.
        met = met.where((F.col("a") != F.col("b")) | (F.col("a_child") <= F.col("b_child")))
        met = met.select("tree", F.col("a_child").alias("a"), F.col("b_child").alias("b"), "centre_a", "centre_b", "radius_a", "radius_b")
        pairs = cut(met.mapInArrow(_apart(limit, kind), "tree string, a string, b string"), "node-pairs")
    return pairs if lone is None else pairs.unionAll(lone)


def block_pairs(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every vector once for each pair of blocks that its block is in: ``name`` of the pair, ``side`` and the vector."""
    sizes = cut(leaves.groupBy("tree", "node").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "leaf-sizes")
    of = lambda k: sizes.select("tree", F.col("node").alias(k), F.col("blocks").alias(f"{k}_blocks"))
    met = pairs.join(of("a"), ["tree", "a"]).join(of("b"), ["tree", "b"])
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1))).where("a <> b OR i <= j")
    met = met.withColumn("name", F.struct("tree", "a", "i", "b", "j"))
    place = lambda k, i, side: met.select("tree", F.col(k).alias("node"), F.col(i).alias("block"), "name", F.lit(side).alias("side"))
    sides = place("a", "i", 0).unionAll(place("b", "j", 1).where("name.a <> name.b OR name.i <> name.j"))
    placed = leaves.join(sizes, ["tree", "node"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return placed.join(sides, ["tree", "node", "block"]).select("name", "side", "rep", "copies", "vector")


def _compare(threshold: float, kind: str):
    def run(key, group):
        side = group.column("side").to_numpy()
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        name = key[0].as_py()
        same = (name["a"], name["i"]) == (name["b"], name["j"])
        if same:
            rows[1] = rows[0]
        if not len(rows[0]) or not len(rows[1]):  # a block that no vector fell into
            return pa.table({n: pa.array([], pa.int64()) for n in ("rep", "links", "middle")})
        vector = group.column("vector")
        a = unit(vector.take(pa.array(rows[0])).to_pylist(), kind)
        b = a if same else unit(vector.take(pa.array(rows[1])).to_pylist(), kind)
        linked = a @ b.T >= threshold
        if same:
            np.fill_diagonal(linked, False)
        reps, copies = (group.column(c).to_numpy() for c in ("rep", "copies"))
        counts = [linked @ copies[rows[1]], linked.T @ copies[rows[0]]]
        used = [np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))]
        if same:  # a row is its own column
            np.fill_diagonal(linked, True)
        middles = stars(linked[np.ix_(*used)])
        out = [[], [], []]
        for k in range(1 if same else 2):
            out[0].append(reps[rows[k][used[k]]])
            out[1].append(counts[k][used[k]])
            # The star's middle: the component is numbered by one of its rows.
            out[2].append(reps[rows[0][used[0]]][middles[k]] if len(used[0]) else np.empty(0, np.int64))
        return pa.table({n: pa.array(np.concatenate(v), pa.int64()) for n, v in zip(("rep", "links", "middle"), out, strict=True)})

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Only vectors with equal labels and dimensions are compared. A vector that is null, empty, zero, or holds null or
    non-finite numbers, a null label or a null id link with nothing: such a row has 0 links and is its own component; it
    is kept. Repeated rows are copies of each other and link. Ties at the threshold link. Other columns
    are not read. An empty table gives an empty one.
    """
    # Doubles stay doubles; anything else is read as float.
    number = "double" if vectors.schema[embedding].dataType.simpleString() == "array<double>" else "float"
    kind = "<f8" if number == "double" else "<f4"
    limit = float(np.sqrt(2 - 2 * threshold))
    numbers = F.col("embedding")
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & numbers.isNotNull()
            & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(numbers, lambda x: x != 0))
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{number}>").alias("embedding"),
                           F.col(label).cast("string").alias("label"))
    keyed = given.select("*", F.coalesce(good, F.lit(False)).alias("good")).select(
        "*", *(F.when(F.col("good"), F.xxhash64("label", "embedding", F.lit(i))).alias(f"k{i}") for i in (0, 1)))
    classes = (keyed.where("good").groupBy("k0", "k1")
               .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"),
                    F.any_value("embedding").alias("embedding")))

    def packed(batches):
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            column = pa.array([np.array(x, kind).tobytes() for x in batch.column(at).to_pylist()], pa.binary())
            yield batch.set_column(at, "vector", column)

    classes = cut(classes.mapInArrow(packed, "k0 long, k1 long, rep long, copies long, label string, vector binary"), "classes")
    # Vectors of a label and of one length make a tree.
    points = classes.select(F.concat_ws("/", F.length("vector").cast("string"), "label").alias("tree"), "rep", "copies", "vector")
    leaves, levels = cover_tree(points, limit, kind)
    pairs = meeting_leaves(points, levels, limit, kind)
    found = cut(block_pairs(leaves, pairs).groupBy("name").applyInArrow(
        _compare(threshold, kind), "rep long, links long, middle long"), "embedding-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = cut(components(found.select(F.col("rep").alias("a"), F.col("middle").alias("b"))), "embedding-components")
    judged = (classes.select("k0", "k1", "rep", "copies").join(counts, "rep", "left")
              .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
              .select("k0", "k1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    judged = cut(judged, "embedding-judged")
    return (keyed.select("vec_id", "k0", "k1").join(judged, ["k0", "k1"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.equal_null("vec_id", "component_id")))


ship(__name__)
