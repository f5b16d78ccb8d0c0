"""A Merkle manifest of a dataset, its nodes kept in van Emde Boas order.

Rows are leaves, in order, of one tree per group (say, per language); the roots of the groups are the leaves
of a last tree. Every tree is cut into aligned subtrees (blocks) of ``8 ** HEIGHT`` leaves whose roots are the
leaves of the next row of blocks, until one block is left. A block is one row of the manifest: its digests
stand in van Emde Boas order, in which the upper half of the levels comes first and is followed by the lower
subtrees, each laid out alike. Where a node stands follows from its level and number alone (``address``), for
building and for finding siblings, whatever the size of a page or a cache line.

Building a block hashes at most 585 nodes in one task. Proofs go down: the path from a block's root is
joined to the block by its number, and its leaves append what they find inside the block.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from churnloom.llm.common import parts, ship
from churnloom.plans.stages import cut, small

RUN = 8
# Levels of a block below its root: 512 leaves, 585 nodes of 32 bytes.
HEIGHT = 3
SPAN = RUN ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def nodes_in(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (RUN ** levels - 1) // (RUN - 1)


def address(levels: int, depth: int, index):
    """Where node ``index`` (a number or an array) at ``depth`` below the root stands in van Emde Boas order."""
    start = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, levels = depth - top, levels - top
        tree, index = index // RUN ** depth, index % RUN ** depth
        start = start + nodes_in(top) + tree * nodes_in(levels)
    return start + index


def levels_for(leaves: int) -> int:
    """Levels of the smallest tree over so many leaves."""
    levels = 1
    while RUN ** (levels - 1) < leaves:
        levels += 1
    return levels


def laid_out(leaves: list[bytes], levels: int) -> bytes:
    """Digests of the tree over the given digests, in van Emde Boas order; absent nodes are zero."""
    out = np.zeros((nodes_in(levels), 32), np.uint8)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        out[address(levels, depth, np.arange(len(row)))] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, 32)
        texts = [d.hex() for d in row]
        row = [sha256("".join(texts[i:i + RUN]).encode()).digest() for i in range(0, len(row), RUN)]
    return out.tobytes()


def siblings(nodes: bytes, levels: int, leaves: int, slot: int) -> list[dict]:
    """The others of each run on the way from a leaf to the root of a block: those left and right of the way."""
    digests, found, count = np.frombuffer(nodes, np.uint8).reshape(-1, 32), [], leaves
    for depth in range(levels - 1, 0, -1):
        first = slot - slot % RUN
        at = address(levels, depth, np.arange(first, min(first + RUN, count)))
        run, mine = digests[at].tobytes().hex(), 64 * (slot - first)
        found.append({"left": run[:mine], "right": run[mine + 64:]})
        slot, count = slot // RUN, -(-count // RUN)
    return found


def leaf_digest(fields: dict[str, Column]) -> Column:
    """sha256 of the fields, each as byte count, colon and value, or a dash for null."""
    def part(value):
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields.values())).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Append ``position`` in, and ``n`` rows of, each ``tree``; rows of a tree go by ``order``.

    A range sort, written; partitions then need only the number of rows of each tree in those before them.
    """
    rows = cut(rows, "leaves")
    keys = ["tree", *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn("at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    shares = placed.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    earlier = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shares = small(shares.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), "start",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
        F.sum("rows").over(W.partitionBy("tree")).alias("n")), "shares")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part"))
    return (placed.join(shares, same).withColumn("position", F.col("before") + F.col("at") - F.col("start"))
            .drop("_tree", "_part", "start", "before", "part", "at"))


def _build(batches):
    for batch in parts(batches):
        nodes, roots, levels = [], [], []
        for leaves, n in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
            # The only block of a tree ends at the tree's root; others are full subtrees with runs of one at the end.
            levels.append(levels_for(n) if n <= SPAN else HEIGHT + 1)
            nodes.append(laid_out([bytes.fromhex(leaf["digest"]) for leaf in leaves], levels[-1]))
            roots.append(nodes[-1][:32].hex())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(levels, pa.int32()), pa.array(nodes, pa.binary()), pa.array(roots)],
            ["tree", "block", "n", "leaves", "levels", "nodes", "root"])


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks over ``tree, position, n, digest`` and further columns (kept as ``leaf``): one row each, written.

    At most 512 rows meet in a group, whatever the size of a tree.
    """
    rest = [c for c in rows.columns if c not in ("tree", "position", "n", "digest")]
    leaf = F.struct((F.col("position") % SPAN).cast("int").alias("slot"), "digest", F.struct(*rest).alias("leaf"))
    grouped = (rows.withColumn("block", F.floor(F.col("position") / SPAN).cast("long")).groupBy("tree", "block")
               .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(leaf)).alias("leaves")))
    kinds = {f.name: f.dataType.simpleString() for f in grouped.schema}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", levels int, nodes binary, root string"
    return cut(grouped.mapInArrow(_build, schema), "blocks")


def _paths(batches):
    for batch in parts(batches):
        names = batch.schema.names
        columns = {n: batch.column(n).to_pylist() for n in names if n not in ("tree", "leaves")}
        leaves = batch.column("leaves")
        sizes = leaves.value_lengths().to_pylist()
        found = []
        for i, size in enumerate(sizes):
            for slot in range(size):
                inside = siblings(columns["nodes"][i], columns["levels"][i], size, slot)
                found.append(inside + columns["upper"][i])
        flat = leaves.flatten()
        owner = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        step = 512  # rows with paths are some kilobytes each
        for at in range(0, len(found), step):
            mine = owner.slice(at, step)
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree").take(mine), batch.column("block").take(mine), flat.slice(at, step),
                 pa.array(found[at:at + step], _PATH)], ["tree", "block", "leaf", "path"])


def paths(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """Each leaf of ``blocks`` with its path to the root, given the ``path`` of each block in ``upper`` (``tree, block``)."""
    above = upper.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("path").alias("upper"))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
    rows = blocks.select("tree", "block", "leaves", "levels", "nodes").join(above, same).drop("_tree", "_block")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    leaf = kinds["leaves"].removeprefix("array<").removesuffix(">")
    return (rows.mapInArrow(_paths, f"tree {kinds['tree']}, block bigint, leaf {leaf}, path {PATH}")
            .select("tree", (F.col("block") * SPAN + F.col("leaf.slot")).alias("position"),
                    F.col("leaf.digest").alias("digest"), "leaf.leaf.*", "path"))


@dataclass
class Forest:
    """Written blocks, those over the leaves first; the last row of blocks has one block per tree."""

    rows: list[DataFrame]

    @classmethod
    def build(cls, leaves: DataFrame) -> Forest:
        """Over ``tree, position, n, digest`` and what else a leaf carries."""
        largest = leaves.agg(F.max("n")).first()[0] or 0
        rows = [blocks_of(leaves)]
        while largest > SPAN:
            largest = -(-largest // SPAN)
            below = rows[-1].select("tree", F.col("block").alias("position"), F.ceil(F.col("n") / SPAN).cast("long").alias("n"),
                                    F.col("root").alias("digest"), F.lit(True).alias("is_block"))
            rows.append(blocks_of(below))
        return cls(rows)

    def roots(self) -> DataFrame:
        return self.rows[-1].select("tree", "root")

    def leaf_paths(self, above: DataFrame) -> DataFrame:
        """Leaves with their paths, ``above`` holding the path of each tree's root (``tree, path``)."""
        upper = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
        for blocks in reversed(self.rows):
            found = paths(blocks, upper)
            upper = found.select("tree", F.col("position").alias("block"), "path")
        return found


@dataclass
class Manifest:
    """Trees over the groups of a table and the tree over their roots."""

    groups: Forest
    top: Forest

    def root(self) -> str | None:
        """The root of all; null for an empty table."""
        found = self.top.roots().first()
        return found["root"] if found else None

    def blocks(self) -> DataFrame:
        """What a store keeps: ``tree, kind, row, block, levels, n_leaves, nodes``, digests in van Emde Boas order."""
        out = None
        for kind, forest in (("group", self.groups), ("top", self.top)):
            for row, blocks in enumerate(forest.rows):
                part = blocks.select(F.col("tree").cast("string"), F.lit(kind).alias("kind"), F.lit(row).alias("row"), "block",
                                     "levels", F.size("leaves").alias("n_leaves"), "nodes")
                out = part if out is None else out.unionAll(part)
        return out

    def proofs(self) -> DataFrame:
        """Each leaf with ``subroot`` and ``path``: the siblings on its way to the root, level by level."""
        above = self.top.leaf_paths(self.top.roots().select("tree", F.lit([]).cast(PATH).alias("path")))
        subroots = above.select(F.col("group").alias("_group"), F.col("digest").alias("subroot"))
        above = above.select(F.col("group").alias("tree"), "path")
        found = self.groups.leaf_paths(above)
        return found.join(small(subroots, "subroots"), F.col("tree").eqNullSafe(F.col("_group"))).drop("_group")


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """The manifest of ``tree, digest`` and further columns; leaves of a tree go by ``order``, trees by their name, null first."""
    groups = Forest.build(ranked(leaves, order))
    tops = groups.roots().select(F.lit(0).alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    return Manifest(groups, Forest.build(ranked(tops, ["group"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda digest, run: F.sha2(F.concat(run["left"], digest, run["right"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    every = F.transform(path, lambda run: F.concat(run["left"], run["right"]))
    return F.sha2(F.array_join(every, "").cast("binary"), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """``tree`` (lang), ``doc_id``, ``digest`` of each row, and ``seen``: the leaf of the text that a reader finds.

    Where the crc32 of the id is divisible by 3 that text has lost its capitals A-Z.
    """
    fields = {name: F.col(name) for name in FIELDS}
    lowered = fields | {"text": F.translate("text", UPPER, LOWER)}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_digest(fields)
    return docs.select(F.col("lang").alias("tree"), "doc_id", leaf.alias("digest"),
                       F.when(changed, leaf_digest(lowered)).otherwise(leaf).alias("seen"),
                       F.monotonically_increasing_id().alias("row"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its leaf, the roots, the digest of its proof, and whether the text found is the original.

    Columns ``doc_id, source, lang, n_chars, text`` are hashed, others are not read. Rows of a language go by id, null
    first, then by leaf; a row repeated in full is one leaf each time, and which of its copies comes first makes no
    difference to any digest. A null language is a tree of its own, before all others. A null id is not tampered with
    (it has no crc32). A null field is hashed as a dash, an empty text as ``0:``. Texts are hashed whole in the JVM,
    whatever their length. A lone leaf is its own subroot; with one language the subroot is the root. An empty table
    gives an empty one.
    """
    found = manifest(document_leaves(docs), ["doc_id", "digest", "row"])
    root = F.lit(found.root()).cast("string")
    return found.proofs().select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("seen"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same in SQL: trees grow level by level, by concatenating runs."""
    def leaf(text):
        return "sha256(" + " || ".join(
            f"coalesce(octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR, '-')"
            for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name, leaves):
        return f"""
{name}(grp, level, pos, node, n) AS (
  {leaves}
  UNION ALL
  SELECT grp, level + 1, pos // {RUN}, sha256(string_agg(node, '' ORDER BY pos)), (n + {RUN - 1}) // {RUN}
  FROM {name} WHERE n > 1 GROUP BY grp, level, pos // {RUN}, n)"""

    def runs(name):
        left, right = (f"coalesce(string_agg(node, '') OVER (PARTITION BY grp, level, pos // {RUN} ORDER BY pos {frame}), '')"
                       for frame in ("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        return f"{name}_runs AS (SELECT grp, level, pos, {left} AS before, {right} AS after FROM {name} WHERE n > 1)"

    crc = """list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda crc, byte:
    list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), 4294967295)"""
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE hashed AS (
  SELECT lang, doc_id, {leaf('text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS seen FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),{tree('low', 'SELECT lang, 0, pos, leaf, n FROM placed')},
subroots AS (SELECT grp AS lang, node, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, count(*) OVER () AS langs FROM low WHERE n = 1),{
tree('high', 'SELECT 0, 0, place, node, langs FROM subroots')},
{runs('low')},
{runs('high')},
lifted(doc_id, lang, start, level, pos, node, proof) AS (
  SELECT doc_id, lang, pos, 0, pos, seen, '' FROM placed
  UNION ALL
  SELECT doc_id, lang, start, l.level + 1, l.pos // {RUN}, sha256(before || node || after), proof || before || after
  FROM lifted l JOIN low_runs r ON r.grp IS NOT DISTINCT FROM l.lang AND r.level = l.level AND r.pos = l.pos),
at_subroot AS (SELECT *, row_number() OVER (PARTITION BY lang, start ORDER BY level DESC) AS nth FROM lifted),
raised(doc_id, lang, start, level, pos, node, proof) AS (
  SELECT doc_id, a.lang, start, 0, place, a.node, proof FROM at_subroot a JOIN subroots s ON s.lang IS NOT DISTINCT FROM a.lang WHERE nth = 1
  UNION ALL
  SELECT doc_id, lang, start, l.level + 1, l.pos // {RUN}, sha256(before || node || after), proof || before || after
  FROM raised l JOIN high_runs r ON r.level = l.level AND r.pos = l.pos),
at_root AS (SELECT *, row_number() OVER (PARTITION BY lang, start ORDER BY level DESC) AS nth FROM raised),
root AS (SELECT node AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, root, sha256(a.proof) AS proof_sha256, a.node AS folded_root, a.node = root AS verified
FROM placed p JOIN at_root a ON a.nth = 1 AND a.lang IS NOT DISTINCT FROM p.lang AND a.start = p.pos
JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root"""


ORACLE = _sql()

ship(__name__)
