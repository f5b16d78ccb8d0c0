"""Packing along a space-filling curve.

Every document is a vector of hashed token weights, projected to few dimensions and placed on a
Hilbert curve. Their ids are written once. Places and lengths are range-sorted, each sorted part with the
running number of its tokens, and the parts' totals (one number per partition) turn these into
positions in one long row of tokens, which are joined to the ids. Sequences are cut from that row, so only its
end can need padding; the end is cut at powers of two, which need none.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.bpe import PreTokenizer
from churnloom.llm.common import dropped, kept, per_batch, ship
from churnloom.plans.stages import cut

LENGTH = 4096
END = 2
DIMENSIONS = 4
BITS = 8  # per dimension


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: neighbouring numbers become unrelated ones."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def projection(n_ids: int) -> np.ndarray:
    """For each id a fixed vector of numbers evenly spread from -1 to 1."""
    with np.errstate(over="ignore"):
        hashed = mixed(np.arange(1, n_ids * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (hashed / 2.0**63 - 1).reshape(n_ids, DIMENSIONS).astype(np.float32)


def curve_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of whole coordinates (rows x dimensions, each below ``2**bits``).

    From the highest bit down, the cell that a point lies in says how the finer part of its
    coordinates is mirrored or swapped; the Gray code of the result is the place on the curve.
    """
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        bit, lower = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            there = (axis & bit) != 0
            swap = np.where(there, 0, (axes[0] ^ axis) & lower)
            axes[0] = np.where(there, axes[0] ^ lower, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros(len(points), np.int64)
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros(len(points), np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turned) >> level) & 1)
    return key


def _tokenise(spec, end):
    def work():
        tokens = kept("pre-tokenizer", spec.value, PreTokenizer)
        # One array per dimension: numbers of an id lie apart, but are gathered and summed in under half the time.
        vectors = np.ascontiguousarray(projection(1 << 16).T, dtype=np.float64)
        last = np.array([end], "<u2").tobytes()

        def each(batch):
            ids = [tokens.packed_ids(text) for text in batch.column(1).to_pylist()]
            points = np.zeros((len(ids), DIMENSIONS))
            for i, packed in enumerate(ids):
                if packed:
                    at = np.frombuffer(packed, "<u2").astype(np.intp)
                    points[i] = np.array([numbers.take(at).sum() for numbers in vectors]) / np.sqrt(len(at))
            # The sums of few or many random numbers spread alike; tanh keeps the far ones in.
            cells = np.clip((np.tanh(points / 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            ids = [x + last for x in ids]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(curve_keys(cells), pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                 pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["row", "curve", "tie", "doc_tokens", "ids"])

        return each

    return work


def _running(batches):
    """Adds the tokens before each row of a sorted partition."""
    dropped("pre-tokenizer")
    total = 0
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("doc_tokens")).to_numpy()
        ends = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], [*batch.schema.names, "before"])
        total = int(ends[-1]) if len(ends) else total


def ends_of(total: int, length: int) -> tuple[int, list[int]]:
    """How many full sequences there are, and the starts of the shorter ones after them."""
    full, rest = divmod(total, length)
    starts, at = [], full * length
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest & (1 << bit):
            starts.append(at)
            at += 1 << bit
    return full, starts


def _cut(starts, total, length):
    full, tail = ends_of(total, length)
    tail = np.array(tail, np.int64)

    def work():
        # The join beside it needs the memory of the tokenizer and its words.
        dropped("pre-tokenizer")

        def each(batch):
            docs, parts, before, ids = (batch.column(i).to_pylist() for i in range(4))
            out = [[] for _ in range(8)]
            for doc, part, local, packed in zip(docs, parts, before, ids, strict=True):
                n, begin = len(packed) // 2, starts[part] + local
                bounds = np.concatenate([
                    np.arange(begin // length + 1, min((begin + n - 1) // length, full) + 1) * length,
                    tail[(tail > begin) & (tail < begin + n)], [begin + n]])
                numbers = np.frombuffer(packed, "<u2").astype("<u4")
                at = begin
                for bound in np.unique(bounds).tolist():
                    if bound <= at:
                        continue
                    if at < full * length:
                        sequence, offset = divmod(at, length)
                    else:
                        which = int(np.searchsorted(tail, at, "right")) - 1
                        sequence, offset = full + which, at - int(tail[which])
                    crc = zlib.crc32(numbers[at - begin:bound - begin].tobytes())
                    for column, value in zip(out, (doc, at - begin, bound - at, crc, n, sequence, offset), strict=False):
                        column.append(value)
                    at = bound
            types = [batch.schema.field(0).type, *[pa.int64()] * 6]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=False)], names)

        return each

    return work


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document ends with the token ``end``; a null text is an empty one, of that token alone.
    ``length`` is a power of two. Sequences are full, but for at most log2(length) ones at the
    end, whose lengths are powers of two. Repeated rows are packed each; equal rows lie next to
    each other. Ids may be null. Other columns are not read. An empty table has no pieces.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    numbered = given.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("row"), "text")
    tokens = per_batch(numbered, _tokenise(spec, end),
                       f"row struct<row: long, doc_id: {kind}>, curve long, tie long, doc_tokens long, ids binary")
    tokens = cut(tokens.select("row.*", "curve", "tie", "doc_tokens", "ids"), "tokens")
    # Equal documents share a place on the curve; the number of the row parts them among partitions.
    order = ["curve", "tie", F.xxhash64("doc_id"), "row"]
    ordered = (tokens.select("row", "doc_id", "curve", "tie", "doc_tokens")
               .repartitionByRange(*order).sortWithinPartitions(*order)
               .select("row", F.spark_partition_id().alias("part"), "doc_tokens"))
    ordered = cut(ordered.mapInArrow(_running, "row long, part int, doc_tokens long, before long"), "packed")
    # One total per partition of the sort.
    totals = sorted(ordered.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    starts, total = {}, 0
    for part, n in totals:
        starts[part] = total
        total += n
    placed = tokens.select("row", "doc_id", "ids").join(ordered.select("row", "part", "before"), "row")
    return per_batch(placed.select("doc_id", "part", "before", "ids"), _cut(starts, total, length),
                     f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                     "sequence_id long, offset long")


ship(__name__)
