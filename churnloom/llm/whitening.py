"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed: it is applied to a block of directions by passes over the centred
vectors, ``Xᵀ(XQ) / n``, each a sum of one small matrix per task. A pass over a block of more directions than are
wanted, QR and Rayleigh-Ritz give estimates; between two of them a Chebyshev polynomial of the covariance,
applied by its three-term recurrence with one pass per degree, damps the spectrum below the block and
lets what is above grow. A few Lanczos passes bound the spectrum from below. It ends when the
residual of every wanted pair certifies it. Directions and Ritz values live on the driver: as many numbers as a
vector has entries, times the block; nothing there grows with the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnloom.llm.common import received, send, ship
from churnloom.plans.stages import cut

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Directions beyond those wanted: the more, the wider the gap that the filter works on.
GUARD = 16
DEGREE = 10
LANCZOS = 12
# Residual, in parts of the largest eigenvalue, that certifies a pair; iteration goes on while it still falls.
CERTIFIED = 1e-11
MOST_ROUNDS = 200
# Numbers of vectors packed into one row of the working table: 1 MB.
BLOCK_NUMBERS = 1 << 17


@dataclass
class Centre:
    """Per-dimension sums, split so that centring subtracts whole numbers first and loses no digit."""

    n: int
    sums: list[int]
    whole: np.ndarray
    part: np.ndarray
    trace: Fraction

    @classmethod
    def of(cls, n: int, sums: list[int], squares: list[int]) -> Centre:
        whole = [s // n for s in sums]
        part = [float(Fraction(s - n * w, n)) for s, w in zip(sums, whole, strict=True)]
        trace = sum((Fraction(n * q - s * s, n * n) for s, q in zip(sums, squares, strict=True)), Fraction(0))
        return cls(n, sums, np.array(whole, np.int64), np.array(part), trace)

    def centred(self, block: np.ndarray) -> np.ndarray:
        return (block - self.whole).astype(np.float64) - self.part


def usable(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, x`` of the vectors without null or non-finite entries that have the most frequent length (ties: the longest)."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.forall("v", entry))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.where(F.size("v") == (lengths["length"] if lengths else 0))
    return rows.where(F.size("v") > 0).select("vec_id", F.transform("v", whole).alias("x"))


def packed(rows: DataFrame) -> DataFrame:
    """The vectors in blocks of bounded size, one row each, with their sums; written, as every pass reads them."""
    ids = rows.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            width = len(batch.column(1)[0]) if batch.num_rows else 1
            step = max(1, BLOCK_NUMBERS // width)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, width)
                big = x.astype(object) if len(x) and int(np.abs(x).max()) ** 2 * len(x) >= 2 ** 62 else x
                sums = [str(v) for v in big.sum(0)]
                squares = [str(v) for v in (big * big).sum(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), pa.array([part.num_rows], pa.int64()),
                     pa.array([x.tobytes()], pa.binary()), pa.array([sums]), pa.array([squares])],
                    ["vec_ids", "rows", "x", "sums", "squares"])

    return cut(rows.mapInArrow(run, f"vec_ids array<{ids}>, rows long, x binary, sums array<string>, squares array<string>"), "vectors")


def centre_of(blocks: DataFrame) -> Centre | None:
    """Exact sums over all blocks; None without a vector."""
    cells = blocks.select("rows", F.posexplode(F.arrays_zip("sums", "squares")).alias("i", "cell"))
    number = lambda name: F.sum(F.col(f"cell.{name}").cast("decimal(38,0)")).cast("string").alias(name)
    found = cells.groupBy("i").agg(F.sum("rows").alias("n"), number("sums"), number("squares")).orderBy("i").collect()
    if not found:
        return None
    return Centre.of(found[0]["n"], [int(r["sums"]) for r in found], [int(r["squares"]) for r in found])


class Passes:
    """Sums over all centred vectors, each by one job that sends one small matrix per task to a sum per cell."""

    def __init__(self, blocks: DataFrame, centre: Centre):
        self.blocks, self.centre, self.spark, self.done = blocks.select("x"), centre, blocks.sparkSession, 0

    def summed(self, shape: tuple[int, int], work) -> np.ndarray:
        """The sum of ``work(centred vectors)``, a matrix of the given shape."""
        sent, size = send(self.spark, self.centre), shape[0] * shape[1]

        def run(batches):
            centre, total = received(sent), np.zeros(shape)
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    total += work(centre.centred(np.frombuffer(block, np.int64).reshape(-1, len(centre.whole))))
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["cells"])

        cells = self.blocks.mapInArrow(run, "cells array<double>").select(F.posexplode("cells").alias("i", "value"))
        found = cells.groupBy("i").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[found.column(0).to_numpy()] = found.column(1).to_numpy()
        sent.unpersist()
        self.done += 1
        return out.reshape(shape)

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        """The covariance matrix times ``q``: one pass, the matrix itself is not formed."""
        return self.summed(q.shape, lambda z: z.T @ (z @ q)) / self.centre.n


def lower_bound(passes: Passes, steps: int, rng: np.random.Generator) -> float:
    """Below the spectrum, or near its lower end: the smallest Ritz value of a few Lanczos steps less the last residual."""
    d = len(passes.centre.whole)
    basis, diagonal, beside = [rng.standard_normal((d, 1))], [], []
    basis[0] /= np.linalg.norm(basis[0])
    for _ in range(min(steps, d)):
        w = passes.covariance_times(basis[-1])
        diagonal.append(float((basis[-1].T @ w)[0, 0]))
        for _ in range(2):
            for v in basis:
                w = w - v * float((v.T @ w)[0, 0])
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        basis.append(w / beside[-1])
    inner = np.array(beside[:len(diagonal) - 1])
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(inner, 1) + np.diag(inner, -1))
    return max(0.0, float(ritz[0]) - beside[-1])


def filtered(passes: Passes, q: np.ndarray, low: float, high: float, largest: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, small on ``low..high`` and 1 at ``largest``, times ``q``."""
    middle, half = (high + low) / 2, max((high - low) / 2, 1e-9 * largest)
    sigma = first = half / (largest - middle)
    before, now = q, (passes.covariance_times(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (passes.covariance_times(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


@dataclass
class Spectrum:
    """Certified leading pairs: eigenvalues falling, unit vectors in columns."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    rounds: int
    passes: int


def spectrum(passes: Passes, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 7) -> Spectrum:
    """The ``components`` largest eigenpairs of the covariance; fewer if the vectors have fewer dimensions or less rank."""
    d, rng = len(passes.centre.whole), np.random.default_rng(seed)
    wanted, block = min(components, d), min(components + guard, d)
    q, low = rng.standard_normal((d, block)), None
    best, worst = None, np.inf
    for rounds in range(1, MOST_ROUNDS + 1):
        q = np.linalg.qr(q)[0]
        vq = passes.covariance_times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        largest = float(values[0])
        if largest <= 0:
            return Spectrum(np.empty(0), np.empty((d, 0)), 0.0, rounds, passes.done)
        off = np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / largest
        if best is None or off < worst:
            best = Spectrum(values[:wanted], q[:, :wanted], float(off), rounds, passes.done)
        # Certified, and no better for another round: what is left is rounding.
        if best.residual <= CERTIFIED and off > worst / 2 or off <= 1e-15:
            break
        worst = min(worst, off)
        if low is None:
            low = lower_bound(passes, LANCZOS, rng)
        # What lies below the block is damped; a block of all dimensions has nothing below.
        high = float(values[-1])
        q = filtered(passes, q, min(low, high), high, largest, degree) if block < d and high < largest else vq
    if best.residual > CERTIFIED:
        raise ArithmeticError(f"residual {best.residual} after {rounds} rounds")
    kept = best.values > 1e-12 * best.values[0]
    return Spectrum(best.values[kept], best.vectors[:, kept], best.residual, best.rounds, passes.done)


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become whole numbers ``floor(64 c) + 1000000``. Null vectors, those with null or non-finite entries and those of
    another length than most have no rows. Repeated vectors and ids, also null ids, each have theirs. Components beyond the
    vectors' length or rank are left out: along a direction without variance nothing can be whitened, so a single vector, or
    vectors all equal, give no rows, as does an empty table. Where eigenvalues are equal any orthonormal vectors of their
    space may come out. A ``deviation`` that a long cannot hold is null. Other columns are not read. Entries whose scaled
    value exceeds a long are held at its limits.
    """
    ids = vectors.schema[vec_id].dataType.simpleString()
    blocks = packed(usable(vectors, vector, vec_id))
    centre = centre_of(blocks)
    schema = f"vec_id {ids}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = spectrum(passes := Passes(blocks, centre), components) if centre else None
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(found.values)
    turned = found.vectors / np.sqrt(found.values)
    explained = [float(Fraction(float(v)) / centre.trace) for v in found.values]
    # Covariance of what comes out, by one more pass: sums of products, and sums in the last row.
    def moments(z):
        w = z @ turned
        return np.vstack([w.T @ w, w.sum(0)])

    sums = passes.summed((k + 1, k), moments) / centre.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    sent = send(vectors.sparkSession, (centre, turned, explained, error))

    def run(batches):
        centre, turned, explained, error = received(sent)
        sums = np.array(centre.sums, object)
        fits = max(map(abs, centre.sums)) < 2 ** 62
        for batch in batches:
            for block, held in zip(batch.column(1).to_pylist(), batch.column(0), strict=True):
                x = np.frombuffer(block, np.int64).reshape(-1, len(centre.whole))
                whitened = centre.centred(x) @ turned
                # Away from the mean by so much at most; object numbers have no limit.
                far = centre.n * (int(np.abs(x - centre.whole).max()) + 1)
                if fits and far * far * x.shape[1] < 2 ** 62 and int(np.abs(x).max()) * centre.n < 2 ** 62:
                    deviation = ((centre.n * x - np.array(centre.sums, np.int64)) ** 2).sum(1).tolist()
                else:
                    deviation = [v if v < 2 ** 63 else None for v in ((centre.n * x.astype(object) - sums) ** 2).sum(1)]
                names = held.values
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(np.arange(len(names)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names))),
                     pa.array(np.full(len(names) * k, centre.n)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(names)), k))),
                     pa.array(whitened.ravel()), pa.array(np.tile(explained, len(names))), pa.array(np.full(len(names) * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.select("vec_ids", "x").mapInArrow(run, schema)


ship(__name__)
