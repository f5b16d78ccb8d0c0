import numpy as np
import pytest

from churnloom.llm import whitening as wh
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, vectors, extra=()):
    held = [(i, None if v is None else [None if c is None else float(c) for c in v], i % 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame([*held, *extra], SCHEMA).selectExpr("*", "'x' AS n", "1 AS component", "2 AS x").repartition(4)


def check(found, vectors: dict, components=32):
    """Against the eigenvectors of the exact covariance matrix."""
    ids = sorted(vectors)
    x = np.array([np.floor(64 * np.asarray(vectors[i], float)) + 1_000_000 for i in ids]).astype(np.int64)
    n, sums = len(ids), x.sum(0)
    z = (x - sums // n) - (sums % n) / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    rows = {(r.vec_id, r.component): r for r in found}
    assert set(rows) == {(i, c) for i in ids for c in range(1, k + 1)}
    whitened = np.array([[rows[i, c].whitened for c in range(1, k + 1)] for i in ids])
    want = z @ turn[:, :k] / np.sqrt(values[:k])
    signs = np.sign((whitened * want).sum(0))
    assert np.abs(whitened - want * signs).max() < 1e-7
    assert np.abs(whitened.T @ whitened / n - np.eye(k)).max() < 1e-9
    for at, i in enumerate(ids):
        assert rows[i, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums, strict=True))
    for c in range(1, k + 1):
        assert rows[ids[0], c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error < 1e-9


def test_table(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    check(wh.whiten(df).collect(), {r.vec_id: r.embedding for r in df.collect()})


def test_more_dimensions_than_directions(spark, monkeypatch):
    """The filter has a spectrum to damp, with a flat part and a steep one; packed in many blocks."""
    monkeypatch.setattr(wh, "BLOCK_NUMBERS", 3000)
    rng = np.random.default_rng(1)
    spread = np.concatenate([np.linspace(9, 6, 10), np.linspace(3, 2.6, 30), np.full(60, 0.5)])
    vectors = rng.standard_normal((900, 100)) * spread
    df = frame(spark, vectors)
    check(wh.whiten(df, 8).collect(), dict(enumerate(vectors)), 8)
    blocks = wh.packed(wh.usable(df))
    found = wh.spectrum(wh.Passes(blocks, wh.centre_of(blocks)), 8)
    assert found.residual < wh.CERTIFIED and found.rounds > 1 and found.passes > found.rounds * wh.DEGREE


def test_lower_bound_and_filter(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 40)) * np.linspace(4, 1, 40)
    blocks = wh.packed(wh.usable(frame(spark, vectors)))
    passes = wh.Passes(blocks, wh.centre_of(blocks))
    whole = passes.covariance_times(np.eye(40))
    values, turn = np.linalg.eigh((whole + whole.T) / 2)
    low = wh.lower_bound(passes, 40, rng)
    assert 0 <= low <= values[0] * 1.000001
    high, largest = values[20], values[-1]
    damped = np.abs((turn.T @ wh.filtered(passes, turn, low, high, largest, 6)).diagonal())
    assert damped[-1] == pytest.approx(1) and damped[:21].max() < damped[30] < 1


def test_odd_rows(spark):
    good = {0: [1, 2.5, -3], 1: [0.01, 9, 1], 2: [4, 4, 4], 3: [1e3, -1e3, 0], 4: [1, 2.5, -3]}
    bad = [None, [1, None, 2], [float("nan"), 1, 2], [float("inf"), 1, 2], [1, 2], [], [1, 2, 3, 4]]
    df = frame(spark, [*good.values(), *bad])
    check(wh.whiten(df).collect(), good)
    null_id = wh.whiten(frame(spark, good.values(), [(None, [1.0, 2.0, 3.0], 0), (2, [7.0, 7.0, 1.0], 0)])).collect()
    assert len(null_id) == 7 * 3 and sum(r.vec_id is None for r in null_id) == 3


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1, 2]], [[1, 2], [1, 2]], [[]]):
        df = frame(spark, vectors)
        assert wh.whiten(df).collect() == []
        assert wh.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_directions_than_entries(spark):
    rng = np.random.default_rng(3)
    flat = np.floor(rng.standard_normal((50, 4)) * 640) / 64
    vectors = np.hstack([flat, flat[:, :1] * 0 + 5])
    check(wh.whiten(frame(spark, vectors)).collect(), dict(enumerate(vectors)))


def test_deviations_beyond_a_long_are_null(spark):
    vectors = [[1e13, 1.0], [3e13, 2.0], [2e13, 7.0]]
    found = {r.vec_id: r.deviation for r in wh.whiten(frame(spark, vectors)).collect()}
    x = [[int(64 * c) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert found == {0: None, 1: None, 2: sum((3 * a - s) ** 2 for a, s in zip(x[2], sums, strict=True))}
