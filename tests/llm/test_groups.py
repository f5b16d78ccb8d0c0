"""Operators that compare documents or vectors."""

from collections import Counter

import numpy as np
import pytest

from churnloom.llm import embedding_dedup as vectors
from churnloom.llm import ngram_jaccard as jaccard
from churnloom.llm.components import components
from churnloom.llm.line_dedup import line_dedup
from oracle import compare
from tests.llm import plain
from tests.llm.conftest import ODD, SMALL


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(400 + i, 401 + i) for i in range(60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = plain.groups({n for link in links for n in link}, links)
    assert found == {n: c for n, c in expected.items() if n in found}
    assert all(expected[n] == n for n in expected if n not in found)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("region", [1024, 3])
def test_jaccard_join(documents, monkeypatch, region):
    monkeypatch.setattr(jaccard, "REGION", region)
    texts = {r.doc_id: r.text for r in documents.collect()}
    sizes, groups = plain.jaccard_components(texts)
    found = jaccard.ngram_jaccard(documents).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted((d, sizes[d], groups[d]) for d in texts)


@pytest.mark.parametrize(("region", "shingles"), [(1024, 1 << 19), (4, 1 << 19), (1024, 150)])
def test_jaccard_join_of_a_family(spark, monkeypatch, region, shingles):
    """Many near copies about the threshold, a passage that unrelated documents share, and pairs of all sizes."""
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", shingles)
    monkeypatch.setattr(jaccard, "FREQUENT_IN_BATCH", 3)
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for d in range(40):
        words = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            words[at] = f"x{d}y{at}"
        texts[d] = " ".join(words[:rng.integers(48, 61)])
    for d in range(40, 60):
        own = [f"o{d}w{i}" for i in range(rng.integers(5, 80))]
        texts[d] = " ".join([*own, *base[:12]])
    texts |= {60: "a b", 61: "A B", 62: "a b c", 63: " ".join(base[:30]), 64: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sizes, groups = plain.jaccard_components(texts)
    found = jaccard.ngram_jaccard(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted((d, sizes[d], groups[d]) for d in texts)
    assert len(set(groups.values())) < 60


def test_jaccard_join_of_odd_rows(odd, nothing):
    found = jaccard.ngram_jaccard(odd).collect()
    assert len(found) == len(ODD)
    got = {r.doc_id: r.component_id for r in found}
    assert [got[d] for d in (1, 2, 6)] == [1, 1, 1] and got[9] == 8 and got[None] is None
    assert [got[d] for d in (3, 4, 5, 7)] == [3, 4, 5, 7]
    assert {r.n_shingles for r in found if r.doc_id in (3, 4, 5)} == {0}
    assert jaccard.ngram_jaccard(nothing).collect() == []


def _vector_groups(rows, threshold=0.98):
    links, counts = [], {r[0]: 0 for r in rows}
    for i, (a, x, k) in enumerate(rows):
        for b, y, m in rows[i + 1:]:
            if k == m and len(x) == len(y):
                cosine = np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
                if cosine >= threshold:
                    links.append((a, b))
                    counts[a] += 1
                    counts[b] += 1
    return counts, plain.groups(counts, links)


@pytest.mark.parametrize(("leaf", "block"), [(2048, 2048), (2048, 4), (4, 2048), (6, 3)])
def test_vectors(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(vectors, "LEAF", leaf)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        if i % 4 == 0:
            centre = rng.standard_normal(8)
        spread = (0, 0.02, 0.06, 0.08)[i % 4]
        rows.append((i, (centre + spread * rng.standard_normal(8)).astype(np.float32).astype(float).tolist(), i // 40))
    rows += [(200 + i, (np.eye(8)[0] + 0.03 * rng.standard_normal(8)).astype(np.float32).astype(float).tolist(), 1) for i in range(40)]
    rows += [(300 + i, [1.0] * 8, 2) for i in range(30)]
    counts, groups = _vector_groups(rows)
    found = vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == sorted(
        (v, counts[v], groups[v], groups[v] == v) for v in counts)


def _tree(spark, rows, limit=0.2):
    table = spark.createDataFrame([("t", i, 1, np.array(x, "<f8").tobytes()) for i, x in enumerate(rows)],
                                  "tree string, rep long, copies long, vector binary").repartition(3)
    leaves, levels = vectors.cover_tree(table, limit, "<f8")
    return leaves, levels, vectors.meeting_leaves(table, levels, limit, "<f8")


def test_the_tree_covers_and_the_traversal_prunes(spark, monkeypatch):
    """Clustered vectors: levels nest, radii cover, and under a tenth of all pairs is compared."""
    monkeypatch.setattr(vectors, "LEAF", 20)
    rng = np.random.default_rng(8)
    coarse = rng.standard_normal((6, 16))
    fine = np.repeat(coarse, 8, 0) + 0.25 * rng.standard_normal((48, 16))
    x = np.repeat(fine, 25, 0) + 0.02 * rng.standard_normal((1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaves, levels, pairs = _tree(spark, x)
    held = {r.rep: r.node for r in leaves.collect()}
    assert len(held) == len(x) and len(levels) > 1
    above = {""}
    for nodes, _ in levels:
        rows = nodes.collect()
        assert {r.parent for r in rows} <= above
        for r in rows:
            centre = np.frombuffer(r.centre, "<f8")
            under = [i for i, n in held.items() if n == r.node or n.startswith(r.node + ".")]
            assert under and max(np.linalg.norm(x[under] - centre, axis=1)) <= r.radius + 1e-7
        above = {r.node for r in rows}
    # A node's centre is a centre below it.
    first, second = ({r.node: r for r in n.collect()} for n, _ in levels[:2])
    for node, r in first.items():
        below = [c for c in second.values() if c.parent == node]
        assert r.centre in {c.centre for c in below}
    sizes, met = Counter(held.values()), [(r.a, r.b) for r in pairs.collect()]
    assert len(set(met)) == len(met)
    assert sum(sizes[a] * sizes[b] for a, b in met) < len(x) ** 2 / 10
    near = np.argwhere(x @ x.T >= 0.98)
    known = set(met) | {(b, a) for a, b in met}
    assert all((held[i], held[j]) in known for i, j in near.tolist())


def test_doubles_are_compared_as_doubles(spark):
    """Two pairs about the threshold that floats cannot tell apart."""
    rows = [(k * 2 + i, [1.0, 0.0] if i == 0 else [c, float(np.sqrt(1 - c * c))], k) for k, c in enumerate((0.98 + 1e-12, 0.98 - 1e-12)) for i in (0, 1)]
    found = vectors.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in found} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "k"), (2, [2.0, 0.0], 1, "k"), (3, [1.0, 0.0], None, "k"), (4, None, 1, "k"), (5, [0.0, 0.0], 1, "k"),
            (6, [nan, 1.0], 1, "k"), (7, [inf, 1.0], 1, "k"), (8, [None, 1.0], 1, "k"), (9, [], 1, "k"), (None, [1.0, 0.0], 1, "k"),
            (10, [1.0, 0.0, 0.0], 1, "k"), (11, [1.0, 0.0], 2, "k"), (2, [2.0, 0.0], 1, "k")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    found = sorted(map(tuple, vectors.embedding_dedup(table).collect()), key=repr)
    expected = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True)]
    expected += [(v, 0, v, True) for v in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert found == sorted(expected, key=repr)
    assert vectors.embedding_dedup(table.limit(0)).collect() == []


def test_lines(spark, documents):
    from churnloom.llm import queries

    assert compare.differences(queries.op4_line_dedup(spark, SMALL), compare.connect(SMALL), queries.oracle_sql()["op4_line_dedup"]) == []
    found = {r.doc_id: (r.clean_text, r.n_lines, r.n_removed) for r in line_dedup(documents).collect()}
    assert found == plain.without_repeated_lines({r.doc_id: r.text for r in documents.collect()})


def test_lines_by_hand(spark, odd, nothing):
    texts = {1: "a\nb\n\nc \nd", 2: "x\n a\nb\nc\ny", 3: "a\nb", 4: "a\nb", 5: "\n", 6: "p\nq\nr\np\nq\nr\np"}
    found = {r.doc_id: r.clean_text for r in line_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {d: t for d, t in found.items() if d != 6} == {1: texts[1], 2: "x\ny", 3: "a\nb", 4: "", 5: "\n"}
    assert found == {d: t for d, (t, _, _) in plain.without_repeated_lines(texts).items()}
    got = line_dedup(odd).collect()
    assert len(got) == len(ODD)
    rows = {(r.doc_id, r.n_lines, r.n_removed) for r in got}
    # Null ids come first, so their row is the first occurrence; equal rows are one.
    assert {(None, 3, 0), (1, 3, 3), (2, 3, 3), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 3, 0)} <= rows
    assert [r.clean_text for r in got if r.doc_id == 3] == [None]
    assert line_dedup(nothing).collect() == []
