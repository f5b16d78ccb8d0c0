import random

import pytest

from churnloom.llm import merkle
from tests.llm.plain import merkle_rows

FIELDS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels", range(1, 8))
def test_addresses_number_every_node_once(levels):
    found = [merkle.address(levels, d, i) for d in range(levels) for i in range(min(8 ** d, 5000))]
    assert len(set(found)) == len(found) and min(found) == 0 and max(found) < merkle.nodes_in(levels)
    if levels <= 5:
        assert sorted(found) == list(range(merkle.nodes_in(levels)))


def test_lower_subtrees_are_contiguous():
    levels, top = 4, 2
    for tree in range(8 ** top):
        mine = [merkle.address(levels, top + d, tree * 8 ** d + i) for d in range(levels - top) for i in range(8 ** d)]
        assert sorted(mine) == list(range(min(mine), min(mine) + merkle.nodes_in(levels - top)))


def test_odd_rows(spark, odd, nothing):
    odd = odd.selectExpr("*", "length(text) AS n_chars")
    held = [tuple(r[f] for f in merkle.FIELDS) for r in odd.collect()]
    assert rows(merkle.verify_documents(odd)) == merkle_rows(held)
    assert merkle.verify_documents(nothing.selectExpr("*", "0L AS n_chars")).collect() == []


def test_documents(spark, documents):
    held = [tuple(r[f] for f in merkle.FIELDS) for r in documents.collect()]
    found = rows(merkle.verify_documents(documents))
    assert found == merkle_rows(held)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("counts", [[1], [8], [9, 1], [512, 513], [1200, 7, 1, 1, 64, 65, 3, 2, 2]])
def test_sizes_about_the_blocks(spark, counts):
    """Trees that end at a block, begin one, hold one leaf; more than eight groups; ids that repeat, rows that do."""
    draw = random.Random(5)
    held = [(draw.randrange(max(2, n // 2)) if n < 100 else i, "s", None if g == 1 else f"l{g}", i % 7, f"Text {i % 5}")
            for g, n in enumerate(counts) for i in range(n)]
    draw.shuffle(held)
    df = spark.createDataFrame(held, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    assert rows(merkle.verify_documents(df)) == merkle_rows(held)


def test_three_rows_of_blocks(spark, monkeypatch):
    for name, value in (("HEIGHT", 1), ("SPAN", 8)):
        monkeypatch.setattr(merkle, name, value)
    held = [(i, None, f"l{i % 2}", None, "x" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(held, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    leaves = merkle.document_leaves(df)
    built = merkle.manifest(leaves, ["doc_id", "digest", "row"])
    assert len(built.groups.rows) == 3
    assert rows(merkle.verify_documents(df)) == merkle_rows(held)
    stored = built.blocks().collect()
    assert all(len(r.nodes) == 32 * merkle.nodes_in(r.levels) for r in stored)
    assert sum(r.n_leaves for r in stored if r.kind == "group" and r.row == 0) == 300


def test_root_of_the_manifest(spark, documents):
    found = merkle.manifest(merkle.document_leaves(documents), ["doc_id", "digest", "row"])
    held = [tuple(r[f] for f in merkle.FIELDS) for r in documents.collect()]
    assert found.root() == merkle_rows(held)[0][3]
