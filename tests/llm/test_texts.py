"""Operators that look at each text on its own."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
import pytest

from churnloom.llm import language_id as lang_module
from churnloom.llm import quality_classifier as quality_module
from churnloom.llm import quality_rules as rules
from churnloom.llm import token_counts as counts
from churnloom.llm.bpe import PreTokenizer
from churnloom.llm.language_id import language_id
from churnloom.llm.packing import curve_keys, ends_of, pack
from churnloom.llm.quality_classifier import quality_classifier
from tests.llm import plain
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as file:
    SPEC = file.read()
TOKENS = PreTokenizer(SPEC)
PARTS = st.lists(st.one_of(st.text(max_size=6), st.sampled_from(
    ["'s", "I'll", " ", "\n", "<|endoftext|>", "<|startoftext|>", "..", "don't", "É", "ǅ", "½", "á", "\x1c", "\xa0"])))


@settings(max_examples=300, deadline=None)
@given(PARTS.map("".join))
def test_ids_are_those_of_the_library(text):
    expected = TOKENS.tokenizer.encode(text, add_special_tokens=False).ids
    assert [i for t in TOKENS.pre_tokens(text) for i in TOKENS.ids(t)] == expected
    packed = TOKENS.packed_ids(text)
    assert [packed[i] + 256 * packed[i + 1] for i in range(0, len(packed), 2)] == expected
    found, others = TOKENS.words(text)
    assert sum(n * len(TOKENS.ids(t)) for w, n in found.items() for t in TOKENS.cut(w)) + sum(
        len(TOKENS.ids(t)) for t in others) == len(expected)


def test_words_of_letters_go_straight_to_the_model(monkeypatch):
    tokens, asked = PreTokenizer(SPEC), []
    monkeypatch.setattr(tokens, "tokenise", lambda written, real=tokens.tokenise: asked.append(written) or real(written))
    words = ["grenzwert", "grenzwert,", "überfluß.", "don't", "...,."]
    expected = [TOKENS.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert [list(memoryview(tokens._packed_word(w)).cast("H")) for w in words] == expected
    assert asked[:3] == ["grenzwert", "grenzwert", ","]
    # No longer by way of ``ids``: its checks are for pre-tokens of any kind.
    monkeypatch.setattr(tokens, "ids", None)
    assert list(memoryview(tokens._packed_word("grenzwert,")).cast("H")) == expected[1]


def _expected_counts(rows):
    tokenizer = plain.tokenizer()
    return sorted(((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for d, t in rows), key=repr)


def test_token_counts(documents, monkeypatch):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, counts.token_counts(documents, PATH).collect()), key=repr) == _expected_counts(rows)
    # Nearly all pieces by the join instead of the lookup.
    monkeypatch.setattr(counts, "COMMON_ROWS", 5)
    assert sorted(map(tuple, counts.token_counts(documents, PATH).collect()), key=repr) == _expected_counts(rows)


def test_token_counts_of_odd_rows(odd, nothing):
    found = counts.token_counts(odd, PATH).collect()
    assert sorted(map(tuple, found), key=repr) == _expected_counts([r[:2] for r in ODD])
    assert counts.token_counts(nothing, PATH).collect() == []


def _ids(rows):
    tokenizer = plain.tokenizer()
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows]


def test_packing(documents, odd, nothing):
    rows = documents.select("doc_id", "text").collect()
    plain.check_packing(pack(documents, PATH).collect(), _ids(rows), 4096)
    plain.check_packing(pack(documents, PATH, length=64).collect(), _ids(rows), 64)
    plain.check_packing(pack(odd, PATH).collect(), _ids(r[:2] for r in ODD), 4096)
    assert pack(nothing, PATH).collect() == []
    assert sorted(pack(documents, PATH).collect()) == sorted(pack(documents.repartition(7), PATH).collect())


def test_hilbert_curve_moves_one_step_at_a_time():
    import numpy as np

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curve_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()
    assert ends_of(4096 * 2 + 5, 4096) == (2, [8192, 8196])


def test_quality_counts(documents, odd, nothing):
    found = rules.quality_rules(documents)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    expected = sorted((d, *plain.rule_counts(t)) for d, t in documents.select("doc_id", "text").collect())
    assert sorted(map(tuple, found.select(names).collect())) == expected
    assert found.where("base_failed and kept").count() == 0
    got = rules.quality_rules(odd)
    assert sorted((tuple(r) for r in got.select(names).collect()), key=repr) == sorted(
        ((r[0], *plain.rule_counts(r[1])) for r in ODD), key=repr)
    assert rules.quality_rules(nothing).collect() == []


def test_quality_rules_keep_good_and_reject_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0
    assert judged.where("quality = 0 and kept").count() == 0


def test_line_faults():
    parts = list(rules.BOILERPLATE)
    assert rules.line_fault("Home | About | Contact | Help", parts) == "navigation"
    assert rules.line_fault("this### is*** all$$$ noise", parts) == "punctuation"
    assert rules.line_fault("BUY NOW!! CHEAP!! GOODS!!", parts) == "punctuation"
    assert rules.line_fault("eight words in a row without any stop", parts) == "punctuation"
    assert rules.line_fault("Copyright 2020 by someone. All rights reserved.", parts) == "boilerplate"
    assert rules.line_fault("A plain sentence ends here.", parts) is None
    assert rules.line_fault("A heading", parts) is None


def test_language(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id(docs).join(docs, "doc_id").where("held_out")
    assert found.where("lang_pred = lang").count() >= 0.97 * found.count() > 0
    assert docs.join(language_id(docs), "doc_id").where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0
    got = language_id(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (3, 4, 5, 10))
    assert language_id(nothing).collect() == []
    unlabelled = language_id(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("size", [1 << 19, 16])
def test_language_is_that_of_plain_naive_bayes(documents, odd, monkeypatch, size):
    """Also where slices are short, so that n-grams cross their seams."""
    monkeypatch.setattr(lang_module, "SLICE", size)
    for df in (documents, odd):
        rows = [(r.doc_id, r.text if r.text is None else r.text[:3000], r.lang) for r in df.select("doc_id", "text", "lang").collect()]
        df = df.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        key = lambda r: (repr(r[0]), r[2], r[3])
        found = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id(df).collect()), key=key)
        expected = sorted(plain.naive_bayes(rows), key=key)
        assert [r[:3] for r in found] == [r[:3] for r in expected]
        assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(found, expected, strict=True))


def test_quality_classifier(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_classifier(docs, labels)
    assert found.count() == docs.count()
    held_out = found.join(labels, "doc_id").where("held_out")
    assert held_out.where("predicted = quality").count() >= 0.95 * held_out.count() > 0
    few = spark.createDataFrame([(1, 1), (2, 0), (8, 1), (7, 0), (None, 1), (9, 7)], "doc_id long, quality int")
    got = quality_classifier(odd, few).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality_classifier(odd, few.limit(0)).collect()} == {0.5}
    assert quality_classifier(nothing, few).collect() == []


@pytest.mark.parametrize("size", [1 << 20, 16])
def test_quality_is_that_of_plain_votes(documents, odd, monkeypatch, size):
    """Also where slices are short, so that trigrams cross their seams, and where copies tie for the last vote."""
    monkeypatch.setattr(quality_module, "SLICE", size)
    texts = sorted({(r.doc_id, (r.text or "")[:2000]) for r in documents.select("doc_id", "text").collect()})
    labels = {d: i % 2 for i, (d, _) in enumerate(texts[:60])}
    rows = texts + [(100_000 + i, t) for i, (_, t) in enumerate(texts[:10])] + [(None, texts[0][1]), (-1, None), (-2, "ab")]
    labels |= {100_000 + i: 1 for i in range(10)}
    spark = odd.sparkSession
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = quality_classifier(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    key = lambda r: repr(r[0])
    got, expected = sorted(((r.doc_id, r.held_out, r.score) for r in found), key=key), sorted(plain.neighbour_votes(rows, labels), key=key)
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, expected, strict=True))
    assert len({round(r[2], 3) for r in got}) > 20
