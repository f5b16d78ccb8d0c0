import random

import pytest

from churnloom.llm import license_scan as ls
from tests.llm.conftest import LONG
from tests.llm.plain import license_marks

FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
MIT = ls.TEMPLATES[0][0]


def rows(df):
    return sorted(((r.doc_id, *(r[f] for f in FIELDS)) for r in df.collect()), key=repr)


def expected(pairs):
    return sorted(((d, *license_marks(t, ls.PHRASES, ls.TEMPLATES, ls.THRESHOLD)) for d, t in pairs), key=repr)


def test_odd_rows(spark, odd, nothing):
    held = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(ls.license_scan(odd)) == expected(held)
    assert ls.license_scan(nothing).collect() == []


def test_documents(documents):
    assert rows(ls.license_scan(documents)) == expected([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_damaged_templates_are_found_as_by_counting(spark, threshold):
    draw, filler, texts = random.Random(3), LONG.split()[:400], []
    for text, _ in ls.TEMPLATES:
        for lost in (0, 1, 3, 6, 12):
            words = text.split()
            for _ in range(lost):
                words[draw.randrange(len(words))] = draw.choice(filler)
            before = draw.randrange(90)
            texts.append("\n".join([" ".join(filler[:before]), " ".join(words).upper(), *filler[before:before + 30]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = rows(ls.license_scan(df, threshold=threshold))
    assert found == sorted(((i, *license_marks(t, ls.PHRASES, ls.TEMPLATES, threshold)) for i, t in enumerate(texts)), key=repr)
    assert sum(r[-1] > 0 for r in found) >= len(ls.TEMPLATES)


def test_slices_do_not_cut_words(monkeypatch):
    numbers = {w: i for i, w in enumerate(ls.words_of(MIT.encode()))}
    text = (MIT.upper() + "\n日本語 é; " + LONG).encode()
    whole = ls.numbered(text, numbers).tolist()
    monkeypatch.setattr(ls, "SLICE", 16)
    assert ls.numbered(text, numbers).tolist() == whole == [numbers.get(w, -1) for w in ls.words_of(text)]


def test_a_notice_in_a_very_long_text(spark):
    long = "filler words, " * 400_000
    df = spark.createDataFrame([(1, long + "Under the MIT License " + long), (2, long + MIT)], "doc_id long, text string")
    found = {r.doc_id: r for r in ls.license_scan(df).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].n_words) == (1, 800_000, 1_600_004)
    assert found[2].labels == "mit" and found[2].score == 1.0 and found[2].base_labels == ""
    assert {m.template for m in found[2].matches} == {0}


def test_templates_need_words(spark, documents):
    with pytest.raises(ValueError, match="words"):
        ls.license_scan(documents, templates=[("...", "x")])
