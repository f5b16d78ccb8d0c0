import corpus_pipeline
from churnloom.llm import quality_rules
from tests.llm import plain
from tests.llm.conftest import ODD, SMALL


def _clean(texts):
    judged = {d: quality_rules.judge(t) for d, t in texts.items()}
    return {d: j[7] for d, j in judged.items() if j[6]}


def test_pipeline(spark, documents):
    rows = {r.doc_id: r for r in documents.collect()}
    texts = _clean({d: r.text for d, r in rows.items()})
    lines = plain.without_repeated_lines(texts)
    texts = {d: t for d, (t, n, removed) in lines.items() if removed == 0 or removed < n}
    _, groups = plain.jaccard_components(texts)
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    mixed = plain.mix([(d, t, rows[d].source) for d, t in texts.items()])
    copies = [d for d, size, *_, parts in mixed for p in parts if p and 2 * p >= size]
    tokenizer = plain.tokenizer()
    ids = {d: [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2] for d in set(copies)}
    found = corpus_pipeline.run(spark, SMALL).collect()
    plain.check_packing(found, [(d, ids[d]) for d in copies], 4096)
    assert {r.doc_id for r in found} == set(copies)


def test_stages_keep_the_columns(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (odd, nothing):
            found = stage(spark, df, SMALL)
            assert found.columns == df.columns, name
            assert {r.doc_id for r in found.select("doc_id").collect()} <= {r[0] for r in ODD}
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, SMALL).collect() == []


def test_one_of_each_group_stays(spark, odd):
    found = sorted((r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, odd, SMALL).select("doc_id").collect()), key=repr)
    assert found == sorted([1, 3, 4, 5, 7, 8, 10, 11, None, None], key=repr)
