"""The pipeline's stages against brute force, and the queries that have SQL."""

import pytest
from test_simhash import plain_fingerprint, plain_groups
from tokenizers import Tokenizer

import check
import corpus_pipeline
from folioweave.llm import catalog, decontaminate, quality_rules
from folioweave.llm.common import table, word_bpe_path


def test_stages_in_order(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.collect()
    results = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        results.append(docs.collect())
    assert all(r[0].asDict().keys() == set(columns) for r in results[:3])
    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    good, single, clean, tokens = results
    # quality: labelled documents that pass the base rules follow their label
    kept = {r.doc_id for r in good}
    for r in before:
        words, _, _, _, repeated = quality_rules.text_counts(r.text)
        if words < 50 or 100 * repeated > 50 * words:
            assert r.doc_id not in kept
        elif r.doc_id in labels:
            assert (r.doc_id in kept) == bool(labels[r.doc_id].quality)
    # one document of each group
    groups = plain_groups([r.doc_id for r in good], [plain_fingerprint(r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(set(groups))
    # no document with most of a benchmark item in order
    items = [decontaminate.word_codes([r.text])[0].tolist() for r in table(spark, sf_dir, "benchmark").collect()]
    words = {r.doc_id: decontaminate.word_codes([r.text])[0].tolist() for r in single}

    def leaks(mine):
        return any(
            decontaminate.common_subsequence(item, mine[at : at + len(item) + 8]) >= 0.8 * len(item)
            for item in items for at in range(0, len(mine), 4) if item and len(set(item) & set(mine[at : at + len(item) + 8])) > 0.5 * len(set(item))
        )

    assert {r.doc_id for r in clean} == {i for i, w in words.items() if not leaks(w)}
    library = Tokenizer.from_file(word_bpe_path())
    text = {r.doc_id: r.text for r in clean}
    assert {r.doc_id for r in tokens} == set(text)
    for r in tokens:
        assert list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(catalog.all_sql()))
def test_sql(spark, sf_dir, name):
    good, note = check.compare(spark, check.connect(sf_dir), name, catalog.all_queries()[name], catalog.all_sql()[name], sf_dir)
    assert good, note


def test_each_operator_has_one_query():
    names = list(catalog.all_queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert names.count("pipeline") == 1
