"""Quality rules: exact counts, features and accuracy on held-out labels."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\x85#*é日|", max_size=80))
def test_counts(text):
    assert q.text_counts(text) == plain_counts(text)


def test_counts_of_edge_cases():
    for t in [None, "", "   \n\n", "a", "a b c", "a b c a b c", "x " * 5000, "l1\nl1\n \nl1", "é\xa0ü \u2003z"]:
        assert q.text_counts(t) == plain_counts(t)


def test_slices_hash_like_single_texts():
    texts = ["", "The cat  sat\n", "é日 x", "a", "the cat sat on the mat " * 40]
    weights = np.random.default_rng(0).normal(size=1 << q.BITS)
    together = q.margins([t.encode() for t in texts], weights)
    for t, m in zip(texts, together):
        dense = np.zeros(1 << q.BITS)
        v = q.sparse_features(t)
        dense[v.indices] = v.values
        assert m == pytest.approx(float(dense @ weights), abs=1e-6)
        assert m == pytest.approx(q.margins([t.encode()], weights)[0], abs=1e-9)


def test_held_out_accuracy_and_calibration(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    train = labels.where("pmod(hash(doc_id), 3) > 0")
    model = q.fit_quality(docs, train)
    scored = {r.doc_id: r for r in q.score_quality(docs, model).collect()}
    held = [r for r in labels.where("pmod(hash(doc_id), 3) = 0").collect() if not scored[r.doc_id].base_failed]
    right = sum(scored[r.doc_id].kept == bool(r.quality) for r in held)
    assert right >= 0.95 * len(held)
    assert all(scored[r.doc_id].kept for r in held if r.quality)  # clean texts stay
    brier = sum((scored[r.doc_id].probability - r.quality) ** 2 for r in held) / len(held)
    assert brier < 0.05


def test_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, True), (2, "", None), (None, "w " * 60, True), (3, " ".join(f"w{i}" for i in range(60)), False), (3, "same id", True)],
        "doc_id bigint, text string, kept boolean",
    )
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 0), (3, 1)], "doc_id bigint, quality int")
    assert q.fit_quality(docs, labels) is None
    kept = q.keep_good(docs, labels).collect()
    assert [(r.doc_id, r.kept) for r in kept] == [(3, False)]
    got = q.score_quality(docs, None).collect()
    assert sorted(r.n_words for r in got) == [0, 0, 2, 60, 60] and all(r.probability is None for r in got)
    assert q.score_quality(docs.limit(0), None).count() == 0
