"""PPM code lengths against a direct model that keeps its trie in a dictionary."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioweave.llm import ppm
from folioweave.llm.common import folded_words


def direct(texts, training, order):
    """Scores by the plain definition, symbol by symbol."""
    seen = defaultdict(Counter)
    learn = [folded_words(t) for t, on in zip(texts, training) if on]
    for words in learn:
        for w in words:
            s = b" " + w + b" "
            for i in range(1, len(s)):
                for k in range(min(i, order) + 1):
                    seen[s[i - k : i]][s[i]] += 1
        for k in (b"", b" "):
            seen[k][0xFF] += 1
    counts = Counter(w for words in learn for w in words)
    tokens, kinds = sum(counts.values()) + len(learn), len(counts) + bool(learn)

    def symbol(context, s):
        gone, p = set(), 1.0
        for k in range(len(context), -1, -1):
            here = seen.get(context[len(context) - k :], {})
            left = {x: c for x, c in here.items() if x not in gone and c}
            total = sum(left.values()) + len(left)
            if s in left:
                return p * left[s] / total
            if total:
                p *= len(left) / total
            gone |= left.keys()
        return p / (256 - len(gone))

    out = []
    for t in texts:
        words = folded_words(t)
        lp = math.log10(symbol(b" ", 0xFF))
        base = math.log10((len(learn) + 1) / (tokens + kinds + 1))
        for w in words:
            s = b" " + w + b" "
            lp += sum(math.log10(symbol(s[max(0, i - order) : i], s[i])) for i in range(1, len(s)))
            base += math.log10((counts[w] + 1) / (tokens + kinds + 1))
        out.append((len(words) + 1, sum(counts[w] > 0 for w in words) + bool(learn), tokens, base, lp))
    return out


CASES = {
    "mixed": (["The cat sat", "the CATS sat on a mat", None, "", "zebra\x0bé\n日本 the", "the cat sat", "x" * 3000, "\0 a \x1c"], [1, 1, 1, 0, 0, 1, 1, 0]),
    "nothing_trained": (["ab", None], [0, 0]),
    "all_trained_empty": ([None, ""], [1, 1]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("order", [1, 3, 5])
def test_scores_match_direct_model(spark, case, order):
    texts, training = CASES[case]
    docs = spark.createDataFrame(
        [(i, t, bool(on), 1.0) for i, (t, on) in enumerate(zip(texts, training))], "doc_id bigint, text string, tr boolean, score double"
    )
    got = {r.doc_id: r for r in ppm.score_documents(docs, F.col("tr"), order=order).collect()}
    for i, want in enumerate(direct(texts, training, order)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9)
        assert r.score == pytest.approx(want[4], rel=1e-9)
        assert r.held_out == (not training[i])


def test_empty_table_and_repeated_ids(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert ppm.score_documents(docs, F.lit(True)).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, "d")], "doc_id bigint, text string")
    assert sorted(r.n_tokens for r in ppm.score_documents(docs, F.lit(True)).collect()) == [2, 2, 3, 3]


def test_query_folds_and_beats_base(spark, sf_dir):
    from folioweave.llm import catalog

    rows = catalog.all_queries()["op1_byte_ppm"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
