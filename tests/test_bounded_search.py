"""Bounded retrieval against scoring everything; rows that leave a task; parts that are skipped."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioweave.operators import bounded_search as bs
from folioweave.operators import lexical


def corpus(seed, n=900):
    rng = random.Random(seed)
    terms = [f"t{i}" for i in range(40)]
    rows = [(c, t, rng.randint(0, 4)) for c in range(n) for t in terms if rng.random() < (0.9 if t == "t0" else 0.05)]
    facts = [(c, [rng.choice([0.7, 1.0]), rng.random(), -rng.choice([0.0, 0.1])]) for c in range(n)]
    queries = [(q, t, rng.choice([0.0, 1.0, 2.5]), rng.choice([1, 2, 4]), 3) for q in range(25) for t in rng.sample(terms, 6) + ["t0"]]
    return rows, facts, list({(q, t): (q, t, w, m, s) for q, t, w, m, s in queries}.values())


def plain(rows, facts, queries, k, score):
    """All matches of every query, scored one by one."""
    held, out = dict(facts), {}
    for q in {x[0] for x in queries}:
        asked = sorted((x for x in queries if x[0] == q), key=lambda x: x[1])
        total, mark = {}, {}
        impact = {(c, t): i for c, t, i in rows}
        for _, t, w, m, size in asked:
            for c in held:
                if (c, t) in impact:
                    total[c] = total.get(c, 0.0) + w * impact[c, t]
                    mark[c] = mark.get(c, 0) | m
        scored = [(float(score(np.array([total[c]]), np.array([mark[c]]), np.array([held[c]]), 3.0)[0]), c, mark[c]) for c in total]
        out[q] = [(c, s, m) for s, c, m in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]
    return out


@pytest.mark.parametrize("chunks, block_queries", [(200, 7), (8192, 1024)])
def test_equals_scoring_everything(spark, chunks, block_queries):
    rows, facts, queries = corpus(3)
    got = {}
    found = bs.bounded_top_k(
        spark.createDataFrame(rows, "chunk_id bigint, term string, impact int"), spark.createDataFrame(facts, "chunk_id bigint, facts array<double>"),
        spark.createDataFrame(queries, "query_id bigint, term string, weight double, mark int, size int"), 10, lexical._passage_scores, chunks, block_queries,
    )
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"], r["mark"]))
    assert got == plain(rows, facts, queries, 10, lexical._passage_scores)


def test_parts_that_cannot_reach_the_first_are_skipped():
    """One part has the high impacts; the others are not looked at."""
    n = 40 * bs.PART
    rows = [{"chunk_id": c, "term": None, "facts": []} for c in range(n)]
    rows += [{"chunk_id": c, "term": "a", "impact": 5.0 if c // bs.PART == 7 else 1.0} for c in range(n)]
    ids, scores, _, _, visited = bs._Block(pd.DataFrame(rows)).search([("a", 2.0, 1)], 0.0, 10, lexical._sums)
    assert visited == 1 and ids.tolist() == list(range(7 * bs.PART, 7 * bs.PART + 10)) and set(scores) == {10.0}
    # equal bounds: the first part has the smaller ids
    flat = pd.DataFrame([{**r, "impact": 1.0} if r["term"] else r for r in rows])
    ids, _, _, _, visited = bs._Block(flat).search([("a", 2.0, 1)], 0.0, 10, lexical._sums)
    assert visited == 1 and ids.tolist() == list(range(10))


def rows_after(df, node, metric):
    """A metric of the plan's nodes of a kind from the top, after running it."""
    df.collect()
    plan, found, names = df._jdf.queryExecution().executedPlan(), [], []

    def walk(p):
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        names.append(p.nodeName())
        if p.nodeName().startswith(node):
            found.append(p.metrics().apply(metric).value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    assert found, names
    return found


def test_at_most_k_rows_a_query_and_block_leave_a_task(spark):
    chunks = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.lit("the word of"), F.col("id").cast("string")).alias("content"))
    queries = spark.createDataFrame([(q, f"the of {q}") for q in range(20)], "query_id bigint, text string")
    found = lexical.bm25(queries, chunks, k=5)
    blocks = spark.sparkContext.defaultParallelism
    # the uppermost exchange brings the rows of a query together
    assert rows_after(found, "Exchange", "shuffleRecordsWritten")[0] <= 20 * 5 * blocks < 20 * 3000
    best = {r["query_id"]: r["chunk_id"] for r in found.where("rank = 1").collect()}
    assert best == {q: q for q in range(20)}


def test_semantic_rows_fill_what_no_term_found(spark):
    chunks = spark.createDataFrame([(i, t, 0.9, False, []) for i, t in enumerate(["alpha beta", "gamma", "beta"])], "chunk_id bigint, content string, confidence double, degraded boolean, refs array<string>")
    queries = spark.createDataFrame([(1, ["alpha"], None)], "query_id bigint, terms array<string>, ref string")
    expanded = spark.createDataFrame([], "query_id bigint, term string")
    near = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.8), (1, 2, 0.1)], "query_id bigint, chunk_id bigint, score double")
    got = lexical.multi_pass_search(queries, chunks, expanded, 5, near).orderBy("rank").collect()
    assert [(r["chunk_id"], r["match_type"]) for r in got] == [(1, "semantic"), (0, "keyword")]
    assert lexical.multi_pass_search(queries.limit(0), chunks, expanded).count() == 0
    assert lexical.multi_pass_search(queries, chunks.limit(0), expanded).count() == 0


def test_half_up_is_one_rule(spark):
    values = [0.0640625, 0.5678125, 0.1234565, 2.5e-7, 1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(bs.half_up_column(F.col("v"))).collect()]
    assert got == bs.half_up(np.array(values)).tolist()


def test_term_counts_carried_and_by_exchange(spark):
    """Both ways to meet the terms equal ``str.count`` on every token, with no exchange after the texts are placed."""
    rng = random.Random(5)
    letters = "abc"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "aaaaaaaa aaaa", "the the theatre"]
    terms = sorted({"".join(rng.choice(letters) for _ in range(n)) for n in range(1, 8) for _ in range(12)} | {"aa", "the", "theatre"})
    chunks = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "chunk_id bigint, content string, kind int")
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    expected = {}
    for i, text in enumerate(texts):
        for t in terms:
            n = sum(w.count(t) for w in (text or "").split())
            if n and len(t) >= 2:
                expected[i, i % 7, t] = n
    for limit in (lexical.CARRIED, 3):
        got = lexical.term_counts(chunks, asked, 2, ["kind"], limit)
        assert {(r["chunk_id"], r["kind"], r["term"]): r["n"] for r in got.collect()} == expected
    counts = lexical.term_counts(chunks, asked, keep=["kind"])
    plan = counts.groupBy("chunk_id", "kind").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rows_of_postings_have_no_null_lists(spark, monkeypatch):
    """A null list costs a row the rows before it when it is written for Python: seconds a cell instead of minutes."""
    seen = []
    cogroup = type(spark.range(1).groupBy("id")).cogroup
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "cogroup", lambda self, other: seen.append(self._df) or cogroup(self, other))
    rows, facts, queries = corpus(4, 50)
    bs.bounded_top_k(
        spark.createDataFrame(rows, "chunk_id bigint, term string, impact int"), spark.createDataFrame(facts, "chunk_id bigint, facts array<double>"),
        spark.createDataFrame(queries, "query_id bigint, term string, weight double, mark int, size int"), 10, lexical._passage_scores,
    )
    assert seen and seen[0].where("facts is null").count() == 0 and seen[0].where("term is null").count() >= 50
