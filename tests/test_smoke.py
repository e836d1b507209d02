"""Smoke queries from structure, searched inside their own document."""

from folioweave.operators import lexical, smoke
from folioweave.operators import query_features as qf
from folioweave.rules import quality as rules
from pyspark.sql import functions as F

UNITS = "doc_id long, unit string, idx int, label string"


def asked(spark, languages, units):
    rows = smoke.smoke_queries(spark.createDataFrame(languages, "doc_id long, language string"), spark.createDataFrame(units, UNITS))
    out = {}
    for r in rows.orderBy("query_id").collect():
        out.setdefault((r.doc_id, r.kind), []).append(r.text)
    return out


def test_queries_follow_the_structure(spark):
    units = [
        (1, "section", 0, "Chương I"), (1, "section", 1, "Mục 2 của chương"), (1, "article", 0, "Điều 7. Tên"), (1, "article", 1, "không số"),
        (1, "article", 2, "ĐIỀU 9a. x"), (1, "article", 3, "Điều 10"), (1, "clause", 0, "Khoản 1"),
        (2, "section", 0, "Part one"), (2, "section", 1, "Section 4"), (2, "article", 0, "Article 3. Name"), (3, "clause", 0, "Clause 1"),
        (5, "article", 0, "Article 1"), (6, "section", 0, None),
    ]
    got = asked(spark, [(1, "vi"), (2, "en"), (3, "mixed"), (4, "vi"), (5, "fr"), (6, None), (7, "de")], units)
    assert got == {
        (1, "primary"): ["điều", "hợp đồng", "bên", "nghĩa vụ", "thanh toán", "khoản", "chương"], (1, "cross"): ["Article 7", "Article 9a"],
        (2, "primary"): ["article", "agreement", "obligation", "payment", "section", "part"], (2, "cross"): ["Điều 3"],
        (3, "primary"): ["điều", "article", "hợp đồng", "agreement", "khoản", "clause"], (4, "primary"): ["điều", "khoản"],
        (5, "primary"): ["article", "agreement", "obligation", "payment"], (6, "primary"): ["article", "clause"], (7, "primary"): ["điều", "khoản"],
    }


CHUNKS = "chunk_id long, scope long, content string, confidence double, degraded boolean, refs array<string>"


def test_search_within_equals_search_of_each_scope(spark):
    texts = ["điều khoản thanh toán của hợp đồng", "article on payment", "nothing here", "", "agreement agreement payment article"]
    chunks = spark.createDataFrame([(d * 10 + i, d, t, 0.5 + i / 10, i == 1, [f"article_{i}"]) for d in (1, 2) for i, t in enumerate(texts[d - 1 :])], CHUNKS)
    words = ["Article 2", "payment", "điều", "zzz", "agreement payment"]
    queries = spark.createDataFrame([(d * 100 + i, d, t) for d in (1, 2) for i, t in enumerate(words)], "query_id long, scope long, text string").select(
        "query_id", "scope", qf.search_terms(F.col("text")).alias("terms"), F.when(F.col("text") == "Article 2", "article_2").alias("ref")
    )
    aliases = spark.createDataFrame(rules.BILINGUAL_ALIASES, "concept string, alias string")
    wide = qf.expand_aliases(queries.select("query_id", F.explode("terms").alias("term")), aliases)
    got = {tuple(r) for r in lexical.search_within(queries, chunks, wide, 3).collect()}
    want = set()
    for d in (1, 2):
        own = queries.filter(F.col("scope") == d)
        part = lexical.multi_pass_search(own.drop("scope"), chunks.filter(F.col("scope") == d).drop("scope"), wide.join(own.select("query_id"), "query_id"), 3)
        want |= {tuple(r) for r in part.collect()}
    assert got == want and len(got) > 10


def test_rates_status_and_warnings(spark):
    rows = [(d * 32 + i, d, "vi", "primary", f"q{i}", h) for d, hits in ((1, [1, 1, 1, 0, 0]), (2, [1, 0, 0])) for i, h in enumerate(hits)]
    rows += [(32 + 16, 1, "vi", "cross", "a", 0), (32 + 17, 1, "vi", "cross", "b", 4), (64 + 16, 2, "vi", "cross", "c", 0)]
    got = {r.doc_id: r for r in smoke.rate_smoke(spark.createDataFrame(rows, "query_id long, doc_id long, language string, kind string, text string, hits int")).collect()}
    assert (got[1].status, got[1].hit_rate, got[1].cross_hit_rate, got[1].warnings, got[1].missed) == ("pass", 0.6, 0.5, 2, "q3,q4")
    assert (got[2].status, got[2].hit_rate, got[2].cross_hit_rate, got[2].warnings) == ("warning", 0.333333, 0.0, 3)
