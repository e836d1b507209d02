"""Filtered recommendations against brute force, with null attributes, null vectors, ties and repeats."""

import random

import numpy as np

from folioweave.operators import recommend

ITEMS = "item_id long, priority int, industry string, kind string, vector array<float>"
REQUESTS = "request_id long, industry string, kind string, vector array<float>"


def fits(request, item, with_general):
    _, industry, kind, _ = request
    own = industry is None or item[2] == industry or with_general and item[2] == "general"
    return own and (kind is None or item[3] == kind)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)


def make(seed):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    vector = lambda: pick(None, *[[float(rng.randint(-3, 3)) or 1.0 for _ in range(4)] for _ in range(4)])
    items = [(i, pick(None, 1, 1, 2, 3), pick(None, "a", "b", "general"), pick(None, "x", "y"), vector()) for i in range(60)]
    requests = [(i, pick(None, "a", "b", "c"), pick(None, "x", "y"), vector()) for i in range(40)]
    return items, requests


def test_templates_equal_brute_force(spark):
    items, requests = make(5)
    want = set()
    for r in requests:
        near = sorted((-cosine(r[3], i[4]), i[0]) for i in items if fits(r, i, False) and r[3] and i[4]) if r[3] else []
        if near:
            want |= {(r[0], i, "vector", n + 1) for n, (_, i) in enumerate(near[:5])}
        else:
            listed = sorted((i[1] is None, i[1] or 0, i[0]) for i in items if fits(r, i, True))
            want |= {(r[0], i, "profile", n + 1) for n, (_, _, i) in enumerate(listed[:5])}
    found = recommend.recommend_templates(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(requests, REQUESTS), ["industry", "kind"], 5, {"industry": "general"}
    ).collect()
    assert {(r.request_id, r.item_id, r.method, r["rank"]) for r in found} == want
    assert {r.method for r in found} == {"vector", "profile"}


def test_lookup_of_repeated_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, 1, "a", "x", None)] * 3 + [(2, 1, "a", None, None)], ITEMS)
    requests = spark.createDataFrame([(7, "a", None, None)] * 2 + [(8, "a", "x", None), (9, "*", None, None)], REQUESTS)
    got = {(r.request_id, r.item_id, r["rank"]) for r in recommend.lookup(items, requests, ["industry", "kind"], 5).collect()}
    assert got == {(7, 1, 1), (7, 2, 2), (8, 1, 1)}
    assert recommend.lookup(items.limit(0), requests, ["industry"], 5).count() == 0
    assert recommend.lookup(items, requests.limit(0), ["industry"], 5).count() == 0


def test_risks_by_keywords_where_no_vector_answers(spark):
    items = spark.createDataFrame(
        [(1, "late Payment of wages", [1.0, 0.0]), (2, "payments and penalties", None), (3, None, [0.0, 1.0]), (4, "", None)],
        "item_id long, description string, vector array<float>",
    )
    requests = spark.createDataFrame(
        [(1, "payment of wages was late", None), (2, "x", [1.0, 0.1]), (3, None, None), (4, "PAYMENT?", None), (5, "payment payment", None)],
        "request_id long, text string, vector array<float>",
    )
    got = {(r.request_id, r.item_id, r.method, r.score) for r in recommend.recommend_risks(items, requests).collect()}
    assert got == {
        (1, 1, "keyword", 3.0), (1, 2, "keyword", 1.0), (2, 1, "vector", 0.995037), (2, 3, "vector", 0.099504),
        (5, 1, "keyword", 1.0), (5, 2, "keyword", 1.0),
    }
