"""Vectors of users: the same by a list that travels and by exchange, and read once by the recommender."""

import pytest
from pyspark.sql import functions as F

from folioweave.operators import vector_search as vs
from folioweave.plans import search


@pytest.mark.parametrize("limit", [0, 8192])
def test_interest_vectors_by_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(vs, "CARRIED_VECTORS", limit)
    events = spark.createDataFrame([(u, i, i, (u * i) % 3, "view") for u in range(4) for i in range(9)], "user_id int, ts int, event_id int, item int, action string")
    chunks = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "item int, vector array<double>")
    got = {r["user_id"]: [round(x, 6) for x in r["vector"]] for r in vs.interest_vectors(events, chunks, F.lit(1.0), 2).collect()}
    assert got == {0: [1.0, 0.0], 3: [1.0, 0.0], 1: [0.707107, 0.707107], 2: [0.707107, 0.707107]}


def test_recommender_makes_user_vectors_once(spark, sf_dir, monkeypatch):
    made, plain = [], search.user_vectors
    monkeypatch.setattr(search, "user_vectors", lambda *a: made.append(1) or plain(*a))
    search.b20(spark, sf_dir)
    assert len(made) == 1
