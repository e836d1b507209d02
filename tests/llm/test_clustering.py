"""Centroid clustering against plain integer arithmetic on every pair."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import clustering


def plain(vectors, k, rounds, label="2:"):
    """Every vector against every centroid in Python integers."""
    kept = {i: [math.floor(256 * float(x)) for x in v] for i, v in vectors.items()}
    order = sorted(kept, key=lambda i: hashlib.sha256(f"{label}{i}".encode()).hexdigest())
    centroids = [list(kept[i]) for i in order[:k]]

    def assign():
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for i, v in kept.items()}

    for _ in range(rounds):
        groups = {}
        for i, (_, j) in assign().items():
            groups.setdefault(j, []).append(kept[i])
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return assign(), centroids


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], f"vec_id bigint, embedding array<{kind}>")


@pytest.mark.parametrize("spread, leading", [(0.05, 3), (1.0, 2), (0.0, 1), (300.0, 8)])
def test_equals_plain_arithmetic(spark, spread, leading):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(9, 8))
    vectors = {i: np.float32(centres[i % 9] + spread * draw.normal(size=8)) for i in range(400)}
    found, centroids = clustering.cluster_vectors(frame(spark, vectors).repartition(5), width=8, k=12, rounds=4, leading=leading)
    want, last = plain(vectors, 12, 4)
    assert centroids == last
    assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in found.collect()} == want


def test_bound_excludes_centroids_and_never_the_nearest():
    draw = np.random.default_rng(8)
    x = np.int64(draw.normal(size=(500, 6)) @ draw.normal(size=(6, 64)) * 100 + draw.normal(size=(500, 64)) * 20)
    c = x[::25].copy()
    mean, directions = x.mean(0), np.linalg.eigh(np.cov(x.T))[1][:, :-17:-1]
    lead, rest = clustering.rotated(x.astype(float), mean, directions)
    c_lead, c_rest = clustering.rotated(c.astype(float), mean, directions)
    exact = ((x[:, None] - c) ** 2).sum(2)
    bound = ((lead[:, None] - c_lead) ** 2).sum(2) + (rest[:, None] - c_rest) ** 2
    assert (bound <= exact * (1 + 1e-9) + 1e-6).all()
    number, distance, work = clustering.nearest(x, lead, rest, c, c_lead, c_rest, float((x * x).sum(1).max() * 2))
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert work < 0.3 * exact.size


def test_rows_left_out_and_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.001], 1), (1, [0.5, -0.001], 2), (2, [1e30, -3e38], 3), (3, [nan, 1.0], 4), (4, [1.0, None], 5), (5, [1.0], 6),
        (6, None, 7), (7, [1.0, 2.0, 3.0], 8), (None, [0.25, 0.25], 9), (8, [-inf, 0.0], 10), (9, [], 11),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, cluster int")
    found, centroids = clustering.cluster_vectors(table, width=2, k=40, rounds=2)
    out = clustering.with_inertia(found, centroids)
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in out.collect()) == [(False, 1), (False, 1), (False, 2), (True, None)]
    assert out.agg(F.max("distance")).first()[0] == 0 and len(centroids) == 4
    got = table.where("vec_id = 2").select(clustering.whole_components(F.col("embedding")).alias("v")).first()["v"]
    assert got == [clustering.LARGEST, -clustering.LARGEST]
    none, nothing = clustering.cluster_vectors(table.where("vec_id > 100"), width=2)
    assert none.count() == 0 and nothing == []
    assert clustering.with_inertia(none, nothing).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_vectors_leave_empty_centroids_alone(spark):
    vectors = {i: [1.0, 2.0] for i in range(60)} | {100: [3.0, 3.0]}
    found, centroids = clustering.cluster_vectors(frame(spark, vectors, "double"), width=2, k=5, rounds=3)
    want, last = plain(vectors, 5, 3)
    assert {r["vec_id"]: (r["distance"], r["cluster"]) for r in found.collect()} == want and centroids == last
