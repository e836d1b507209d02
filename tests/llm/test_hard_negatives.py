"""Hard negatives against plain integer arithmetic on every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import hard_negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (200, 64, 130), (64, 0, 64), (128, 7, 90)])
@pytest.mark.parametrize("depth", [0, 1, 3])
def test_strassen_equals_plain_product(shape, depth):
    draw = np.random.default_rng(sum(shape) + depth)
    m, k, n = shape
    for most in (3, 1 << 24):
        a, b = draw.integers(-most, most + 1, (m, k)), draw.integers(-most, most + 1, (k, n))
        got = hard_negatives.strassen(a, b, depth, leaf=2)
        assert got.dtype == np.int64 and (got == a.astype(object) @ b.astype(object)).all()


def plain(rows, is_anchor, relabel=lambda i, y: y, positives=5, negatives=3):
    """Every anchor against every row; rows are ``(id, vector, label)`` in table order."""
    kept = []
    for at, (i, v, y) in enumerate(rows):
        if y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((at, i, [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(x))))) for x in v], relabel(i, y)))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for at, i, v, y in kept:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other, z) for other, j, w, z in kept]
        for score, j, _, _ in sorted((s for s in scored if s[3] == y and s[2] != at), key=key)[:positives]:
            fit = sorted((s for s in scored if s[3] != y and 50 * score <= 100 * s[0] <= 95 * score), key=key)[:negatives]
            out += [(i, j, rank, s[1], score, s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows], "vec_id bigint, embedding array<float>, label int").coalesce(1)


def mined(frame, tile=32, **options):
    return sorted(map(tuple, hard_negatives.mine_hard_negatives(frame, F.col("id") % 5 == 0, tile=tile, **options).collect()), key=str)


def test_equals_plain_arithmetic_over_many_tiles(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 12))
    rows = [(i, centres[i % 6] + draw.normal(size=12) * 0.6, int(draw.integers(0, 4))) for i in range(150)]
    assert mined(table(spark, rows)) == plain(rows, lambda i: i % 5 == 0)


def test_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0], i % 2) for i in range(40)]
    odd = [
        (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.75, 0.0], 0), (10, [nan, 0.0], 1), (15, [None, 0.0], 1), (20, None, 1),
        (25, [1.0, 0.0], None), (30, [inf, 1.0], 0), (35, [], 1), (40, [0.7], 0), (45, [0.7, 0.1, 9.0], 0), (50, [1e30, 1.0], 2), (55, [-1.0, 0.0], 3),
    ]
    rows = [*same, *odd, *[(i, [0.8, 0.01], 4) for i in range(60, 64)]]
    assert mined(table(spark, rows)) == plain(rows, lambda i: i % 5 == 0)
    again = table(spark, rows).withColumn("row", F.lit(1)).withColumn("windows", F.lit("x")).withColumn("anchor_id", F.lit(3))
    assert mined(again) == plain(rows, lambda i: i % 5 == 0)
    assert mined(table(spark, rows).where("vec_id < 0")) == []
    assert mined(table(spark, [(5, [1.0], 1)])) == []


def test_windows_of_negative_and_zero_scores(spark):
    rows = [(5, [1.0, 0.0], 1), (6, [0.0, 1.0], 1), (7, [-1.0, 0.0], 1), (8, [0.0, 2.0], 2), (9, [-0.8, 0.0], 2)]
    assert mined(table(spark, rows)) == plain(rows, lambda i: i % 5 == 0) == [(5, 6, 1, 8, 0, 0)]
