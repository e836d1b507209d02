"""Co-users through masks of the most used items, their exceptions and the items beyond."""

import random

import pytest

from folioweave.operators import collaborative as cf
from test_scale_properties import brute_cf


@pytest.mark.parametrize("seed", [1, 2])
def test_items_beyond_the_masks(spark, seed):
    rng = random.Random(seed)
    rows = [(u, int(400 * rng.random() ** 2), rng.choice("ab")) for u in range(120) for _ in range(rng.randint(1, 12))]
    df = spark.createDataFrame(rows, "user_id int, item int, action string")
    assert len({r[1] for r in rows}) > cf.HOT_ITEMS
    got = {}
    for r in cf.co_user_items(df, {"a": 2.0, "b": 1.0}, 0.5, 5).orderBy("user_id", "rank").collect():
        got.setdefault(r["user_id"], []).append((r["item"], r["collab_score"], r["similar_users"]))
    assert got == brute_cf(rows, 5)


@pytest.mark.parametrize("block", [7, 1000])
def test_disjoint_masks_equal_brute_force(spark, block):
    rng = random.Random(3)
    rows = list({tuple(sum(1 << rng.randrange(cf.WORD) for _ in range(9)) & ((1 << cf.WORD) - 1) for _ in cf.MASK) for _ in range(60)})
    masks = spark.createDataFrame(rows, ", ".join(f"{m} bigint" for m in cf.MASK))
    got = sorted(tuple(r) for r in cf.disjoint_masks(masks, block).collect())
    want = sorted((*a, *b) for a in rows for b in rows if not any(x & y for x, y in zip(a, b)))
    assert want and got == want


def test_popular_items_make_no_pairs(spark):
    # 20 items used by half of all people: masks of six of them left a fifth of all pairs
    rng = random.Random(4)
    masks = {(sum(1 << i for i in range(20) if rng.random() < 0.5), 0) for _ in range(400)}
    frame = spark.createDataFrame(sorted(masks), ", ".join(f"{m} bigint" for m in cf.MASK))
    assert cf.disjoint_masks(frame).count() < len(masks) ** 2 // 100
