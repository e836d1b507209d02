"""Peers of topic sets against direct sums."""

import random
from collections import Counter

import pytest

from folioweave.operators import collaborative


def direct(counts, sets, limit):
    out = {}
    for name in sets:
        totals = Counter()
        for user, topic, n in counts:
            if str(topic) in name.split(","):
                totals[user] += n
        out[name] = sorted(totals.items(), key=lambda p: (-p[1], p[0]))[:limit]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_peers_equal_direct_sums(spark, seed):
    rng = random.Random(seed)
    # many ties, a heavy user, a topic with few users
    counts = [(u, t, rng.choice([1, 1, 2, 3, 9])) for u in range(80) for t in range(5) if rng.random() < 0.5]
    counts += [(200, 1, 500), (201, 9, 2), (202, 9, 2)]
    sets = ["0,1,2", "1,3", "4", "9", "0,9"]
    events = spark.createDataFrame([(u, t) for u, t, n in counts for _ in range(n)], "user_id int, topic int")
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets * 2)], "user_id int, topic_set string")
    got = collaborative.peer_ranking(events, frame, 6).collect()
    want = direct(counts, sets, 7)
    for name in sets:
        mine = sorted((r for r in got if r.topic_set == name), key=lambda r: r["rank"])
        assert [(r.peer, r.overlap) for r in mine] == want[name]
