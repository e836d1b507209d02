"""Suggestions and feeds: scores that end in a half, and branches that never meet in a union."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioweave.operators import interactions as ix

AS_OF = "2024-01-31 00:00:00"


def suggestions(spark):
    # topic 2 weighs 0.565 of topic 1, and 0.565 * 0.9 is the double just below 0.5085
    ages = [(1, 10.0), (2, 17.137)]
    rows = [(i, 7, datetime(2024, 1, 31) - timedelta(days=a), "view", t * 4, t) for i, (t, a) in enumerate(ages)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, action string, item int, topic int")
    adjacency = spark.createDataFrame([(1, 0, 2), (1, 1, 5), (2, 0, 9)], "topic int, position int, neighbour int")
    return ix.proactive_suggestions(events, adjacency, AS_OF, 8)


def test_half_is_rounded_on_the_scaled_double(spark):
    got = [(r.rec_type, r.topic, r.score) for r in suggestions(spark).orderBy("rank").collect()]
    assert got == [("re_engage", 1, 0.9), ("cross_domain", 5, 0.6), ("re_engage", 2, 0.508)]


def test_feed_without_union(spark):
    users = spark.createDataFrame([(7,), (8,)], "user_id bigint")
    defaults = spark.createDataFrame([("default", 3, 0.45)], "rec_type string, topic int, score double")
    feed = ix.personal_feed(suggestions(spark), users, defaults, 2)
    assert "Union" not in feed._jdf.queryExecution().optimizedPlan().toString()
    got = feed.select("user_id", "rec_type", "topic", "score").orderBy("user_id", F.desc("score")).collect()
    assert list(map(tuple, got)) == [(7, "re_engage", 1, 0.9), (7, "cross_domain", 5, 0.6), (8, "default", 3, 0.45)]
