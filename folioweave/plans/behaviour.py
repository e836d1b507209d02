"""Behaviour analytics queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.operators import collaborative as cf
from folioweave.operators import interactions as ix
from folioweave.operators.ranking import top_overall, top_per_key
from folioweave.plans.fixtures import (
    ACTION_WEIGHTS,
    AS_OF,
    AS_OF_SQL,
    EV,
    OTHER_WEIGHT,
    WEIGHT_SQL,
    interactions,
    table,
)
from folioweave.plans.registry import query

FEEDBACK = {"purchase": 0.09, "click": 0.045, "view": 0.003, "error": -0.11, "signup": -0.08}
TRANSITIONS = [
    ("view", "click", 0), ("view", "signup", 1),
    ("click", "purchase", 0), ("click", "view", 1), ("click", "signup", 2),
    ("signup", "view", 0), ("purchase", "view", 0), ("purchase", "click", 1),
    ("error", "view", 0),
]
TRANSITIONS_SQL = ", ".join(f"('{a}', '{b}', {p})" for a, b, p in TRANSITIONS)


def adjacency(events):
    """Neighbour topics of every topic present: +1, +5 and +11 of 25."""
    topics = events.select("topic").distinct()
    return topics.select(
        "topic",
        F.posexplode(
            F.array(*[((F.col("topic") + s) % 25).cast("int") for s in (1, 5, 11)])
        ).alias("position", "neighbour"),
    )


def risk_table(events):
    """Risk r relates to topics r, 2r and r+7 (modulo 25)."""
    topics = events.select("topic").distinct()
    t = F.col("topic")
    return topics.select(
        t.alias("risk_id"),
        F.array_distinct(
            F.array(t, ((t * 2) % 25).cast("int"), ((t + 7) % 25).cast("int"))
        ).alias("related_topics"),
    )


def profile_counts(events):
    """Profile counters: how often a user signed up or purchased in a topic."""
    return (
        events.filter(F.col("action").isin("signup", "purchase"))
        .groupBy("user_id", "topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "b09_user_item_cf",
    f"""
WITH {EV}, ui AS (SELECT user_id, item, sum({WEIGHT_SQL}) AS w FROM ev GROUP BY 1, 2),
pairs AS (SELECT DISTINCT a.user_id, b.user_id AS peer FROM ui a JOIN ui b ON a.item = b.item AND a.user_id <> b.user_id),
s AS (SELECT p.user_id, u.item, sum(u.w) AS collab_score, count(*) AS similar_users
      FROM pairs p JOIN ui u ON u.user_id = p.peer
      WHERE NOT EXISTS (SELECT 1 FROM ui o WHERE o.user_id = p.user_id AND o.item = u.item)
      GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY collab_score DESC, item) AS INTEGER) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""",
)
def b09(spark, sf):
    return cf.co_user_items(interactions(spark, sf), ACTION_WEIGHTS, OTHER_WEIGHT, 10)


@query(
    "b01_viewed_items",
    f"""WITH {EV}, l AS (SELECT user_id, item, max(ts) AS m FROM ev GROUP BY 1, 2),
r AS (SELECT user_id, item, epoch_us(m) AS last_us, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m DESC, item) AS INTEGER) AS rank FROM l)
SELECT * FROM r WHERE rank <= 50""",
)
def b01(spark, sf):
    out = ix.viewed_items(interactions(spark, sf), 50)
    return out.select(
        "user_id", "item", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "rank"
    )


@query("b02_action_frequency", f"WITH {EV} SELECT user_id, action, count(*) AS n FROM ev GROUP BY 1, 2")
def b02(spark, sf):
    return ix.action_frequency(interactions(spark, sf))


@query(
    "a01_count_by_key_top",
    f"""WITH {EV}, c AS (SELECT action, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY 1)
SELECT action, n, users, CAST(row_number() OVER (ORDER BY n DESC, action) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""",
)
def a01(spark, sf):
    counts = interactions(spark, sf).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")
    )
    return top_overall(counts, [F.desc("n"), F.asc("action")], 3)


@query(
    "a02_conditional_weight_sum",
    f"""WITH {EV} SELECT item, sum({WEIGHT_SQL}) AS weight,
count(DISTINCT user_id) AS users, min(action) AS first_action FROM ev GROUP BY 1""",
)
def a02(spark, sf):
    return interactions(spark, sf).groupBy("item").agg(
        F.sum(ix.action_weight(ACTION_WEIGHTS, OTHER_WEIGHT)).alias("weight"),
        F.countDistinct("user_id").alias("users"),
        F.min("action").alias("first_action"),
    )


@query(
    "a03_distinct_users_per_topic",
    f"WITH {EV} SELECT topic, action, count(DISTINCT user_id) AS users, count(DISTINCT item) AS items FROM ev GROUP BY 1, 2",
)
def a03(spark, sf):
    return interactions(spark, sf).groupBy("topic", "action").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("item").alias("items")
    )


@query(
    "a04_first_and_last_per_group",
    f"""WITH {EV} SELECT item, arg_min(topic, event_id) AS first_topic, arg_min(action, event_id) AS first_action,
arg_max(action, event_id) AS last_action, epoch_us(max(ts)) AS last_us, max(value) AS max_value FROM ev GROUP BY 1""",
)
def a04(spark, sf):
    return interactions(spark, sf).groupBy("item").agg(
        F.min_by("topic", "event_id").alias("first_topic"),
        F.min_by("action", "event_id").alias("first_action"),
        F.max_by("action", "event_id").alias("last_action"),
        F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"),
        F.max("value").alias("max_value"),
    )


@query("b03_active_hours", f"""WITH {EV}, c AS (SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 6""")
def b03(spark, sf):
    return ix.active_hours(interactions(spark, sf), 6)


@query("b04_topics_since", f"WITH {EV} SELECT DISTINCT user_id, topic FROM ev WHERE topic IS NOT NULL AND ts >= {AS_OF_SQL} - INTERVAL 7 DAY")
def b04(spark, sf):
    return ix.topics_since(interactions(spark, sf), AS_OF, 7)


@query("b05_trending_topics", f"""WITH {EV}, c AS (SELECT topic, count(*) AS n FROM ev WHERE topic IS NOT NULL GROUP BY 1)
SELECT topic, n, CAST(row_number() OVER (ORDER BY n DESC, topic) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""")
def b05(spark, sf):
    return ix.trending_topics(interactions(spark, sf), 5)


BIGRAMS = """led AS (SELECT user_id, action AS first_action, lead(action) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second_action FROM ev),
bg AS (SELECT user_id, first_action, second_action, count(*) AS n FROM led WHERE second_action IS NOT NULL GROUP BY 1, 2, 3)"""


@query("b06_action_bigrams", f"""WITH {EV}, {BIGRAMS},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_action, second_action) AS INTEGER) AS rank FROM bg)
SELECT * FROM r WHERE rank <= 20""")
def b06(spark, sf):
    return ix.action_bigrams(interactions(spark, sf), 20)


@query("a07_global_bigrams", f"WITH {EV}, {BIGRAMS} SELECT first_action, second_action, CAST(sum(n) AS BIGINT) AS n, count(*) AS users FROM bg GROUP BY 1, 2")
def a07(spark, sf):
    return ix.action_bigrams(interactions(spark, sf), None).groupBy("first_action", "second_action").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("users")
    )


@query("s13_history", f"""WITH {EV}, r AS (SELECT user_id, event_id, action, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank
FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 10 DAY) SELECT * FROM r WHERE rank <= 20""")
def s13(spark, sf):
    return ix.history(interactions(spark, sf), AS_OF, 10, 20).select(
        "user_id", "event_id", "action", "item", "rank"
    )


@query("s18_history_page", f"""WITH {EV}, r AS (SELECT user_id, event_id, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank
FROM ev WHERE action = 'view') SELECT * FROM r WHERE rank > 5 AND rank <= 10""")
def s18(spark, sf):
    return ix.history_page(interactions(spark, sf), "view", 5, 5).select(
        "user_id", "event_id", "item", "rank"
    )


HIST = f"""hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS hr
FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 60 DAY) WHERE hr <= 200),
raw AS (SELECT user_id, topic, sum(exp(-0.08 * greatest(0.0::DOUBLE, date_diff('microsecond', ts, {AS_OF_SQL}) / 8.64e10::DOUBLE))) AS raw
FROM hist WHERE topic IS NOT NULL GROUP BY 1, 2),
wt AS (SELECT user_id, topic, round(raw / max(raw) OVER (PARTITION BY user_id), 3) AS weight FROM raw),
topw AS (SELECT user_id, topic AS top_topic, weight AS top_weight FROM wt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, topic) = 1),
nb AS (SELECT topic, s.pos AS position, (topic + s.step) % 25 AS neighbour FROM (SELECT DISTINCT topic FROM ev), (VALUES (0, 1), (1, 5), (2, 11)) s(pos, step)),
adj AS (SELECT t.user_id, t.top_topic, t.top_weight, n.neighbour, row_number() OVER (PARTITION BY t.user_id ORDER BY n.position) AS ar
FROM topw t JOIN nb n ON n.topic = t.top_topic WHERE NOT EXISTS (SELECT 1 FROM wt w WHERE w.user_id = t.user_id AND w.topic = n.neighbour))"""


@query("a08_decayed_weights", f"WITH {EV}, {HIST} SELECT user_id, topic, weight FROM wt")
def a08(spark, sf):
    return ix.decayed_weights(interactions(spark, sf), AS_OF)


@query("b15_decayed_profile", f"""WITH {EV}, {HIST},
tot AS (SELECT user_id, count(*) AS total_interactions, count(DISTINCT CAST(ts AS DATE)) AS days_active, epoch_us(max(ts)) AS last_us FROM hist GROUP BY 1),
aj AS (SELECT user_id, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY ar) AS adjacent FROM adj GROUP BY 1)
SELECT user_id, total_interactions, days_active, last_us, top_topic, coalesce(adjacent, '') AS adjacent FROM tot JOIN topw USING (user_id) LEFT JOIN aj USING (user_id)""")
def b15(spark, sf):
    ev = interactions(spark, sf)
    out = ix.profile_summary(ev, adjacency(ev), AS_OF)
    return out.select(
        "user_id", "total_interactions", "days_active",
        F.unix_micros(F.col("last_active").cast("timestamp")).alias("last_us"),
        "top_topic",
        F.array_join(F.col("adjacent_topics").cast("array<string>"), ",").alias("adjacent"),
    )


SUGGEST = f"""{HIST},
recent AS (SELECT DISTINCT user_id, topic FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY),
trend AS (SELECT topic, row_number() OVER (ORDER BY n DESC, topic) AS place FROM (SELECT topic, count(*) AS n FROM ev GROUP BY 1) QUALIFY place <= 5),
sug AS (
 SELECT user_id, 're_engage' AS rec_type, topic, round(weight * 0.9::DOUBLE, 3) AS score FROM wt WHERE weight >= 0.25
   AND NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = wt.user_id AND r.topic = wt.topic)
 UNION ALL SELECT user_id, 'cross_domain', neighbour, round(top_weight * 0.6::DOUBLE, 3) FROM adj WHERE ar <= 3
 UNION ALL SELECT u.user_id, 'proactive', t.topic, round(greatest(0.3::DOUBLE, 0.55::DOUBLE - (t.place - 1) * 0.05::DOUBLE), 3)
   FROM (SELECT DISTINCT user_id FROM wt) u, trend t WHERE NOT EXISTS (SELECT 1 FROM wt w WHERE w.user_id = u.user_id AND w.topic = t.topic))"""


@query("b16_proactive_suggestions", f"""WITH {EV}, {SUGGEST}
SELECT user_id, rec_type, topic, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_type, topic) AS INTEGER) AS rank FROM sug QUALIFY rank <= 6""")
def b16(spark, sf):
    ev = interactions(spark, sf)
    return ix.proactive_suggestions(ev, adjacency(ev), AS_OF, 6)


@query("b27_personal_feed", f"""WITH {EV}, {SUGGEST},
s6 AS (SELECT user_id, rec_type, topic, score FROM sug QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_type, topic) <= 8),
f AS (SELECT * FROM s6 UNION ALL SELECT c.c_custkey, 'default', d.topic, d.score FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM s6)) c,
 (SELECT topic, round(0.5::DOUBLE - place * 0.05::DOUBLE, 3) AS score FROM trend) d)
SELECT user_id, rec_type, topic, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_type, topic) AS INTEGER) AS rank FROM f QUALIFY rank <= 8""")
def b27(spark, sf):
    ev = interactions(spark, sf)
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("user_id"))
    everyone = people.unionByName(ev.select("user_id")).distinct()
    defaults = ix.trending_topics(ev, 5).select(
        F.lit("default").alias("rec_type"), "topic",
        F.round(F.lit(0.5) - F.col("rank") * 0.05, 3).alias("score"),
    )
    return ix.personal_feed(
        ix.proactive_suggestions(ev, adjacency(ev), AS_OF, 8), everyone, defaults, 8
    )


NEXT = f"""{BIGRAMS}, bg20 AS (SELECT * FROM bg QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_action, second_action) <= 20),
lastact AS (SELECT user_id, arg_max(action, (ts, event_id)) AS last_action FROM ev GROUP BY 1),
tr(action, next_action, position) AS (VALUES {TRANSITIONS_SQL}),
nx AS (SELECT l.user_id, 'seq_' || last_action || '_' || next_action AS rec_id, round(0.85::DOUBLE - position * 0.1::DOUBLE, 3) AS score FROM lastact l JOIN tr ON tr.action = l.last_action
 UNION SELECT b.user_id, 'hist_seq_' || second_action, round(least(0.78::DOUBLE, n * 0.13::DOUBLE), 3) FROM bg20 b JOIN lastact l ON l.user_id = b.user_id AND l.last_action = b.first_action)"""


@query("b17_next_action", f"""WITH {EV}, {NEXT}
SELECT user_id, rec_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_id) AS INTEGER) AS rank FROM nx QUALIFY rank <= 3""")
def b17(spark, sf):
    transitions = spark.createDataFrame(TRANSITIONS, "action string, next_action string, position int")
    return ix.next_actions(interactions(spark, sf), transitions, 3)


PEERS = f"""{HIST}, top3 AS (SELECT user_id, topic FROM wt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, topic) <= 3),
cnt AS (SELECT user_id, topic, count(*) AS n FROM ev WHERE topic IS NOT NULL GROUP BY 1, 2),
ov AS (SELECT t.user_id, c.user_id AS peer, CAST(sum(c.n) AS BIGINT) AS overlap FROM top3 t JOIN cnt c ON c.topic = t.topic AND c.user_id <> t.user_id GROUP BY 1, 2),
pr AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, peer) AS INTEGER) AS rank FROM ov QUALIFY rank <= 20)"""


def weekly_interest(ev):
    return ix.decayed_weights(ev, AS_OF).withColumnRenamed("weight", "score")


@query("b07_peer_users", f"WITH {EV}, {PEERS} SELECT * FROM pr")
def b07(spark, sf):
    ev = interactions(spark, sf)
    return cf.peer_users(ev, weekly_interest(ev), 20)


TREND = f"""{PEERS}, used AS (SELECT user_id, item, max(ts) AS last_ts FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 14 DAY GROUP BY 1, 2),
pt AS (SELECT p.user_id, u.item, count(DISTINCT u.user_id) AS peer_count, max(u.last_ts) AS la FROM pr p JOIN used u ON u.user_id = p.peer
 WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = p.user_id AND e.item = u.item) GROUP BY 1, 2),
ptr AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY peer_count DESC, la DESC, item) AS INTEGER) AS rank FROM pt QUALIFY rank <= 5)"""


@query("b08_peer_trending", f"WITH {EV}, {TREND} SELECT user_id, item, peer_count, epoch_us(la) AS last_us, rank FROM ptr")
def b08(spark, sf):
    ev = interactions(spark, sf)
    out = cf.peer_trending(ev, weekly_interest(ev), AS_OF)
    return out.select(
        "user_id", "item", "peer_count",
        F.unix_micros(F.col("last_accessed").cast("timestamp")).alias("last_us"), "rank",
    )


@query("b18_peer_recommendations", f"WITH {EV}, {TREND} SELECT user_id, item, peer_count, round(least(0.95::DOUBLE, peer_count * 0.15::DOUBLE), 3) AS score, rank FROM ptr")
def b18(spark, sf):
    ev = interactions(spark, sf)
    return cf.peer_recommendations(cf.peer_trending(ev, weekly_interest(ev), AS_OF))


@query("b13_user_top_topics", f"""WITH {EV}, s AS (SELECT user_id, topic, CAST(count(*) AS DOUBLE) AS score FROM ev GROUP BY 1, 2
 UNION ALL SELECT user_id, topic, count(*) * 1.5::DOUBLE FROM ev WHERE action IN ('signup', 'purchase') GROUP BY 1, 2),
g AS (SELECT user_id, topic, sum(score) AS score FROM s GROUP BY 1, 2)
SELECT user_id, topic, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, topic) AS INTEGER) AS rank FROM g QUALIFY rank <= 5""")
def b13(spark, sf):
    ev = interactions(spark, sf)
    return ix.top_topics(ev, profile_counts(ev), 5)


@query("b14_risks_from_history", f"""WITH {EV}, c AS (SELECT user_id, topic, count(*) AS n FROM ev GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, topic) <= 5),
rk AS (SELECT DISTINCT t.topic AS risk_id, unnest(list_distinct([t.topic, (t.topic * 2) % 25, (t.topic + 7) % 25])) AS topic FROM (SELECT DISTINCT topic FROM ev) t),
h AS (SELECT user_id, risk_id, CAST(sum(n) AS BIGINT) AS hits FROM c JOIN rk USING (topic) GROUP BY 1, 2)
SELECT user_id, risk_id, hits, least(hits / 10.0::DOUBLE, 1.0::DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, risk_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 10""")
def b14(spark, sf):
    ev = interactions(spark, sf)
    return ix.risks_from_history(ev, risk_table(ev), 5, 10)


@query("b21_feedback_scores", f"""WITH {EV}, h AS (SELECT *, CASE action WHEN 'purchase' THEN 0.09::DOUBLE WHEN 'click' THEN 0.045::DOUBLE WHEN 'view' THEN 0.003::DOUBLE WHEN 'error' THEN -0.11::DOUBLE WHEN 'signup' THEN -0.08::DOUBLE ELSE 0.0::DOUBLE END AS delta
 FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 60 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 500),
k AS (SELECT user_id, 'item:' || item AS key, delta AS d FROM h UNION ALL SELECT user_id, 'module:' || topic, delta * 0.8::DOUBLE FROM h),
g AS (SELECT user_id, key, CAST(sum(CAST(round(d, 6) AS DECIMAL(18,6))) AS DOUBLE) AS s FROM k GROUP BY 1, 2)
SELECT user_id, key, round(greatest(-0.18::DOUBLE, least(s, 0.18::DOUBLE)), 3) + 0.0 AS score FROM g""")
def b21(spark, sf):
    return ix.feedback_scores(interactions(spark, sf), AS_OF, FEEDBACK)


@query("b30_popularity_counters", f"""WITH {EV} SELECT item, count(*) FILTER (action = 'view') AS n_view, count(*) FILTER (action = 'click') AS n_click,
count(*) FILTER (action = 'purchase') AS n_purchase, count(*) FILTER (action = 'signup') AS n_signup, count(*) FILTER (action = 'error') AS n_error FROM ev GROUP BY 1""")
def b30(spark, sf):
    return interactions(spark, sf).groupBy("item").agg(
        *[
            F.count_if(F.col("action") == a).alias(f"n_{a}")
            for a in ("view", "click", "purchase", "signup", "error")
        ]
    )


@query("b19_daily_digest", f"""WITH {EV}, {SUGGEST}, {NEXT},
top3 AS (SELECT user_id, topic FROM wt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, topic) <= 3),
cnt AS (SELECT user_id, topic, count(*) AS n FROM ev WHERE topic IS NOT NULL GROUP BY 1, 2),
ov AS (SELECT t.user_id, c.user_id AS peer, CAST(sum(c.n) AS BIGINT) AS overlap FROM top3 t JOIN cnt c ON c.topic = t.topic AND c.user_id <> t.user_id GROUP BY 1, 2),
pr AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, peer) <= 20),
used AS (SELECT user_id, item, max(ts) AS last_ts FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 14 DAY GROUP BY 1, 2),
pt AS (SELECT p.user_id, u.item, count(DISTINCT u.user_id) AS peer_count, max(u.last_ts) AS la FROM pr p JOIN used u ON u.user_id = p.peer
 WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.user_id = p.user_id AND e.item = u.item) GROUP BY 1, 2),
week AS (SELECT user_id, count(*) AS week_total FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1),
allr AS (
 (SELECT user_id, rec_type || '_' || topic AS rec_id, score FROM sug QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_type, topic) <= 4)
 UNION ALL (SELECT user_id, rec_id, score FROM nx WHERE user_id IN (SELECT user_id FROM week) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_id) <= 2)
 UNION ALL (SELECT user_id, 'peer_' || item, round(least(0.95::DOUBLE, peer_count * 0.15::DOUBLE), 3) FROM pt QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY peer_count DESC, la DESC, item) <= 3))
SELECT user_id, rec_id, score, coalesce(week_total, 0) AS week_total, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rec_id) AS INTEGER) AS rank
FROM allr LEFT JOIN week USING (user_id) QUALIFY rank <= 8""")
def b19(spark, sf):
    ev = interactions(spark, sf)
    transitions = spark.createDataFrame(TRANSITIONS, "action string, next_action string, position int")
    week = ix.since(ev, AS_OF, 7).groupBy("user_id").agg(F.count(F.lit(1)).alias("week_total"))
    proactive = ix.proactive_suggestions(ev, adjacency(ev), AS_OF, 4).select(
        "user_id", F.concat_ws("_", "rec_type", "topic").alias("rec_id"), "score"
    )
    active = week.select("user_id")
    sequential = ix.next_actions(ev, transitions, 2).join(active, "user_id", "left_semi").select(
        "user_id", "rec_id", "score"
    )
    peers = cf.peer_recommendations(cf.peer_trending(ev, weekly_interest(ev), AS_OF, k=3)).select(
        "user_id", F.concat_ws("_", F.lit("peer"), "item").alias("rec_id"), "score"
    )
    merged = proactive.unionByName(sequential).unionByName(peers)
    best = top_per_key(merged, ["user_id"], [F.desc("score"), F.asc("rec_id")], 8)
    return best.join(week, "user_id", "left").select(
        "user_id", "rec_id", "score", F.coalesce("week_total", F.lit(0)).alias("week_total"), "rank"
    )
