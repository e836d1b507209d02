"""Streaming queries over the events and conversations files."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import query_features as qf
from folioweave.plans.corpus import TOPIC_CASE, TOPICS
from folioweave.plans.fixtures import AS_OF, AS_OF_SQL, EV, table
from folioweave.plans.registry import query
from folioweave.plans.search import DOMAINS, OVERRIDES, SESSION
from folioweave.streaming import jobs


#: After the last window over the events has closed.
STREAM_END = "2100-01-01 00:00:00"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    item = F.get_json_object("props", "$.k").cast("int")
    return jobs.file_stream(spark, sf, schema, "events.parquet").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("action"), item.alias("item"),
        F.floor(item / 4).cast("int").alias("topic"),
    )


@query("x01_intake", f"WITH {EV} SELECT action, count(*) AS n, count(DISTINCT event_id) AS ids FROM ev GROUP BY 1")
def x01(spark, sf):
    accepted, _ = jobs.take_in(event_stream(spark, sf), table(spark, sf, "events"))
    return accepted.groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids")
    )


@query("x02_running_profiles", f"""WITH {EV}, c AS (SELECT user_id, topic, count(*) AS n FROM ev GROUP BY 1, 2), k AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS total, string_agg(topic || '=' || n, ',' ORDER BY topic) AS counters FROM c GROUP BY 1),
r AS (SELECT user_id, string_agg(CAST(item AS VARCHAR), ',' ORDER BY ts, event_id) AS recent FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30) GROUP BY 1),
l AS (SELECT user_id, arg_max(action, (ts, event_id)) AS last_action FROM ev GROUP BY 1) SELECT user_id, last_action, total, counters, recent FROM k JOIN r USING (user_id) JOIN l USING (user_id)""")
def x02(spark, sf):
    path = jobs.drain(jobs.running_profiles(event_stream(spark, sf)), "update", jobs.update_batch)
    return jobs.latest_per_key(spark, path, ["user_id"])


@query("x03_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 24 HOUR) AS end_us, count(*) AS events FROM n GROUP BY user_id, no""")
def x03(spark, sf):
    path = jobs.drain_windows(jobs.sessions, event_stream(spark, sf), STREAM_END)
    return spark.read.parquet(path).drop("epoch")


@query("x04_session_preferences", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, topic, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev),
f AS (SELECT user_id, i, [topic] AS p FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN list_contains(list_slice(f.p, 1, 3), o.topic) THEN f.p ELSE list_slice([o.topic] || f.p, 1, 10) END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, least(max(i), 50) AS turns, array_to_string(arg_max(p, i), ',') AS preferences FROM f GROUP BY 1""")
def x04(spark, sf):
    path = jobs.drain(jobs.session_preferences(event_stream(spark, sf)), "update", jobs.update_batch)
    return jobs.latest_per_key(spark, path, ["user_id"])


@query("x05_expiring_context", f"WITH {EV}, l AS (SELECT user_id, arg_max(item, (ts, event_id)) AS item, arg_max(ts + to_hours(item), (ts, event_id)) AS expires FROM ev GROUP BY 1) SELECT user_id, item, epoch_us(expires) AS expires_us FROM l WHERE expires > {AS_OF_SQL}")
def x05(spark, sf):
    timed = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    cached = timed.withColumn("expires_at", F.expr("ts + make_interval(0, 0, 0, 0, item)"))
    path = jobs.drain(jobs.expiring_context(cached), "update", jobs.update_batch)
    alive = F.col("expires_us") > F.unix_micros(F.lit(AS_OF).cast("timestamp"))
    return jobs.latest_per_key(spark, path, ["user_id"]).filter(alive).select("user_id", "item", "expires_us")


@query("x06_spaced_reflections", f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM ev),
f AS (SELECT user_id, i, ts AS last, 1 AS ok FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN o.ts - f.last >= INTERVAL 24 HOUR THEN o.ts ELSE f.last END, CASE WHEN o.ts - f.last >= INTERVAL 24 HOUR THEN 1 ELSE 0 END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, CAST(sum(ok) AS BIGINT) AS allowed, CAST(sum(1 - ok) AS BIGINT) AS refused FROM f GROUP BY 1""")
def x06(spark, sf):
    path = jobs.drain(jobs.spaced_reflections(event_stream(spark, sf), 86400.0), "update", jobs.update_batch)
    return jobs.latest_per_key(spark, path, ["user_id"])


@query("x07_popularity", f"WITH {EV} SELECT item, action, count(*) AS n FROM ev GROUP BY 1, 2")
def x07(spark, sf):
    path = jobs.drain(jobs.popularity(event_stream(spark, sf)), "update", jobs.merge_counts(["item", "action"]))
    return jobs.merged_counts(spark, path, ["item", "action"])


@query("x08_incremental_corpus", f"SELECT {TOPIC_CASE} AS topic, count(*) AS docs, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def x08(spark, sf):
    def classify(stream):
        return stream.select(
            "doc_id", tx.first_label(F.lower("text"), TOPICS, "general").alias("topic"),
            tx.token_estimate(F.col("text")).alias("tokens"),
        )

    rows = jobs.incremental_corpus(spark, sf, table(spark, sf, "documents").schema, "documents.parquet", classify)
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))


@query("x08_job_status", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, count(*) AS changes FROM events GROUP BY 1")
def x08_status(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("event_id").alias("at"))
    return jobs.job_status(log)


@query("x09_sliding_topics", f"WITH {EV}, x AS (SELECT topic, date_trunc('day', ts) - to_days(CAST(d AS INTEGER)) AS s FROM ev, range(14) r(d)) SELECT epoch_us(s) AS start_us, topic, count(*) AS n FROM x GROUP BY 1, 2")
def x09(spark, sf):
    path = jobs.drain_windows(jobs.sliding_topics, event_stream(spark, sf), STREAM_END)
    return spark.read.parquet(path).drop("epoch")


@query("x10_domain_continuity", f"""WITH RECURSIVE {SESSION}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM se),
f AS (SELECT conv_id, turn, i, named AS est FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.turn, o.i, CASE WHEN o.named IS NULL THEN f.est WHEN f.est IS NULL THEN o.named WHEN o.firm THEN o.named ELSE f.est END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id AS session_id, max(turn) AS turn, coalesce(arg_max(coalesce(est, 'general'), i), 'general') AS session_domain FROM f GROUP BY 1""")
def x10(spark, sf):
    stream = jobs.file_stream(spark, sf, table(spark, sf, "conversations").schema, "conversations.parquet")
    scored = qf.domain_scores(stream, "text", DOMAINS, OVERRIDES).filter(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"), "turn", F.size(F.split("text", " ")).alias("words"),
        "domain", "domain_hits", "primary",
    )
    path = jobs.drain(jobs.domain_continuity(scored), "update", jobs.update_batch)
    return jobs.latest_per_key(spark, path, ["session_id"])
