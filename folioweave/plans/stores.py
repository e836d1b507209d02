"""Keyed stores, conversations, quality jobs and generic joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import conversations as cv
from folioweave.operators import graph_build as gb
from folioweave.operators import interactions as ix
from folioweave.operators import quality, recommend, smoke, traversal
from folioweave.operators import query_features as qf
from folioweave.operators.ranking import top_per_key
from folioweave.plans import graph
from folioweave.plans.behaviour import FEEDBACK, risk_table
from folioweave.plans.corpus import FLAGS, PII, REDACT, TOPIC_CASE, TOPICS
from folioweave.plans.fixtures import (
    ACTION_WEIGHTS, AS_OF, AS_OF_SQL, EV, LN, conversations, documents, interactions, line_blocks, structured_blocks,
    table, vectors,
)
from folioweave.plans.graph import ATEXT, GR, chunk_table, parts
from folioweave.plans.registry import query
from folioweave.plans.search import EMB, SEARCH, bench_queries, corpus_chunks, query_parts, search_results
from folioweave.plans.structure import HI, UN, structured, titles
from folioweave.rules import quality as checks
from folioweave.session import shared_folder, stage_table
from folioweave.sources import stores


def turns(spark, sf):
    return conversations(spark, sf).withColumnRenamed("conv_id", "session_id")


# --- stores -------------------------------------------------------------------

@query("s01_file_manifest")
def s01(spark, sf):
    return stores.file_manifest(spark, sf)


@query("s09_upsert", f"WITH {EV} SELECT user_id, item, arg_max(action, event_id) AS action, max(event_id) AS event_id FROM ev GROUP BY 1, 2")
def s09(spark, sf):
    ev = interactions(spark, sf).select("user_id", "item", "action", "event_id")
    old, new = ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")
    return stores.upsert(old, new, ["user_id", "item"], ["event_id"])


@query("s10_insert_keep_created", f"WITH {EV} SELECT user_id, topic, min(event_id) AS created_at, arg_max(action, event_id) AS action, max(event_id) AS event_id FROM ev GROUP BY 1, 2")
def s10(spark, sf):
    ev = interactions(spark, sf).select("user_id", "topic", "action", "event_id")
    return stores.upsert_keep_created(ev, ["user_id", "topic"], "event_id", ["event_id"])


@query("s11_delete_by_key", "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def s11(spark, sf):
    gone = table(spark, sf, "labels").filter("toxic = 1")
    return stores.delete_keys(documents(spark, sf).select("doc_id", "lang", "source"), gone, ["doc_id"])


@query("s12_ordered_read", f"WITH {LN} SELECT doc_id, pos, length(raw_text) AS n FROM ln WHERE (source = 'src1' OR doc_id % 3 = 0) AND pos < 500")
def s12(spark, sf):
    rows = line_blocks(spark, sf).withColumn("is_global", F.col("doc_id") % 3 == 0)
    seen = stores.visible(rows, "source", "src1", "is_global")
    return top_per_key(seen, ["doc_id"], [F.asc("pos")], 500).select("doc_id", "pos", F.length("raw_text").cast("bigint").alias("n"))


@query("s14_collection_stats", "SELECT 'documents' AS collection, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS n_global FROM documents UNION ALL SELECT 'events', count(*), NULL FROM events UNION ALL SELECT 'conversations', count(*), NULL FROM conversations UNION ALL SELECT 'embeddings', count(*), count(*) FILTER (label = 0) FROM embeddings")
def s14(spark, sf):
    names = ["documents", "events", "conversations", "embeddings"]
    return stores.collection_stats(
        {n: table(spark, sf, n) for n in names}, {"documents": "doc_id % 3 = 0", "embeddings": "label = 0"}
    )


@query("s15_json_reports", "SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def s15(spark, sf):
    reports = documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    stores.write_json_reports(reports, path)
    return spark.read.schema(reports.schema).json(path)


@query("s15_markdown_reports", "WITH m AS (SELECT source, 'docs' AS metric, count(*) AS value FROM documents GROUP BY 1 UNION ALL SELECT source, 'longest', max(n_chars) FROM documents GROUP BY 1) SELECT source, '| metric | value |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || metric || ' | ' || value || ' |', chr(10) ORDER BY metric) AS markdown FROM m GROUP BY 1")
def s15_markdown(spark, sf):
    base = documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.max("n_chars").alias("longest"))
    return stores.markdown_reports(base.unpivot("source", ["docs", "longest"], "metric", "value"), "source")


def trace_rows(spark, sf):
    """Events written as trace lines (every 50th line broken) and read back."""
    e = table(spark, sf, "events")
    line = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("trace_id"),
            F.lit("orchestrator").alias("module"), (F.col("event_id") % 8).cast("string").alias("stage"),
            F.col("event_type").alias("status"), F.col("ts").cast("string").alias("ts"), F.col("value").alias("duration_ms"),
        )
    )
    path = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    e.select(F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(line).alias("value")).write.text(path)
    return stores.read_traces(spark, path)


@query("s16_trace_lines", "SELECT CASE WHEN event_id % 50 = 0 THEN 'corrupt' ELSE CAST(event_id % 8 AS VARCHAR) END AS stage, count(*) AS n FROM events GROUP BY 1")
def s16(spark, sf):
    return trace_rows(spark, sf).groupBy(F.coalesce("stage", F.lit("corrupt")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("q11_trace_analytics", """WITH t AS (SELECT CAST(event_id % 8 AS VARCHAR) AS stage, event_type AS status, value AS d FROM events WHERE event_id % 50 <> 0)
SELECT stage, count(*) AS events, round(avg(CASE WHEN status = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS error_share, round(avg(d), 6) AS mean_ms, max(d) AS max_ms, quantile_disc(round(d, 2), 0.5) AS p50_ms, quantile_disc(round(d, 2), 0.95) AS p95_ms FROM t GROUP BY 1""")
def q11(spark, sf):
    return quality.stage_latency(trace_rows(spark, sf).filter(F.col("stage").isNotNull()))


@query("s17_reference_seed", f"WITH {EV} SELECT DISTINCT topic AS risk_id, len(list_distinct([topic, (topic * 2) % 25, (topic + 7) % 25])) AS n_topics FROM ev")
def s17(spark, sf):
    ev = interactions(spark, sf)
    risks = risk_table(ev).select("risk_id", F.size("related_topics").cast("bigint").alias("n_topics"))
    once = stores.seed(risks.filter("risk_id % 2 = 0"), risks, ["risk_id"])
    return stores.seed(once, risks, ["risk_id"])


# --- predicates ---------------------------------------------------------------

@query("p02_visibility", "SELECT doc_id, source FROM documents WHERE source = 'src3' OR doc_id % 7 = 0")
def p02(spark, sf):
    rows = documents(spark, sf).select("doc_id", "source", (F.col("doc_id") % 7 == 0).alias("g"))
    return stores.visible(rows, "source", "src3", "g").drop("g")


@query("p03_not_null", f"WITH {EV}, n AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN NULL ELSE topic END AS t FROM ev) SELECT t AS topic, count(*) AS n FROM n WHERE t IS NOT NULL GROUP BY 1")
def p03(spark, sf):
    ev = interactions(spark, sf).withColumn("topic", F.when(F.col("event_id") % 9 != 0, F.col("topic")))
    return ix.known_topic(ev).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("p04_time_cutoff", f"WITH {EV} SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM ev WHERE ts >= {AS_OF_SQL} - INTERVAL 3 DAY GROUP BY 1")
def p04(spark, sf):
    return ix.since(interactions(spark, sf), AS_OF, 3).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    )


@query("p11_system_rows", f"WITH {EV} SELECT item, count(*) AS n FROM ev WHERE item NOT IN (0, 50, 99) GROUP BY 1")
def p11(spark, sf):
    return ix.without_system_items(interactions(spark, sf), [0, 50, 99]).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


# --- joins --------------------------------------------------------------------

@query("j01_self_join", f"WITH {EV}, p AS (SELECT user_id, topic, count(*) AS bought FROM ev WHERE action = 'purchase' GROUP BY 1, 2), a AS (SELECT user_id, topic, count(*) AS total FROM ev GROUP BY 1, 2) SELECT user_id, topic, bought, total FROM p JOIN a USING (user_id, topic)")
def j01(spark, sf):
    ev = interactions(spark, sf)
    bought = ev.filter("action = 'purchase'").groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("bought"))
    total = ev.groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("total"))
    return bought.join(total, ["user_id", "topic"])


@query("j02_semi_join", f"WITH {EV} SELECT user_id, count(*) AS n FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE item = 7) GROUP BY 1")
def j02(spark, sf):
    ev = interactions(spark, sf)
    return ev.join(ev.filter("item = 7").select("user_id"), "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("j03_anti_join", f"WITH {EV}, u AS (SELECT DISTINCT user_id, item FROM ev) SELECT user_id, item FROM u WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.user_id = u.user_id AND p.item = u.item AND p.action = 'error')")
def j03(spark, sf):
    ev = interactions(spark, sf)
    bad = ev.filter("action = 'error'").select("user_id", "item")
    return ev.select("user_id", "item").distinct().join(bad, ["user_id", "item"], "left_anti")


@query("j04_array_membership", f"WITH {EV}, rk AS (SELECT risk_id, unnest(list_distinct([risk_id, (risk_id * 2) % 25, (risk_id + 7) % 25])) AS topic FROM (SELECT DISTINCT topic AS risk_id FROM ev)), c AS (SELECT topic, count(*) AS n FROM ev GROUP BY 1) SELECT risk_id, CAST(sum(n) AS BIGINT) AS events FROM rk JOIN c USING (topic) GROUP BY 1")
def j04(spark, sf):
    ev = interactions(spark, sf)
    counts = ev.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return risk_table(ev).select("risk_id", F.explode("related_topics").alias("topic")).join(counts, "topic").groupBy("risk_id").agg(
        F.sum("n").alias("events")
    )


@query("j05_inner_unwind", "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}')) AS number FROM documents")
def j05(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{3,}"), F.lit(0))).alias("number"))


@query("j12_dictionary_join", f"WITH {EV} SELECT action, w, count(*) AS n FROM ev JOIN (VALUES ('purchase', 3.0::DOUBLE), ('signup', 2.0::DOUBLE), ('view', 1.0::DOUBLE)) d(a, w) ON d.a = ev.action GROUP BY 1, 2")
def j12(spark, sf):
    weights = spark.createDataFrame(list(ACTION_WEIGHTS.items()), "action string, w double")
    return interactions(spark, sf).join(F.broadcast(weights), "action").groupBy("action", "w").agg(F.count(F.lit(1)).alias("n"))


@query("q_set_operations", f"WITH {EV} SELECT topic, count(*) AS n FROM (SELECT DISTINCT user_id, topic FROM ev WHERE action = 'view' UNION SELECT user_id, topic FROM ev WHERE action = 'click') GROUP BY 1")
def set_ops(spark, sf):
    ev = interactions(spark, sf)
    views = ev.filter("action = 'view'").select("user_id", "topic")
    clicks = ev.filter("action = 'click'").select("user_id", "topic")
    return views.unionByName(clicks).distinct().groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


# --- windows ------------------------------------------------------------------

@query("w07_first_occurrence", rf"WITH {LN} SELECT doc_id, pos, min(pos) OVER (PARTITION BY doc_id, lower(raw_text)) AS first_pos FROM ln WHERE length(raw_text) > 40")
def w07(spark, sf):
    same = Window.partitionBy("doc_id", F.lower("raw_text"))
    return line_blocks(spark, sf).filter(F.length("raw_text") > 40).select("doc_id", "pos", F.min("pos").over(same).alias("first_pos"))


@query("w09_bounded_history", "WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id AS session_id, string_agg(text, '|' ORDER BY turn) AS history FROM l GROUP BY 1")
def w09(spark, sf):
    return cv.bounded_history(turns(spark, sf), "session_id", "turn", 3).select(
        "session_id", F.array_join("history", "|").alias("history")
    )


@query("w10_top_hours", f"WITH {EV}, c AS (SELECT item, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY 1, 2) SELECT item, hour, n, CAST(row_number() OVER (PARTITION BY item ORDER BY n DESC, hour) AS INTEGER) AS rank FROM c QUALIFY rank <= 3")
def w10(spark, sf):
    counts = interactions(spark, sf).groupBy("item", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, ["item"], [F.desc("n"), F.asc("hour")], 3)


@query("w12_first_non_empty", "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_user_text, arg_min(role, turn) FILTER (length(text) > 100) AS first_long_role FROM conversations GROUP BY 1")
def w12(spark, sf):
    user, long = F.col("role") == "user", F.length("text") > 100
    return conversations(spark, sf).groupBy("conv_id").agg(
        F.min_by("text", F.when(user, F.col("turn"))).alias("first_user_text"),
        F.min_by("role", F.when(long, F.col("turn"))).alias("first_long_role"),
    )


# --- conversations ------------------------------------------------------------

@query("b31_session_summaries", "SELECT conv_id AS session_id, count(*) AS turns, max(turn) AS last_turn, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 60) AS title FROM conversations GROUP BY 1")
def b31(spark, sf):
    return cv.session_summaries(turns(spark, sf))


ACTIONS = [
    cv.Action("evidence_gap", "evidence", 0.40, (("has_the", 0.2), ("is_long", 0.1))),
    cv.Action("law_search", "search", 0.45, (("has_und", 0.2),)),
    cv.Action("action_plan", "plan", 0.30, (("is_user", 0.15), ("has_the", 0.1))),
    cv.Action("risk_review", "risk", 0.25, (("is_long", 0.3),)),
    cv.Action("timeline", "plan", 0.20, (("has_les", 0.25),)),
    cv.Action("similar_cases", "search", 0.35, ()),
    cv.Action("contract_review", "contract", 0.10, (("has_que", 0.5),)),
    cv.Action("checklist", "plan", 0.15, (("has_und", 0.1), ("has_les", 0.1))),
    cv.Action("journey", "plan", 0.33, (("is_user", 0.05),)),
]
GOAL_BOOSTS = [("divorce", "evidence_gap", 0.12), ("divorce", "timeline", 0.15), ("debt", "law_search", 0.10), ("land", "risk_review", 0.20), ("debt", "risk_review", 0.08)]
GOALS = [("divorce", ["ment", "ung"]), ("debt", ["ther", "que"]), ("land", ["tion"])]
FLAGS_SQL = {"has_the": "contains(low, ' the ')", "has_und": "contains(low, ' und ')", "has_les": "contains(low, ' les ')", "has_que": "contains(low, ' que ')", "is_long": "length(text) > 200", "is_user": "role = 'user'"}
GOAL_SQL = {"divorce": "(contains(f, 'ment') OR contains(f, 'ung'))", "debt": "(contains(f, 'ther') OR contains(f, 'que'))", "land": "contains(f, 'tion')"}


def _action_sql(a):
    total = " + ".join([f"{a.base}::DOUBLE"] + [f"CASE WHEN {FLAGS_SQL[f]} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for f, v in a.bonuses])
    boost = " + ".join(["0.0::DOUBLE"] + [f"CASE WHEN {GOAL_SQL[g]} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for g, aid, v in GOAL_BOOSTS if aid == a.action_id])
    return f"SELECT context_id, user_id, '{a.action_id}' AS action_id, '{a.module}' AS module, least(greatest(0.0::DOUBLE, least({total}, 0.98::DOUBLE)) + least({boost}, 0.22::DOUBLE), 0.98::DOUBLE) AS score FROM cx"


NBA_SQL = (
    "cx AS (SELECT conv_id * 1000 + turn AS context_id, conv_id AS user_id, role, text, lower(text) AS low, replace(strip_accents(lower(text)), 'đ', 'd') AS f FROM conversations), sc AS ("
    + " UNION ALL ".join(_action_sql(a) for a in ACTIONS)
    + f"), fb AS (SELECT user_id, 'item:' || (['evidence_gap', 'law_search', 'risk_review'])[item % 3 + 1] AS key, round(sum(CASE action WHEN 'purchase' THEN 0.01::DOUBLE WHEN 'error' THEN -0.02::DOUBLE ELSE 0.0::DOUBLE END), 6) AS delta FROM ev GROUP BY 1, 2),"
    + " fs AS (SELECT s.context_id, s.action_id, sum(f.delta) AS delta FROM sc s JOIN fb f ON f.user_id = s.user_id AND f.key = 'item:' || s.action_id GROUP BY 1, 2),"
    + " nb AS (SELECT s.context_id, s.action_id, round(greatest(0.0::DOUBLE, least(s.score + coalesce(f.delta, 0.0::DOUBLE), 0.98::DOUBLE)), 3) AS score FROM sc s LEFT JOIN fs f USING (context_id, action_id))"
)


@query("b22_next_best_actions", f"WITH {EV}, {NBA_SQL} SELECT context_id, action_id, score, CAST(row_number() OVER (PARTITION BY context_id ORDER BY score DESC, action_id) AS INTEGER) AS rank FROM nb WHERE score >= 0.34 QUALIFY rank <= 6")
def b22(spark, sf):
    low = F.lower("text")
    folded = tx.fold_accents(F.col("text"))
    contexts = conversations(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("context_id"), F.col("conv_id").alias("user_id"),
        *[F.contains(low, F.lit(f" {w} ")).alias(f"has_{w}") for w in ("the", "und", "les", "que")],
        (F.length("text") > 200).alias("is_long"), (F.col("role") == "user").alias("is_user"),
        F.array_compact(F.array(*[F.when(tx.any_term(folded, ws), F.lit(g)) for g, ws in GOALS])).alias("goals"),
    )
    names = F.array(*map(F.lit, ["evidence_gap", "law_search", "risk_review"]))
    feedback = interactions(spark, sf).groupBy(
        "user_id", F.concat(F.lit("item:"), F.element_at(names, F.col("item") % 3 + 1)).alias("key")
    ).agg(F.round(F.sum(ix.action_weight({"purchase": 0.01, "error": -0.02}, 0.0)), 6).alias("score"))
    return cv.next_best_actions(contexts, ACTIONS, GOAL_BOOSTS, feedback, 6)


QUESTIONS = [("divorce", "children?", ["kind", "en"]), ("divorce", "assets?", ["au"]), ("debt", "amount?", ["an"]), ("land", "title?", ["st"]), ("land", "since?", ["ou"])]


@query("b23_goal_profiles", """WITH cx AS (SELECT conv_id * 1000 + turn AS text_id, replace(strip_accents(lower(text)), 'đ', 'd') AS f FROM conversations),
g AS (SELECT *, contains(f, 'ment') OR contains(f, 'ung') AS a, contains(f, 'ther') OR contains(f, 'que') AS b, contains(f, 'tion') AS c FROM cx)
SELECT text_id, CASE WHEN a OR b OR c THEN concat_ws(',', CASE WHEN a THEN 'divorce' END, CASE WHEN b THEN 'debt' END, CASE WHEN c THEN 'land' END) ELSE 'clarify_legal_goal' END AS goals, CASE WHEN contains(f, 'wh') THEN 'buyer' WHEN contains(f, 'sch') THEN 'seller' ELSE 'general_user' END AS position,
array_to_string(list_slice(list_filter([CASE WHEN a AND NOT (contains(f, 'kind') OR contains(f, 'en')) THEN 'children?' END, CASE WHEN a AND NOT contains(f, 'au') THEN 'assets?' END, CASE WHEN b AND NOT contains(f, 'an') THEN 'amount?' END, CASE WHEN c AND NOT contains(f, 'st') THEN 'title?' END, CASE WHEN c AND NOT contains(f, 'ou') THEN 'since?' END], lambda x: x IS NOT NULL), 1, 4), ',') AS questions FROM g""")
def b23(spark, sf):
    rows = conversations(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    out = cv.goal_profile(rows, "text", GOALS, [("buyer", ["wh"]), ("seller", ["sch"])], QUESTIONS)
    return out.select("text_id", F.array_join("goals", ",").alias("goals"), "position", F.array_join("open_questions", ",").alias("questions"))


@query("b24_template_lookup", """WITH it AS (SELECT doc_id AS item_id, n_chars AS priority, unnest(list_distinct([lang, CASE WHEN doc_id % 11 = 0 THEN 'general' ELSE source END])) AS tag FROM documents),
r AS (SELECT conv_id AS request_id, unnest([(['en', 'fr', 'de', 'es'])[conv_id % 4 + 1], 'general']) AS tag FROM (SELECT DISTINCT conv_id FROM conversations)), d AS (SELECT DISTINCT request_id, item_id, priority FROM r JOIN it USING (tag))
SELECT request_id, item_id, priority, CAST(row_number() OVER (PARTITION BY request_id ORDER BY priority, item_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5""")
def b24(spark, sf):
    items = documents(spark, sf).select(
        F.col("doc_id").alias("item_id"), F.col("n_chars").alias("priority"),
        F.array_distinct(F.array("lang", F.when(F.col("doc_id") % 11 == 0, F.lit("general")).otherwise(F.col("source")))).alias("tags"),
    )
    tags = F.array(*map(F.lit, ["en", "fr", "de", "es"]))
    requests = conversations(spark, sf).select("conv_id").distinct().select(
        F.col("conv_id").alias("request_id"), F.element_at(tags, (F.col("conv_id") % 4 + 1).cast("int")).alias("tag")
    )
    return cv.by_profile(items, requests)


@query("b25_checklist_progress", f"""WITH {EV}, en AS (SELECT source AS list_id, unnest(range(20)) AS e FROM (SELECT DISTINCT source FROM documents)), ck AS (SELECT DISTINCT user_id, 'src' || (item % 20) AS list_id, item % 25 AS e FROM ev),
t AS (SELECT list_id, count(*) AS total FROM en GROUP BY 1), d AS (SELECT user_id, list_id, count(*) AS done FROM ck JOIN en USING (list_id, e) GROUP BY 1, 2), u AS (SELECT DISTINCT user_id, list_id FROM ck)
SELECT user_id, list_id, coalesce(done, 0) AS done, total, round(coalesce(done, 0) / total::DOUBLE, 6) AS progress FROM u JOIN t USING (list_id) LEFT JOIN d USING (user_id, list_id)""")
def b25(spark, sf):
    lists = documents(spark, sf).select("source").distinct().select(
        F.col("source").alias("list_id"), F.sequence(F.lit(0), F.lit(19)).alias("entries")
    )
    checked = interactions(spark, sf).select(
        "user_id", F.concat(F.lit("src"), F.col("item") % 20).alias("list_id"), (F.col("item") % 25).alias("entry")
    )
    return cv.checklist_progress(lists, checked)


@query("b25_checklist_lookup", """WITH it AS (SELECT doc_id AS item_id, n_chars AS priority, CASE WHEN doc_id % 11 = 0 THEN 'general' ELSE lang END AS business, source AS deal FROM documents),
rq AS (SELECT conv_id AS request_id, CASE WHEN conv_id % 5 <> 0 THEN (['en', 'fr', 'de', 'es'])[conv_id % 4 + 1] END AS business, CASE WHEN conv_id % 3 <> 0 THEN 'src' || (conv_id % 20) END AS deal FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT request_id, item_id, priority, CAST(row_number() OVER (PARTITION BY request_id ORDER BY priority, item_id) AS INTEGER) AS rank FROM rq JOIN it ON (rq.business IS NULL OR it.business IN (rq.business, 'general')) AND (rq.deal IS NULL OR it.deal = rq.deal) QUALIFY rank <= 5""")
def b25_lookup(spark, sf):
    d, c = F.col("doc_id"), F.col("conv_id")
    items = documents(spark, sf).select(
        d.alias("item_id"), F.col("n_chars").alias("priority"), F.when(d % 11 == 0, "general").otherwise(F.col("lang")).alias("business"),
        F.col("source").alias("deal"),
    )
    names = F.array(*map(F.lit, ["en", "fr", "de", "es"]))
    requests = conversations(spark, sf).select("conv_id").distinct().select(
        c.alias("request_id"), F.when(c % 5 != 0, F.element_at(names, (c % 4 + 1).cast("int"))).alias("business"),
        F.when(c % 3 != 0, F.concat(F.lit("src"), c % 20)).alias("deal"),
    )
    return recommend.lookup(items, requests, ["business", "deal"], 5, {"business": "general"})


def tagged_vectors(spark, sf):
    """Vectors as templates: the industry from the label, the kind from the id; every third request has no vector, some no filter."""
    v, label = F.col("vec_id"), F.col("label").cast("string")
    rows = vectors(spark, sf)
    items = rows.select(
        v.alias("item_id"), F.col("embedding").alias("vector"), (v % 17).alias("priority"),
        F.when(v % 7 == 0, "general").otherwise(label).alias("industry"), (v % 3).cast("string").alias("kind"),
    )
    requests = rows.select(
        v.alias("request_id"), F.when(v % 3 != 1, F.col("embedding")).alias("vector"),
        F.when(v % 4 != 0, label).alias("industry"), F.when(v % 5 != 0, (v % 4).cast("string")).alias("kind"),
    )
    return items, requests


@query("b24_template_recommendations", f"""WITH {EMB}, it AS (SELECT vec_id AS item_id, v, vec_id % 17 AS priority, CASE WHEN vec_id % 7 = 0 THEN 'general' ELSE CAST(label AS VARCHAR) END AS industry, CAST(vec_id % 3 AS VARCHAR) AS kind FROM e),
rq AS (SELECT vec_id AS request_id, CASE WHEN vec_id % 3 <> 1 THEN v END AS q, CASE WHEN vec_id % 4 <> 0 THEN CAST(label AS VARCHAR) END AS industry, CASE WHEN vec_id % 5 <> 0 THEN CAST(vec_id % 4 AS VARCHAR) END AS kind FROM e),
nr AS (SELECT request_id, item_id, 'vector' AS method, round(list_cosine_similarity(q, v), 6) AS score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, item_id) AS INTEGER) AS rank FROM rq JOIN it ON (rq.industry IS NULL OR rq.industry = it.industry) AND (rq.kind IS NULL OR rq.kind = it.kind) WHERE q IS NOT NULL QUALIFY rank <= 5)
SELECT * FROM nr UNION ALL (SELECT request_id, item_id, 'profile', NULL, CAST(row_number() OVER (PARTITION BY request_id ORDER BY priority, item_id) AS INTEGER) AS rank FROM rq JOIN it ON (rq.industry IS NULL OR it.industry IN (rq.industry, 'general')) AND (rq.kind IS NULL OR rq.kind = it.kind) WHERE request_id NOT IN (SELECT request_id FROM nr) QUALIFY rank <= 5)""")
def b24_recommendations(spark, sf):
    return recommend.recommend_templates(*tagged_vectors(spark, sf), ["industry", "kind"], 5, {"industry": "general"})


@query("b26_risk_recommendations", rf"""WITH {EMB}, it AS (SELECT item_id, lower(text) AS low, v FROM benchmark b LEFT JOIN e ON e.vec_id = b.item_id),
rq AS (SELECT conv_id * 1000 + turn AS request_id, list_distinct(list_slice(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: length(w) >= 4), 1, 6)) AS words, CASE WHEN conv_id % 2 = 0 THEN v END AS q FROM conversations c LEFT JOIN e ON e.vec_id = c.conv_id),
nr AS (SELECT request_id, item_id, 'vector' AS method, round(list_cosine_similarity(q, v), 6) AS score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(list_cosine_similarity(q, v), 6) DESC, item_id) AS INTEGER) AS rank FROM rq, it WHERE q IS NOT NULL AND v IS NOT NULL QUALIFY rank <= 6),
kw AS (SELECT request_id, item_id, len(list_filter(words, lambda w: contains(low, w)))::DOUBLE AS hits FROM rq, it WHERE request_id NOT IN (SELECT request_id FROM nr))
SELECT * FROM nr UNION ALL (SELECT request_id, item_id, 'keyword', hits, CAST(row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, item_id) AS INTEGER) AS rank FROM kw WHERE hits > 0 QUALIFY rank <= 6)""")
def b26_recommendations(spark, sf):
    known = vectors(spark, sf).select("vec_id", F.col("embedding").alias("vector"))
    risks = table(spark, sf, "benchmark").join(known, F.col("item_id") == F.col("vec_id"), "left").select("item_id", F.col("text").alias("description"), "vector")
    asked = conversations(spark, sf).join(known, F.col("conv_id") == F.col("vec_id"), "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text", F.when(F.col("conv_id") % 2 == 0, F.col("vector")).alias("vector")
    )
    return recommend.recommend_risks(risks, asked, 6)


RISKS = [("dismissal", ["keit", "ung", "heit"]), ("boundary", [" the ", "wh", "th"]), ("breach", ["eau", "tion", "ment"]), ("fraud", ["ción", "que"])]


@query("b26_keyword_risks", "WITH c AS (SELECT conv_id * 1000 + turn AS text_id, lower(text) AS low FROM conversations), s AS (" + " UNION ALL ".join(f"SELECT text_id, '{r}' AS risk, CAST({' + '.join(f'''CAST(contains(low, '{w}') AS INTEGER)''' for w in ws)} AS INTEGER) AS hits FROM c" for r, ws in RISKS) + ") SELECT text_id, risk, hits, CAST(row_number() OVER (PARTITION BY text_id ORDER BY hits DESC, risk) AS INTEGER) AS rank FROM s WHERE hits > 0 QUALIFY rank <= 3")
def b26(spark, sf):
    rows = conversations(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "text")
    return cv.keyword_risks(rows, RISKS)


PATTERNS = rf"""{REDACT}, ps AS (SELECT doc_id, CASE WHEN length(s) < 10 THEN 'Tình huống pháp lý cần tư vấn.' ELSE s END AS s, {TOPIC_CASE} AS domain, n_email + n_phone + n_card + n_address AS n FROM (SELECT *, trim(regexp_replace(t4, '\s{{2,}}', ' ', 'g')) AS s FROM r3)),
pp AS (SELECT substr(md5(s), 1, 12) AS pattern_id, min(s) AS summary, arg_min(domain, doc_id) AS domain, count(*) AS impressions, CAST(sum(n) AS BIGINT) AS redactions FROM ps GROUP BY 1)"""


def patterns(spark, sf):
    cases = documents(spark, sf).select(
        F.col("doc_id").alias("case_id"), "text", tx.first_label(F.lower("text"), TOPICS, "general").alias("domain")
    )
    return cv.publish_patterns(cases, PII)


@query("b28_publish_patterns", f"WITH {PATTERNS} SELECT pattern_id, md5(summary) AS digest, domain, impressions, redactions FROM pp")
def b28(spark, sf):
    return patterns(spark, sf).select("pattern_id", F.md5("summary").alias("digest"), "domain", "impressions", "redactions")


@query("b29_search_patterns", f"WITH {PATTERNS} SELECT pattern_id, domain, impressions, length(summary) % 50 AS useful FROM pp WHERE contains(lower(summary || ' ' || domain || ' ' || substr(pattern_id, 1, 2)), 'license') OR contains(lower(summary || ' ' || domain || ' ' || substr(pattern_id, 1, 2)), 'example') ORDER BY useful DESC, impressions DESC, pattern_id LIMIT 10")
def b29(spark, sf):
    base = patterns(spark, sf).withColumns(
        {"tags": F.array(F.substring("pattern_id", 1, 2)), "useful": (F.length("summary") % 50).cast("bigint")}
    )
    return cv.search_patterns(base, ["license", "example"], None, 10).select("pattern_id", "domain", "impressions", "useful")


# --- quality ------------------------------------------------------------------

METRICS = UN + """,
qs AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (unit = 'section') AS sections, count(*) FILTER (unit = 'article') AS articles, count(*) FILTER (unit = 'clause') AS clauses, count(*) FILTER (unit = 'article' AND cur_section IS NOT NULL) AS articles_with_section FROM hi GROUP BY 1),
qc AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (idx % 9 = 4) AS degraded_chunks, count(*) FILTER (idx % 9 <> 4 AND 0.5::DOUBLE + (idx % 5) / 10.0::DOUBLE >= 0.65) AS authoritative_chunks, round(avg(length(label) // 4), 4) AS mean_tokens, CAST(max(length(label) // 4) AS INTEGER) AS max_tokens, CAST(min(length(label) // 4) AS INTEGER) AS min_tokens FROM un WHERE unit = 'article' GROUP BY 1),
qm AS (SELECT *, CASE WHEN clauses > 0 THEN 3 WHEN articles > 0 THEN 2 WHEN sections > 0 THEN 1 ELSE 0 END AS depth, CASE WHEN articles > 0 AND sections > 0 THEN 'hierarchical' WHEN articles > 0 THEN 'article_level' WHEN sections > 0 THEN 'section_level' ELSE 'flat' END AS structure_quality FROM qs LEFT JOIN qc USING (doc_id))"""


def metrics(spark, sf):
    s, u = parts(spark, sf)
    chunks = chunk_table(u).withColumn("tokens", tx.token_estimate(F.col("label")))
    return quality.document_metrics(s, chunks)


@query("q01_document_metrics", f"WITH {METRICS} SELECT doc_id, blocks, sections, articles, clauses, articles_with_section, chunks, degraded_chunks, authoritative_chunks, mean_tokens, max_tokens, min_tokens, depth, structure_quality FROM qm")
def q01(spark, sf):
    return metrics(spark, sf)


@query("q02_missing_content", f"WITH {LN}, p AS (SELECT doc_id, CAST(unnest(range(1, greatest(1, length(text) // 500) + 1)) AS INTEGER) AS page FROM documents), x AS (SELECT DISTINCT doc_id, CAST(pos // 2 + 1 AS INTEGER) AS page FROM ln) SELECT doc_id, page FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = p.doc_id AND x.page = p.page)")
def q02(spark, sf):
    profiled = documents(spark, sf).select(
        "doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 500)).cast("int").alias("page_count")
    )
    extracted = line_blocks(spark, sf).select("doc_id", (F.floor(F.col("pos") / 2) + 1).cast("int").alias("page"))
    return quality.missing_content(profiled, extracted)


def _sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


CHECK_SQL = f"""qb0 AS (SELECT doc_id, pos, regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') AS s, 0.5::DOUBLE + (pos % 5) / 10.0::DOUBLE AS confidence FROM ln),
qb AS (SELECT doc_id, count(*) AS blocks, round(count(*) FILTER (s <> '') / count(*)::DOUBLE, 6) AS coverage, count(*) FILTER ((doc_id + pos) % 97 = 0) AS unplaced_blocks, count(*) FILTER (s IN ({_sql_list(checks.PLACEHOLDERS)}) AND confidence > {checks.PLACEHOLDER_CONFIDENCE}) AS placeholder_blocks,
 count(*) FILTER (confidence < {checks.LOW_CONFIDENCE}) AS low_blocks, count(*) FILTER (pos % 9 = 4) AS degraded_blocks FROM qb0 GROUP BY 1),
qr AS (SELECT doc_id, count(*) FILTER (contains(raw_text, ',')) AS n_rows FROM ln GROUP BY 1),
qh AS (SELECT doc_id, count(*) AS chunks, count(*) FILTER (regexp_replace(label, '^\\s+|\\s+$', '', 'g') = '') AS empty_chunks, count(*) FILTER (degraded) AS degraded_chunks, count(*) FILTER (CAST(right(chunk_id, 5) AS INTEGER) % 13 = 12) AS unplaced_chunks FROM gch GROUP BY 1),
qn AS (SELECT doc_id, count(*) AS graph_nodes, count(*) FILTER (node_type IN ('Section', 'Article', 'Clause')) AS structure_units FROM nodes GROUP BY 1),
qe AS (SELECT doc_id, count(*) AS structural_edges FROM e0 WHERE edge_type IN ('CONTAINS', 'DERIVED_TO_CHUNK') GROUP BY 1),
qf AS (SELECT d.doc_id, blocks, coverage, unplaced_blocks, placeholder_blocks, low_blocks, degraded_blocks, CAST(n_rows = 0 AS BIGINT) AS broken_tables, CAST(0.5::DOUBLE + (d.doc_id % 5) / 10.0::DOUBLE < {checks.LOW_TABLE_CONFIDENCE} AS BIGINT) AS low_tables, coalesce(chunks, 0) AS chunks, coalesce(empty_chunks, 0) AS empty_chunks,
 coalesce(degraded_chunks, 0) AS degraded_chunks, coalesce(unplaced_chunks, 0) AS unplaced_chunks, graph_nodes, structure_units, coalesce(structural_edges, 0) AS structural_edges FROM documents d JOIN qb USING (doc_id) JOIN qr USING (doc_id) LEFT JOIN qh USING (doc_id) JOIN qn USING (doc_id) LEFT JOIN qe USING (doc_id)),
qk AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS check_name, '{s}' AS severity, {e} AS passed FROM qf" for n, s, e in checks.DOCUMENT_CHECKS)})"""


def checked_documents(spark, sf):
    """Facts of the checks: lines are blocks, lines with a comma the rows of the one table, articles are chunks."""
    _, u = parts(spark, sf)
    lines = line_blocks(spark, sf)
    filled = F.regexp_replace("raw_text", r"^\s+|\s+$", "") != ""
    pos = F.col("pos")
    blocks = lines.select(
        "doc_id", "raw_text", F.when((F.col("doc_id") + pos) % 97 != 0, F.floor(pos / 2)).alias("page"),
        (F.lit(0.5) + pos % 5 / 10.0).alias("confidence"), (pos % 9 == 4).alias("degraded"),
    )
    cells = F.filter(F.split("text", "\n"), lambda line: F.contains(line, F.lit(",")))
    tables = documents(spark, sf).select(
        "doc_id", F.size(cells).alias("n_rows"),
        F.coalesce(F.array_max(F.transform(cells, lambda line: F.size(F.split(line, ",")))), F.lit(0)).alias("n_columns"),
        (F.lit(0.5) + F.col("doc_id") % 5 / 10.0).alias("confidence"),
    )
    cut = chunk_table(u)
    number = F.right("chunk_id", F.lit(5)).cast("int")
    chunks = cut.select("doc_id", F.col("label").alias("content"), "degraded", (number % 13 != 12).cast("int").alias("n_refs"))
    nodes = gb.structure_nodes(u, titles(spark, sf)).unionByName(gb.chunk_nodes(cut))
    edges = gb.containment_edges(u).unionByName(gb.chunk_edges(cut))
    coverage = lines.groupBy("doc_id").agg(F.round(F.avg(filled.cast("double")), 6).alias("coverage"))
    return quality.document_facts(coverage, blocks, tables, chunks, nodes, edges)


def checked(spark, sf):
    return quality.check_suite(checked_documents(spark, sf), checks.DOCUMENT_CHECKS)


@query("q03_check_suite", f"WITH {GR}, {CHECK_SQL} SELECT doc_id, check_name, severity, passed FROM qk")
def q03(spark, sf):
    return checked(spark, sf).withColumnRenamed("check", "check_name")


@query("q03_risk_warnings", f"""WITH {GR}, {CHECK_SQL}, w AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS warning, {e} AS n FROM qf" for n, e in checks.RISK_WARNINGS)}) SELECT doc_id, warning, n FROM w WHERE n > 0""")
def q03_warnings(spark, sf):
    return quality.risk_warnings(checked_documents(spark, sf))


@query("q04_run_rollup", f"WITH {GR}, {CHECK_SQL} SELECT doc_id, count(*) AS checks, count(*) FILTER (NOT passed) AS failed, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (NOT passed), '') AS failed_checks, CASE max(CASE WHEN NOT passed AND severity = 'fail' THEN 2 WHEN NOT passed THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'pass' END AS status FROM qk GROUP BY 1")
def q04(spark, sf):
    return quality.run_rollup(checked(spark, sf), "doc_id")


LANG_SQL = "CASE WHEN doc_id % 9 = 8 THEN 'mixed' WHEN doc_id % 3 = 1 THEN 'en' ELSE 'vi' END"


def _language():
    d = F.col("doc_id")
    return F.when(d % 9 == 8, "mixed").when(d % 3 == 1, "en").otherwise("vi")


def _smoke_words(language):
    always, article, clause, labels = checks.SMOKE_QUERIES[language]
    arr = lambda ws: "[" + _sql_list(ws) + "]"
    parts = [arr(always), f"CASE WHEN f_article THEN {arr(article)} ELSE [] END", f"CASE WHEN f_clause THEN {arr(clause)} ELSE [] END"]
    parts += [f"CASE WHEN f_{w} THEN ['{w}'] ELSE [] END" for w, _ in labels]
    return "flatten([" + ", ".join(parts) + "])"


_LABEL_FLAGS = ", ".join(
    f"bool_or(unit = 'section' AND contains(lower(label), '{w}')" + (f" AND NOT contains(lower(label), '{o}')" if o else "") + f") AS f_{w}"
    for _, _, _, labels in checks.SMOKE_QUERIES.values() for w, o in labels
)
SMOKE = UN + rf""", {ATEXT},
sl AS (SELECT doc_id, {LANG_SQL} AS language FROM documents),
su AS (SELECT doc_id, bool_or(unit = 'article') AS f_article, bool_or(unit = 'clause') AS f_clause, {_LABEL_FLAGS}, list(regexp_extract(label, '(?i)^\s*(?:điều|article|section|§)\s*([0-9]+[a-zđ]?)', 1) ORDER BY idx) FILTER (unit = 'article' AND idx < 3) AS numbers FROM un GROUP BY 1),
sg AS (SELECT doc_id, language, CASE language WHEN 'vi' THEN {_smoke_words('vi')} WHEN 'mixed' THEN {_smoke_words('mixed')} ELSE {_smoke_words('en')} END AS named, list_filter(coalesce(numbers, []), lambda n: n <> '') AS numbers FROM sl LEFT JOIN su USING (doc_id)),
sp AS (SELECT doc_id, language, list_slice(CASE WHEN len(named) > 0 THEN named WHEN language = 'en' THEN ['article', 'clause'] ELSE ['điều', 'khoản'] END, 1, 10) AS p, CASE language WHEN 'vi' THEN list_transform(numbers, lambda n: 'Article ' || n) WHEN 'en' THEN list_transform(numbers, lambda n: 'Điều ' || n) ELSE [] END AS x FROM sg),
sq AS (SELECT doc_id, language, 'primary' AS kind, unnest(p) AS text, unnest(range(len(p))) AS place, NULL AS ref FROM sp UNION ALL SELECT doc_id, language, 'cross', unnest(x), unnest(range(len(x))) + 16, 'article_' || regexp_extract(unnest(x), '[0-9]+') FROM sp),
st0 AS (SELECT doc_id, place, unnest(list_distinct(list_filter(list_concat(regexp_split_to_array(lower(text), '\s+'), [ref]), lambda w: w <> ''))) AS term FROM sq),
sa(concept, alias) AS (VALUES {', '.join(f"('{c}', '{a}')" for c, a in checks.BILINGUAL_ALIASES)}),
st AS (SELECT doc_id, place, term FROM st0 WHERE length(term) >= 2 UNION SELECT doc_id, place, b.alias FROM st0 JOIN sa a ON a.alias = term JOIN sa b ON b.concept = a.concept),
sc AS (SELECT x.doc_id, x.article_no, lower(x.text) AS low, u.ref FROM atx x JOIN un u ON u.doc_id = x.doc_id AND u.unit = 'article' AND u.idx = x.article_no),
sh AS (SELECT doc_id, place, article_no FROM st JOIN sc USING (doc_id) WHERE contains(low, term) UNION SELECT q.doc_id, place, article_no FROM sq q JOIN sc ON sc.doc_id = q.doc_id AND sc.ref = q.ref),
sn AS (SELECT q.*, least(coalesce(h.n, 0), 20) AS hits FROM sq q LEFT JOIN (SELECT doc_id, place, count(*) AS n FROM sh GROUP BY 1, 2) h USING (doc_id, place)),
sr0 AS (SELECT doc_id, language, count(*) FILTER (kind = 'primary') AS queries, count(*) FILTER (kind = 'primary' AND hits > 0) AS hit, round(avg(hits) FILTER (kind = 'primary'), 6) AS mean_hits, count(*) FILTER (kind = 'cross') AS cross_queries, count(*) FILTER (kind = 'cross' AND hits > 0) AS cross_hit, coalesce(string_agg(text, ',' ORDER BY place) FILTER (kind = 'primary' AND hits = 0), '') AS missed FROM sn GROUP BY 1, 2),
smo AS (SELECT doc_id, language, queries, hit, mean_hits, round(hit / greatest(queries, 1)::DOUBLE, 6) AS hit_rate, cross_queries, cross_hit, round(cross_hit / greatest(cross_queries, 1)::DOUBLE, 6) AS cross_hit_rate, missed, queries - hit + CASE WHEN cross_queries > 0 AND cross_hit / cross_queries::DOUBLE < 0.5 THEN cross_queries - cross_hit ELSE 0 END AS warnings, CASE WHEN hit * 10 >= queries * 6 THEN 'pass' ELSE 'warning' END AS status FROM sr0)"""


def smoke_results(spark, sf):
    """Every document asked through the search over its own articles."""
    s, u = parts(spark, sf)
    languages = documents(spark, sf).select("doc_id", _language().alias("language"))
    articles = u.filter("unit = 'article'").select("doc_id", F.col("idx").alias("article_no"), F.array("ref").alias("refs"))
    i = F.col("article_no")
    chunks = graph.article_texts(spark, sf, s).join(articles, ["doc_id", "article_no"]).select(
        (F.col("doc_id") * 1000000 + i).alias("chunk_id"), F.col("doc_id").alias("scope"), F.col("text").alias("content"),
        (F.lit(0.5) + i % 5 / 10.0).alias("confidence"), (i % 9 == 4).alias("degraded"), "refs",
    )
    aliases = spark.createDataFrame(checks.BILINGUAL_ALIASES, "concept string, alias string")
    return smoke.rate_smoke(smoke.run_smoke(smoke.smoke_queries(languages, u), chunks, aliases)), u


@query("q06_smoke_queries", f"WITH {SMOKE} SELECT * FROM smo")
def q06(spark, sf):
    return smoke_results(spark, sf)[0]


@query("q05_multilingual_metrics", f"""WITH {SMOKE}, m AS (SELECT {LANG_SQL} AS language, count(*) AS n_units, count(*) FILTER (unit = 'article') AS articles, round(avg(CASE WHEN starts_with(ref, 'article') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS ref_coverage, count(DISTINCT ref) AS distinct_refs, count(DISTINCT doc_id) FILTER (unit = 'article' AND idx % 4 = 3) AS alias_edges FROM un GROUP BY 1),
c AS (SELECT language, sum(cross_queries)::BIGINT AS cross_queries, sum(cross_hit)::BIGINT AS cross_hit FROM smo GROUP BY 1)
SELECT m.*, cross_queries, cross_hit, round(cross_hit / greatest(cross_queries, 1)::DOUBLE, 3) AS cross_hit_rate FROM m JOIN c USING (language)""")
def q05(spark, sf):
    rated, u = smoke_results(spark, sf)
    # a document with a fourth article has one alias edge, as in the rated graph
    alias = F.when((F.col("unit") == "article") & (F.col("idx") % 4 == 3), F.col("doc_id"))
    own = u.groupBy(_language().alias("language")).agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("unit") == "article").alias("articles"),
        F.round(F.avg(F.col("ref").startswith("article").cast("double")), 6).alias("ref_coverage"),
        F.countDistinct("ref").alias("distinct_refs"), F.countDistinct(alias).alias("alias_edges"),
    )
    cross = rated.groupBy("language").agg(F.sum("cross_queries").alias("cross_queries"), F.sum("cross_hit").alias("cross_hit"))
    rate = F.round(F.col("cross_hit") / F.greatest("cross_queries", F.lit(1)), 3)
    return own.join(cross, "language").withColumn("cross_hit_rate", rate)


BENCH = SEARCH + """,
bt AS (SELECT s.query_id, s.score, s.rank, c.lang FROM sr s JOIN ck c USING (chunk_id)),
bq AS (SELECT query_id, CASE WHEN query_id % 10 = 9 THEN 'general' ELSE 'en' END AS expected, arg_min(lang, rank) AS top1, bool_or(rank <= 3 AND lang = 'en') AS in3, max(score) AS top_score, min(score) < 0.5 AS fb, bool_or(rank = 1 AND lang = 'es') AS ce FROM bt GROUP BY 1),
bm AS (SELECT count(*) AS queries, count(*) FILTER (expected <> 'general') AS named_queries, round(count(*) FILTER (expected <> 'general' AND top1 = expected) / greatest(count(*) FILTER (expected <> 'general'), 1)::DOUBLE * 100, 4) AS top1_accuracy_pct, round(count(*) FILTER (expected <> 'general' AND in3) / greatest(count(*) FILTER (expected <> 'general'), 1)::DOUBLE * 100, 4) AS top3_accuracy_pct,
 round(count(*) FILTER (expected <> 'general' AND ce) / greatest(count(*) FILTER (expected <> 'general'), 1)::DOUBLE * 100, 4) AS cross_domain_error_pct, 0.0::DOUBLE AS empty_rate_pct, round(count(*) FILTER (fb) / count(*)::DOUBLE * 100, 4) AS fallback_rate_pct, round(avg(top_score) FILTER (top_score > 0), 6) AS mean_top1_score FROM bq)"""


def benchmark_rows(spark, sf):
    found = search_results(spark, sf).join(corpus_chunks(spark, sf).select("chunk_id", "lang"), "chunk_id")
    return found.groupBy("query_id").agg(
        F.min_by("lang", "rank").alias("top1"), F.collect_set(F.when(F.col("rank") <= 3, F.col("lang"))).alias("top3"),
        F.max("score").alias("top_score"), (F.min("score") < 0.5).alias("is_fallback"),
        F.bool_or((F.col("rank") == 1) & (F.col("lang") == "es")).alias("cross_error"),
    ).withColumns(
        {"expected": F.when(F.col("query_id") % 10 == 9, "general").otherwise("en"), "is_empty": F.lit(False)}
    )


@query("q07_retrieval_metrics", f"WITH {BENCH} SELECT * FROM bm")
def q07(spark, sf):
    return quality.retrieval_metrics(benchmark_rows(spark, sf))


GATE = f"""rg AS ({" UNION ALL ".join(f"SELECT '{n}' AS gate, CAST({n} AS DOUBLE) AS value, {t}::DOUBLE AS target, {n} {'=' if o == '==' else o} {t} AS passed FROM bm" for n, o, t in quality.RETRIEVAL_TARGETS)})"""


@query("q07_retrieval_gate", f"WITH {BENCH}, {GATE} SELECT gate, value, target, passed FROM rg")
def q07_gate(spark, sf):
    return quality.gate(quality.retrieval_metrics(benchmark_rows(spark, sf)))


@query("q07_worst_queries", f"WITH {BENCH} SELECT query_id, expected, top1, top_score, CAST(row_number() OVER (ORDER BY top_score, query_id) AS INTEGER) AS rank FROM bq WHERE expected <> 'general' AND top1 <> expected QUALIFY rank <= 5")
def q07_worst(spark, sf):
    return quality.worst_queries(benchmark_rows(spark, sf))


# findings of the smoke cases in the vocabulary of the conversations
FINDINGS = [("[P0] contradiction", "keit und"), ("[P0] forbidden phrase", "heit der"), ("HTTP 500", "wh the"), ("is_demo missing", "eaux les"), ("score < 0.55 leak", "que la ")]
RELEASE = BENCH + f""", {GATE},
sk AS (SELECT conv_id * 1000 + turn AS case_id, {" + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for _, w in FINDINGS)} AS bad, {", ".join(f"contains(lower(text), '{w}') AS f{i}" for i, (_, w) in enumerate(FINDINGS))} FROM conversations WHERE role = 'assistant'),
ss AS (SELECT count(*) AS n, count(*) FILTER (bad = 0) AS good, {", ".join(f"count(*) FILTER (f{i}) AS f{i}" for i in range(len(FINDINGS)))} FROM sk),
mq AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good FROM labels),
gt AS (SELECT 'contradictions' AS gate, 'hard' AS level, CAST(f0 + f1 AS DOUBLE) AS value, n > 0 AND f0 + f1 = 0 AS passed FROM ss UNION ALL SELECT 'forbidden_phrases', 'hard', f1, n > 0 AND f1 = 0 FROM ss UNION ALL SELECT 'server_errors', 'hard', f2, n > 0 AND f2 = 0 FROM ss
 UNION ALL SELECT 'demo_labels', 'hard', f3, n > 0 AND f3 = 0 FROM ss UNION ALL SELECT 'score_leaks', 'hard', f4, n > 0 AND f4 = 0 FROM ss UNION ALL SELECT 'smoke_cases', 'beta', good, good >= greatest(1, floor(n * 9 / 10.0)) FROM ss
 UNION ALL SELECT gate, CASE gate WHEN 'cross_domain_error_pct' THEN 'hard' ELSE 'general' END, value, passed FROM rg UNION ALL SELECT 'manual_scenarios', 'general', good, n >= 15 AND good >= 15 FROM mq)"""


def gates_of(spark, sf):
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(name)) for name, w in FINDINGS]))
    smoke = conversations(spark, sf).filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), (F.size(found) == 0).alias("passed"), found.alias("findings")
    )
    manual = table(spark, sf, "labels").select(F.col("doc_id").alias("scenario"), (F.col("quality") == 1).alias("passed"))
    return quality.release_gates(smoke, quality.gate(quality.retrieval_metrics(benchmark_rows(spark, sf))), manual)


@query("q08_hard_gates", f"WITH {RELEASE} SELECT gate, level, value, passed FROM gt")
def q08_rows(spark, sf):
    return gates_of(spark, sf)


@query("q08_release_gates", f"WITH {RELEASE} SELECT bool_and(passed OR level = 'general') AS beta, bool_and(passed) AS general, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed), '') AS failed FROM gt")
def q08(spark, sf):
    return quality.release_decision(gates_of(spark, sf))


@query("q09_knowledge_base_score", """WITH c AS (SELECT d.text AS content, e.vec_id IS NOT NULL AS v, d.doc_id % 4 <> 0 AS p, d.source FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
f AS (SELECT count(*) AS total, avg(v::INT) * 100 AS v, avg(p::INT) * 100 AS p, count(DISTINCT source) AS s, avg((length(content) BETWEEN 100 AND 4000)::INT) * 100 AS g, CAST(sum(length(content)) // count(*) AS BIGINT) AS mean_length FROM c),
x AS (SELECT total, mean_length, CASE WHEN v >= 95 THEN 30 WHEN v >= 80 THEN 22 WHEN v >= 60 THEN 14 ELSE 5 END AS vector_points, CASE WHEN g >= 80 THEN 25 WHEN g >= 60 THEN 18 WHEN g >= 40 THEN 10 ELSE 3 END AS length_points, CASE WHEN s >= 20 THEN 20 WHEN s >= 10 THEN 15 WHEN s >= 5 THEN 9 ELSE 3 END AS source_points, CASE WHEN p >= 80 THEN 15 WHEN p >= 50 THEN 10 WHEN p >= 20 THEN 5 ELSE 1 END AS path_points FROM f)
SELECT *, vector_points + length_points + source_points + path_points AS score, CASE WHEN vector_points + length_points + source_points + path_points >= 90 THEN 'A' WHEN vector_points + length_points + source_points + path_points >= 75 THEN 'B' WHEN vector_points + length_points + source_points + path_points >= 60 THEN 'C' WHEN vector_points + length_points + source_points + path_points >= 45 THEN 'D' ELSE 'F' END AS grade FROM x""")
def q09(spark, sf):
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v"))
    rows = documents(spark, sf).join(have, "doc_id", "left").select(
        F.col("text").alias("content"), F.coalesce("v", F.lit(False)).alias("has_vector"),
        (F.col("doc_id") % 4 != 0).alias("has_path"), "source",
    )
    return quality.knowledge_base_scorecard(rows)


SCOPED = SEARCH.replace("lang FROM documents)", "lang FROM documents WHERE lang = 'en' OR doc_id % 2 = 0)")


@query("r33_corpus_evidence_search", f"WITH {SCOPED}, m AS (SELECT query_id, s.chunk_id, CASE WHEN rank <= 5 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, c.confidence, c.degraded FROM sr s JOIN ck c USING (chunk_id)), b AS (SELECT query_id, count(*) AS n_chunks, count(*) FILTER (w = 2) AS n_seeds, count(*) FILTER (degraded) AS n_degraded, count(*) FILTER (NOT degraded AND confidence >= 0.65) AS n_authoritative, round(sum(confidence * w) / sum(w), 6) AS confidence FROM m GROUP BY 1) SELECT *, CASE WHEN n_seeds = 0 THEN 'unsupported' WHEN n_authoritative = 0 THEN 'partially_supported' WHEN n_degraded > n_chunks // 2 THEN 'partially_supported' ELSE 'supported' END AS status FROM b")
def r33(spark, sf):
    # the tenant's scope comes before the search, so that its 20 best are all in scope
    chunks = corpus_chunks(spark, sf).filter((F.col("lang") == "en") | (F.col("chunk_id") % 2 == 0))
    found = search_results(spark, sf, chunks=chunks)
    seeds = found.filter(F.col("rank") <= 5).select("query_id", "chunk_id")
    return traversal.evidence_bundles(
        seeds, found.select("query_id", "chunk_id"), chunks.select("chunk_id", "confidence", "degraded")
    )


R33_LEVELS = graph.LEVELS.replace(
    graph.START, f"SELECT s.query_id, {graph.ROOT.replace('doc_id', 's.chunk_id')} AS node_id, 0 AS depth, 0.9::DOUBLE AS score, s.rank AS place, true AS kept, NULL::BIGINT AS pp, NULL::VARCHAR AS eid FROM found s WHERE s.rank <= 5"
)
R33_SEEDS = """, seedc AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS seq FROM (SELECT f.query_id, g.chunk_id, f.rank FROM found f JOIN gch g ON g.doc_id = f.chunk_id WHERE f.rank <= 5 QUALIFY row_number() OVER (PARTITION BY f.query_id, g.doc_id ORDER BY g.confidence DESC, g.chunk_id) = 1)),
rqs AS (SELECT DISTINCT query_id FROM asked)"""


@query("r33_graph_evidence", f"WITH found AS (WITH {SCOPED} SELECT query_id, chunk_id, rank FROM sr), asked AS (SELECT item_id AS query_id FROM benchmark), {graph.GR}{R33_LEVELS}{graph.PATHS}{R33_SEEDS}{graph.CONTENTS}")
def r33_graph(spark, sf):
    """Scope, search, expansion from the documents found, bundle."""
    chunks = corpus_chunks(spark, sf).filter((F.col("lang") == "en") | (F.col("chunk_id") % 2 == 0))
    hits = stage_table(
        search_results(spark, sf, chunks=chunks).filter(F.col("rank") <= 5)
        .select("query_id", F.col("chunk_id").alias("doc_id"), "rank")
    )
    nodes, edges = graph.whole_graph(spark, sf)
    nodes, edges = stage_table(nodes), stage_table(edges)
    s, units = graph.parts(spark, sf)
    pieces = stage_table(graph.chunk_table(units))
    starts = hits.select(
        "query_id", gb.node_id(F.col("doc_id"), "Document", F.lit("root")).alias("node_id"), F.col("rank").alias("seq")
    )
    # the surest chunk of each document found is a seed
    best = top_per_key(pieces, ["doc_id"], [F.desc("confidence"), F.asc("chunk_id")], 1).select("doc_id", "chunk_id")
    seeds = hits.join(best, "doc_id").select("query_id", "chunk_id", F.col("rank").alias("seq"))
    found = traversal.expand(starts, nodes, edges)
    out = traversal.bundle_contents(
        query_parts(spark, sf).select("query_id"), seeds, graph.reached_chunks(nodes, found), graph.cited_chunks(s, pieces)
    )
    return graph.shown_contents(out)
