"""Jobs over conversations: sessions, next actions, community patterns, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.functions.ids import short_md5
from folioweave.operators.cleaning import redact
from folioweave.operators.ranking import top_per_key

# Bounds of next-best-action scores.
MIN_ACTION_SCORE = 0.34
MAX_ACTION_SCORE = 0.98
MAX_GOAL_BOOST = 0.22


def session_summaries(turns: DataFrame, title_length: int = 60) -> DataFrame:
    """Turn count, opening line and last turn per session.

    ``turns``: ``session_id, turn, role, text``.
    """
    opening = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.max("turn").alias("last_turn"),
        F.substring(opening, 1, title_length).alias("title"),
    )


def bounded_history(turns: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The last ``limit`` entries per key, oldest first, as one array."""
    last = top_per_key(turns, [key], [F.desc(order)], limit)
    return last.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]).alias("history")
    )


@dataclass(frozen=True)
class Action:
    """A scored action: base score plus bonuses for context flags."""

    action_id: str
    module: str
    base: float
    bonuses: tuple[tuple[str, float], ...]


def next_best_actions(
    contexts: DataFrame,
    actions: Sequence[Action],
    goal_boosts: Sequence[tuple[str, str, float]],
    feedback: DataFrame | None = None,
    limit: int = 6,
) -> DataFrame:
    """Actions ranked per context.

    ``contexts``: ``context_id, user_id``, one boolean column per flag used by
    the actions, and ``goals array<string>``.  ``feedback``: ``user_id, key,
    score`` with keys ``item:<action>`` and ``module:<module>``.  The action
    list is closed, so scoring is an array in the row and needs no join.
    """
    scored = []
    for a in actions:
        total: Column = F.lit(a.base)
        for flag, bonus in a.bonuses:
            total = total + F.when(F.col(flag), bonus).otherwise(0.0)
        boost: Column = F.lit(0.0)
        for goal, action_id, value in goal_boosts:
            if action_id == a.action_id:
                boost = boost + F.when(F.array_contains("goals", goal), value).otherwise(0.0)
        base = F.greatest(F.lit(0.0), F.least(total, F.lit(MAX_ACTION_SCORE)))
        lifted = F.least(base + F.least(boost, F.lit(MAX_GOAL_BOOST)), F.lit(MAX_ACTION_SCORE))
        scored.append(F.struct(F.lit(a.action_id).alias("action_id"), F.lit(a.module).alias("module"), lifted.alias("score")))
    rows = contexts.select("context_id", "user_id", F.explode(F.array(*scored)).alias("a")).select(
        "context_id", "user_id", "a.action_id", "a.module", "a.score"
    )
    if feedback is not None:
        keys = F.array(F.concat(F.lit("item:"), "action_id"), F.concat(F.lit("module:"), "module"))
        sums = (
            rows.select("context_id", "user_id", "action_id", F.explode(keys).alias("key"))
            .join(feedback.withColumnRenamed("score", "delta"), ["user_id", "key"])
            .groupBy("context_id", "action_id").agg(F.sum("delta").alias("delta"))
        )
        rows = rows.join(sums, ["context_id", "action_id"], "left").withColumn(
            "score",
            F.greatest(F.lit(0.0), F.least(F.col("score") + F.coalesce("delta", F.lit(0.0)), F.lit(MAX_ACTION_SCORE))),
        )
    kept = rows.withColumn("score", F.round("score", 3)).filter(F.col("score") >= MIN_ACTION_SCORE)
    return top_per_key(kept, ["context_id"], [F.desc("score"), F.asc("action_id")], limit).select(
        "context_id", "action_id", "score", "rank"
    )


def goal_profile(
    df: DataFrame, text_col: str, goals: Sequence[tuple[str, Sequence[str]]],
    positions: Sequence[tuple[str, Sequence[str]]], questions: Sequence[tuple[str, str, Sequence[str]]],
) -> DataFrame:
    """Goals, position and open questions (at most four) of folded texts.

    ``questions``: ``(goal, question, words that answer it)``.
    """
    low = tx.fold_accents(F.col(text_col))
    found = F.array_compact(F.array(*[F.when(tx.any_term(low, ws), F.lit(g)) for g, ws in goals]))
    named = F.when(F.size(found) == 0, F.array(F.lit("clarify_legal_goal"))).otherwise(found)
    with_goals = df.withColumn("goals", named)
    asked = F.array_compact(
        F.array(
            *[F.when(F.array_contains("goals", g) & ~tx.any_term(low, answers), F.lit(q)) for g, q, answers in questions]
        )
    )
    return with_goals.withColumns(
        {"position": tx.first_label(low, positions, "general_user"), "open_questions": F.slice(asked, 1, 4)}
    )


def publish_patterns(cases: DataFrame, redactions) -> DataFrame:
    """Redacted summaries keyed by their hash; repeats count as impressions.

    ``cases``: ``case_id, text, domain``.
    """
    safe = redact(cases, redactions)
    return safe.groupBy(short_md5(F.col("safe_summary")).alias("pattern_id")).agg(
        F.min("safe_summary").alias("summary"), F.min_by("domain", "case_id").alias("domain"),
        F.count(F.lit(1)).alias("impressions"), F.sum("redaction_count").alias("redactions"),
    )


def search_patterns(patterns: DataFrame, words: Sequence[str], domain: str | None, limit: int = 10) -> DataFrame:
    """Patterns mentioning a word in any field, most useful first."""
    low = F.lower(F.concat_ws(" ", "summary", "domain", F.array_join("tags", " ")))
    hit = patterns.filter(tx.any_term(low, [w.lower() for w in words]))
    hit = hit if domain is None else hit.filter(F.col("domain") == domain)
    return hit.orderBy(F.desc("useful"), F.desc("impressions"), F.asc("pattern_id")).limit(limit)


def by_profile(items: DataFrame, requests: DataFrame, general: str = "general", limit: int = 5) -> DataFrame:
    """Items whose tags contain the request's tag or the general tag.

    ``items``: ``item_id, tags array, priority``; ``requests``: ``request_id,
    tag``.  Both sides meet by equality on exploded tags.
    """
    # a request has at most two tags and takes the best of both, so each tag is cut before the join
    tagged = top_per_key(
        items.select("item_id", "priority", F.explode("tags").alias("tag")).distinct(), ["tag"],
        [F.asc("priority"), F.asc("item_id")], limit,
    ).select("item_id", "priority", "tag")
    wanted = requests.select("request_id", F.explode(F.array_distinct(F.array(F.col("tag"), F.lit(general)))).alias("tag"))
    found = wanted.join(tagged, "tag").select("request_id", "item_id", "priority").distinct()
    return top_per_key(found, ["request_id"], [F.asc("priority"), F.asc("item_id")], limit)


def checklist_progress(items: DataFrame, checked: DataFrame) -> DataFrame:
    """Checked and total entries per user and list.

    ``items``: ``list_id, entries array<string>``; ``checked``: ``user_id,
    list_id, entry``.
    """
    entries = items.select("list_id", F.explode("entries").alias("entry"))
    totals = entries.groupBy("list_id").agg(F.count(F.lit(1)).alias("total"))
    done = checked.distinct().join(entries, ["list_id", "entry"], "left_semi").groupBy("user_id", "list_id").agg(
        F.count(F.lit(1)).alias("done")
    )
    users = checked.select("user_id", "list_id").distinct()
    return users.join(totals, "list_id").join(done, ["user_id", "list_id"], "left").select(
        "user_id", "list_id", F.coalesce("done", F.lit(0)).alias("done"), "total",
        F.round(F.coalesce("done", F.lit(0)) / F.col("total"), 6).alias("progress"),
    )


def keyword_risks(texts: DataFrame, risks: Sequence[tuple[str, Sequence[str]]], limit: int = 3) -> DataFrame:
    """Risks whose keywords occur in a text, by number of hits."""
    low = F.lower("text")
    scored = F.array(*[F.struct(F.lit(r).alias("risk"), tx.terms_present(low, ws).alias("hits")) for r, ws in risks])
    rows = texts.select("text_id", F.explode(scored).alias("s")).select("text_id", "s.risk", "s.hits").filter("hits > 0")
    return top_per_key(rows, ["text_id"], [F.desc("hits"), F.asc("risk")], limit)
