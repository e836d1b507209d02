"""Set-at-a-time analytics over an interaction log.

Input columns: ``event_id, user_id, ts, action, item, topic``.  Every operator
answers for all users at once and takes its clock as ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.bounded_search import half_up_column
from folioweave.operators.ranking import lead_in_time, page_per_key, top_per_key

# Weight of an action in preference scores.
DEFAULT_WEIGHTS = {"download": 3.0, "save": 2.0, "view": 1.0}
DEFAULT_OTHER_WEIGHT = 0.5
# Pseudo items written by the system itself.
SYSTEM_ITEMS = ["__recommendation__", "__cases__", "__risk__", "__situation__"]
# Profile decay per day, idle days, minimum weight to re-engage.
DECAY_PER_DAY = 0.08
RE_ENGAGE_DAYS = 7
RE_ENGAGE_MIN_WEIGHT = 0.25


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(8.64e10)


def since(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events of the last ``days`` days before ``as_of`` (pushed to the scan)."""
    start = instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return events.filter(F.col("ts") >= start)


def action_weight(
    weights: dict[str, float] | None = None, other: float = DEFAULT_OTHER_WEIGHT
) -> Column:
    chosen = DEFAULT_WEIGHTS if weights is None else weights
    expr = None
    for action, value in chosen.items():
        hit = F.col("action") == action
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr.otherwise(F.lit(other)) if expr is not None else F.lit(other)


def without_system_items(events: DataFrame, items: list | None = None) -> DataFrame:
    """Drop pseudo items; the list is a fixed handful, so a literal set suffices."""
    names = SYSTEM_ITEMS if items is None else items
    return events.filter(F.col("item").isNull() | ~F.col("item").cast("string").isin(*map(str, names)))


def known_topic(events: DataFrame) -> DataFrame:
    return events.filter(F.col("topic").isNotNull())


def append_interactions(events: DataFrame, path: str) -> None:
    """Append to a day-partitioned Parquet log; re-reading prunes by ``day``."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def history(events: DataFrame, as_of: str, days: int = 60, limit: int = 200) -> DataFrame:
    """Newest events per user: filter by time first, then cap."""
    return top_per_key(
        since(events, as_of, days), ["user_id"], [F.desc("ts"), F.desc("event_id")], limit
    )


def history_page(events: DataFrame, action: str | None, limit: int, offset: int) -> DataFrame:
    """Offset paging per user, newest first, optionally of one action."""
    kept = events if action is None else events.filter(F.col("action") == action)
    return page_per_key(kept, ["user_id"], [F.desc("ts"), F.desc("event_id")], limit, offset)


def viewed_items(events: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct items per user, most recent first."""
    last = events.groupBy("user_id", "item").agg(F.max("ts").alias("last_ts"))
    return top_per_key(last, ["user_id"], [F.desc("last_ts"), F.asc("item")], limit)


def action_frequency(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "action").agg(F.count(F.lit(1)).alias("n"))


def active_hours(events: DataFrame, limit: int = 6) -> DataFrame:
    counts = events.groupBy("user_id", F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return top_per_key(counts, ["user_id"], [F.desc("n"), F.asc("hour")], limit)


def topics_since(events: DataFrame, as_of: str, days: int = RE_ENGAGE_DAYS) -> DataFrame:
    return known_topic(since(events, as_of, days)).select("user_id", "topic").distinct()


def trending_topics(events: DataFrame, limit: int = 5) -> DataFrame:
    counts = known_topic(events).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), F.asc("topic")).limit(limit)
    return best.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("topic")))
    )


def action_bigrams(events: DataFrame, limit: int | None = 20) -> DataFrame:
    """Counts of consecutive action pairs per user, best ``limit`` kept."""
    led = lead_in_time(
        events.select("user_id", "ts", "event_id", "action"),
        "user_id",
        ["ts", "event_id"],
        F.to_date("ts"),
        {"next_action": "action"},
    )
    pairs = (
        led.filter(F.col("next_action").isNotNull())
        .groupBy(
            "user_id",
            F.col("action").alias("first_action"),
            F.col("next_action").alias("second_action"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if limit is None:
        return pairs
    order = [F.desc("n"), F.asc("first_action"), F.asc("second_action")]
    return top_per_key(pairs, ["user_id"], order, limit)


def top_topics(
    events: DataFrame,
    profile_counts: DataFrame | None = None,
    limit: int = 5,
    profile_weight: float = 1.5,
) -> DataFrame:
    """Event counts plus weighted profile counters, best topics per user."""
    scored = known_topic(events).groupBy("user_id", "topic").agg(
        F.count(F.lit(1)).cast("double").alias("score")
    )
    if profile_counts is not None:
        boost = profile_counts.select(
            "user_id", "topic", (F.col("n") * F.lit(profile_weight)).alias("score")
        )
        scored = (
            scored.unionByName(boost).groupBy("user_id", "topic").agg(F.sum("score").alias("score"))
        )
    return top_per_key(scored, ["user_id"], [F.desc("score"), F.asc("topic")], limit)


def decayed_weights(events: DataFrame, as_of: str, days: int = 60, limit: int = 200) -> DataFrame:
    """Recency-weighted topic interest per user, scaled so the best topic is 1."""
    recent = known_topic(history(events, as_of, days, limit))
    age = F.greatest(F.lit(0.0), days_between(instant(as_of), F.col("ts")))
    raw = recent.groupBy("user_id", "topic").agg(
        F.sum(F.exp(F.lit(-DECAY_PER_DAY) * age)).alias("raw")
    )
    best = F.max("raw").over(Window.partitionBy("user_id"))
    return raw.select("user_id", "topic", half_up_column(F.col("raw") / best, 3).alias("weight"))


def unexplored_neighbours(weights: DataFrame, adjacency: DataFrame, *more: Column) -> DataFrame:
    """Top topic per user, its weight, and its neighbours that the user has not explored, nearest first.

    ``more``: further aggregates over the rows of a user.
    """
    top = weights.groupBy("user_id").agg(
        F.max_by("topic", F.struct("weight", -F.col("topic"))).alias("top_topic"),
        F.max("weight").alias("top_weight"),
        F.collect_set("topic").alias("explored"),
        *more,
    )
    near = adjacency.groupBy(F.col("topic").alias("top_topic")).agg(
        F.array_sort(F.collect_list(F.struct("position", "neighbour"))).alias("near")
    )
    unexplored = F.array_except(F.transform("near", lambda s: s["neighbour"]), F.col("explored"))
    return top.join(near, "top_topic", "left").withColumn(
        "adjacent_topics", F.coalesce(unexplored, F.array().cast("array<int>"))
    )


def profile_summary(
    events: DataFrame,
    adjacency: DataFrame,
    as_of: str,
    days: int = 60,
    limit: int = 200,
) -> DataFrame:
    """One row per user: totals, active days, top topic, last activity, adjacent topics.

    ``adjacency(topic, neighbour, position)`` is a small closed table.
    """
    recent = history(events, as_of, days, limit)
    totals = recent.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.countDistinct(F.to_date("ts")).alias("days_active"),
        F.max("ts").alias("last_active"),
    )
    near = unexplored_neighbours(decayed_weights(events, as_of, days, limit), adjacency)
    return totals.join(near, "user_id", "left").select(
        "user_id",
        "total_interactions",
        "days_active",
        "top_topic",
        "last_active",
        F.coalesce("adjacent_topics", F.array().cast("array<int>")).alias("adjacent_topics"),
    )


def proactive_suggestions(
    events: DataFrame, adjacency: DataFrame, as_of: str, limit: int = 6
) -> DataFrame:
    """Re-engage, cross-topic and trending suggestions, best ``limit`` per user.

    All kinds come from one row per user with the weights of their topics.  A union of
    branches that are each partitioned by user fails when adaptive execution leaves
    them different numbers of partitions.
    """
    recent = topics_since(events, as_of).withColumn("recent", F.lit(True))
    weights = decayed_weights(events, as_of).join(recent, ["user_id", "topic"], "left")
    trending = trending_topics(events, 5).agg(F.collect_list(F.struct("topic", "rank")).alias("trend"))
    users = unexplored_neighbours(
        weights, adjacency, F.collect_list(F.struct("topic", "weight", "recent")).alias("weights")
    ).crossJoin(F.broadcast(trending))  # one row holding five topics is attached to every user

    def suggestion(kind: str, topic: Column, score: Column) -> Column:
        return F.struct(F.lit(kind).alias("rec_type"), topic.alias("topic"), half_up_column(score, 3).alias("score"))

    idle = F.filter("weights", lambda w: (w["weight"] >= RE_ENGAGE_MIN_WEIGHT) & w["recent"].isNull())
    unseen = F.filter("trend", lambda t: ~F.array_contains("explored", t["topic"]))
    everything = users.select("user_id", F.inline(F.concat(
        F.transform(idle, lambda w: suggestion("re_engage", w["topic"], w["weight"] * 0.9)),
        F.transform(F.slice("adjacent_topics", 1, 3), lambda t: suggestion("cross_domain", t, F.col("top_weight") * 0.6)),
        F.transform(unseen, lambda t: suggestion(
            "proactive", t["topic"], F.greatest(F.lit(0.3), F.lit(0.55) - (t["rank"] - 1) * 0.05)
        )),
    )))
    return top_per_key(
        everything, ["user_id"], [F.desc("score"), F.asc("rec_type"), F.asc("topic")], limit
    )


def personal_feed(
    suggestions: DataFrame, users: DataFrame, defaults: DataFrame, limit: int = 8
) -> DataFrame:
    """Suggestions per user; users without any receive the default rows.

    ``users`` are distinct; ``defaults`` is a handful of rows, attached as one.
    """
    served = suggestions.select("user_id", F.struct("rec_type", "topic", "score").alias("own"))
    filler = defaults.agg(F.collect_list(F.struct("rec_type", "topic", "score")).alias("defaults"))
    shown = F.when(F.col("own").isNull(), F.col("defaults")).otherwise(F.array("own"))
    everyone = served.join(users, "user_id", "full").crossJoin(F.broadcast(filler))
    return top_per_key(
        everyone.select("user_id", F.inline(shown)),
        ["user_id"],
        [F.desc("score"), F.asc("rec_type"), F.asc("topic")],
        limit,
    )


def next_actions(
    events: DataFrame, transitions: DataFrame, limit: int = 3, as_of: str | None = None
) -> DataFrame:
    """What each user may do after the latest action.

    ``transitions(action, next_action, position)`` is a small closed table; the
    user's own bigrams are the second signal.
    """
    latest = events.groupBy("user_id").agg(
        F.max_by("action", F.struct("ts", "event_id")).alias("last_action")
    )
    planned = latest.join(
        transitions, F.col("last_action") == F.col("action")
    ).select(
        "user_id",
        F.concat_ws("_", F.lit("seq"), "last_action", "next_action").alias("rec_id"),
        F.round(F.lit(0.85) - F.col("position") * 0.1, 3).alias("score"),
    )
    own = (
        action_bigrams(events, 20)
        .join(latest, "user_id")
        .filter(F.col("first_action") == F.col("last_action"))
        .select(
            "user_id",
            F.concat_ws("_", F.lit("hist_seq"), "second_action").alias("rec_id"),
            F.round(F.least(F.lit(0.78), F.col("n") * 0.13), 3).alias("score"),
        )
    )
    return top_per_key(
        planned.unionByName(own).dropDuplicates(["user_id", "rec_id"]),
        ["user_id"],
        [F.desc("score"), F.asc("rec_id")],
        limit,
    )


def risks_from_history(
    events: DataFrame, risks: DataFrame, top: int = 5, limit: int = 10
) -> DataFrame:
    """Top topics joined to the risks that list them; score grows with use.

    ``risks(risk_id, related_topics array)`` is exploded so that membership is
    an equality join.
    """
    counts = known_topic(events).groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    best = top_per_key(counts, ["user_id"], [F.desc("n"), F.asc("topic")], top)
    members = risks.select("risk_id", F.explode("related_topics").alias("topic"))
    scored = (
        best.join(members, "topic")
        .groupBy("user_id", "risk_id")
        .agg(F.sum("n").alias("hits"))
        .withColumn("score", F.least(F.col("hits") / 10.0, F.lit(1.0)))
    )
    return top_per_key(scored, ["user_id"], [F.desc("hits"), F.asc("risk_id")], limit)


def feedback_scores(
    events: DataFrame,
    as_of: str,
    weights: dict[str, float],
    days: int = 60,
    limit: int = 500,
    module_factor: float = 0.8,
    clamp: float = 0.18,
) -> DataFrame:
    """Signed feedback per user and key (the item, and its module at a discount)."""
    recent = history(events, as_of, days, limit).withColumn("delta", action_weight(weights, 0.0))
    keys = F.array(
        F.struct(F.concat(F.lit("item:"), F.col("item")).alias("key"), F.lit(1.0).alias("factor")),
        F.struct(
            F.concat(F.lit("module:"), F.col("topic")).alias("key"),
            F.lit(module_factor).alias("factor"),
        ),
    )
    spread = recent.select("user_id", "delta", F.explode(keys).alias("k"))
    return spread.groupBy("user_id", F.col("k.key").alias("key")).agg(
        F.round(
            F.greatest(F.lit(-clamp), F.least(F.sum(F.col("delta") * F.col("k.factor")), F.lit(clamp))),
            3,
        ).alias("score")
    )
