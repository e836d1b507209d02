"""Collaborative filtering and peers without listing all user pairs of a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.operators.interactions import (
    action_weight,
    known_topic,
    since,
    without_system_items,
)
from folioweave.operators.ranking import ranked_prefix, top_per_key
from folioweave.session import spread, stage_table

#: Bits of a mask word, and words of a mask: so many of the most used items are kept out of the pair join.
WORD, WORDS = 63, 2
HOT_ITEMS = WORD * WORDS
MASK = [f"m{i}" for i in range(WORDS)]
OTHER = [f"o{i}" for i in range(WORDS)]
#: Masks of one block, and bits that are compared first.
MASKS, HEAD_BITS = 16384, 8


def user_item_weights(events: DataFrame, weights: dict[str, float] | None, other: float) -> DataFrame:
    """(user, item, weight): one row per pair, the unit of every later join."""
    return events.groupBy("user_id", "item").agg(
        F.sum(action_weight(weights, other)).alias("w")
    )


def co_user_items(
    events: DataFrame,
    weights: dict[str, float] | None = None,
    other: float = 0.5,
    k: int = 10,
) -> DataFrame:
    """For every user: items used by people who share an item, best ``k``.

    An item used by a third of all people would make every pair of them co-users.
    So the most used items are taken out of the pair join: each user carries a bit
    mask saying which of them they used, and whoever has a mask counts as a co-user
    of all others with one, minus those whose masks are disjoint (``disjoint_masks``).
    Where people share popular items such masks are few, so one ranking of all items
    serves nearly everybody.  Pairs are formed only through the other items, and
    only where the masks are disjoint.  Both parts are exact, so sums and counts add up.
    """
    # far smaller than the log and read by every branch below
    ui = stage_table(user_item_weights(events, weights, other))
    hot = (
        ui.filter(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("users"))
        .orderBy(F.desc("users"), F.asc("item")).limit(HOT_ITEMS)
    )
    hot_bits = hot.select("item", F.expr("row_number() over (order by users desc, item) - 1").alias("bit"))
    tagged = ui.join(F.broadcast(hot_bits), "item", "left")
    word = lambda i: F.expr(f"if(bit div {WORD} = {i}, shiftleft(1L, bit % {WORD}), 0L)")
    masks = stage_table(
        tagged.groupBy("user_id").agg(
            *[F.coalesce(F.sum(word(i)), F.lit(0)).alias(m) for i, m in enumerate(MASK)], F.count(F.lit(1)).alias("n_seen")
        )
    )
    masked = F.greatest(*MASK) > 0
    rated = ui.join(masks.filter(masked).select("user_id", *MASK), "user_id")

    # popular part: totals of all who have a mask, less what belongs to disjoint masks
    total = rated.groupBy("item").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("people"))
    apart = stage_table(disjoint_masks(masks.filter(masked).select(*MASK).distinct()))
    by_mask = (
        rated.join(apart.select(*[F.col(o).alias(m) for m, o in zip(MASK, OTHER)]).distinct(), MASK, "left_semi")
        .groupBy(*[F.col(m).alias(o) for m, o in zip(MASK, OTHER)], "item")
        .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("people"))
    )
    strangers = stage_table(
        apart.join(by_mask, OTHER).groupBy(*MASK, "item").agg(F.sum("w").alias("w"), F.sum("people").alias("people"))
    )

    # tail part: pairs through the remaining items with disjoint masks
    tail = (
        tagged.filter(F.col("bit").isNull()).select("user_id", "item").join(masks, "user_id")
        .select("user_id", "item", *MASK)
    )
    left, right = spread(tail, "user_id").alias("a"), tail.alias("b")
    disjoint = F.lit(True)
    for m in MASK:
        disjoint = disjoint & (F.col(f"a.{m}").bitwiseAND(F.col(f"b.{m}")) == 0)
    pairs = (
        left.join(
            right,
            (F.col("a.item") == F.col("b.item"))
            & (F.col("a.user_id") != F.col("b.user_id"))
            & disjoint,
        )
        .select(F.col("a.user_id").alias("user_id"), F.col("b.user_id").alias("peer"))
        .distinct()
    )
    tail_scores = stage_table(
        pairs.join(ui.withColumnRenamed("user_id", "peer"), "peer")
        .groupBy("user_id", "item")
        .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("people"))
    )

    # candidates: tail items, plus just enough of the ranking of the totals that the
    # best k unseen items must be among them: what strangers take away moves items down
    ranking = total.withColumn("rank", F.expr("row_number() over (order by w desc, item)")).withColumn("all", F.lit(1))
    lowered = strangers.groupBy(*MASK).agg(F.count(F.lit(1)).alias("n_lowered"))
    needs = masks.filter(masked).join(F.broadcast(lowered), MASK, "left").select(
        "user_id", F.lit(1).alias("all"), (F.col("n_seen") + F.coalesce("n_lowered", F.lit(0)) + F.lit(k)).alias("need")
    )
    head = ranked_prefix(needs, ranking, "all", "need").select("user_id", "item")
    # items that may still be won, before anything is looked up for them
    fresh = head.unionByName(tail_scores.select("user_id", "item")).distinct().join(
        ui.select("user_id", "item"), ["user_id", "item"], "left_anti"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    scored = (
        fresh.join(masks.select("user_id", *MASK, masked.alias("masked")), "user_id")
        .join(total.select("item", F.col("w").alias("tw"), F.col("people").alias("tp")), "item", "left")
        .join(strangers.select(*MASK, "item", F.col("w").alias("sw"), F.col("people").alias("sp")), [*MASK, "item"], "left")
        .join(tail_scores, ["user_id", "item"], "left")
        .select(
            "user_id", "item",
            (F.when(F.col("masked"), zero("tw") - zero("sw")).otherwise(0.0) + zero("w")).alias("w"),
            (F.when(F.col("masked"), zero("tp") - zero("sp")).otherwise(0) + zero("people")).alias("people"),
        )
        .filter("people > 0")
    )
    return top_per_key(scored, ["user_id"], [F.desc("w"), F.asc("item")], k).select(
        "user_id",
        "item",
        F.col("w").alias("collab_score"),
        F.col("people").alias("similar_users"),
        "rank",
    )


def disjoint_masks(masks: DataFrame, block: int = MASKS) -> DataFrame:
    """Pairs of masks without a common bit, in both orders: columns ``MASK`` and ``OTHER``.

    Blocks of masks meet in cells of bounded memory.  Within a cell the first bits,
    those of the most used items, are compared per distinct value, and only the masks
    behind values without a common bit are compared further.
    """
    cells = max(1, -(-masks.count() // block))
    mine = F.pmod(F.xxhash64(*MASK), F.lit(cells)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    left = masks.select("*", mine.alias("_a"), every.alias("_b"))
    right = masks.select(*[F.col(m).alias(o) for m, o in zip(MASK, OTHER)], mine.alias("_b"), every.alias("_a"))

    def cell(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        a, b = own[MASK].to_numpy(np.int64), other[OTHER].to_numpy(np.int64)
        low = (1 << HEAD_BITS) - 1
        a, b = a[np.argsort(a[:, 0] & low, kind="stable")], b[np.argsort(b[:, 0] & low, kind="stable")]
        heads, first = np.unique(a[:, 0] & low, return_index=True)
        found = [np.zeros((0, 2 * WORDS), np.int64)]
        for head, rows in zip(heads, np.split(a, first[1:])):
            rest = b[(b[:, 0] & head) == 0]
            for n in range(0, len(rows), 256):
                part = rows[n : n + 256]
                i, j = np.nonzero(~np.logical_or.reduce([(part[:, w, None] & rest[None, :, w]) != 0 for w in range(WORDS)]))
                found.append(np.hstack([part[i], rest[j]]))
        return pd.DataFrame(np.concatenate(found), columns=[*MASK, *OTHER])

    schema = ", ".join(f"{c} bigint" for c in [*MASK, *OTHER])
    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(cell, schema)


def topic_sets(interest: DataFrame, top: int = 3) -> DataFrame:
    """The set of each user's best topics, as a key many users share.

    ``interest(user_id, topic, score)``.
    """
    best = top_per_key(interest, ["user_id"], [F.desc("score"), F.asc("topic")], top)
    return best.groupBy("user_id").agg(
        F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topic_set")
    )


def peer_ranking(events: DataFrame, sets: DataFrame, limit: int = 20) -> DataFrame:
    """Users ranked by activity in a topic set; one ranking per distinct set.

    Users with the same topic set have the same ranking except for themselves,
    so ``limit + 1`` rows per set serve all of them.
    """
    counts = known_topic(events).groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    wanted = spread(sets.select("topic_set").distinct(), "topic_set").select(
        "topic_set", F.explode(F.split("topic_set", ",").cast("array<int>")).alias("topic")
    )
    overlap = (
        wanted.join(spread(counts, "user_id"), "topic").groupBy("topic_set", "user_id").agg(F.sum("n").alias("overlap"))
    )
    return top_per_key(
        overlap, ["topic_set"], [F.desc("overlap"), F.asc("user_id")], limit + 1
    ).select("topic_set", F.col("user_id").alias("peer"), "overlap", "rank")


def peer_users(events: DataFrame, interest: DataFrame, limit: int = 20, top: int = 3) -> DataFrame:
    """Best ``limit`` peers of every user by activity in the user's top topics."""
    sets = stage_table(topic_sets(interest, top))
    ranking = peer_ranking(events, sets, limit)
    joined = sets.join(ranking.drop("rank"), "topic_set").filter(F.col("peer") != F.col("user_id"))
    return top_per_key(joined, ["user_id"], [F.desc("overlap"), F.asc("peer")], limit).select(
        "user_id", "peer", "overlap", "rank"
    )


def peer_trending(
    events: DataFrame,
    interest: DataFrame,
    as_of: str,
    days: int = 14,
    peers: int = 20,
    top: int = 3,
    k: int = 5,
) -> DataFrame:
    """Unseen items most used by the peers of each user in the last days.

    Peer lists are shared: all users of a topic set have the same list, apart
    from the few who are on it themselves.  Trends are computed per list and
    each user reads the prefix of the ranking that must hold ``k`` unseen items.
    """
    sets = stage_table(topic_sets(interest, top))
    ranking = stage_table(peer_ranking(events, sets, peers))
    plain = ranking.filter(F.col("rank") <= peers).select(
        F.concat(F.col("topic_set"), F.lit("#")).alias("list"), "peer"
    )
    # only users who are on the list of their own topic set need another list
    insiders = (
        ranking.filter(F.col("rank") <= peers)
        .select("topic_set", F.col("peer").alias("user_id"))
        .join(sets, ["topic_set", "user_id"], "left_semi")
        .select("topic_set", F.col("user_id").alias("insider"))
    )
    without_self = (
        insiders.join(ranking, "topic_set")
        .filter(F.col("insider") != F.col("peer"))
        .select(F.concat(F.col("topic_set"), F.lit("#"), F.col("insider")).alias("list"), "peer")
    )
    lists = plain.unionByName(without_self)

    used = without_system_items(since(events, as_of, days)).groupBy("user_id", "item").agg(
        F.max("ts").alias("last_ts")
    )
    trends = (
        lists.join(used.withColumnRenamed("user_id", "peer"), "peer")
        .groupBy("list", "item")
        .agg(F.count(F.lit(1)).alias("peer_count"), F.max("last_ts").alias("last_accessed"))
        .withColumn(
            "rank",
            F.expr(
                "row_number() over (partition by list "
                "order by peer_count desc, last_accessed desc, item)"
            ),
        )
    )

    seen = events.select("user_id", "item").distinct()
    seen_counts = seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_seen"))
    member = insiders.withColumnRenamed("insider", "user_id").withColumn("inside", F.lit(True))
    needs = (
        sets.join(member, ["topic_set", "user_id"], "left")
        .join(seen_counts, "user_id")
        .select(
            "user_id",
            F.concat(
                F.col("topic_set"),
                F.lit("#"),
                F.when(F.col("inside"), F.col("user_id").cast("string")).otherwise(F.lit("")),
            ).alias("list"),
            (F.col("n_seen") + F.lit(k)).alias("need"),
        )
    )
    found = ranked_prefix(needs, trends, "list", "need").join(
        seen, ["user_id", "item"], "left_anti"
    )
    order = [F.desc("peer_count"), F.desc("last_accessed"), F.asc("item")]
    return top_per_key(found.drop("rank"), ["user_id"], order, k).select(
        "user_id", "item", "peer_count", "last_accessed", "rank"
    )


def peer_recommendations(trending: DataFrame) -> DataFrame:
    """Score of a peer trend: 0.15 per peer, at most 0.95."""
    return trending.select(
        "user_id",
        "item",
        "peer_count",
        F.round(F.least(F.lit(0.95), F.col("peer_count") * 0.15), 3).alias("score"),
        "rank",
    )
