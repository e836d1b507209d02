"""Fusion of scored signals and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.operators.bounded_search import half_up_column
from folioweave.operators.ranking import top_per_key
from folioweave.rules import queries as rules


def merge_signals(signals: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Long ``keys, signal, score`` to one row per candidate; missing means 0.

    One conditional aggregation instead of a chain of full outer joins.
    """
    return signals.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("signal") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in names]
    )


def min_max(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Min–max scaling per key; a column with one value stays as it is.

    The bounds are a pre-aggregated row per key, so a query with a huge
    candidate set does not pass through one window task.
    """
    bounds = df.groupBy(key).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    scaled = {
        c: F.when(
            F.col(f"_hi_{c}") > F.col(f"_lo_{c}"),
            (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")),
        ).otherwise(F.col(c))
        for c in columns
    }
    joined = df.join(bounds, key).withColumns(scaled)
    return joined.drop(*[f"_lo_{c}" for c in columns], *[f"_hi_{c}" for c in columns])


def fuse(
    signals: DataFrame,
    query_domains: DataFrame,
    item_domains: DataFrame,
    top_topics: DataFrame,
    limit: int = 15,
    weights: dict[str, float] | None = None,
    vector_threshold: float = rules.FUSION_VECTOR_THRESHOLD,
) -> DataFrame:
    """Four-signal fusion for every query.

    ``signals``: ``query_id, item_id, signal (vector|tf|graph), score``;
    ``query_domains``: ``query_id, user_id, domain``; ``item_domains``: ``item_id,
    item_domain``; ``top_topics``: ``user_id, domain, rank`` of the user's best
    five.  The behaviour boost goes to candidates of the query's domain.
    """
    w = weights or rules.FUSION_WEIGHTS
    useful = signals.filter(
        (F.col("signal") != "vector") | (F.col("score") >= vector_threshold)
    )
    wide = merge_signals(useful, ["vector", "tf", "graph"], ["query_id", "item_id"])
    boosts = query_domains.join(top_topics, ["user_id", "domain"], "left").select(
        "query_id", "domain",
        F.when(F.col("rank").isNotNull(), F.greatest(F.lit(0.1), F.lit(1.0) - (F.col("rank") - 1) * 0.2))
        .otherwise(0.0).alias("boost"),
    )
    boosted = (
        wide.join(boosts, "query_id")
        .join(item_domains, "item_id", "left")
        .withColumn(
            "behavior", F.when(F.col("item_domain") == F.col("domain"), F.col("boost")).otherwise(0.0)
        )
        .drop("boost")
    )
    names = ["vector", "tf", "graph", "behavior"]
    scaled = min_max(boosted, "query_id", names)
    score = sum((F.col(n) * w[n] for n in names[1:]), F.col(names[0]) * w[names[0]])
    fused = scaled.withColumn("fusion_score", half_up_column(score))
    return top_per_key(fused, ["query_id"], [F.desc("fusion_score"), F.asc("item_id")], limit)


def usage_signals(candidates: DataFrame, events: DataFrame, accepted: list[str]) -> DataFrame:
    """Popularity and acceptance of candidates, each relative to the best in its set.

    ``candidates``: ``query_id, item_id, usage_key``; ``events``: ``item, action``.
    """
    counts = events.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action").isin(*accepted)).alias("a")
    )
    joined = candidates.join(counts, F.col("usage_key") == F.col("item"), "left")
    tops = joined.groupBy("query_id").agg(F.max("n").alias("top_n"), F.max("a").alias("top_a"))
    share = lambda value, top: F.coalesce(F.col(value) / F.greatest(F.col(top), F.lit(1)), F.lit(0.0))
    return joined.join(tops, "query_id").select(
        "query_id", "item_id", share("n", "top_n").alias("popularity"), share("a", "top_a").alias("accepted")
    )


def rerank(candidates: DataFrame, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Six-signal weighted ranking with the dominant signal named.

    ``candidates``: ``query_id, item_id`` and one column per signal.
    """
    w = weights or rules.RANK_WEIGHTS
    if abs(sum(w.values()) - 1.0) > 0.02:
        raise ValueError("ranking weights must sum to 1")
    parts = {n: F.col(n) * F.lit(v) for n, v in w.items()}
    total = None
    for part in parts.values():
        total = part if total is None else total + part
    best = F.array_max(
        F.array(
            *[F.struct(F.round(p, 6).alias("c"), F.lit(-i).alias("r"), F.lit(n).alias("n")) for i, (n, p) in enumerate(parts.items())]
        )
    )
    scored = candidates.withColumns({"final_score": F.round(total, 6), "dominant": best["n"]})
    return top_per_key(scored, ["query_id"], [F.desc("final_score"), F.asc("item_id")], limit)


def recommend_documents(signals: DataFrame, limit: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """Vector, collaborative, item and peer signals per user blended with reasons.

    ``signals``: ``user_id, item_id, signal, score`` with raw scores for
    ``collab`` and ``peer``, which are scaled by the user's best.
    """
    w = weights or rules.DOCUMENT_WEIGHTS
    wide = merge_signals(signals, list(w), ["user_id", "item_id"])
    tops = wide.groupBy("user_id").agg(F.max("collab").alias("_c"), F.max("peer").alias("_p"))
    scaled = wide.join(tops, "user_id").withColumns(
        {
            "collab": F.col("collab") / F.greatest(F.col("_c"), F.lit(1.0)),
            "peer": F.col("peer") / F.greatest(F.col("_p"), F.lit(1.0)),
        }
    )
    total = None
    for n, v in w.items():
        total = F.col(n) * v if total is None else total + F.col(n) * v
    reasons = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) > 0, F.lit(n)) for n in w])), "+")
    out = scaled.drop("_c", "_p").withColumns({"final_score": F.round(total, 6), "reason": reasons})
    return top_per_key(out, ["user_id"], [F.desc("final_score"), F.asc("item_id")], limit)


def position_strength(results: DataFrame, strong: float = 0.55) -> DataFrame:
    """Case strength per query: best score plus support, with label bands."""
    per_query = results.groupBy("query_id").agg(
        F.max("score").alias("top"), F.count_if(F.col("score") >= strong).alias("n_strong")
    )
    value = F.least(F.lit(1.0), F.col("top") + F.least(F.col("n_strong") * 0.04, F.lit(0.15)))
    label = F.when(F.col("strength") >= 0.75, "strong").when(F.col("strength") >= 0.55, "moderate").otherwise("weak")
    return per_query.withColumn("strength", F.round(value, 6)).withColumn("label", label)


def reconcile_citations(cited: DataFrame, results: DataFrame, limit: int = 8, floor: float = 0.40) -> DataFrame:
    """Cited references first: matched rows keep their score, missing ones get 0.9.

    ``cited``: ``query_id, ref, place``; ``results``: ``query_id, ref, score``.
    Rows below the floor go, unless nothing else is left for the query.
    """
    best = results.groupBy("query_id", "ref").agg(F.max("score").alias("score"))
    marks = cited.groupBy("query_id", "ref").agg(F.min("place").alias("place"))
    joined = marks.join(best, ["query_id", "ref"], "full").withColumn(
        "grp", F.when(F.col("place").isNull(), 2).when(F.col("score").isNull(), 1).otherwise(0)
    )
    scored = joined.withColumn("score", F.coalesce("score", F.lit(0.9)))
    top = scored.groupBy("query_id").agg(F.max("score").alias("_top"))
    kept = scored.join(top, "query_id").filter(
        (F.col("score") >= floor) | ((F.col("_top") < floor) & (F.col("score") == F.col("_top")))
    )
    return top_per_key(
        kept, ["query_id"], [F.asc("grp"), F.desc("score"), F.asc("ref")], limit
    ).select("query_id", "ref", "score", "grp", "rank")


