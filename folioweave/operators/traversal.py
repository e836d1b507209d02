"""Bounded breadth-first expansion for many queries at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.rules import graph as rules
from folioweave.session import stage_table


@dataclass(frozen=True)
class Policy:
    """Which edges to follow, how deep to go, when to stop."""

    allowed: tuple[str, ...] = field(default=tuple(rules.ALLOWED_EDGES))
    blocked: tuple[str, ...] = field(default=tuple(rules.BLOCKED_EDGES))
    max_depth: int = rules.MAX_DEPTH
    min_edge_confidence: float = rules.MIN_EDGE_CONFIDENCE
    max_fan_out: int = rules.MAX_FAN_OUT
    max_nodes: int = rules.MAX_NODES
    min_node_score: float = rules.MIN_NODE_SCORE


def usable_edges(edges: DataFrame, policy: Policy) -> DataFrame:
    """Edges the policy allows with their weight; filters run before any join."""
    weights = F.create_map(*[F.lit(x) for kv in rules.EDGE_WEIGHTS.items() for x in kv])
    types = [t for t in policy.allowed if t not in policy.blocked]
    return edges.filter(
        F.col("edge_type").isin(*types) & (F.col("confidence") >= policy.min_edge_confidence)
    ).select(
        "src", "dst", "edge_id", "edge_type",
        (F.coalesce(weights[F.col("edge_type")], F.lit(rules.UNKNOWN_EDGE_WEIGHT)) * F.col("confidence")).alias("gain"),
    )


def neighbours(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None, min_confidence: float = 0.60) -> DataFrame:
    """Direct neighbours over confident edges of the given types."""
    kept = edges.filter(F.col("confidence") >= min_confidence)
    kept = kept if types is None else kept.filter(F.col("edge_type").isin(*types))
    return kept.join(nodes.select(F.col("node_id").alias("dst"), "node_type", "label"), "dst").select(
        "src", "dst", "edge_type", "node_type", "label"
    )


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Expansion of all queries level by level.

    ``seeds``: ``query_id, node_id, seq`` (order of the seeds).  ``edges`` are
    followed in the order of ``edge_id``.  Result rows: ``query_id, node_id,
    depth, score, place`` (discovery order), ``kept``: false for nodes below the
    score floor, which are seen but not expanded, and the way a node was reached:
    ``parent_place`` (the place of the node before it) and ``edge_id``, null for
    seeds; ``with_paths`` follows them back.

    The state of a query is bounded by ``max_nodes`` results, so a node can lose
    at most ``max_nodes × max_fan_out`` targets to nodes before it.  Hence only
    that many edges per node and level are looked at, which bounds the work on
    hubs, and the sequential part (each node takes the first free targets) is a
    fold over that bounded list.  Each level is written to the shared folder.
    """
    policy = policy or Policy()
    follow = usable_edges(edges, policy)
    facts = nodes.select("node_id", F.col("confidence").alias("node_conf"), "degraded")
    claims = policy.max_fan_out * (policy.max_nodes + 1)
    # the first edge to each target and its place below its source don't depend on the query
    pair = Window.partitionBy("src", "dst").orderBy("edge_id")
    single = follow.withColumn("_e", F.row_number().over(pair)).filter(F.col("_e") == 1).drop("_e")
    ranked = stage_table(single.withColumn("edge_no", F.row_number().over(Window.partitionBy("src").orderBy("edge_id"))))

    start = (
        seeds.join(facts, "node_id")
        .groupBy("query_id", "node_id")
        .agg(F.min("seq").alias("seq"), F.first("node_conf").alias("node_conf"))
        .select(
            "query_id", "node_id", F.lit(0).alias("depth"),
            F.greatest(F.col("node_conf"), F.lit(0.5)).alias("score"), F.col("seq").cast("bigint").alias("order_no"),
            F.lit(None).cast("bigint").alias("parent_place"), F.lit(None).cast("string").alias("edge_id"),
        )
    )
    level = stage_table(_settle(start, None, policy))
    done = level
    for depth in range(1, policy.max_depth + 1):
        frontier = level.filter(F.col("kept")).select(
            "query_id", F.col("node_id").alias("src"), F.col("place").alias("parent_place"),
            F.col("score").alias("parent_score"),
        )
        seen = done.select("query_id", F.col("node_id").alias("dst"))
        # targets that a query has seen push the wanted ones back by at most their number
        most = done.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        near = ranked.filter(F.col("edge_no") <= claims + most).drop("edge_no")
        nearest = frontier.join(near, "src").join(seen, ["query_id", "dst"], "left_anti")
        by_parent = Window.partitionBy("query_id", "src").orderBy("edge_id")
        capped = nearest.withColumn("nth", F.row_number().over(by_parent)).filter(F.col("nth") <= claims)
        taken = (
            capped.groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct("parent_place", "nth", "dst", "parent_score", "gain", "edge_id"))).alias("c"))
            .select("query_id", _claim(policy.max_fan_out).alias("t"))
            .select("query_id", F.posexplode("t").alias("order_no", "t"))
        )
        raw = F.col("t.parent_score") * F.col("t.gain") - F.lit(depth * rules.DEPTH_PENALTY)
        scored = (
            taken.withColumn("node_id", F.col("t.dst"))
            .join(facts, "node_id")
            .select(
                "query_id", "node_id", F.lit(depth).alias("depth"),
                F.greatest(
                    F.when(F.col("degraded"), raw * rules.DEGRADED_FACTOR).otherwise(raw), F.lit(0.0)
                ).alias("score"),
                F.col("order_no").cast("bigint").alias("order_no"), "t.parent_place", "t.edge_id",
            )
        )
        level = stage_table(_settle(scored, done, policy))
        done = done.unionByName(level)
    return done


def _claim(fan_out: int):
    """Fold: every parent in turn takes its first ``fan_out`` free targets."""
    item = "struct<parent_place:bigint,nth:int,dst:string,parent_score:double,gain:double,edge_id:string>"
    start = F.struct(
        F.lit(-1).cast("bigint").alias("parent"), F.lit(0).alias("count"),
        F.array().cast("array<string>").alias("ids"), F.array().cast(f"array<{item}>").alias("out"),
    )

    def step(acc, c):
        used = F.when(acc["parent"] == c["parent_place"], acc["count"]).otherwise(F.lit(0))
        free = (used < fan_out) & ~F.array_contains(acc["ids"], c["dst"])
        return F.struct(
            c["parent_place"].alias("parent"),
            F.when(free, used + 1).otherwise(used).alias("count"),
            F.when(free, F.concat(acc["ids"], F.array(c["dst"]))).otherwise(acc["ids"]).alias("ids"),
            F.when(free, F.concat(acc["out"], F.array(c))).otherwise(acc["out"]).alias("out"),
        )

    typed = F.transform(
        "c",
        lambda c: F.struct(
            c["parent_place"].cast("bigint").alias("parent_place"), c["nth"].alias("nth"), c["dst"].alias("dst"),
            c["parent_score"].alias("parent_score"), c["gain"].alias("gain"), c["edge_id"].alias("edge_id"),
        ),
    )
    return F.aggregate(typed, start, step, lambda acc: acc["out"])


def _settle(level: DataFrame, before: DataFrame | None, policy: Policy) -> DataFrame:
    """Apply the score floor and the node budget; number the results."""
    order = Window.partitionBy("query_id").orderBy("order_no", "node_id")
    kept = F.col("score") >= policy.min_node_score
    numbered = level.withColumn("kept", kept).withColumn(
        "nth", F.sum(F.col("kept").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    if before is None:
        placed = numbered.withColumn("place", F.col("nth"))
    else:
        used = before.groupBy("query_id").agg(F.count_if("kept").alias("used"))
        placed = numbered.join(used, "query_id").withColumn("place", F.col("nth") + F.col("used")).drop("used")
    # a suppressed node counts only while the budget is not yet used up
    within = F.when(F.col("kept"), F.col("place") <= policy.max_nodes).otherwise(F.col("place") < policy.max_nodes)
    return placed.filter(within).select(
        "query_id", "node_id", "depth", "score", "place", "kept", "order_no", "parent_place", "edge_id"
    )


def with_paths(expanded: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Rows of ``expand`` with ``path_nodes`` (from the seed to the node itself) and ``path_edges``.

    Paths are rebuilt from the parents level by level.  A parent is always a
    kept node, and its place is unique among the kept nodes of a query; a path
    has at most ``max_depth`` edges.
    """
    policy = policy or Policy()
    level = expanded.filter("depth = 0").select(
        "*", F.array("node_id").alias("path_nodes"), F.array().cast("array<string>").alias("path_edges")
    )
    done = level
    for depth in range(1, policy.max_depth + 1):
        above = level.filter("kept").select(
            "query_id", F.col("place").alias("parent_place"), F.col("path_nodes").alias("_n"), F.col("path_edges").alias("_e")
        )
        level = (
            expanded.filter(F.col("depth") == depth).join(above, ["query_id", "parent_place"])
            .select(
                *expanded.columns, F.concat("_n", F.array("node_id")).alias("path_nodes"),
                F.concat("_e", F.array("edge_id")).alias("path_edges"),
            )
        )
        done = done.unionByName(level)
    return done


def stop_reasons(seeds: DataFrame, expanded: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Why each query stopped, with result and suppressed counts."""
    policy = policy or Policy()
    counts = expanded.groupBy("query_id").agg(
        F.count_if("kept").alias("results"), F.count_if(~F.col("kept")).alias("suppressed"),
        F.max(F.when(F.col("kept"), F.col("depth"))).alias("deepest"),
    )
    reason = (
        F.when(F.col("results").isNull(), "no_valid_seeds")
        .when(F.col("results") >= policy.max_nodes, "budget_exhausted")
        .when(F.col("deepest") >= policy.max_depth, "depth_limit")
        .otherwise("complete")
    )
    return seeds.select("query_id").distinct().join(counts, "query_id", "left").select(
        "query_id", F.coalesce("results", F.lit(0)).alias("results"),
        F.coalesce("suppressed", F.lit(0)).alias("suppressed"), reason.alias("stop_reason"),
    )


def evidence_bundles(seed_chunks: DataFrame, expanded: DataFrame, chunks: DataFrame, authority: float = rules.AUTHORITY) -> DataFrame:
    """Seeds and expanded chunks per query with confidence and support status.

    ``seed_chunks``: ``query_id, chunk_id``; ``expanded``: ``query_id, chunk_id``;
    ``chunks``: ``chunk_id, confidence, degraded``.  A seed weighs twice.
    """
    members = (
        seed_chunks.select("query_id", "chunk_id", F.lit(2.0).alias("w"))
        .unionByName(expanded.select("query_id", "chunk_id", F.lit(1.0).alias("w")))
        .groupBy("query_id", "chunk_id").agg(F.max("w").alias("w"))
    )
    joined = members.join(chunks, "chunk_id")
    sums = joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("w") == 2.0).alias("n_seeds"),
        F.count_if("degraded").alias("n_degraded"),
        F.count_if(~F.col("degraded") & (F.col("confidence") >= authority)).alias("n_authoritative"),
        F.round(F.sum(F.col("confidence") * F.col("w")) / F.sum("w"), 6).alias("confidence"),
    )
    status = (
        F.when((F.col("n_chunks") == 0) | (F.col("n_seeds") == 0), "unsupported")
        .when(F.col("n_authoritative") == 0, "partially_supported")
        .when(F.col("n_degraded") > F.floor(F.col("n_chunks") / 2), "partially_supported")
        .otherwise("supported")
    )
    return sums.withColumn("status", status)


def bundle_contents(
    queries: DataFrame, seed_chunks: DataFrame, reached: DataFrame, chunks: DataFrame, authority: float = rules.AUTHORITY
) -> DataFrame:
    """What a query's bundle holds: evidence in order, citations, graph paths, warnings.

    ``queries``: ``query_id``, one row each in the result; ``seed_chunks``:
    ``query_id, chunk_id, seq``; ``reached``: kept rows of ``with_paths`` with
    ``chunk_id`` (null for nodes that are no chunk); ``chunks``: ``chunk_id,
    confidence, degraded, citations`` (array of strings or null).

    Seeds come first in their order, then reached chunks by score and discovery,
    each chunk once.  ``citations`` are the distinct non-empty citations in the
    order of the evidence, ``paths`` the ways of the nodes that an edge reached,
    best score first.  ``warnings`` are ``missing_chunk:<id>`` for chunks without
    a row, ``below_authority`` if no chunk is authoritative, ``no_seeds``.  Lists
    are bounded by the seeds and the node budget of a query.
    """
    place = lambda part, score, no: F.struct(
        F.lit(part).alias("part"), score.alias("below"), no.cast("bigint").alias("no")
    )
    members = (
        seed_chunks.select("query_id", "chunk_id", place(0, F.lit(0.0), F.col("seq")).alias("at"))
        .unionByName(reached.filter(F.col("chunk_id").isNotNull()).select(
            "query_id", "chunk_id", place(1, -F.col("score"), F.col("place")).alias("at")
        ))
        .groupBy("query_id", "chunk_id").agg(F.min("at").alias("at"))
        .join(chunks.select("chunk_id", "confidence", "degraded", "citations", F.lit(True).alias("known")), "chunk_id", "left")
    )
    none = F.array().cast("array<string>")
    row = F.struct("at", "chunk_id", F.coalesce("citations", none).alias("citations"))
    held = members.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), row))).alias("e"),
        F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("chunk_id")))).alias("missing"),
        F.count_if(F.col("known") & ~F.col("degraded") & (F.col("confidence") >= authority)).alias("good"),
        F.count_if(F.col("at.part") == 0).alias("seeds"),
    )
    ways = reached.filter(F.size("path_edges") > 0).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "place", "path_nodes", "path_edges"))).alias("w")
    )
    all_of = queries.select("query_id").distinct().join(held, "query_id", "left").join(ways, "query_id", "left")
    cited = F.flatten(F.transform("e", lambda s: s["citations"]))
    return all_of.select(
        "query_id",
        F.coalesce(F.transform("e", lambda s: s["chunk_id"]), none).alias("evidence"),
        F.coalesce(F.array_distinct(F.filter(cited, lambda c: c != "")), none).alias("citations"),
        F.coalesce(F.transform("w", lambda s: s["path_nodes"]), F.array().cast("array<array<string>>")).alias("paths"),
        F.coalesce(F.transform("w", lambda s: s["path_edges"]), F.array().cast("array<array<string>>")).alias("path_edges"),
        F.concat(
            F.coalesce(F.transform("missing", lambda m: F.concat(F.lit("missing_chunk:"), m)), none),
            F.when((F.size("e") > 0) & (F.col("good") == 0), F.array(F.lit("below_authority"))).otherwise(none),
            F.when(F.coalesce("seeds", F.lit(0)) == 0, F.array(F.lit("no_seeds"))).otherwise(none),
        ).alias("warnings"),
    )


def excerpts(bundle_chunks: DataFrame, k: int = 5, authority: float = rules.AUTHORITY) -> DataFrame:
    """Authoritative chunks first (all if none), cut at a sentence end.

    ``bundle_chunks``: ``query_id, chunk_id, content, confidence, degraded, place``.
    """
    from folioweave.functions.text import excerpt
    from folioweave.operators.ranking import top_per_key

    good = (~F.col("degraded")) & (F.col("confidence") >= authority)
    flags = bundle_chunks.groupBy("query_id").agg(F.bool_or(good).alias("_any"))
    kept = bundle_chunks.join(flags, "query_id").filter(good | ~F.col("_any"))
    top = top_per_key(kept, ["query_id"], [F.asc("place"), F.asc("chunk_id")], k)
    return top.select(
        "query_id", "chunk_id", "rank", excerpt(F.col("content")).alias("excerpt"),
        F.when(F.col("_any"), "authoritative").otherwise("low_confidence").alias("basis"),
    )


def gated_reports(requests: DataFrame, bundles: DataFrame) -> DataFrame:
    """Status of a report request from the state of its bundles.

    ``requests``: ``request_id, mode, query_id``; ``bundles``: ``query_id,
    status``.  Comparing needs two populated sides, a compliance review both its
    sides, the other modes one sufficient bundle.
    """
    joined = requests.join(bundles.select("query_id", "status"), "query_id", "left")
    counts = joined.groupBy("request_id", "mode").agg(
        F.count(F.lit(1)).alias("sides"),
        F.count_if(F.col("status") == "supported").alias("full"),
        F.count_if(F.col("status") == "partially_supported").alias("partial"),
    )
    populated = F.col("full") + F.col("partial")
    need = F.when(F.col("mode") == "compare", 2).when(F.col("mode") == "compliance", F.col("sides")).otherwise(1)
    outcome = (
        F.when(populated == 0, "refused")
        .when(populated < need, "insufficient")
        .when(F.col("full") >= need, "complete")
        .otherwise("partial")
    )
    return counts.withColumn("outcome", outcome)
