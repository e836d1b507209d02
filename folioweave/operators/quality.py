"""Metrics, checks, gates and scorecards."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators.ranking import top_overall
from folioweave.rules import graph as graph_rules
from folioweave.rules import quality as rules


def banded(value: Column, bands: Sequence[tuple[float, int]], lowest: int) -> Column:
    """Points of the first band whose lower bound is reached."""
    chain = None
    for low, points in bands:
        chain = F.when(value >= low, points) if chain is None else chain.when(value >= low, points)
    return F.lit(lowest) if chain is None else chain.otherwise(lowest)


def one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side join of single-row aggregates."""
    out = None
    for frame in frames:
        keyed = frame.withColumn("_one", F.lit(1))
        out = keyed if out is None else out.join(keyed, "_one")
    return out.drop("_one")


def graph_facts(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """The measured value of every dimension of ``GRAPH_DIMENSIONS``, in one row.

    ``nodes``: ``node_type``; ``edges``: ``edge_type``; ``chunks``: ``has_path,
    has_ref``.  Both histograms are as small as their type sets, so only counts
    leave the tasks.  Unknown types count for the density alone.  An empty graph
    or corpus gives zeros.
    """
    families = graph_rules.EDGE_FAMILIES
    number = lambda kinds, column: F.coalesce(F.sum(F.when(F.col(column).isin(kinds), F.col("c"))), F.lit(0))
    total = F.coalesce(F.sum("c"), F.lit(0))
    by_node = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("c")).agg(
        total.alias("n"), F.count_if(F.col("node_type").isin(graph_rules.NODE_TYPES)).alias("node_types"),
        F.count_if(F.col("node_type").isin(graph_rules.STRUCTURE_NODES)).alias("structure_types"),
        number(graph_rules.SEMANTIC_NODES, "node_type").alias("semantic_nodes"),
    )
    by_edge = edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("c")).agg(
        total.alias("e"), F.count_if(F.col("edge_type").isin(list(graph_rules.EDGE_WEIGHTS))).alias("edge_types"),
        number(families["cross_document"], "edge_type").alias("cross_document_edges"),
        number(families["citation"], "edge_type").alias("citation_edges"),
    )
    share = lambda c: F.round(F.count_if(c) * 100 / F.greatest(F.count(F.lit(1)), F.lit(1)), 6)
    metadata = chunks.agg(share(F.col("has_path")).alias("chunk_path_pct"), share(F.col("has_ref")).alias("chunk_reference_pct"))
    return one_row(by_node, by_edge, metadata).withColumn("density", F.round(F.col("e") / F.greatest("n", F.lit(1)), 6))


def graph_scorecard(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``dimension, value, points, grade``: nine banded dimensions of a graph, their total of 100 and its grade.

    Inputs as ``graph_facts``; only the total has a grade.
    """
    dims = [
        F.struct(
            F.lit(name).alias("dimension"), F.col(name).cast("double").alias("value"),
            banded(F.col(name), bands, lowest).alias("points"), F.lit(None).cast("string").alias("grade"),
        )
        for name, bands, lowest in rules.GRAPH_DIMENSIONS
    ]
    points = F.aggregate("rows", F.lit(0), lambda acc, r: acc + r["points"])
    letter = None
    for low, name in rules.GRADES:
        letter = F.when(F.col("total") >= low, name) if letter is None else letter.when(F.col("total") >= low, name)
    total = F.struct(
        F.lit("total").alias("dimension"), F.col("total").cast("double").alias("value"), F.col("total").alias("points"),
        letter.otherwise(rules.LOWEST_GRADE).alias("grade"),
    )
    facts = graph_facts(nodes, edges, chunks).select(F.array(*dims).alias("rows"))
    return facts.withColumn("total", points).select(F.inline(F.concat("rows", F.array(total))))


def document_facts(docs: DataFrame, blocks: DataFrame, tables: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What the checks and risk warnings of a document are about, one row a document.

    ``docs``: ``doc_id, coverage``; ``blocks``: ``doc_id, raw_text, page, confidence,
    degraded``; ``tables``: ``doc_id, n_rows, n_columns, confidence``; ``chunks``:
    ``doc_id, content, degraded, n_refs``; ``nodes``: ``doc_id, node_type``;
    ``edges``: ``doc_id, edge_type``.  Each input becomes rows of indicators and all
    meet in one aggregation, which is combined before its only shuffle; a document of
    any size is a few numbers there.  Documents without rows in an input get zeros, a
    null coverage counts as 0, and a null text, page or reference count as absent.
    """
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    low = lambda limit: F.coalesce(F.col("confidence"), F.lit(0.0)) < limit
    measures = [
        (blocks, {
            "blocks": F.lit(True), "unplaced_blocks": F.col("page").isNull(),
            "placeholder_blocks": blank(F.col("raw_text")).isin(rules.PLACEHOLDERS) & (F.col("confidence") > rules.PLACEHOLDER_CONFIDENCE),
            "low_blocks": low(rules.LOW_CONFIDENCE), "degraded_blocks": F.col("degraded"),
        }),
        (tables, {
            "tables": F.lit(True), "broken_tables": (F.coalesce("n_rows", F.lit(0)) == 0) | (F.coalesce("n_columns", F.lit(0)) == 0),
            "low_tables": low(rules.LOW_TABLE_CONFIDENCE),
        }),
        (chunks, {
            "chunks": F.lit(True), "empty_chunks": blank(F.col("content")) == "", "degraded_chunks": F.col("degraded"),
            "unplaced_chunks": F.coalesce("n_refs", F.lit(0)) == 0,
        }),
        (nodes, {"graph_nodes": F.lit(True), "structure_units": F.col("node_type").isin("Section", "Article", "Clause")}),
        (edges, {"structural_edges": F.col("edge_type").isin(rules.STRUCTURAL_EDGES)}),
    ]
    rows = docs.select("doc_id", F.coalesce(F.col("coverage").cast("double"), F.lit(0.0)).alias("coverage"))
    names = []
    for frame, wanted in measures:
        own = frame.select("doc_id", *[c.cast("long").alias(n) for n, c in wanted.items()])
        rows, names = rows.unionByName(own, allowMissingColumns=True), [*names, *wanted]
    summed = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    return rows.groupBy("doc_id").agg(F.max("coverage").alias("coverage"), *summed).filter("coverage IS NOT NULL")


def risk_warnings(facts: DataFrame, warnings: Sequence[tuple[str, str]] = tuple(rules.RISK_WARNINGS)) -> DataFrame:
    """``doc_id, warning, n`` for every warning that a document's facts give rise to."""
    rows = F.array(*[F.struct(F.lit(n).alias("warning"), F.expr(e).cast("long").alias("n")) for n, e in warnings])
    return facts.select("doc_id", F.inline(rows)).filter("n > 0")


def document_metrics(structured: DataFrame, chunks: DataFrame, authority: float = 0.65) -> DataFrame:
    """Structure depth, quality class and chunk statistics per document.

    ``structured``: output of the hierarchy; ``chunks``: ``doc_id, tokens,
    confidence, degraded``.
    """
    shape = structured.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        *[F.count_if(F.col("unit") == u).alias(f"{u}s") for u in ("section", "article", "clause")],
        F.count_if((F.col("unit") == "article") & F.col("cur_section").isNotNull()).alias("articles_with_section"),
    )
    sizes = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("degraded").alias("degraded_chunks"),
        F.count_if(~F.col("degraded") & (F.col("confidence") >= authority)).alias("authoritative_chunks"),
        F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.max("tokens").alias("max_tokens"), F.min("tokens").alias("min_tokens"),
    )
    depth = F.when(F.col("clauses") > 0, 3).when(F.col("articles") > 0, 2).when(F.col("sections") > 0, 1).otherwise(0)
    quality = (
        F.when((F.col("articles") > 0) & (F.col("sections") > 0), "hierarchical")
        .when(F.col("articles") > 0, "article_level").when(F.col("sections") > 0, "section_level").otherwise("flat")
    )
    return shape.join(sizes, "doc_id", "left").withColumns({"depth": depth, "structure_quality": quality})


def missing_content(profiled: DataFrame, extracted: DataFrame) -> DataFrame:
    """Pages of the profile without any extracted block.

    ``profiled``: ``doc_id, page_count``; ``extracted``: ``doc_id, page``.
    """
    pages = profiled.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    return pages.join(extracted.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def check_suite(facts: DataFrame, checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per document and check: ``(name, severity, boolean expression)``."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.expr(e).alias("passed"))
            for n, s, e in checks
        ]
    )
    return facts.select("doc_id", F.inline(rows))


def run_rollup(results: DataFrame, by: str) -> DataFrame:
    """Worst status per group with counts of failed checks."""
    failed = ~F.col("passed")
    level = F.max(F.when(failed & (F.col("severity") == "fail"), 2).when(failed, 1).otherwise(0))
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(failed).alias("failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(failed, F.col("check")))), ",").alias("failed_checks"),
        level.alias("_l"),
    ).withColumn("status", F.when(F.col("_l") == 2, "fail").when(F.col("_l") == 1, "warning").otherwise("pass")).drop("_l")


def retrieval_metrics(rows: DataFrame, general: str = "general") -> DataFrame:
    """Benchmark metrics over all queries in one row.

    ``rows``: ``query_id, expected, top1, top3 array, top_score, is_fallback,
    is_empty, cross_error``.
    """
    named = F.col("expected") != general
    pct = lambda hit, base: F.round(F.count_if(hit) / F.greatest(F.count_if(base), F.lit(1)) * 100, 4)
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(named).alias("named_queries"),
        pct(named & (F.col("top1") == F.col("expected")), named).alias("top1_accuracy_pct"),
        pct(named & F.array_contains("top3", F.col("expected")), named).alias("top3_accuracy_pct"),
        pct(named & F.col("cross_error"), named).alias("cross_domain_error_pct"),
        pct(F.col("is_empty"), F.lit(True)).alias("empty_rate_pct"),
        pct(F.col("is_fallback"), F.lit(True)).alias("fallback_rate_pct"),
        F.round(F.avg(F.when(F.col("top_score") > 0, F.col("top_score"))), 6).alias("mean_top1_score"),
    )


def worst_queries(rows: DataFrame, general: str = "general", k: int = 5) -> DataFrame:
    """``query_id, expected, top1, top_score, rank``: the ``k`` answers with the least score among named queries that missed.

    ``rows`` as in ``retrieval_metrics``.  A query without an answer has score 0 and
    a null ``top1`` and comes first; ties go to the smaller id.
    """
    missed = (F.col("expected") != general) & ~F.coalesce(F.col("top1") == F.col("expected"), F.lit(False))
    scored = rows.filter(missed).select("query_id", "expected", "top1", F.coalesce("top_score", F.lit(0.0)).alias("top_score"))
    return top_overall(scored, [F.asc("top_score"), F.asc("query_id")], k)


# Targets of the retrieval gate.
RETRIEVAL_TARGETS = [
    ("top1_accuracy_pct", ">=", 85.0), ("top3_accuracy_pct", ">=", 90.0), ("cross_domain_error_pct", "==", 0.0),
    ("empty_rate_pct", "==", 0.0), ("fallback_rate_pct", "<=", 30.0), ("mean_top1_score", ">=", 0.55),
]


def gate(metrics: DataFrame, targets=tuple(RETRIEVAL_TARGETS)) -> DataFrame:
    """One row per target with its value and whether it is met."""
    ops = {">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t, "==": lambda v, t: v == t}
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(t).alias("target"), ops[o](F.col(n), F.lit(t)).alias("passed"))
            for n, o, t in targets
        ]
    )
    return metrics.select(F.inline(rows))


def release_gates(smoke: DataFrame, retrieval: DataFrame, manual: DataFrame) -> DataFrame:
    """``gate, level, value, passed``: hard gates, the share of smoke cases, retrieval targets and manual scenarios.

    ``smoke``: ``case_id, passed, findings array<string>``; ``retrieval``: ``gate,
    value, passed`` (as ``gate`` gives it); ``manual``: ``scenario, passed``.  A hard
    gate's value is its number of findings.  Gates over an empty report fail: what was
    not tested is not released.
    """
    findings = F.coalesce("findings", F.array().cast("array<string>"))

    def number(any_of: Sequence[str], all_of: Sequence[str]) -> Column:
        hits = F.filter(findings, lambda x: _mentions(x, any_of) & (_mentions(x, all_of) if all_of else F.lit(True)))
        return F.coalesce(F.sum(F.size(hits)), F.lit(0))

    counts = {name: number(any_of, all_of) for name, any_of, all_of in rules.HARD_GATES}
    cases = smoke.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("good"), *[c.alias(n) for n, c in counts.items()]
    )
    row = lambda gate, level, value, passed: F.struct(
        F.lit(gate).alias("gate"), F.lit(level).alias("level"), value.cast("double").alias("value"), passed.alias("passed")
    )
    some = F.col("cases") > 0
    needed = F.greatest(F.lit(1), F.floor(F.col("cases") * rules.SMOKE_SHARE_TENTHS / 10))
    hard = cases.select(F.inline(F.array(
        *[row(n, "hard", F.col(n), some & (F.col(n) == 0)) for n in counts],
        row("smoke_cases", "beta", F.col("good"), F.col("good") >= needed),
    )))
    error = F.col("gate") == "cross_domain_error_pct"
    measured = retrieval.select("gate", F.when(error, "hard").otherwise("general").alias("level"), F.col("value").cast("double").alias("value"), "passed")
    by_hand = manual.agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("good")).select(F.inline(F.array(
        row("manual_scenarios", "general", F.col("good"), (F.col("n") >= rules.MANUAL_SCENARIOS) & (F.col("good") >= rules.MANUAL_SCENARIOS))
    )))
    return hard.unionByName(measured).unionByName(by_hand)


def _mentions(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def release_decision(gates: DataFrame) -> DataFrame:
    """``beta, general, failed``: beta needs the hard and beta gates, general release every gate.

    ``gates``: as ``release_gates``; ``failed`` lists the gates that did not pass.
    """
    failed = ~F.col("passed")
    return gates.agg(
        F.coalesce(F.bool_and(F.col("passed") | (F.col("level") == "general")), F.lit(False)).alias("beta"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("general"),
        F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("gate")))), ",").alias("failed"),
    )


def knowledge_base_scorecard(chunks: DataFrame) -> DataFrame:
    """Banded score over length, vector, path and source coverage.

    ``chunks``: ``content, has_vector, has_path, source``.
    """
    n = F.length("content")
    facts = chunks.agg(
        F.count(F.lit(1)).alias("total"), F.avg(F.col("has_vector").cast("double")).alias("v"),
        F.avg(F.col("has_path").cast("double")).alias("p"), F.countDistinct("source").alias("s"),
        F.avg(((n >= 100) & (n <= 4000)).cast("double")).alias("g"), F.floor(F.sum(n) / F.count(F.lit(1))).alias("mean_length"),
    )
    points = {
        "vector_points": banded(F.col("v") * 100, [(95, 30), (80, 22), (60, 14)], 5),
        "length_points": banded(F.col("g") * 100, [(80, 25), (60, 18), (40, 10)], 3),
        "source_points": banded(F.col("s"), [(20, 20), (10, 15), (5, 9)], 3),
        "path_points": banded(F.col("p") * 100, [(80, 15), (50, 10), (20, 5)], 1),
    }
    total = sum(list(points.values())[1:], list(points.values())[0])
    return facts.withColumns({**points, "score": total}).select("total", "mean_length", *points, "score").withColumn(
        "grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C")
        .when(F.col("score") >= 45, "D").otherwise("F"),
    )


def stage_latency(traces: DataFrame) -> DataFrame:
    """Count, error share, mean and percentiles of durations per stage.

    Durations are pre-counted per value, so a stage that holds most events does
    not collect them in one place; percentiles are exact.
    """
    from pyspark.sql import Window

    totals = traces.groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.avg((F.col("status") == "error").cast("double")), 6).alias("error_share"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
    )
    counts = traces.groupBy("stage", "duration_ms").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("stage")
    run = counts.withColumns(
        {"upto": F.sum("c").over(w.orderBy("duration_ms")), "n": F.sum("c").over(w)}
    )
    pick = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("duration_ms")))
    marks = run.groupBy("stage").agg(pick(0.5).alias("p50_ms"), pick(0.95).alias("p95_ms"))
    return totals.join(marks, "stage")
