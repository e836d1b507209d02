"""Checks, warnings, scorecards and gates on small cases with known verdicts."""

from folioweave.operators import graph_build, quality
from folioweave.rules import graph as graph_rules
from folioweave.rules import quality as rules


def facts_of(spark, docs, blocks=(), tables=(), chunks=(), nodes=(), edges=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return quality.document_facts(
        frame(docs, "doc_id long, coverage double"),
        frame(blocks, "doc_id long, raw_text string, page int, confidence double, degraded boolean"),
        frame(tables, "doc_id long, n_rows int, n_columns int, confidence double"),
        frame(chunks, "doc_id long, content string, degraded boolean, n_refs int"),
        frame(nodes, "doc_id long, node_type string"), frame(edges, "doc_id long, edge_type string"),
    )


def failed(facts):
    rows = quality.check_suite(facts, rules.DOCUMENT_CHECKS).filter("NOT passed").collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add(r.check)
    return out


def test_each_check_fails_for_its_own_reason(spark):
    good = dict(block=("text", 1, 0.9, False), table=(2, 2, 0.9), chunk=("text", False, 1))
    spoiled = {
        1: {}, 2: {"block": None}, 3: {"coverage": 0.29}, 4: {"block": ("text", None, 0.9, False)}, 5: {"block": (" N/A ", 1, 0.9, False)},
        6: {"table": (0, 2, 0.9)}, 7: {"block": ("text", 1, 0.64, False)}, 8: {"chunk": None}, 9: {"chunk": (" \t", False, 1)},
        10: {"chunk": ("text", True, 1)}, 11: {"chunk": ("text", False, 0)}, 12: {"nodes": 0}, 13: {"edge": "CITES"}, 14: {"chunks": 3},
        15: {"block": (None, 1, 0.9, False)}, 16: {"block": ("N/A", 1, 0.8, False)}, 17: {"coverage": None},
    }
    docs, blocks, tables, chunks, nodes, edges = [], [], [], [], [], []
    for d, change in spoiled.items():
        own = {**good, "coverage": 1.0, "nodes": 2, "edge": "CONTAINS", "chunks": 1, **change}
        docs.append((d, own["coverage"]))
        blocks += [(d, *own["block"])] if own["block"] else []
        tables += [(d, *own["table"])]
        chunks += [(d, *own["chunk"])] * own["chunks"] if own["chunk"] else []
        nodes += [(d, "Chunk")] * own["nodes"]
        edges += [(d, own["edge"])]
    got = failed(facts_of(spark, docs, blocks, tables, chunks, nodes, edges))
    assert got == {
        2: {"blocks_present"}, 3: {"coverage"}, 4: {"block_provenance"}, 5: {"no_invented_text"}, 6: {"tables_intact"},
        7: {"low_confidence_rate"}, 8: {"chunks_present"}, 9: {"no_empty_chunks"}, 10: {"degraded_chunk_rate"}, 11: {"chunk_provenance"},
        12: {"graph_has_nodes", "no_orphan_chunks"}, 13: {"structural_edges"}, 14: {"no_orphan_chunks"}, 15: {"no_invented_text"}, 17: {"coverage"},
    }


def test_documents_without_anything_and_rows_without_document(spark):
    got = facts_of(spark, [(1, 0.5)], blocks=[(2, "x", 1, 0.9, False), (None, "x", 1, 0.9, False)]).collect()
    assert [(r.doc_id, r.blocks, r.graph_nodes) for r in got] == [(1, 0, 0)]
    assert facts_of(spark, []).count() == 0


def test_risk_warnings_state_their_numbers(spark):
    blocks = [(1, "x", 1, 0.5, i < 2) for i in range(21)] + [(2, "x", 1, 0.9, False)] * 21 + [(3, "x", 1, 0.9, False)] * 20
    facts = facts_of(
        spark, [(1, 1.0), (2, 1.0), (3, 1.0)], blocks, [(1, 1, 1, 0.69), (1, 1, 1, 0.7), (2, 1, 1, None)], nodes=[(2, "Article")]
    )
    got = {(r.doc_id, r.warning): r.n for r in quality.risk_warnings(facts).collect()}
    assert got == {
        (1, "low_confidence_blocks"): 21, (1, "degraded_blocks"): 2, (1, "no_structure_in_large_document"): 21, (1, "low_confidence_tables"): 1,
        (2, "low_confidence_tables"): 1,
    }


def test_graph_scorecard_bands_total_and_grade(spark):
    nodes = spark.createDataFrame([(t,) for t in ["Document", "Section", "Article", "Clause", "Chunk"]] + [("Obligation",)] * 50 + [("Strange",)], "node_type string")
    kinds = ["CONTAINS"] * 30 + ["CITES"] * 30 + ["AMENDS"] * 5 + ["Strange"] * 19
    edges = spark.createDataFrame([(k, i % 3) for i, k in enumerate(kinds)], "edge_type string, doc_id int")
    chunks = spark.createDataFrame([(True, i < 4) for i in range(10)], "has_path boolean, has_ref boolean")
    got = {r.dimension: (r.value, r.points, r.grade) for r in quality.graph_scorecard(nodes, edges, chunks).collect()}
    assert got == {
        "node_types": (6.0, 4, None), "edge_types": (3.0, 2, None), "cross_document_edges": (5.0, 5, None), "citation_edges": (30.0, 7, None),
        "semantic_nodes": (50.0, 7, None), "chunk_path_pct": (100.0, 15, None), "chunk_reference_pct": (40.0, 7, None),
        "density": (1.5, 4, None), "structure_types": (5.0, 10, None), "total": (61.0, 61, "C"),
    }
    assert sum(bands[0][1] for _, bands, _ in rules.GRAPH_DIMENSIONS) == 100
    empty = quality.graph_scorecard(nodes.limit(0), edges.limit(0), chunks.limit(0)).collect()
    assert [(r.points, r.grade) for r in empty if r.dimension == "total"] == [(2, "F")]


def test_graph_stats_count_documents_and_families(spark):
    nodes = spark.createDataFrame([("Document",), ("Article",), ("Strange",)], "node_type string")
    edges = spark.createDataFrame(
        [("CITES", 1), ("CITES", 1), ("CITES", 2), ("ALIAS_OF", 3), ("DEFINES", 3), ("CONTAINS", 1)], "edge_type string, doc_id int"
    )
    got = {r.metric: r.value for r in graph_build.graph_stats(nodes, edges).collect()}
    assert (got["docs_with_cites"], got["docs_with_alias"], got["density"], got["node:Strange"]) == (2.0, 1.0, 2.0, 1.0)
    assert got["node_type_pct"] == round(200 / len(graph_rules.NODE_TYPES), 6) and got["edge_type_pct"] == round(400 / len(graph_rules.EDGE_WEIGHTS), 6)
    assert {k: v for k, v in got.items() if k.startswith("family:")} == {
        "family:structural": 1.0, "family:citation": 3.0, "family:semantic": 1.0, "family:cross_document": 1.0,
    }


def gates(spark, findings, good=10, error=0.0, by_hand=15):
    smoke = spark.createDataFrame([(i, True, []) for i in range(good)] + [(100 + i, False, [f]) for i, f in enumerate(findings)], "case_id int, passed boolean, findings array<string>")
    retrieval = spark.createDataFrame([("cross_domain_error_pct", error, error == 0), ("top1_accuracy_pct", 90.0, True)], "gate string, value double, passed boolean")
    manual = spark.createDataFrame([(i, True) for i in range(by_hand)], "scenario int, passed boolean")
    return quality.release_decision(quality.release_gates(smoke, retrieval, manual)).first()


def test_release_needs_every_hard_gate_and_nine_tenths(spark):
    assert gates(spark, []) == (True, True, "")
    assert gates(spark, ["slow answer"]) == (True, True, "")
    assert gates(spark, ["slow answer"], good=8) == (True, True, "")
    assert gates(spark, ["slow answer"] * 3, good=9) == (False, False, "smoke_cases")
    assert gates(spark, ["[P0] Forbidden phrase"]) == (False, False, "contradictions,forbidden_phrases")
    assert gates(spark, ["forbidden phrase"]) == (True, True, "")
    assert gates(spark, ["HTTP 503"]) == (False, False, "server_errors")
    assert gates(spark, ["is_demo missing"]) == (False, False, "demo_labels")
    assert gates(spark, [], error=3.0) == (False, False, "cross_domain_error_pct")
    assert gates(spark, [], by_hand=14) == (True, False, "manual_scenarios")
    assert gates(spark, [], good=0)[0] is False


def test_worst_queries_are_the_named_ones_that_missed(spark):
    rows = spark.createDataFrame(
        [(1, "a", "a", 0.1), (2, "a", "b", 0.7), (3, "general", "b", 0.0), (4, "a", None, None), (5, "b", "a", 0.7), (6, "b", "a", 0.2)],
        "query_id int, expected string, top1 string, top_score double",
    )
    assert [(r.query_id, r.top_score) for r in quality.worst_queries(rows, k=3).collect()] == [(4, 0.0), (6, 0.2), (2, 0.7)]


def test_grids_are_runs_of_marked_lines(spark):
    texts = {1: ["a,b", "c,d,e", "x", "f,g", "y", "h,i", "j,k"], 2: ["no", None, ""], 3: ["a,b", "c,d"]}
    lines = spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, pos int, raw_text string")
    got = sorted(tuple(r) for r in graph_build.line_grids(lines).collect())
    assert got == [(1, "table_0", "a,b", 0, 2, 3), (1, "table_5", "h,i", 5, 2, 2), (3, "table_0", "a,b", 0, 2, 2)]
    rows = spark.createDataFrame([(1, "table_0", " ", 0.8, None), (1, "table_5", None, None, True), (2, "t", " Fees ", 0.8, False)], "doc_id long, source string, title string, confidence double, degraded boolean")
    nodes = graph_build.attachment_nodes(rows, "Table").collect()
    assert [(n.label, n.degraded) for n in nodes] == [("table_0", False), ("table_5", True), ("Fees", False)]
    edges = graph_build.attachment_edges(rows, "HAS_TABLE", "Table").collect()
    assert {e.dst for e in edges} == {n.node_id for n in nodes} and len({e.src for e in edges}) == 2
