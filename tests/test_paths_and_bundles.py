"""Paths of the expansion and what an evidence bundle holds."""

import random

from folioweave.operators import traversal


def test_paths_lead_from_seed_to_node(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(25)]
    edges = [(f"e{i:03d}", rng.choice(["CONTAINS", "CITES"]), rng.choice(names), rng.choice(names), 0.95) for i in range(120)]
    nodes = spark.createDataFrame([(n, 0.9, False) for n in names], "node_id string, confidence double, degraded boolean")
    frame = spark.createDataFrame(edges, "edge_id string, edge_type string, src string, dst string, confidence double")
    seeds = spark.createDataFrame([(1, "n00", 0), (2, "n03", 0), (2, "n07", 1)], "query_id int, node_id string, seq int")
    policy = traversal.Policy(max_fan_out=3, max_nodes=12, min_node_score=0.3)
    found = traversal.expand(seeds, nodes, frame, policy)
    rows = traversal.with_paths(found, policy).collect()
    ends = {e[0]: (e[2], e[3]) for e in edges}
    kept = {(r.query_id, r.node_id) for r in rows if r.kept}
    assert len(rows) == found.count() and max(r.depth for r in rows) >= 2
    for r in rows:
        assert r.path_nodes[-1] == r.node_id and len(r.path_edges) == r.depth == len(r.path_nodes) - 1
        assert r.path_nodes[0] in {1: ["n00"], 2: ["n03", "n07"]}[r.query_id]
        # each edge joins its neighbours in the path, and only kept nodes lead on
        assert [ends[e] for e in r.path_edges] == list(zip(r.path_nodes, r.path_nodes[1:]))
        assert all((r.query_id, n) in kept for n in r.path_nodes[:-1])


def test_bundle_contents(spark):
    chunks = spark.createDataFrame(
        [("a", 0.9, False, ["L1", "", "L2"]), ("b", 0.4, False, ["L2", "L3"]), ("c", 0.9, True, None), ("d", 0.8, False, ["L1"])],
        "chunk_id string, confidence double, degraded boolean, citations array<string>",
    )
    seeds = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "b", 2), (2, "c", 0), (5, "z", 0)], "query_id int, chunk_id string, seq int")
    reached = spark.createDataFrame(
        [
            (1, "n0", None, 0.9, 1, ["n0"], []), (1, "n1", "d", 0.7, 2, ["n0", "n1"], ["e1"]),
            (1, "n2", "c", 0.8, 3, ["n0", "n2"], ["e2"]), (1, "n3", "a", 0.8, 4, ["n0", "n2", "n3"], ["e2", "e3"]),
            (3, "n1", "d", 0.7, 1, ["n1"], []), (2, "n9", "gone", 0.5, 1, ["n9"], []),
        ],
        "query_id int, node_id string, chunk_id string, score double, place bigint, path_nodes array<string>, path_edges array<string>",
    )
    queries = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id int")
    got = {r.query_id: r for r in traversal.bundle_contents(queries, seeds, reached, chunks).collect()}
    assert got[1].evidence == ["b", "a", "c", "d"] and got[1].citations == ["L2", "L3", "L1"] and got[1].warnings == []
    assert got[1].paths == [["n0", "n2"], ["n0", "n2", "n3"], ["n0", "n1"]] and got[1].path_edges == [["e2"], ["e2", "e3"], ["e1"]]
    assert got[2].evidence == ["c"] and got[2].warnings == ["missing_chunk:gone", "below_authority"]
    assert got[3].evidence == ["d"] and got[3].warnings == ["no_seeds"]
    assert (got[4].evidence, got[4].citations, got[4].paths, got[4].warnings) == ([], [], [], ["no_seeds"])
    assert got[5].evidence == [] and got[5].warnings == ["missing_chunk:z"]
