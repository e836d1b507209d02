"""Inverted lists: recall and pairs compared, long lists, filters, unseen neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.operators import vector_index as vi
from folioweave.operators import vector_search as vs


def vectors(spark, hot):
    """Sixty clusters; one of them holds the share ``hot`` of all vectors."""
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(60, 24))
    group = np.where(draw.random(6000) < hot, 0, draw.integers(0, 60, 6000))
    data = centres[group] + 0.25 * draw.normal(size=(6000, 24))
    rows = [(i, [float(x) for x in v], int(g) % 4) for i, (v, g) in enumerate(zip(data, group))]
    return spark.createDataFrame(rows, "item_id bigint, vector array<double>, label int").repartition(8).cache()


@pytest.fixture(scope="module")
def clustered(spark):
    return vectors(spark, 0.33)


def as_queries(corpus):
    return corpus.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")


@pytest.fixture(scope="module")
def index(clustered):
    return vi.build_index(clustered, 10, keep=["label"])


def test_high_recall_at_a_tenth_of_the_pairs(spark):
    corpus = vectors(spark, 0.0)
    index, queries = vi.build_index(corpus, 10), as_queries(corpus).drop("label")
    found = vi.search(index, queries, 10, skip_self=True)
    truth = vs.top_k_similar(queries, corpus.drop("label"), 10, skip_self=True)
    pairs = vi.compared_pairs(index, queries).first()
    assert vs.recall(found, truth, 10).first()["recall"] >= 0.9
    assert pairs["all_pairs"] == 300 * 6000 and pairs["compared"] <= 0.1 * pairs["all_pairs"]


def test_a_hot_cluster_keeps_the_recall(clustered, index):
    queries = as_queries(clustered).drop("label")
    found = vi.search(index, queries, 10, skip_self=True)
    truth = vs.top_k_similar(queries, clustered.drop("label"), 10, skip_self=True)
    pairs = vi.compared_pairs(index, queries).first()
    assert vs.recall(found, truth, 10).first()["recall"] >= 0.9
    assert pairs["compared"] <= 0.5 * pairs["all_pairs"]


def test_every_row_is_in_one_list_and_scores_are_exact(clustered, index):
    assert index.items.count() == 6000 == index.items.select("item_id").distinct().count()
    queries = as_queries(clustered).drop("label")
    truth = vs.top_k_similar(queries, clustered.drop("label"), 10, skip_self=True)
    found = vi.search(index, queries, 10, skip_self=True).join(truth.withColumnRenamed("score", "exact"), ["query_id", "item_id"])
    assert found.where("score <> exact").count() == 0
    whole = vi.VectorIndex(index.centroids, index.items, len(index.centroids))
    complete = vi.search(whole, queries, 10, skip_self=True)
    assert sorted(map(tuple, complete.collect())) == sorted(map(tuple, truth.collect()))


def test_long_lists_are_split_and_filters_hold(clustered, index):
    queries = as_queries(clustered)
    whole = vi.search(index, queries, 5, on=["label"], skip_self=True)
    split = vi.search(index, queries, 5, on=["label"], skip_self=True, cell_rows=64)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    labels = clustered.select("item_id", "label")
    joined = whole.join(labels, "item_id").join(queries.select("query_id", F.col("label").alias("asked")), "query_id")
    assert joined.where("label <> asked").count() == 0 and joined.count() > 0


def test_tuned_probes_reach_the_target(clustered):
    fewer = vi.build_index(clustered, 10, target=0.6).probes
    more = vi.build_index(clustered, 10, target=0.99).probes
    assert 1 <= fewer <= more


def test_small_empty_and_zero_vectors(spark):
    kind = "item_id bigint, vector array<double>"
    empty = spark.createDataFrame([], kind)
    assert vi.search(vi.build_index(empty), empty.withColumnRenamed("item_id", "query_id"), 3).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0]), (5, None)], kind)
    found = vi.search(vi.build_index(few, 2, target=1.0), few.withColumnRenamed("item_id", "query_id"), 2, skip_self=True)
    assert {r["query_id"] for r in found.collect()} <= {1, 2, 3, 4}
    assert {(r["query_id"], r["item_id"]) for r in found.where("rank = 1 and query_id = 1").collect()} == {(1, 3)}


def test_seen_documents_are_left_out_before_the_cut(spark):
    """The user has seen the forty nearest neighbours; the next ones count."""
    items = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(200)], "item_id bigint, vector array<double>")
    events = spark.createDataFrame([(7, i, i, i) for i in range(1, 41)] + [(7, 0, 99, 99)], "user_id bigint, item int, ts int, event_id int")
    near = lambda q, n: vs.top_k_similar(q, items, n, skip_self=True)
    got = vs.item_based(events, near, items.withColumnRenamed("item_id", "query_id"), items.select("item_id", F.col("item_id").alias("doc")), seeds=1)
    assert [r["doc"] for r in got.orderBy("rank").collect()] == list(range(41, 51))


def test_queries_ask_for_every_fiftieth_row_against_all(spark, sf_dir):
    """The registered searches take the ids divisible by 50, find them among all rows, and report their own recall."""
    from folioweave.plans import catalog

    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()}
    asked = {i for i in ids if i % 50 == 0}
    found = catalog.all_queries()["r14_approximate_top_k"](spark, sf_dir).collect()
    assert {r["query_id"] for r in found} == asked and len(found) == 10 * len(asked)
    assert {r["item_id"] for r in found} - asked
    assert {r["query_id"] for r in catalog.all_queries()["r35_clause_similarity_approximate"](spark, sf_dir).collect()} == asked
    row = catalog.all_queries()["r14_recall_at_10"](spark, sf_dir).first()
    assert row["queries"] == len(asked) and row["all_pairs"] == len(asked) * len(ids) and row["recall"] >= 0.9


def test_a_query_goes_to_a_cell_once_however_many_lists_it_probes(clustered, index, monkeypatch):
    """It was copied to each list that it probes and came back with k rows from each."""
    queries, exact, sent = as_queries(clustered).drop("label"), vs.top_k_similar, []
    truth = sorted(map(tuple, exact(queries, clustered.drop("label"), 10, skip_self=True).collect()))
    whole = vi.VectorIndex(index.centroids, index.items, len(index.centroids))
    monkeypatch.setattr(vs, "top_k_similar", lambda q, *a, **b: sent.append(q.count()) or exact(q, *a, **b))
    assert sorted(map(tuple, vi.search(whole, queries, 10, skip_self=True).collect())) == truth
    assert sorted(map(tuple, vi.search(whole, queries, 10, skip_self=True, cell_rows=1000).collect())) == truth
    assert sent[0] == 300 and sent[1] <= 300 * 8


def test_a_cell_compares_the_probed_lists_only(index):
    items = index.items.toPandas()
    queries = items.head(600)[["item_id", "vector"]].rename(columns={"item_id": "query_id"})
    queries["lists"] = [np.array([i % 7, 7 + i % 5, 40]) for i in range(600)]
    found = vs._best_in_cell(queries, items, 4, -2.0, True)
    per_list = items.groupby("list")
    for i in range(0, 600, 37):
        mine = queries.iloc[[i]].drop(columns="lists")
        near = [vs._best_in_cell(mine, per_list.get_group(n).drop(columns="list"), 4, -2.0, True) for n in queries["lists"].iloc[i] if n in per_list.groups]
        want = sorted((-s, t) for part in near for t, s in zip(part["item_id"], part["score"]))[:4]
        got = found[found["query_id"] == mine["query_id"].iloc[0]]
        assert sorted((-s, t) for t, s in zip(got["item_id"], got["score"])) == want


def test_rows_that_come_twice_take_one_place(clustered, index):
    queries = as_queries(clustered).drop("label")
    twice = vi.VectorIndex(index.centroids, index.items.union(index.items), index.probes)
    found = [vi.search(i, queries, 10, skip_self=True).collect() for i in (index, twice)]
    assert sorted(map(tuple, found[1])) == sorted(map(tuple, found[0])) and len(found[0]) == 3000


def test_sizes_of_keys_travel_and_vectors_do_not(spark):
    """Spark takes the copies of queries for as small as the rows before them, and sent them to the driver to broadcast them."""
    rows = spark.range(20).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"), (F.col("id") % 3).alias("label"))
    found = vs.top_k_similar(rows, rows.withColumnRenamed("query_id", "item_id"), 2, on=["label"], skip_self=True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("rightHint=(strategy=broadcast)") == 2
    assert found.count() == 40
