"""Exact nearest neighbours for whole tables of queries.

Neither side is broadcast and no pair is emitted before it is among the best
``k`` of its cell: both sides are cut into cells of bounded size, every query
cell meets every corpus cell of the same key in one grouped task, and each task
returns at most ``k`` rows per query.  A key holding a large share of the rows
only means more cells.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.ranking import top_per_key
from folioweave.session import carried, stage_table

CELL_ROWS = 16384
#: Queries scored at a time: the scores of a block and their copies are all that a cell holds besides its vectors.
BLOCK_ROWS = 256
#: Vectors of used items that travel to every task; more meet their users by exchange.
CARRIED_VECTORS = 8192
SCORE_DIGITS = 6


def unit_rows(column: pd.Series) -> np.ndarray:
    """Vectors as rows of length one; zero vectors stay zero."""
    data = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    length = np.linalg.norm(data, axis=1, keepdims=True)
    return np.divide(data, length, out=np.zeros_like(data), where=length > 0)


def _best_in_cell(queries: pd.DataFrame, corpus: pd.DataFrame, k: int, min_score: float, skip_self: bool) -> pd.DataFrame:
    """Best ``k`` corpus rows per query of one cell, by (score desc, id).

    Queries with ``lists`` only meet the rows whose ``list`` is among them.
    """
    none = pd.DataFrame({"query_id": [], "item_id": [], "score": []})
    if queries.empty or corpus.empty:
        return none
    corpus = corpus.sort_values("item_id", kind="stable")
    probing = "lists" in queries
    if probing:  # queries of the same nearest list stand together, so a block asks for few lists
        queries = queries.iloc[np.argsort([x[0] for x in queries["lists"]], kind="stable")]
        listed = corpus["list"].to_numpy()
    all_items, all_right = corpus["item_id"].to_numpy(), unit_rows(corpus["vector"])
    items, right = all_items, all_right
    out_q, out_i, out_s = [], [], []
    for start in range(0, len(queries), BLOCK_ROWS):
        block = queries.iloc[start : start + BLOCK_ROWS]
        ids = block["query_id"].to_numpy()
        if probing:
            probed = np.zeros((len(block), max(listed.max(), max(map(max, block["lists"]))) + 1), bool)
            for row, lists in enumerate(block["lists"]):
                probed[row, lists] = True
            there = np.flatnonzero(probed.any(axis=0)[listed])
            if not len(there):
                continue
            items, right = all_items[there], all_right[there]
        scores = np.round(unit_rows(block["vector"]) @ right.T, SCORE_DIGITS)
        if probing:
            scores[~probed[:, listed[there]]] = -np.inf
        if skip_self:
            scores[ids[:, None] == items[None, :]] = -np.inf
        if probing:  # a repeated id takes one of the k places
            first = np.flatnonzero(np.append(True, items[1:] != items[:-1]))
            if len(first) < len(items):
                scores, items = np.maximum.reduceat(scores, first, axis=1), items[first]
        take = min(k, scores.shape[1])
        # equal scores keep the smaller id, hence a stable sort on the threshold set
        cut = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
        for row in range(len(ids)):
            near = np.flatnonzero(scores[row] >= max(cut[row], min_score))
            near = near[np.argsort(-scores[row][near], kind="stable")][:k]
            near = near[np.isfinite(scores[row][near])]
            out_q.append(np.full(len(near), ids[row]))
            out_i.append(items[near])
            out_s.append(scores[row][near])
    return none if not out_q else pd.DataFrame(
        {"query_id": np.concatenate(out_q), "item_id": np.concatenate(out_i), "score": np.concatenate(out_s)}
    )


def _cells(df: DataFrame, id_col: str, own: str, other: str, own_count: str, other_count: str) -> DataFrame:
    """Assign a cell on the own side and copy the row to every cell of the other."""
    return df.withColumn(
        own, F.pmod(F.xxhash64(id_col), F.col(own_count)).cast("int")
    ).withColumn(other, F.explode(F.sequence(F.lit(0), (F.col(other_count) - 1).cast("int"))))


def top_k_similar(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    on: list[str] | None = None,
    min_score: float = -2.0,
    skip_self: bool = False,
    cell_rows: int = CELL_ROWS,
    probing: bool = False,
) -> DataFrame:
    """Cosine top ``k`` per query: ``query_id, item_id, score, rank``.

    ``queries``: ``query_id, vector``; ``corpus``: ``item_id, vector``; both also
    carry the columns of ``on``, which must be equal (filters applied before the
    search).  With ``probing`` a query also has ``lists``, a row its ``list``, and
    only pairs whose list is among the query's are compared.
    """
    keys = on or []
    # fresh column identities: both sides may come from the same table
    q = queries.select(*[F.col(n).alias(n) for n in ("query_id", "vector", *keys, *["lists"] * probing)])
    c = corpus.select(*[F.col(n).alias(n) for n in ("item_id", "vector", *keys, *["list"] * probing)])

    def cell_count(n):
        return F.ceil(n / F.lit(float(cell_rows)))

    if keys:
        # one small row per key value tells both sides how many cells they need; it travels, never the vectors
        sizes = carried(
            q.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq"))
            .join(c.groupBy(*keys).agg(F.count(F.lit(1)).alias("nc")), keys)
            .select(*keys, cell_count(F.col("nq")).alias("_nq"), cell_count(F.col("nc")).alias("_nc"))
        )
        again = sizes.select(*[F.col(n).alias(n) for n in (*keys, "_nq", "_nc")])
        q, c = q.join(sizes, keys), c.join(again, keys)
    else:
        n_q = max(1, -(-q.count() // cell_rows))
        n_c = max(1, -(-c.count() // cell_rows))
        q = q.withColumns({"_nq": F.lit(n_q), "_nc": F.lit(n_c)})
        c = c.withColumns({"_nq": F.lit(n_q), "_nc": F.lit(n_c)})
    left = _cells(q, "query_id", "_qc", "_cc", "_nq", "_nc")
    right = _cells(c, "item_id", "_cc", "_qc", "_nc", "_nq")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_in_cell(a, b, k, min_score, skip_self)

    grid = [*keys, "_qc", "_cc"]
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(
        score, "query_id bigint, item_id bigint, score double"
    )
    distinct = found.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_per_key(distinct, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def filtered_after(found: DataFrame, corpus_filter: DataFrame, k: int) -> DataFrame:
    """Post-filter form: the best of a prefetch that pass, at most ``k``.

    ``corpus_filter``: ``query_id, item_id`` pairs are not listed; it holds
    ``item_id`` and the columns shared with ``found`` that must agree.
    """
    shared = [c for c in corpus_filter.columns if c in found.columns]
    kept = found.drop("rank").join(corpus_filter, shared, "left_semi")
    return top_per_key(kept, ["query_id"], [F.desc("score"), F.asc("item_id")], k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean share of the true neighbours that were found."""
    hits = truth.join(found.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    per_query = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(
        hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("h")), "query_id", "left"
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")), 6).alias("recall"),
        F.lit(k).alias("k"),
    )


def mean_vectors(rows: DataFrame, key: str, dim: int, weight: str = "w", vector: str = "vector") -> DataFrame:
    """Weighted mean per key scaled to length one.

    One sum per dimension inside a single aggregation: map tasks combine to one
    row per key, whatever the number of vectors behind it.
    """
    sums = [
        F.sum(F.col(weight) * F.element_at(vector, i + 1).cast("double")).alias(f"_d{i}") for i in range(dim)
    ]
    agg = rows.groupBy(key).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("n"), *sums)
    mean = F.array(*[F.col(f"_d{i}") / F.col("_w") for i in range(dim)])
    length = F.sqrt(F.aggregate("_m", F.lit(0.0), lambda acc, v: acc + v * v))
    return (
        agg.select(key, "n", mean.alias("_m"))
        .withColumn("_l", length)
        .select(
            key, "n",
            F.transform("_m", lambda v: F.when(F.col("_l") > 0, v / F.col("_l")).otherwise(v)).alias("vector"),
        )
    )


def interest_vectors(
    events: DataFrame, chunks: DataFrame, weight, dim: int, limit: int = 100
) -> DataFrame:
    """User interest: latest events, best weight per chunk, weighted mean vector.

    ``events``: ``user_id, ts, event_id, item, action``; ``chunks``: ``item, vector``.
    """
    recent = top_per_key(
        events.filter(F.col("item").isNotNull()), ["user_id"], [F.desc("ts"), F.desc("event_id")], limit
    )
    best = stage_table(recent.groupBy("user_id", "item").agg(F.max(weight).alias("w")))
    # the vectors go to the users: rows of a user that lie together are added up before they move
    return mean_vectors(best.join(carried(used_vectors(best, chunks), CARRIED_VECTORS), "item"), "user_id", dim)


def used_vectors(best: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(best.select("item").distinct(), "item", "left_semi")


def item_based(
    events: DataFrame, neighbours: Callable[[DataFrame, int], DataFrame], items: DataFrame, docs: DataFrame,
    seeds: int = 5, per_seed: int = 10, k: int = 10, prefetch: int = 30,
) -> DataFrame:
    """Items similar to what a user read last, without what the user has seen.

    ``neighbours(queries, n)`` returns the ``n`` nearest items of each query item as
    ``query_id, item_id, score, rank`` and is shared by all users who read it;
    ``items``: ``query_id, vector``; ``docs``: ``item_id, doc``.  Seen documents are
    taken out before the cut at ``per_seed``: a seed that has fewer left, although it
    has more neighbours than were fetched, is asked again four times as deep.
    """
    last = stage_table(events.groupBy("user_id", "item").agg(F.max(F.struct("ts", "event_id")).alias("last")))
    recent = stage_table(top_per_key(last, ["user_id"], [F.desc("last"), F.asc("item")], seeds).select(
        "user_id", F.col("item").cast("bigint").alias("query_id")
    ))
    seen = last.select("user_id", F.col("item").cast("bigint").alias("doc"))
    wanted, depth, parts = recent, prefetch, []
    while True:
        asked = items.join(wanted.select("query_id").distinct(), "query_id", "left_semi")
        near = stage_table(neighbours(asked, depth).join(docs, "item_id").select("query_id", "item_id", "score", "doc"))
        fresh = wanted.join(near, "query_id").join(seen, ["user_id", "doc"], "left_anti")
        kept = stage_table(top_per_key(fresh, ["user_id", "query_id"], [F.desc("score"), F.asc("item_id")], per_seed))
        cut = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= depth).select("query_id")
        enough = kept.where(F.col("rank") == per_seed).select("user_id", "query_id")
        short = stage_table(wanted.join(cut, "query_id", "left_semi").join(enough, ["user_id", "query_id"], "left_anti"))
        parts.append(kept.join(short, ["user_id", "query_id"], "left_anti"))
        if short.isEmpty():
            break
        wanted, depth = short, depth * 4
    sums = reduce(DataFrame.unionByName, parts).groupBy("user_id", "doc").agg(F.sum("score").alias("raw"))
    best = F.max("raw").over(Window.partitionBy("user_id"))
    scored = sums.select("user_id", "doc", F.round(F.col("raw") / best, 6).alias("item_score"))
    return top_per_key(scored, ["user_id"], [F.desc("item_score"), F.asc("doc")], k)
