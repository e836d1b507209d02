"""Approximate nearest neighbours through inverted lists around trained centroids.

Centroids are trained on a bounded sample; every vector then goes to the list of
its nearest centroid.  A query compares only the lists of its nearest centroids,
the probes; neighbouring numbers share a cell.  How many that must be for a recall is measured, not assumed: a bounded
sample of queries is compared with the whole corpus, and the probes that reach the
target on it are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from folioweave.operators import vector_search as vs
from folioweave.session import stage_table

#: Most lists, hence rows of the centroid matrix that goes to every task.
MAX_LISTS = 4096
#: Vectors a list that the centroids are trained on, and queries that the probes are tuned on.
TRAIN_PER_LIST, TUNE_QUERIES = 64, 256


@dataclass(frozen=True)
class VectorIndex:
    """``items``: ``item_id, vector, list`` and the columns kept for filters, as a stage table."""

    centroids: np.ndarray
    items: DataFrame
    probes: int


def nearest_lists(vector: Column, centroids: np.ndarray, n: int) -> Column:
    """The numbers of the ``n`` nearest centroids by cosine, nearest first; ties by number."""
    n = min(n, len(centroids))

    @F.pandas_udf(ArrayType(IntegerType()))
    def lists(vectors: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(vectors), 1024):
            score = vs.unit_rows(vectors.iloc[start : start + 1024]) @ centroids.T
            out += list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32))
        return pd.Series(out)

    return lists(vector)


def hashed_sample(rows: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """About ``size`` of ``total`` rows, chosen by a hash of the key; all if there are no more."""
    return rows if total <= size else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(total)) < size)


def train_centroids(corpus: DataFrame, lists: int, total: int, rounds: int = 10, seed: int = 17) -> np.ndarray:
    """Unit centroids of ``lists`` lists from about TRAIN_PER_LIST vectors a list."""
    sample = hashed_sample(corpus, "item_id", lists * TRAIN_PER_LIST, total)
    rows = sample.where(F.exists("vector", lambda x: x != 0)).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, lists), maxIter=rounds, seed=seed, initMode="random", distanceMeasure="cosine").fit(stage_table(rows))
    return vs.unit_rows(pd.Series(list(model.clusterCenters())))


def build_index(
    corpus: DataFrame, k: int = 10, target: float = 0.95, lists: int | None = None, probes: int | None = None,
    keep: Sequence[str] = (), cell_rows: int = vs.CELL_ROWS,
) -> VectorIndex:
    """Index ``corpus(item_id, vector, *keep)``; every row is in exactly one list.

    ``lists`` is about the root of the number of vectors, at most MAX_LISTS.
    Without ``probes`` they are tuned so that TUNE_QUERIES corpus vectors find the
    ``target`` share of their ``k`` nearest others.
    """
    rows = stage_table(corpus.select("item_id", "vector", *keep).where("vector is not null"))
    total = rows.count()
    lists = lists or min(MAX_LISTS, max(2, round(total**0.5)))
    centroids = train_centroids(rows, lists, total) if total else np.zeros((1, 1))
    items = stage_table(rows.withColumn("list", F.element_at(nearest_lists(F.col("vector"), centroids, 1), 1)))
    index = VectorIndex(centroids, items, probes or 1)
    if probes is None and total:
        sample = hashed_sample(rows, "item_id", TUNE_QUERIES, total).select(F.col("item_id").alias("query_id"), "vector")
        index = VectorIndex(centroids, items, tuned_probes(index, sample, k, target, cell_rows))
    return index


def tuned_probes(index: VectorIndex, queries: DataFrame, k: int, target: float, cell_rows: int = vs.CELL_ROWS) -> int:
    """The fewest probes with which ``queries`` find the ``target`` share of their exact neighbours.

    An exact neighbour is found if its list is among the query's first lists, so
    the places of these lists say what any number of probes would find; only a
    histogram of places, one number a list, reaches the driver.
    """
    queries = stage_table(queries)
    corpus = index.items.select("item_id", "vector")
    truth = vs.top_k_similar(queries, corpus, k, skip_self=True, cell_rows=cell_rows).select("query_id", "item_id")
    order = queries.select("query_id", F.posexplode(nearest_lists(F.col("vector"), index.centroids, len(index.centroids))).alias("place", "list"))
    places = truth.join(index.items.select("item_id", "list"), "item_id").join(order, ["query_id", "list"])
    found = np.zeros(len(index.centroids))
    for row in places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect():
        found[row["place"]] = row["n"]
    if not found.sum():
        return len(found)
    return int(np.searchsorted(np.cumsum(found) / found.sum(), target - 1e-12)) + 1


def _probing(index: VectorIndex, queries: DataFrame) -> DataFrame:
    return queries.withColumn("list", F.explode(nearest_lists(F.col("vector"), index.centroids, index.probes)))


def search(
    index: VectorIndex, queries: DataFrame, k: int, on: Sequence[str] = (), min_score: float = -2.0, skip_self: bool = False,
    cell_rows: int = vs.CELL_ROWS,
) -> DataFrame:
    """Cosine top ``k`` among the probed lists: ``query_id, item_id, score, rank``.

    ``queries``: ``query_id, vector`` and the columns of ``on``, which must have been
    kept in the index.  Scores are exact.  As many lists as fill a cell of ``cell_rows``
    rows go together, and a query goes there once with those it probes, so it is copied
    and answered once a cell, however many probes it takes.  Lists with more rows, or
    that more queries probe, are split into cells like any hot key.
    """
    keys = [*on, "together"]
    width = max(1, cell_rows * len(index.centroids) // max(1, index.items.count()))

    def together(number: Column) -> Column:
        return F.floor(number / width).cast("int")

    asked = queries.where("vector is not null").select("query_id", "vector", *on)
    asked = stage_table(asked.withColumn("lists", nearest_lists(F.col("vector"), index.centroids, index.probes)))
    probing = asked.withColumn("together", F.explode(F.array_distinct(F.transform("lists", together)))).withColumn(
        "lists", F.filter("lists", lambda number: together(number) == F.col("together"))
    )
    items = index.items.withColumn("together", together(F.col("list"))).select("item_id", "vector", "list", *keys)
    return vs.top_k_similar(probing, items, k, on=keys, min_score=min_score, skip_self=skip_self, cell_rows=cell_rows, probing=True)


def compared_pairs(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """``compared, all_pairs``: pairs that ``search`` scores, and those of an exact search."""
    sizes = index.items.groupBy("list").agg(F.count(F.lit(1)).alias("items"))
    asked = _probing(index, queries.select("query_id", "vector")).groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
    whole = sizes.agg(F.sum("items").alias("n")).join(queries.agg(F.count(F.lit(1)).alias("q")))
    pairs = asked.join(sizes, "list").agg(F.sum(F.col("items") * F.col("queries")).alias("compared"))
    return pairs.join(whole).select("compared", (F.col("n") * F.col("q")).alias("all_pairs"))
