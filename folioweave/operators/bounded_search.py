"""Top-k retrieval that leaves out what cannot reach the first k.

Postings are dealt to blocks of chunks.  A task holds one block, sorts its postings
by term, part of the block and impact, and answers a block of queries: for each
query the parts are visited in the order of an upper bound of their scores, and the
rest is skipped as soon as no part can beat the k-th best.  So at most ``k`` rows a
query leave a task, however many chunks its terms occur in.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators.ranking import top_per_key

#: Chunks and queries of one cell, and chunks of one part that is skipped or scored as a whole.
CHUNKS, QUERIES, PART = 8192, 1024, 256

#: ``score(total, mark, facts, size)`` over chunks, ``facts`` with one column a chunk fact.  It must not fall when a
#: total or fact rises or a mark gets more bits; it is applied to the highest of each in a part for the part's bound.
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def half_up(values: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded half up on the scaled double, as ``half_up_column`` does."""
    return np.floor(values * 10.0**digits + 0.5) / 10.0**digits


def half_up_column(c: Column, digits: int = 6) -> Column:
    """Rounded half up on the scaled double: one rule that every engine with IEEE doubles can repeat."""
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


class _Block:
    """The postings of one block, by term, part and falling impact."""

    def __init__(self, rows: pa.Table | pd.DataFrame):
        table = pa.Table.from_pandas(rows, preserve_index=False) if isinstance(rows, pd.DataFrame) else rows
        posted = pc.is_valid(table["term"])
        facts, posts = table.filter(pc.invert(posted)), table.filter(posted)
        ids = facts["chunk_id"].to_numpy()
        values = np.asarray(pc.list_flatten(facts["facts"]).to_numpy(), float)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order].astype(np.int64)
        self.facts = values.reshape(len(ids), len(values) // max(1, len(ids)))[order]
        place = np.searchsorted(self.ids, posts["chunk_id"].to_numpy())
        coded = pa.concat_arrays(posts["term"].cast(pa.large_string()).chunks or [pa.array([], pa.large_string())]).dictionary_encode()
        code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        self.code = {t: i for i, t in enumerate(terms)}
        self.parts = -(-len(self.ids) // PART)
        impact = posts["impact"].to_numpy().astype(float)
        order = np.lexsort((-impact, place // PART, code))
        self.place, self.impact = place[order], impact[order]
        self.start = np.searchsorted((code * self.parts + place // PART)[order], np.arange(len(terms) * self.parts + 1))
        # the first posting of a term and part has the highest impact
        there = self.start[1:] > self.start[:-1]
        best = np.zeros(len(there))
        best[there] = self.impact[self.start[:-1][there]]
        self.best, self.there = best.reshape(-1, self.parts), there.reshape(-1, self.parts)
        self.highest = np.maximum.reduceat(self.facts, np.arange(0, len(self.ids), PART), axis=0)

    def search(self, query: list[tuple[str, float, int]], size: float, k: int, score: Scorer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids, scores, totals and marks of the best ``k``, and how many parts were scored.

        A bound adds up in the order in which scores do, so rounding cannot lift a
        score above it.  Parts hold rising ids: one whose bound only ties the k-th
        best is left out if its ids are larger.
        """
        ids, scores, totals, marks, visited = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0
        known = [(self.code[t], w, m) for t, w, m in query if t in self.code]
        if not known:
            return ids, scores, totals, marks, visited
        total, mark = np.zeros(self.parts), np.zeros(self.parts, np.int64)
        for c, w, m in known:
            total += w * self.best[c]
            mark |= m * self.there[c]
        bound = np.where(mark > 0, score(total, mark, self.highest, size), -np.inf)
        for part in np.argsort(-bound, kind="stable"):
            base, full = part * PART, len(ids) == k
            if bound[part] == -np.inf or full and bound[part] < scores[-1]:
                break
            if full and bound[part] == scores[-1] and self.ids[base] > ids[-1]:
                continue
            visited += 1
            n = min(PART, len(self.ids) - base)
            total, mark = np.zeros(n), np.zeros(n, np.int64)
            for c, w, m in known:
                own = slice(*self.start[c * self.parts + part : c * self.parts + part + 2])
                at = self.place[own] - base
                total[at] += w * self.impact[own]
                mark[at] |= m
            at = np.flatnonzero(mark)
            ids, totals, marks = np.append(ids, self.ids[base + at]), np.append(totals, total[at]), np.append(marks, mark[at])
            scores = np.append(scores, score(total[at], mark[at], self.facts[base + at], size))
            order = np.lexsort((ids, -scores))[:k]
            ids, scores, totals, marks = ids[order], scores[order], totals[order], marks[order]
        return ids, scores, totals, marks, visited


def bounded_top_k(
    postings: DataFrame, facts: DataFrame, queries: DataFrame, k: int, score: Scorer, chunks: int = CHUNKS, block_queries: int = QUERIES,
) -> DataFrame:
    """``query_id, chunk_id, score, total, mark, rank``: the best ``k`` chunks of every query by (score, smaller id).

    ``postings``: ``chunk_id, term, impact``, one row a chunk and term, impacts of 0
    or more; ``facts``: ``chunk_id, facts array<double>``, one row for every chunk
    with a posting; ``queries``: ``query_id, term, weight, mark, size``, one row a
    query and term, weights of 0 or more, ``mark`` above 0.  A chunk's total is the sum of weight times impact over the query's terms in
    it, its mark the union of their marks.  Both sides are cut into blocks by hash,
    so a frequent term or a long list of queries only means more of them.
    """
    spark = postings.sparkSession
    asked = queries.select("query_id").distinct().count()
    n_q = max(1, -(-asked // block_queries))
    n_c = max(1, -(-facts.count() // chunks), math.ceil(spark.sparkContext.defaultParallelism / n_q))

    def spread(side: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        cell = F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own)
        return side.select("*", cell, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    none = F.lit(None)
    # an empty array and no null: the Arrow writer passes the nulls of a list again with every row, the square of a block
    rows = postings.select("chunk_id", "term", F.col("impact").cast("double").alias("impact"), F.array().cast("array<double>").alias("facts"))
    rows = rows.unionByName(facts.select("chunk_id", none.cast("string").alias("term"), none.cast("double").alias("impact"), "facts"))
    left = spread(rows, "chunk_id", "_c", n_c, "_q", n_q)
    right = spread(queries.select("query_id", "term", F.col("weight").cast("double").alias("weight"), "mark", F.col("size").cast("double").alias("size")), "query_id", "_q", n_q, "_c", n_c)

    def cell(block: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "chunk_id": [], "score": [], "total": [], "mark": []}
        if len(block) and len(asked):
            held = _Block(block)
            for query, own in asked.to_pandas().sort_values(["query_id", "term"]).groupby("query_id", sort=False):
                terms = list(zip(own["term"], own["weight"].astype(float), own["mark"].astype(int)))
                ids, scores, totals, marks, _ = held.search(terms, float(own["size"].iloc[0]), k, score)
                for part, values in zip(out.values(), (np.full(len(ids), query), ids, scores, totals, marks)):
                    part.append(values)
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for (c, v), t in zip(out.items(), types)})

    found = left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(cell, "query_id bigint, chunk_id bigint, score double, total double, mark bigint")
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
