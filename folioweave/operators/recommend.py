"""Recommendations from filtered vector search with a lookup for requests that it cannot answer.

A request fixes some attributes and leaves others open (null).  Which attributes it
fixes, and to what, is its scope; items belong to every scope that leaves some of
their attributes open.  So filters become one equality on the scope, and no request
meets an item that its filters exclude.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators import lexical
from folioweave.operators.bounded_search import bounded_top_k
from folioweave.operators.ranking import top_per_key
from folioweave.operators.vector_search import top_k_similar
from folioweave.session import stage_table

_OPEN, _NEXT = "*", "\x01"


def _scope(parts: Sequence[Column]) -> Column:
    """Null as soon as a part is null, so it equals no other scope."""
    return F.concat(*[F.concat(p, F.lit(_NEXT)) for p in parts])


def _fixed(name: str) -> Column:
    return F.concat(F.lit("="), F.col(name).cast("string"))


def scopes_of_items(items: DataFrame, attributes: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Items once for each of the ``wanted`` scopes (distinct ``scope``) that they belong to, 2^attributes at most.

    A null attribute fits only where it is left open.
    """
    choices = itertools.product(*[(F.lit(_OPEN), _fixed(a)) for a in attributes])
    every = F.array_compact(F.array(*[_scope(parts) for parts in choices]))
    return items.withColumn("scope", F.explode(every)).join(wanted, "scope", "left_semi")


def scopes_of_requests(requests: DataFrame, attributes: Sequence[str], general: dict[str, str] | None = None) -> DataFrame:
    """Requests with their scope; a fixed attribute of ``general`` also asks for that general value."""
    general = general or {}
    rows = requests
    for a in attributes:
        own = F.coalesce(_fixed(a), F.lit(_OPEN))
        both = F.array_distinct(F.array(own, F.lit(f"={general[a]}"))) if a in general else F.array(own)
        rows = rows.withColumn(f"_{a}", F.explode(F.when(F.col(a).isNull(), F.array(own)).otherwise(both)))
    return rows.withColumn("scope", _scope([F.col(f"_{a}") for a in attributes])).drop(*[f"_{a}" for a in attributes])


def lookup(items: DataFrame, requests: DataFrame, attributes: Sequence[str], limit: int, general: dict[str, str] | None = None) -> DataFrame:
    """``request_id, item_id, priority, rank``: the first ``limit`` items that agree with a request's attributes.

    ``items``: ``item_id, priority`` and the attributes; ``requests``: ``request_id``
    and the attributes, null for any.  Lower priorities come first, null ones last,
    ties by id; repeated items and requests count once.  Every scope is cut before
    it meets its requests, so a popular one is no larger than a rare one.
    """
    asked = scopes_of_requests(requests.select("request_id", *attributes).distinct(), attributes, general).select("request_id", "scope")
    order = [F.asc_nulls_last("priority"), F.asc("item_id")]
    held = scopes_of_items(items.select("item_id", "priority", *attributes).distinct(), attributes, asked.select("scope").distinct())
    best = top_per_key(held.select("scope", "item_id", "priority").distinct(), ["scope"], order, limit).drop("rank")
    found = asked.join(best, "scope").select("request_id", "item_id", "priority").distinct()
    return top_per_key(found, ["request_id"], order, limit).select("request_id", "item_id", "priority", "rank")


def similar_in_scope(items: DataFrame, requests: DataFrame, attributes: Sequence[str], limit: int) -> DataFrame:
    """``request_id, item_id, score, rank``: the most similar items among those that agree with a request's attributes.

    ``items`` and ``requests`` as in ``lookup``, both with ``vector``; rows without
    one take no part.  The filter applies before the search, so a request gets
    ``limit`` items if so many agree.
    """
    asked = requests.filter("vector IS NOT NULL")
    asked = scopes_of_requests(asked, attributes).select(F.col("request_id").alias("query_id"), "vector", "scope")
    held = scopes_of_items(items.filter("vector IS NOT NULL"), attributes, asked.select("scope").distinct())
    found = top_k_similar(asked, held.select("item_id", "vector", "scope"), limit, on=["scope"])
    return found.select(F.col("query_id").alias("request_id"), "item_id", "score", "rank")


def _or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of ``first``, and those of ``second`` for requests that it does not answer."""
    answered = first.select("request_id").distinct()
    return first.unionByName(second.join(answered, "request_id", "left_anti"))


def recommend_templates(
    items: DataFrame, requests: DataFrame, attributes: Sequence[str], limit: int = 5, general: dict[str, str] | None = None,
) -> DataFrame:
    """``request_id, item_id, method, score, rank``: by vector, and by attributes for requests that get nothing there.

    Inputs as in ``lookup``, with a nullable ``vector`` on both sides.  A method is
    ``vector`` or ``profile``; profile rows have no score.
    """
    near = stage_table(similar_in_scope(items, requests, attributes, limit).withColumn("method", F.lit("vector")))
    listed = lookup(items, requests, attributes, limit, general)
    plain = listed.select("request_id", "item_id", F.lit(None).cast("double").alias("score"), "rank", F.lit("profile").alias("method"))
    return _or_else(near, plain).select("request_id", "item_id", "method", "score", "rank")


def keyword_matches(items: DataFrame, requests: DataFrame, limit: int, words: int = 6, shortest: int = 4) -> DataFrame:
    """``request_id, item_id, hits, rank``: items whose description contains most of a request's first words.

    ``items``: ``item_id, description``; ``requests``: ``request_id, text``.  The
    first ``words`` words of at least ``shortest`` characters count, in any case and
    inside other words; ties by id.  Descriptions meet words through postings and
    at most ``limit`` rows a request leave a block of them.
    """
    long = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.length(w) >= shortest)
    terms = requests.select("request_id", F.explode(F.array_distinct(F.slice(long, 1, words))).alias("term")).distinct()
    chunks = items.select(F.col("item_id").alias("chunk_id"), F.col("description").alias("content"))
    found = stage_table(lexical.term_counts(chunks, terms, shortest).select("chunk_id", "term", F.lit(1).alias("impact")))
    one = F.lit(1)
    asked = terms.select(F.col("request_id").alias("query_id"), "term", one.alias("weight"), one.alias("mark"), one.alias("size"))
    facts = found.select("chunk_id").distinct().select("chunk_id", F.array(F.lit(0.0)).alias("facts"))
    best = bounded_top_k(found, facts, asked, limit, lambda total, mark, facts, size: total)
    return best.select(F.col("query_id").alias("request_id"), F.col("chunk_id").alias("item_id"), F.col("score").cast("int").alias("hits"), "rank")


def recommend_risks(items: DataFrame, requests: DataFrame, limit: int = 6) -> DataFrame:
    """``request_id, item_id, method, score, rank``: risks by vector, and by keywords for requests that get none.

    ``items``: ``item_id, description, vector``; ``requests``: ``request_id, text,
    vector``, both vectors nullable.  Keyword rows have their number of words as score.
    """
    near = stage_table(similar_in_scope(items.withColumn("_all", F.lit("")), requests.withColumn("_all", F.lit("")), ["_all"], limit).withColumn("method", F.lit("vector")))
    left = requests.join(near.select("request_id").distinct(), "request_id", "left_anti")
    words = keyword_matches(items, left, limit).select("request_id", "item_id", F.col("hits").cast("double").alias("score"), "rank", F.lit("keyword").alias("method"))
    return near.unionByName(words).select("request_id", "item_id", "method", "score", "rank")
