"""Smoke queries: every document is asked for what its own structure promises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.operators import lexical
from folioweave.operators import query_features as qf
from folioweave.operators.hierarchy import references
from folioweave.rules import quality as rules
from folioweave.session import stage_table

#: Places of a document's queries: primary ones from 0, cross-language ones from here.
CROSS_PLACE = 16
_PLACES = 32


def structure_flags(languages: DataFrame, units: DataFrame) -> DataFrame:
    """``doc_id, language``, which units and label words a document has, and the numbers of its first articles.

    ``languages``: ``doc_id, language``; ``units``: ``doc_id, unit, idx, label``.
    Documents without units have all flags false; a null language counts as English.
    """
    low = F.lower("label")
    flags = [F.bool_or(F.col("unit") == "article").alias("_article"), F.bool_or(F.col("unit") == "clause").alias("_clause")]
    for _, _, _, labels in rules.SMOKE_QUERIES.values():
        for word, other in labels:
            named = (F.col("unit") == "section") & F.contains(low, F.lit(word))
            flags.append(F.bool_or(named if other is None else named & ~F.contains(low, F.lit(other))).alias(f"_{word}"))
    first = (F.col("unit") == "article") & (F.col("idx") < rules.CROSS_ARTICLES)
    number = F.struct("idx", F.regexp_extract("label", rules.ARTICLE_NUMBER, 1).alias("number"))
    shape = units.groupBy("doc_id").agg(*flags, F.array_sort(F.collect_list(F.when(first, number))).alias("_numbers"))
    named = languages.select("doc_id", F.coalesce("language", F.lit("en")).alias("language"))
    return named.join(shape, "doc_id", "left")


def smoke_queries(languages: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, doc_id, language, kind, text``: at most ten primary and five cross-language queries a document.

    Primary queries are words of the document's language for the structure that it
    has (a minimal set without any); cross-language ones name its first articles in
    the other language.  ``query_id`` is ``doc_id`` times 32 plus the place.
    """
    flags = structure_flags(languages, units)
    on = lambda name: F.coalesce(F.col(f"_{name}"), F.lit(False))
    empty = F.array().cast("array<string>")
    words = lambda ws: F.array(*map(F.lit, ws)) if ws else empty

    def of_language(language: str) -> Column:
        always, article, clause, labels = rules.SMOKE_QUERIES[language]
        parts = [words(always), F.when(on("article"), words(article)).otherwise(empty), F.when(on("clause"), words(clause)).otherwise(empty)]
        return F.concat(*parts, *[F.when(on(word), words([word])).otherwise(empty) for word, _ in labels])

    def by_language(table: dict, entry, other: Column) -> Column:
        chain = None
        for name in table:
            chain = F.when(F.col("language") == name, entry(name)) if chain is None else chain.when(F.col("language") == name, entry(name))
        return chain.otherwise(other)

    named = by_language({k: v for k, v in rules.SMOKE_QUERIES.items() if k != "en"}, of_language, of_language("en"))
    fallback = by_language(rules.SMOKE_FALLBACK, lambda n: words(rules.SMOKE_FALLBACK[n]), words(rules.SMOKE_OTHER_FALLBACK))
    primary = F.slice(F.when(F.size("_named") > 0, F.col("_named")).otherwise(fallback), 1, rules.PRIMARY_QUERIES)
    numbers = F.filter(F.transform(F.coalesce("_numbers", F.array().cast("array<struct<idx:int,number:string>>")), lambda s: s["number"]), lambda n: n != "")
    cross = by_language(
        rules.CROSS_WORDS, lambda n: F.transform(numbers, lambda x: F.concat(F.lit(rules.CROSS_WORDS[n] + " "), x)), empty
    )
    entry = lambda kind, start: lambda text, i: F.struct((i + start).alias("place"), F.lit(kind).alias("kind"), text.alias("text"))
    asked = F.concat(
        F.transform(primary, entry("primary", 0)), F.transform(F.slice(cross, 1, rules.CROSS_QUERIES), entry("cross", CROSS_PLACE))
    )
    rows = flags.withColumn("_named", named).select("doc_id", "language", F.explode(asked).alias("q"))
    return rows.select((F.col("doc_id") * _PLACES + F.col("q.place")).alias("query_id"), "doc_id", "language", "q.kind", "q.text")


def run_smoke(queries: DataFrame, chunks: DataFrame, aliases: DataFrame, k: int = lexical.rules.MAX_RESULTS) -> DataFrame:
    """``smoke_queries`` with ``hits``: how many of its document's chunks the multi-pass search finds, at most ``k``.

    ``chunks``: as in ``lexical.search_within`` with the document as scope;
    ``aliases``: ``concept, alias``.
    """
    queries = stage_table(queries)
    asked = queries.select("query_id", F.col("doc_id").alias("scope"), qf.search_terms(F.col("text")).alias("terms"), F.try_element_at(references(F.col("text")), F.lit(1)).alias("ref"))
    expanded = qf.expand_aliases(asked.select("query_id", F.explode("terms").alias("term")), aliases)
    found = lexical.search_within(asked, chunks, expanded, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return queries.join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def rate_smoke(results: DataFrame) -> DataFrame:
    """One row a document: rates of both kinds, status and warnings.

    A document passes if 60 % of its primary queries hit; cross-language misses are
    warnings where less than half of those queries hit, and never decide.
    """
    kind = lambda name: F.col("kind") == name
    hit = F.col("hits") > 0
    rated = results.groupBy("doc_id", "language").agg(
        F.count_if(kind("primary")).alias("queries"), F.count_if(kind("primary") & hit).alias("hit"),
        F.round(F.avg(F.when(kind("primary"), F.col("hits"))), 6).alias("mean_hits"),
        F.count_if(kind("cross")).alias("cross_queries"), F.count_if(kind("cross") & hit).alias("cross_hit"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(kind("primary") & ~hit, F.struct("query_id", "text")))), lambda s: s["text"]
        ), ",").alias("missed"),
    )
    rate = lambda a, b: F.round(F.col(a) / F.greatest(b, F.lit(1)), 6)
    few = (F.col("cross_queries") > 0) & (F.col("cross_hit") / F.col("cross_queries") < rules.CROSS_WARNING)
    missed = F.col("queries") - F.col("hit")
    return rated.select(
        "doc_id", "language", "queries", "hit", "mean_hits", rate("hit", "queries").alias("hit_rate"), "cross_queries", "cross_hit",
        rate("cross_hit", "cross_queries").alias("cross_hit_rate"), "missed",
        (missed + F.when(few, F.col("cross_queries") - F.col("cross_hit")).otherwise(0)).alias("warnings"),
        F.when(F.col("hit") * 10 >= F.col("queries") * rules.SMOKE_PASS_TENTHS, "pass").otherwise("warning").alias("status"),
    )
