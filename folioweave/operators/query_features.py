"""Query understanding as projections over a table of queries or turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators.hierarchy import references
from folioweave.rules import queries as rules
from folioweave.session import stage_table

TOKEN_BREAK = r"[\s,;.:()\[\]]+"


def search_terms(text: Column) -> Column:
    """First canonical reference, then the distinct lower-case tokens."""
    tokens = F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda w: w != "")
    first = F.slice(references(text), 1, 1)
    return F.array_distinct(F.concat(first, tokens))


def expand_aliases(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Terms plus all other names of their concept.

    ``terms``: ``query_id, term``; ``aliases``: ``concept, alias``.  Numbers and
    one-letter terms are dropped.
    """
    kept = terms.filter((F.length("term") > 1) & ~F.col("term").rlike(r"^\d+$")).select("query_id", "term")
    concepts = aliases.select("concept", F.col("alias").alias("term"))
    same = kept.join(concepts, "term").select("query_id", "concept").distinct()
    more = same.join(aliases, "concept").select("query_id", F.col("alias").alias("term"))
    return kept.unionByName(more).distinct()


def cross_language(queries: DataFrame, phrases: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Terms of the other language for every phrase found in the query text."""
    low = F.lower("text")
    hits = F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(p)), F.array(*map(F.lit, terms))) for p, terms in phrases])
    )
    return queries.select("query_id", F.explode(F.flatten(hits)).alias("term")).distinct()


def domain_scores(
    df: DataFrame,
    text_col: str = "text",
    keywords: Sequence[tuple[str, Sequence[str]]] = tuple(rules.DOMAIN_KEYWORDS),
    overrides: Sequence[tuple[str, Sequence[str], Sequence[str]]] = tuple(rules.DOMAIN_OVERRIDES),
) -> DataFrame:
    """Adds ``domain, domain_confidence, domain_hits, primary``.

    Best keyword count wins, ties by rule order; an override domain with at
    least one hit takes over when one of its primary words occurs, unless the
    domain found so far is on its stop list.
    """
    low = F.lower(F.col(text_col))
    labels = [d for d, _ in keywords]
    counted = df.withColumns({f"_h_{d}": tx.terms_present(low, ws) for d, ws in keywords})
    total = sum((F.col(f"_h_{d}") for d in labels[1:]), F.col(f"_h_{labels[0]}"))
    best = F.array_max(
        F.array(*[F.struct(F.col(f"_h_{d}").alias("h"), F.lit(-i).alias("r"), F.lit(d).alias("d")) for i, d in enumerate(labels)])
    )
    out = counted.withColumns(
        {
            "_total": total,
            "domain": F.when(best["h"] > 0, best["d"]).otherwise(F.lit(rules.GENERAL)),
            "primary": F.lit(False),
        }
    )
    for domain, stop, words in overrides:
        said = tx.any_term(low, words)
        takes = said & (F.col(f"_h_{domain}") >= 1) & ~F.col("domain").isin(*stop)
        out = out.withColumns(
            {"domain": F.when(takes, F.lit(domain)).otherwise(F.col("domain")), "primary": F.col("primary") | said}
        )
    hits = F.coalesce(*[F.when(F.col("domain") == d, F.col(f"_h_{d}")) for d in labels], F.lit(0))
    return (
        out.withColumn("domain_hits", hits)
        .withColumn(
            "domain_confidence",
            F.when(F.col("domain") == rules.GENERAL, F.lit(0.25)).otherwise(
                F.round(F.col("domain_hits") / F.greatest(F.col("_total"), F.lit(1)), 3)
            ),
        )
        .drop("_total", *[f"_h_{d}" for d in labels])
    )


def entities(text: Column, patterns=tuple(rules.ENTITIES)) -> dict[str, Column]:
    """Capped distinct matches per entity kind."""
    return {kind: tx.all_matches(text, pattern, cap=cap) for kind, pattern, cap in patterns}


def dispute_class(text: Column, domain: Column, classes=tuple(rules.DISPUTES)) -> Column:
    found = tx.first_label(F.lower(text), classes, "")
    return F.when(found != "", found).otherwise(F.concat(F.lit("tranh_chap_"), domain))


def strategies(domain: Column, dispute: Column, n_laws: Column,
               graph_domains=tuple(rules.GRAPH_DOMAINS), risk_domains=tuple(rules.RISK_DOMAINS),
               case_marks=tuple(rules.CASE_MARKS)) -> Column:
    """Retrieval passes a query needs, in order."""
    return F.array_compact(
        F.array(
            F.lit("vector"), F.lit("bm25"),
            F.when(domain.isin(*graph_domains) | (n_laws > 0), F.lit("graph")),
            F.when(tx.any_term(dispute, list(case_marks)), F.lit("cases")),
            F.when(domain.isin(*risk_domains), F.lit("risks")),
            F.lit("behavior"),
        )
    )


def variants(text: Column, domain: Column, laws: Column, context=None) -> Column:
    """At most four distinct wordings of a query."""
    table = F.create_map(*[F.lit(x) for kv in (context or rules.CONTEXT_TERMS).items() for x in kv])
    short = F.regexp_replace(F.substring(text, 1, 80), r" [^ ]*$", "")
    made = F.array_compact(
        F.array(
            text,
            F.concat(text, F.lit(" "), table[domain]),
            F.when(
                F.size(laws) > 0,
                F.concat(F.array_join(F.slice(laws, 1, 2), " "), F.lit(": "), F.substring(text, 1, 120)),
            ),
            F.when(F.length(text) > 80, short),
        )
    )
    return F.slice(F.array_distinct(made), 1, 4)


def session_domains(turns: DataFrame) -> DataFrame:
    """Domain of each turn when short follow-ups inherit the session's domain.

    ``turns``: ``session_id, turn, words, domain, domain_hits, primary``.  A turn
    inherits when it names no domain, or is short, names another one and has
    neither two hits nor a primary word.  So the running domain only changes at
    turns that cannot inherit, which are marked beforehand; without any of those
    the first named domain holds.  Two running values replace a fold.
    """
    run = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("domain") != rules.GENERAL, F.col("domain"))
    firm = (F.col("words") > rules.FOLLOW_UP_WORDS) | (F.col("domain_hits") >= rules.STRONG_HITS) | F.col("primary")
    settled = F.last(F.when(firm, named), ignorenulls=True).over(run)
    opened = F.first(named, ignorenulls=True).over(run)
    # a weak opening counts until the first firm turn replaces it
    return turns.withColumn("session_domain", F.coalesce(settled, opened, F.lit(rules.GENERAL)))


def weak_query(text: Column, small_talk: Sequence[str], min_letters: int = 5) -> Column:
    """Empty, junk or small-talk queries."""
    t = F.trim(text)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    distinct = F.size(F.array_distinct(F.split(F.lower(F.regexp_replace(t, r"\s", "")), "")))
    chat = F.lower(F.regexp_replace(t, r"[.!?,]+$", "")).isin(*small_talk)
    return (letters < min_letters) | (distinct < 3) | chat


def intent(text: Column, rules_in_order: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """First intent whose words occur (ordered taxonomy)."""
    return tx.first_label(F.lower(text), rules_in_order, default)


def intent_by_count(text: Column, rule_set: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Intent with most keyword hits (counting taxonomy)."""
    label, _, _ = tx.best_label(F.lower(text), rule_set, default)
    return label


def similarity_band(score: Column) -> Column:
    chain = None
    for low, label in rules.SIMILARITY_BANDS:
        chain = F.when(score >= low, label) if chain is None else chain.when(score >= low, label)
    return chain.otherwise(rules.SIMILARITY_LOWEST)


def related_first(results: DataFrame, related: DataFrame, floor: float = 0.55) -> DataFrame:
    """Drop unrelated low scores, then order: same domain, related, other.

    ``results``: ``query_id, item_id, score, query_domain, item_domain``;
    ``related``: ``query_domain, item_domain`` (a closed relation of domains).
    """
    allowed = related.select("query_domain", "item_domain", F.lit(True).alias("_rel"))
    tagged = results.join(allowed, ["query_domain", "item_domain"], "left")
    known = F.coalesce("_rel", F.lit(False)) | (F.col("query_domain") == F.col("item_domain"))
    general = F.col("query_domain") == rules.GENERAL
    tier = F.when(general, 0).when(F.col("query_domain") == F.col("item_domain"), 0).when(known, 1).otherwise(2)
    return (
        tagged.withColumn("tier", tier)
        .filter(general | known | (F.col("score") >= floor))
        .withColumn("limitations", (F.col("tier") == 2).cast("int") + (F.col("score") < floor).cast("int"))
        .drop("_rel")
    )


#: Characters of an opening by which it is looked up in texts.
ANCHOR = 8


def prefix_counts(queries: DataFrame, length: int = 30, read: int = 60) -> DataFrame:
    """How many texts contain the opening of each query, at any place and in any case.

    The opening is the first ``read`` characters without full stops, trimmed and cut
    to ``length``.  Every place of a distinct text gives one row: the ANCHOR characters
    there, which meet the beginnings of the openings by equality, and as many more
    as an opening can have, on which a hit is verified.  Openings shorter than that
    are whole words at most; the windows of their few lengths are compared as they are.
    """
    low = F.lower("text")
    opening = F.substring(F.trim(F.replace(F.substring(low, 1, read), F.lit("."), F.lit(""))), 1, length)
    keyed = queries.withColumn("opening", opening)
    wanted = stage_table(keyed.select("opening").where("opening is not null").distinct())
    texts = queries.where("text is not null").groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("copies"))
    texts = stage_table(texts.withColumn("text_no", F.monotonically_increasing_id()))

    long = wanted.where(F.length("opening") >= ANCHOR).withColumn("anchor", F.substring("opening", 1, ANCHOR))
    places = F.sequence(F.lit(1), F.length("low") - ANCHOR + 1)
    tails = F.transform(places, lambda at: F.substring(F.col("low"), at, F.lit(max(length, ANCHOR))))
    tailed = texts.where(F.length("low") >= ANCHOR).select("text_no", "copies", F.explode(tails).alias("tail"))
    anchored = tailed.withColumn("anchor", F.substring("tail", 1, ANCHOR))
    found = anchored.join(long, "anchor").where(F.startswith("tail", "opening")).select("text_no", "copies", "opening").distinct()

    short = wanted.where(F.length("opening") < ANCHOR)
    sizes = sorted(r["n"] for r in short.select(F.length("opening").alias("n")).distinct().collect())  # fewer than ANCHOR

    def windows(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("low") - n + 1)
        made = F.transform(starts, lambda at: F.substring(F.col("low"), at, F.lit(n))) if n else F.array(F.lit(""))
        return F.when(F.length("low") >= n, made).otherwise(F.array().cast("array<string>"))

    whole = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(windows, sizes)))
    few = texts.select("text_no", "copies", F.explode(whole).alias("opening")).join(short, "opening", "left_semi").select("text_no", "copies", "opening")
    counted = found.unionByName(few).groupBy("opening").agg(F.sum("copies").alias("n_similar"))
    return keyed.join(counted, "opening", "left").drop("text").fillna(0, ["n_similar"])
