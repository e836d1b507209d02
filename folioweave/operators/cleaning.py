"""Noise, duplicates, recognition repair and redaction over text tables.

``blocks``: ``doc_id, pos, raw_text``, one row per text unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.rules import corpus as rules


def flag_blocks(blocks: DataFrame) -> DataFrame:
    """Flags page numbers, repeated short lines and in-document duplicates.

    All three need only rows with the same normalised text in one document, so
    one exchange on (doc_id, norm) serves every window; a document that fills a
    partition on its own is still spread by its different lines.
    """
    base = blocks.withColumn("norm", tx.normalize(F.col("raw_text"))).withColumn(
        "page_number", F.trim("raw_text").rlike(rules.PAGE_NUMBER)
    )
    same = Window.partitionBy("doc_id", "norm")
    short = F.length("norm") <= rules.REPEAT_MAX_LENGTH
    repeated = short & (F.count(F.lit(1)).over(same) >= rules.REPEAT_THRESHOLD)
    flagged = base.withColumn(
        "noise",
        F.when(F.col("page_number"), F.lit("noise_page_number")).when(
            repeated, F.lit("noise_repeated_line")
        ),
    )
    first = F.min(F.when(F.col("noise").isNull(), F.col("pos"))).over(same)
    duplicate = (
        F.col("noise").isNull()
        & (F.length("norm") > rules.DUPLICATE_MIN_LENGTH)
        & (F.col("pos") > first)
    )
    return flagged.withColumn("duplicate_of", F.when(duplicate, first)).drop("page_number")


def cleaning_summary(flagged: DataFrame, pages: DataFrame) -> DataFrame:
    """Per document: noise, duplicates, coverage and status.

    ``pages``: ``doc_id, page_count``.
    """
    counts = flagged.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count("noise").alias("n_noise"),
        F.count("duplicate_of").alias("n_duplicates"),
    )
    joined = pages.join(counts, "doc_id", "left").fillna(
        0, ["n_blocks", "n_noise", "n_duplicates"]
    )
    coverage = F.least(F.lit(1.0), F.col("n_blocks") / F.greatest(F.lit(1), F.col("page_count") * 3))
    warned = (F.col("n_noise") > 0) | (F.col("n_duplicates") > 0)
    return joined.select(
        "doc_id", "n_blocks", "n_noise", "n_duplicates",
        F.round(coverage, 3).alias("coverage"),
        F.when(F.col("n_blocks") == 0, "fail").when(warned, "warning").otherwise("pass").alias("status"),
    )


def clean_recognised_text(c: Column, compatibility_form: bool = True) -> Column:
    """Control characters, hyphenated line ends and junk lines removed."""
    t = tx.strip_control(c)
    if compatibility_form:
        t = tx.nfkc(t)
    t = F.regexp_replace(t, r"-\s*\n\s*", "")
    t = F.regexp_replace(t, r"([^.?!])\n\s+(\p{Ll}+)", "$1 $2")
    kept = F.filter(
        F.split(t, "\n"),
        lambda line: (F.size(F.split(F.trim(line), r"\s+")) >= 3) & (tx.alnum_ratio(line) >= 0.3),
    )
    return F.array_join(F.transform(kept, lambda line: F.trim(line)), "\n")


def confident_words(words: Column, confidences: Column, minimum: int) -> Column:
    """Words recognised with at least the given confidence, joined by blanks."""
    pairs = F.arrays_zip(words.alias("w"), confidences.alias("c"))
    kept = F.filter(pairs, lambda p: (F.trim(p["w"]) != "") & (p["c"] >= minimum))
    return F.array_join(F.transform(kept, lambda p: p["w"]), " ")


def repair_tokens(
    docs: DataFrame, repairs: Sequence[tuple[str, str]] = tuple(rules.OCR_REPAIRS)
) -> DataFrame:
    """Ordered rewrites with the number of changed characters as a report column."""
    fixed = tx.fold_rules(F.col("text"), repairs)
    return docs.withColumn("fixed", fixed).withColumn("changed", F.col("fixed") != F.col("text"))


def repair_report(docs: DataFrame, repairs: Sequence[tuple[str, str]]) -> DataFrame:
    """How many matches each rule finds in the text as the earlier rules left it."""
    step = F.col("text")
    hits = []
    for i, (pattern, replacement) in enumerate(repairs):
        hits.append(F.sum(F.regexp_count(step, F.lit(pattern))).alias(f"rule_{i:02d}"))
        step = F.regexp_replace(step, pattern, replacement)
    totals = docs.agg(*hits)
    return totals.unpivot([], [f"rule_{i:02d}" for i in range(len(repairs))], "rule", "hits")


def redact(
    docs: DataFrame,
    redactions: Sequence[tuple[str, str, str]] = tuple(rules.REDACTIONS),
    topic: Column | None = None,
) -> DataFrame:
    """Personal data replaced in order; counts are taken step by step.

    Adds ``safe_summary, redaction_count, risk_flags`` and one count per rule.
    """
    out = docs.withColumn("_t", F.col("text"))
    for flag, pattern, replacement in redactions:
        out = out.withColumns(
            {
                f"n_{flag}": F.regexp_count(F.col("_t"), F.lit(pattern)),
                "_t": F.regexp_replace(F.col("_t"), pattern, replacement),
            }
        )
    counts = [F.col(f"n_{flag}") for flag, _, _ in redactions]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    flags = F.array_compact(
        F.array(*[F.when(F.col(f"n_{flag}") > 0, F.lit(flag)) for flag, _, _ in redactions])
    )
    safe = F.trim(F.regexp_replace("_t", r"\s{2,}", " "))
    fallback = F.lit(rules.SAFE_SUMMARY_DEFAULT)
    if topic is not None:
        table = F.create_map(*[F.lit(x) for kv in rules.SAFE_SUMMARIES.items() for x in kv])
        fallback = F.coalesce(table[topic], fallback)
    return out.select(
        *docs.columns,
        F.when(F.length(safe) < rules.SAFE_SUMMARY_MIN_LENGTH, fallback).otherwise(safe).alias(
            "safe_summary"
        ),
        total.alias("redaction_count"),
        flags.alias("risk_flags"),
        *[F.col(f"n_{flag}") for flag, _, _ in redactions],
    )


def redaction_report(redacted: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    """Documents and hits per flag and group."""
    totals = redacted.groupBy(by).agg(
        *[F.sum(f"n_{f}").alias(f) for f in flags],
        F.count_if(F.col("redaction_count") > 0).alias("docs_redacted"),
        F.count(F.lit(1)).alias("docs"),
    )
    return totals


def scrub(c: Column, field: str = "notes", rule_set=None) -> tuple[Column, Column]:
    """(clean text or null, number of replacements) for stored user text."""
    chosen = rules.SCRUB_RULES if rule_set is None else rule_set
    t = tx.strip_control(c)
    hits = F.lit(0)
    for _, pattern in chosen:
        hits = hits + F.regexp_count(t, F.lit(pattern))
        t = F.regexp_replace(t, pattern, rules.SCRUB_MARK)
    limit = rules.FIELD_LIMITS.get(field, 200)
    cut = F.trim(F.substring(t, 1, limit))
    return F.nullif(cut, F.lit("")), hits


def personal_facts(turns: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """First stated value of each personal fact per user.

    ``turns``: ``user_id, seq, text``.  Matching is a projection; only matches
    reach the exchange, reduced to one per user and fact on the map side.  Where no
    name is declared, a self-introduction by one word that is no role counts.
    """
    chosen = rules.FACT_PATTERNS if patterns is None else patterns
    stop = F.array(*map(F.lit, rules.NAME_STOPWORDS))
    found = []
    for fact, pattern in chosen.items():
        value = F.trim(F.regexp_extract("text", pattern, 1))
        ok = value != ""
        if fact == "name":
            value = F.trim(F.element_at(F.split(value, r"[,.\n;:]"), 1))
            words = F.split(F.lower(value), r"\s+")
            ok = (value != "") & (F.size(words) <= 4) & F.length(value).between(2, 45) & ~F.arrays_overlap(words, stop)
            single = F.regexp_extract("text", rules.SINGLE_NAME, 1)
            stated = (single != "") & ~F.array_contains(stop, F.lower(single))
            value, ok = F.when(ok, value).otherwise(single), ok | stated
        if fact == "age":
            ok = ok & value.try_cast("int").between(10, 100)
        found.append(F.when(ok, F.struct(F.lit(fact).alias("fact"), value.alias("value"))))
    rows = turns.select(
        "user_id", "seq", F.explode(F.array_compact(F.array(*found))).alias("f")
    )
    return rows.groupBy("user_id", F.col("f.fact").alias("fact")).agg(
        F.min_by("f.value", "seq").alias("value"), F.min("seq").alias("seq")
    )
