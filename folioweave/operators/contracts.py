"""Contract clauses: splitting, classification, red flags and coaching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators.quality import banded
from folioweave.rules import evidence as rules
from folioweave.sources.texts import CONTRACT_ARTICLE_START

MIN_CLAUSE = 30


def split_articles(contracts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contract parts of at least 30 characters, split before article headings.

    Texts without headings fall apart at blank lines.
    """
    marked = F.split(text, CONTRACT_ARTICLE_START)
    parts = F.when(F.size(marked) > 1, marked).otherwise(F.split(text, r"\n\s*\n"))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ \n\t\r]+|[ \n\t\r]+$", ""))
    return contracts.select(key, F.posexplode(trimmed).alias("part", "text")).filter(
        F.length("text") >= MIN_CLAUSE
    )


def classify_clauses(
    clauses: DataFrame,
    types: Sequence[tuple[str, Sequence[str]]],
    high: Sequence[tuple[str, str]],
    medium: Sequence[tuple[str, str]],
    default: str = "general_provisions",
) -> DataFrame:
    """Type by most matching patterns (ties to the earlier), first red flag as risk.

    ``clauses``: ``doc_id, part, text``; patterns run on lower-cased text.
    """
    low = F.lower("text")
    counts = F.array(
        *[
            F.struct(
                sum((low.rlike(p).cast("int") for p in patterns[1:]), low.rlike(patterns[0]).cast("int")).alias("n"),
                F.lit(-i).alias("r"),
                F.lit(name).alias("type"),
            )
            for i, (name, patterns) in enumerate(types)
        ]
    )
    best = F.array_max(counts)

    def first(rows, level):
        return [F.when(low.rlike(p), F.struct(F.lit(level).alias("level"), F.lit(why).alias("reason"))) for p, why in rows]

    calm = F.struct(F.lit("low").alias("level"), F.lit(None).cast("string").alias("reason"))
    risk = F.coalesce(*first(high, "high"), *first(medium, "medium"), calm)
    return clauses.withColumns({"_b": best, "_r": risk}).select(
        *clauses.columns,
        F.when(F.col("_b.n") > 0, F.col("_b.type")).otherwise(F.lit(default)).alias("clause_type"),
        F.col("_r.level").alias("risk_level"),
        F.col("_r.reason").alias("risk_reason"),
    )


def contract_summary(classified: DataFrame) -> DataFrame:
    """Clause counts by risk and a compliance score per contract."""
    counts = classified.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("clauses"),
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in ("high", "medium", "low")],
    )
    return counts.withColumn(
        "compliance_score", F.greatest(F.lit(0), F.lit(100) - F.col("high") * 15 - F.col("medium") * 5)
    )


def coach(
    clauses: DataFrame,
    patterns: Sequence[tuple[str, str, Sequence[str]]],
    templates: Sequence[tuple[str, str]],
) -> DataFrame:
    """Risk patterns found, standard clauses missing, score and band per clause.

    ``patterns``: ``(risk, severity, keywords)``; ``templates``: ``(clause name,
    importance)``, missing when no word of the name occurs.
    """
    low = F.lower("text")
    found = F.array_compact(
        F.array(
            *[
                F.when(tx.any_term(low, words), F.struct(F.lit(name).alias("risk"), F.lit(rules.SEVERITY_WEIGHTS[severity]).alias("w")))
                for name, severity, words in patterns
            ]
        )
    )
    lacking = F.array_compact(
        F.array(
            *[
                F.when(
                    ~tx.any_term(low, name.lower().split()),
                    F.struct(F.lit(name).alias("clause"), F.lit(10 if importance == "required" else 3).alias("w")),
                )
                for name, importance in templates
            ]
        )
    )
    summed = lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["w"])
    scored = clauses.withColumns({"_f": found, "_m": lacking}).withColumn(
        "coach_score", F.least(F.lit(100.0), summed(F.col("_f")) + summed(F.col("_m")) * 0.5)
    )
    return scored.select(
        *clauses.columns,
        F.array_join(F.transform("_f", lambda s: s["risk"]), ",").alias("risks"),
        F.array_join(F.transform("_m", lambda s: s["clause"]), ",").alias("missing"),
        "coach_score",
        banded(F.col("coach_score"), rules.COACH_BANDS, "low").alias("coach_level"),
    )
