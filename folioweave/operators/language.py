"""Language, jurisdiction and document profile as pure projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.rules import corpus as rules


@dataclass(frozen=True)
class LanguageRules:
    """Patterns of the two languages told apart; matched on lower-cased text."""

    first: str = "vi"
    second: str = "en"
    diacritics: str = rules.VI_DIACRITICS
    first_structure: str = rules.VI_STRUCTURE
    first_content: str = rules.VI_CONTENT
    second_structure: str = rules.EN_STRUCTURE
    second_content: str = rules.EN_CONTENT
    first_jurisdiction: tuple[str, str] = ("VN", rules.VI_JURISDICTION)
    second_jurisdictions: tuple[tuple[str, str], ...] = field(
        default=tuple(rules.EN_JURISDICTIONS)
    )


def _band(hits: Column, many: float, some: float) -> Column:
    return F.when(hits >= 3, many).when(hits >= 1, some).otherwise(0.0)


def detect_language(df: DataFrame, text_col: str = "text", r: LanguageRules | None = None) -> DataFrame:
    """Adds ``language, lang_confidence, jurisdiction, script, signals``.

    The whole text is read.  Only counts are carried between the steps.
    """
    r = r or LanguageRules()
    low = F.lower(F.col(text_col))
    counted = df.withColumns(
        {
            "_len": F.length(F.col(text_col)),
            "_blank": F.trim(F.coalesce(F.col(text_col), F.lit(""))) == "",
            "_dia": F.regexp_count(low, F.lit(r.diacritics)),
            "_fs": F.regexp_count(low, F.lit(r.first_structure)),
            "_fc": F.regexp_count(low, F.lit(r.first_content)),
            "_ss": F.regexp_count(low, F.lit(r.second_structure)),
            "_sc": F.regexp_count(low, F.lit(r.second_content)),
            "_fj": low.rlike(r.first_jurisdiction[1]),
            "_sj": F.coalesce(
                *[F.when(low.rlike(p), F.lit(code)) for code, p in r.second_jurisdictions]
            ),
        }
    )
    density = F.col("_dia") / F.greatest(F.col("_len"), F.lit(1))
    first = (
        F.when(density > 0.05, 0.5).when(density > 0.01, 0.25).otherwise(0.0)
        + _band(F.col("_fs"), 0.3, 0.15)
        + _band(F.col("_fc"), 0.25, 0.1)
    )
    plain = _band(F.col("_ss"), 0.35, 0.2) + _band(F.col("_sc"), 0.3, 0.15)
    second = plain + F.when((F.col("_dia") == 0) & (plain > 0), 0.1).otherwise(0.0)
    scored = counted.withColumns(
        {"_f": F.least(F.round(first, 6), F.lit(1.0)), "_s": F.least(F.round(second, 6), F.lit(1.0))}
    )
    f, s = F.col("_f"), F.col("_s")
    language = (
        F.when(F.col("_blank") | ((f == 0) & (s == 0)), F.lit("unknown"))
        .when(F.round(f - s, 6) >= 0.25, F.lit(r.first))
        .when(F.round(s - f, 6) >= 0.25, F.lit(r.second))
        .otherwise(F.lit("mixed"))
    )
    confidence = (
        F.when(F.col("language") == "unknown", 0.0)
        .when(F.col("language") == r.first, f)
        .when(F.col("language") == r.second, s)
        .otherwise((f + s) / 2)
    )
    stated = F.when((f > 0) & F.col("_fj"), F.lit(r.first_jurisdiction[0])).when(
        s > 0, F.col("_sj")
    )
    implied = F.when(
        (F.col("language") == r.first) | ((F.col("language") == "mixed") & (f > 0)),
        F.lit(r.first_jurisdiction[0]),
    )
    signals = F.array_compact(
        F.array(
            F.when(density > 0.05, F.lit("diacritics_high")).when(density > 0.01, F.lit("diacritics_low")),
            F.when(F.col("_fs") > 0, F.concat(F.lit(f"{r.first}_structure:"), F.col("_fs"))),
            F.when(F.col("_fc") > 0, F.concat(F.lit(f"{r.first}_content:"), F.col("_fc"))),
            F.when(F.col("_ss") > 0, F.concat(F.lit(f"{r.second}_structure:"), F.col("_ss"))),
            F.when(F.col("_sc") > 0, F.concat(F.lit(f"{r.second}_content:"), F.col("_sc"))),
            F.when((F.col("_dia") == 0) & (plain > 0), F.lit("ascii_only")),
        )
    )
    return (
        scored.withColumn("language", language)
        .withColumns(
            {
                "lang_confidence": F.round(confidence, 3),
                "jurisdiction": F.coalesce(stated, implied),
                "script": F.when(
                    (F.col("language") == r.first) | ((F.col("language") == "mixed") & (f > 0)),
                    "latin_diacritics",
                ).when(F.col("language") == "unknown", F.when(F.col("_dia") > 0, "latin_diacritics").otherwise("ascii"))
                .otherwise("ascii"),
                "signals": signals,
            }
        )
        .drop("_len", "_blank", "_dia", "_fs", "_fc", "_ss", "_sc", "_fj", "_sj", "_f", "_s")
    )


def language_rollup(detected: DataFrame, key: str, first: str = "vi", second: str = "en",
                    default_jurisdiction: str = "VN") -> DataFrame:
    """Per key: mean scores (mixed counts half for both) and majority jurisdiction."""
    lang, conf = F.col("language"), F.col("lang_confidence")

    def part(name: str) -> Column:
        return F.when(lang == name, conf).when(lang == "mixed", conf * 0.5).otherwise(0.0)

    means = detected.groupBy(key).agg(
        F.avg(part(first)).alias("f"), F.avg(part(second)).alias("s"), F.count(F.lit(1)).alias("n")
    )
    votes = (
        detected.filter(F.col("jurisdiction").isNotNull())
        .groupBy(key, "jurisdiction").agg(F.count(F.lit(1)).alias("votes"))
        .groupBy(key)
        .agg(F.min_by("jurisdiction", F.struct(-F.col("votes"), "jurisdiction")).alias("jurisdiction"))
    )
    gap = F.round(F.col("f") - F.col("s"), 6)
    language = F.when(gap >= 0.15, first).when(gap <= -0.15, second).otherwise("mixed")
    confidence = (
        F.when(language == first, F.least(F.col("f"), F.lit(1.0)))
        .when(language == second, F.least(F.col("s"), F.lit(1.0)))
        .otherwise((F.col("f") + F.col("s")) / 2)
    )
    return means.join(votes, key, "left").select(
        key, "n",
        language.alias("language"),
        F.round(confidence, 3).alias("lang_confidence"),
        F.coalesce(
            "jurisdiction", F.when(language == first, F.lit(default_jurisdiction))
        ).alias("jurisdiction"),
    )


def quick_languages(c: Column, diacritics: str = rules.VI_DIACRITICS,
                    first_words: str = rules.VI_QUICK_KEYWORDS,
                    second_words: str = rules.EN_QUICK_KEYWORDS,
                    first: str = "vi", second: str = "en") -> Column:
    """List of languages a text seems to contain; the second one by default."""
    low = F.lower(c)
    has_first = low.rlike(diacritics) | low.rlike(first_words)
    has_second = low.rlike(second_words)
    found = F.array_compact(F.array(F.when(has_first, F.lit(first)), F.when(has_second, F.lit(second))))
    return F.when(F.size(found) == 0, F.array(F.lit(second))).otherwise(found)


def stop_word_overlap(c: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), r"\s+"), F.array(*map(F.lit, words)))


def profile(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Size, page estimate and structure hints of every document."""
    t = F.col(text_col)
    tokens = tx.token_estimate(t)
    low = F.lower(t)
    return docs.withColumns(
        {
            "chars": F.length(t),
            "tokens": tokens,
            "page_count": F.greatest(F.lit(1), F.floor(tokens / rules.TOKENS_PER_PAGE)).cast("int"),
            "has_tables": F.contains(low, F.lit("<table")) | t.rlike(r"\|.*\||\t.*\t"),
            "has_images": F.contains(low, F.lit("<img")),
        }
    ).withColumn(
        "is_long",
        (F.col("tokens") >= rules.LONG_DOCUMENT_TOKENS)
        | (F.col("page_count") >= rules.LONG_DOCUMENT_PAGES),
    )


def extraction_route(file_type: Column, coverage: Column, is_long: Column) -> Column:
    """Which reading strategy a document needs."""
    by_length = F.when(is_long, "long_local").otherwise("simple_local")
    return (
        F.when(file_type.isin("docx", "html"), by_length)
        .when(coverage >= rules.STRONG_TEXT_LAYER, by_length)
        .when(coverage < rules.WEAK_TEXT_LAYER, "scan_recovery")
        .otherwise("hybrid_region_precision")
    )
