"""Column builders for text: everything stays inside generated JVM code."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def collapse_spaces(c: Column) -> Column:
    """Trim and turn every run of (Unicode) white space into one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse_spaces(c))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL_CHARS, "")


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"[ \t]+", " "))


def _folding_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode."""
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        if letter != letter.lower():
            continue
        base = unicodedata.normalize("NFD", letter)
        if len(base) > 1 and base[0].isascii():
            source.append(letter)
            target.append(base[0])
    return "".join(source) + "đ", "".join(target) + "d"


_FOLD_FROM, _FOLD_TO = _folding_table()


def fold_accents(c: Column) -> Column:
    """Lower case without diacritics; ``đ`` becomes ``d``."""
    return F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)


def fold_for_matching(c: Column) -> Column:
    """Folded text where everything but words, ``/``, ``.`` and ``-`` is blank."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(fold_accents(c), r"[^a-z0-9_\s/.\-]", " "), r"\s+", " ")
    )


def occurrences(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a literal term."""
    needle = F.lit(term) if isinstance(term, str) else term
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise((gone / F.length(needle)).cast("int"))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def alnum_ratio(c: Column) -> Column:
    kept = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return kept / F.greatest(F.length(c), F.lit(1))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """True when one of the literal terms occurs."""
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def terms_present(text: Column, terms: Sequence[str]) -> Column:
    """Number of distinct terms that occur."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def all_matches(text: Column, pattern: str, group: int = 0, cap: int | None = None) -> Column:
    """Distinct matches in order of appearance, at most ``cap``."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return found if cap is None else F.slice(found, 1, cap)


def ellipsis(c: Column, limit: int) -> Column:
    """Cut at the last word boundary before ``limit`` and append an ellipsis."""
    head = F.substring(c, 1, limit)
    at_word = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(at_word, F.lit("…")))


def excerpt(c: Column, limit: int = 800) -> Column:
    """Cut at the last sentence end inside ``limit``; hard cut with mark when none."""
    head = F.substring(c, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?;])(?:\s|$)", 1)
    cut = F.when(F.length(whole) > F.lit(limit // 2), whole).otherwise(
        F.concat(F.rtrim(head), F.lit("…"))
    )
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def sentences(c: Column, min_length: int = 1) -> Column:
    """Trimmed sentences split after ``.``, ``!``, ``?`` or a line break."""
    parts = F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= min_length)


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


NFKC_SUSPECT = (
    r"[\u00A0\u00A8\u00AA\u00AF\u00B2-\u00B5\u00B8-\u00BA\u00BC-\u00BE\u0132\u0133\u013F\u0140"
    r"\u0149\u017F\u01C4-\u01CC\u01F1-\u01F3\u02B0-\u02B8\u02D8-\u02DD\u02E0-\u02E4\u0300-\u1DFF"
    r"\u1E9A\u1E9B\u1FBD-\u1FFF\u2000-\u33FF\uA69C-\uFFFF]|[\x{10000}-\x{10FFFF}]"
)


def nfkc(c: Column) -> Column:
    """NFKC, with a Python worker only for rows that may change."""
    return F.when(c.rlike(NFKC_SUSPECT), _nfkc(F.when(c.rlike(NFKC_SUSPECT), c))).otherwise(c)


def fold_rules(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply ordered (pattern, replacement) rewrites."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def first_label(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first rule with a term in the text."""
    chain = None
    for label, terms in rules:
        hit = any_term(text, terms)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def best_label(
    text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str
) -> tuple[Column, Column, Column]:
    """(label, hits, total hits) of the rule with most distinct terms present.

    Ties go to the earlier rule; no hit at all yields ``default``.
    """
    scored = F.array(
        *[
            F.struct(
                terms_present(text, terms).alias("hits"),
                F.lit(-i).alias("rank"),
                F.lit(label).alias("label"),
            )
            for i, (label, terms) in enumerate(rules)
        ]
    )
    best = F.array_max(scored)
    total = F.aggregate(scored, F.lit(0), lambda acc, s: acc + s["hits"])
    label = F.when(best["hits"] > 0, best["label"]).otherwise(F.lit(default))
    return label, best["hits"], total
