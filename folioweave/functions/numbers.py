"""Numeric column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral; null when other letters occur."""
    text = F.lower(F.trim(c))
    digits = F.transform(
        F.filter(F.split(text, ""), lambda ch: ch != ""),
        lambda ch: F.coalesce(
            *[F.when(ch == k, F.lit(v)) for k, v in ROMAN.items()], F.lit(0)
        ),
    )
    total = F.aggregate(
        digits,
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("prev")),
        lambda acc, v: F.struct(
            (acc["sum"] + v - F.when(acc["prev"] < v, acc["prev"] * 2).otherwise(F.lit(0))).alias("sum"),
            v.alias("prev"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(text.rlike("^[ivxlcdm]+$"), total)


def plain_number(c: Column) -> Column:
    """Arabic or Roman number with an optional sub-letter, as text.

    ``IV`` becomes ``4``, ``12A`` becomes ``12a``; anything else is lower-cased.
    """
    text = F.lower(F.trim(c))
    return F.when(text.rlike(r"^\d+[a-zđ]?$"), text).otherwise(
        F.coalesce(roman_value(text).cast("string"), text)
    )


def freshness(age_days: Column, half_life: float = 180.0, missing: float = 0.65) -> Column:
    """Exponential decay with the given half life; unknown age is neutral."""
    decayed = F.exp(F.lit(-math.log(2.0) / half_life) * F.greatest(age_days, F.lit(0.0)))
    return F.when(age_days.isNull(), F.lit(missing)).otherwise(decayed)
