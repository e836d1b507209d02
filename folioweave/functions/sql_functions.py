"""SQL-callable versions of the scalar functions (inlined by Catalyst)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from folioweave.functions import text


def register(spark: SparkSession) -> None:
    """Create temporary SQL functions; they expand to expressions, no Python runs."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fold_accents(t STRING) RETURNS STRING RETURN "
        f"translate(lower(t), '{text._FOLD_FROM}', '{text._FOLD_TO}')"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION count_term(t STRING, k STRING) RETURNS INT RETURN "
        "CASE WHEN length(k) = 0 THEN 0 "
        "ELSE (length(t) - length(replace(t, k, ''))) div length(k) END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN "
        r"lower(trim(regexp_replace(t, '(?U)\\s+', ' ')))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS INT RETURN "
        "CAST(length(t) div 4 AS INT)"
    )
