"""Adapters from the shared test tables to the inputs of the operators.

``events`` plays the interaction log: the item is the JSON property ``k`` and
the topic is ``k`` in steps of four.  The clock is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import widen

AS_OF = "2024-01-31 00:00:00"

# Action weights in the vocabulary of the events table.
ACTION_WEIGHTS = {"purchase": 3.0, "signup": 2.0, "view": 1.0}
OTHER_WEIGHT = 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.get_json_object("props", "$.k").cast("int")
    return widen(table(spark, sf_dir, "events"), "user_id").select(
        "event_id",
        "user_id",
        "ts",
        F.col("event_type").alias("action"),
        item.alias("item"),
        F.floor(item / 4).cast("int").alias("topic"),
        "value",
    )


EV = """ev AS (
  SELECT event_id, user_id, ts, event_type AS action,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS item,
         CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 4.0) AS INTEGER) AS topic,
         value
  FROM events)"""

WEIGHT_SQL = "CASE action WHEN 'purchase' THEN 3.0::DOUBLE WHEN 'signup' THEN 2.0::DOUBLE WHEN 'view' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"


# --- corpus -----------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "documents"), "doc_id")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document as blocks."""
    return documents(spark, sf_dir).select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "raw_text")
    )


def _decorate(line, pos, doc_id):
    """Give a line the heading its position calls for (every third document English)."""
    en = doc_id % 3 == 1
    chapter = F.floor(pos / 11) + 1
    article = F.floor(pos / 5) + 1

    def two(vi: str, eng: str):
        return F.when(en, F.lit(eng)).otherwise(F.lit(vi))

    return (
        F.when(pos % 11 == 0, F.concat(two("Chương ", "Chapter "), chapter, F.lit(". "), line))
        .when((doc_id % 5 == 4) & (pos % 11 == 5), F.concat(two("Mẫu số ", "Form "), chapter, F.lit(" "), line))
        .when(pos % 5 == 1, F.concat(two("Điều ", "Article "), article, F.lit(". "), line))
        .when(pos % 5 == 2, F.concat(two("Khoản 1. ", "Clause 1. "), line))
        .when(pos % 5 == 4, F.concat(two("Khoản 2. ", "Clause 2. "), line))
        .when(pos % 10 == 3, F.concat(two("Điểm a) ", "Point 1. "), line))
        .otherwise(
            F.concat(
                line, two(" theo Điều ", " see Article "), (pos * 3) % 7 + 1,
                two(" và Khoản ", " and Clause "), pos % 3 + 1,
            )
        )
    )


def structured_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines carry statute headings, derived row by row."""
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: _decorate(line, i.cast("bigint"), F.col("doc_id"))
    )
    return documents(spark, sf_dir).select("doc_id", "source", F.array_join(lines, "\n").alias("text"))


def structured_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: _decorate(line, i.cast("bigint"), F.col("doc_id"))
    )
    return documents(spark, sf_dir).select(
        "doc_id", "source", F.posexplode(lines).alias("pos", "raw_text")
    )


LN = """ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw_text,
  CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM documents)"""

# The heading decoration as SQL; yields sb(doc_id, source, pos, raw_text).
SB = LN + """,
sb AS (SELECT doc_id, source, pos, CASE
  WHEN pos % 11 = 0 THEN CASE WHEN doc_id % 3 = 1 THEN 'Chapter ' ELSE 'Chương ' END || (pos // 11 + 1) || '. ' || raw_text
  WHEN doc_id % 5 = 4 AND pos % 11 = 5 THEN CASE WHEN doc_id % 3 = 1 THEN 'Form ' ELSE 'Mẫu số ' END || (pos // 11 + 1) || ' ' || raw_text
  WHEN pos % 5 = 1 THEN CASE WHEN doc_id % 3 = 1 THEN 'Article ' ELSE 'Điều ' END || (pos // 5 + 1) || '. ' || raw_text
  WHEN pos % 5 = 2 THEN CASE WHEN doc_id % 3 = 1 THEN 'Clause 1. ' ELSE 'Khoản 1. ' END || raw_text
  WHEN pos % 5 = 4 THEN CASE WHEN doc_id % 3 = 1 THEN 'Clause 2. ' ELSE 'Khoản 2. ' END || raw_text
  WHEN pos % 10 = 3 THEN CASE WHEN doc_id % 3 = 1 THEN 'Point 1. ' ELSE 'Điểm a) ' END || raw_text
  ELSE raw_text || CASE WHEN doc_id % 3 = 1 THEN ' see Article ' ELSE ' theo Điều ' END || (pos * 3 % 7 + 1)
       || CASE WHEN doc_id % 3 = 1 THEN ' and Clause ' ELSE ' và Khoản ' END || (pos % 3 + 1)
  END AS raw_text FROM ln)"""
ST = SB + """,
st AS (SELECT doc_id, any_value(source) AS source, string_agg(raw_text, chr(10) ORDER BY pos) AS text FROM sb GROUP BY 1)"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "conversations"), "conv_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
