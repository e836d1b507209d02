"""A training corpus from raw documents: quality, near-duplicates, benchmark passages, tokens.

``run`` applies the stages to the documents table.  Each stage's result is written
as Parquet in the shared folder and read again, so a lost executor repeats at most
one stage.  A stage's decisions take effect: rows it rejects are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioweave.llm import bpe, decontaminate, quality_rules, simhash
from folioweave.llm.common import release_memory, table, word_bpe_path
from folioweave.session import new_folder

#: Bytes of words that a worker remembers when it encodes; the workers of earlier stages still live.
REMEMBERED = 20 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the classifier fitted on ``labels``."""
    release_memory()  # what earlier runs in this driver have freed
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group of near copies."""
    release_memory()
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a passage of ``benchmark``."""
    release_memory()
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    release_memory()
    return bpe.round_trip(docs, word_bpe_path(), with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: The classifier, the fingerprints and the merges have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokenised documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
