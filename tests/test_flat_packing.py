"""Flat packing against a plain loop, across batch borders, and on one very long document."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import chunking

SCHEMA = "doc_id int, pos int, raw_text string, heading string"


def plain_packing(rows, target):
    """Chunks of one document: (chunk_no, content, tokens, n_blocks, first_pos, hierarchy)."""
    rows = sorted((r for r in rows if r[2]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))
    chunks, used = [], 0
    for i, row in enumerate(rows):
        at_place = sum(len(r[2]) // 4 for r in rows if r[1] == row[1])
        new_place = i == 0 or rows[i - 1][1] != row[1]
        if new_place and (i == 0 or used + at_place > target):
            chunks.append([])
            used = 0
        used += at_place if new_place else 0
        chunks[-1].append(i)
    out = []
    for no, members in enumerate(chunks):
        read = [rows[i][3] for i in range(min(members[-1] + 2, len(rows))) if rows[i][3] is not None]
        part = [rows[i] for i in members]
        out.append((
            no, "\n\n".join(r[2] for r in part), sum(len(r[2]) // 4 for r in part), len(part),
            part[0][1], read[-1] if read else "",
        ))
    return out


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_packing_equals_a_plain_loop(spark, batch):
    rng = random.Random(5)
    rows = [
        (doc, pos, "w" * rng.choice([0, 1, 3, 40, 90, 500, 3000]), rng.choice([None, None, f"H{pos}"]))
        for doc in (*range(12), None) for pos in range(rng.choice([1, 2, 7, 60]))
    ]
    # one place twice, equal rows, no place at all
    rows += [(50, 1, "a" * 400, None), (50, 1, "b" * 400, "H"), (50, 2, "c" * 400, None), (50, 2, "c" * 400, None), (50, None, "d" * 90, "N")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = chunking.flat_chunks(spark.createDataFrame(rows, SCHEMA), 150).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for doc in {r[0] for r in rows}:
        mine = sorted(tuple(r)[1:] for r in got if r.doc_id == doc)
        assert mine == plain_packing([r for r in rows if r[0] == doc], 150), doc


def test_no_blocks_no_chunks(spark):
    assert chunking.flat_chunks(spark.createDataFrame([(1, 0, "", None)], SCHEMA)).collect() == []
    assert chunking.flat_chunks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_document_of_a_million_blocks(spark):
    n = 1_000_000
    blocks = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.repeat(F.lit("x"), 40).alias("raw_text"),
        F.when(F.col("id") % 1000 == 0, F.col("id").cast("string")).alias("heading"),
    )
    got = chunking.flat_chunks(blocks)
    # 50 blocks of ten tokens a chunk; the last heading is the one of block 999,000
    assert got.agg(F.count(F.lit(1)), F.sum("n_blocks"), F.max("tokens"), F.max("chunk_no")).first() == (20_000, n, 500, 19_999)
    assert got.filter("chunk_no = 19").first().hierarchy == "1000"
    assert got.filter("chunk_no = 19999").first().hierarchy == "999000"
