"""Retrieval units: article, clause, form, flat and table chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.rules import structure as rules
from folioweave.session import spread


def ordered_text(text: str = "raw_text", order: str = "pos", sep: str = "\n\n", when: Column | None = None) -> Column:
    """Texts of a group joined in order; only rows meeting ``when``."""
    item = F.struct(order, F.col(text).alias("_t"))
    item = item if when is None else F.when(when, item)
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_t"]), sep)


def article_coverage(structured: DataFrame) -> DataFrame:
    """Share of blocks inside articles or clauses, and whether to chunk flat."""
    inside = (F.col("unit").isin("article", "clause")) | (
        (F.col("unit") == "body") & (F.col("cur_clause").isNotNull() | F.col("cur_article").isNotNull())
    )
    return structured.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.count_if(F.col("unit") == "article").alias("n_articles"),
        F.round(F.avg(inside.cast("double")), 6).alias("coverage"),
    ).withColumn(
        "flat", (F.col("n_articles") == 0) | (F.col("coverage") < rules.MIN_ARTICLE_COVERAGE)
    )


def strategy(profile: DataFrame) -> DataFrame:
    """Chunk strategy per document.

    ``profile`` needs ``family, doc_type, topic, has_tables, table_density,
    image_density, layout_complexity, scan_quality, is_long, has_structure``.
    """
    c = F.col
    contract = (c("family") == "hop_dong") | (c("doc_type") == "hop_dong") | (c("topic") == "hop_dong")
    score = F.when(c("has_structure"), 0.8).otherwise(0.3)
    chosen = (
        F.when((c("family") == "bieu_mau") | (c("doc_type") == "bieu_mau"), "mixed_group")
        .when(contract & (c("has_tables") | (c("table_density") > 0.05)), "table_aware")
        .when(contract, "legal_aware")
        .when(c("topic").isin("dat_dai", "gia_dinh", "dan_su") & c("has_structure"), "structural")
        .when(
            (score >= 0.7) & (c("table_density") <= 0.2) & (c("image_density") <= 0.2),
            F.when(c("is_long"), "long_local_structural").otherwise("structural"),
        )
        .when((score >= 0.5) & c("is_long"), "legal_aware")
        .when((c("table_density") >= 0.4) & (c("layout_complexity") <= 0.5), "table_aware")
        .when((c("image_density") >= 0.3) | (c("scan_quality") < 0.5), "conservative_fallback")
        .when(c("layout_complexity") >= 0.7, "mixed_group")
        .otherwise("semantic")
    )
    fallback = {
        "structural": "legal_aware", "long_local_structural": "legal_aware", "legal_aware": "semantic",
        "table_aware": "mixed_group", "mixed_group": "conservative_fallback",
        "semantic": "conservative_fallback", "conservative_fallback": "conservative_fallback",
    }
    table = F.create_map(*[F.lit(x) for kv in fallback.items() for x in kv])
    return profile.withColumn("strategy", chosen).withColumn("fallback", table[F.col("strategy")])


def article_chunks(structured: DataFrame, paths: DataFrame, max_tokens: int = rules.CHUNK_MAX_TOKENS) -> DataFrame:
    """One chunk per article; oversized articles become heading plus clauses.

    Rows: ``doc_id, article_no, clause_no (null for the article row), chunk_type
    (article | parent | clause), path, content, tokens, first_pos``.
    """
    # the clauses a row is printed under: its own, and the current numbered
    # clause for points and body text
    own = F.struct(F.col("in_article").alias("article_no"), F.col("clause_no").alias("clause_no"))
    carrier = F.struct(F.col("clause_article").alias("article_no"), F.col("cur_clause").alias("clause_no"))
    holders = F.array_compact(
        F.array(
            F.when(F.col("unit") == "clause", own),
            F.when((F.col("kind") == "điểm") | (F.col("unit") == "body"), carrier),
        )
    )
    rows = structured.withColumn(
        "holders", F.filter(holders, lambda h: h["article_no"].isNotNull() & h["clause_no"].isNotNull())
    )
    inside = rows.filter(F.col("in_article").isNotNull())
    bodies = inside.groupBy("doc_id", F.col("in_article").alias("article_no")).agg(
        ordered_text().alias("body"),
        ordered_text(when=F.size("holders") == 0).alias("intro"),
        F.count_if(F.col("unit") == "clause").alias("n_clauses"),
        F.min("pos").alias("first_pos"),
    )
    titled = bodies.join(paths, ["doc_id", "article_no"]).withColumn(
        "header", F.concat(F.array_join("path", rules.PATH_SEPARATOR), F.lit("\n\n## "), F.col("label"))
    )

    def content(body: str) -> Column:
        return F.when(F.col(body) == "", F.col("header")).otherwise(
            F.concat("header", F.lit("\n\n"), F.col(body))
        )

    sized = titled.withColumn("content", content("body")).withColumn(
        "tokens", tx.token_estimate(F.col("content"))
    )
    oversized = (F.col("tokens") > max_tokens) & (F.col("n_clauses") > 0)
    plain = sized.filter(~oversized).withColumn("chunk_type", F.lit("article"))
    parent = (
        sized.filter(oversized)
        .withColumn("content", content("intro"))
        .withColumn("chunk_type", F.lit("parent"))
    )
    keep = ["doc_id", "article_no", "clause_no", "chunk_type", "path", "ref", "content", "first_pos"]
    top = plain.unionByName(parent).withColumn("clause_no", F.lit(None).cast("int")).select(*keep)

    split = sized.filter(oversized).select("doc_id", "article_no", "label", "path", "ref")
    groups = (
        rows.select("doc_id", "pos", "raw_text", F.explode("holders").alias("h"))
        .groupBy("doc_id", F.col("h.article_no").alias("article_no"), F.col("h.clause_no").alias("clause_no"))
        .agg(
            ordered_text().alias("clause_text"),
            F.min("pos").alias("first_pos"),
            F.min_by(F.substring(F.trim("raw_text"), 1, rules.LABEL_LENGTH), "pos").alias("clause_label"),
        )
    )
    clause = groups.join(split, ["doc_id", "article_no"]).withColumns(
        {
            "path": F.concat(F.col("path"), F.array("clause_label")),
            "chunk_type": F.lit("clause"),
        }
    )
    clause = clause.withColumn(
        "content",
        F.concat(
            F.array_join("path", rules.PATH_SEPARATOR), F.lit("\n\n["), F.col("label"), F.lit("]\n\n"),
            F.col("clause_text"),
        ),
    ).select(*keep)
    return top.unionByName(clause).withColumn("tokens", tx.token_estimate(F.col("content")))


def siblings(chunks: DataFrame) -> DataFrame:
    """Clause chunks listed on their parent chunk, in order."""
    return (
        chunks.filter(F.col("chunk_type") == "clause")
        .groupBy("doc_id", "article_no")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_pos", "clause_no"))), lambda s: s["clause_no"]
            ).alias("clause_nos")
        )
    )


def numbered(chunks: DataFrame, order: list[Column]) -> DataFrame:
    """Sequential chunk ids per document."""
    no = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return chunks.withColumn("chunk_no", no).withColumn(
        "chunk_id",
        F.concat(F.col("doc_id").cast("string"), F.lit("__chunk"), F.lpad(F.col("chunk_no").cast("string"), 5, "0")),
    )


def validated(chunks: DataFrame) -> DataFrame:
    """Empty chunks are kept but marked."""
    empty = F.trim("content") == ""
    return chunks.withColumn("degraded", empty).withColumn(
        "reason", F.when(empty, F.lit("empty_content"))
    )


def form_chunks(structured: DataFrame) -> DataFrame:
    """Preamble plus one chunk per form; text before the first form is the preamble."""
    forms = F.sum((F.col("kind") == "form").cast("int")).over(
        Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        structured.withColumn("form_no", forms)
        .groupBy("doc_id", "form_no")
        .agg(
            ordered_text().alias("content"),
            F.min_by(F.substring(F.trim("raw_text"), 1, rules.LABEL_LENGTH), "pos").alias("first_line"),
            F.count(F.lit(1)).alias("n_blocks"),
        )
        .withColumn("label", F.when(F.col("form_no") == 0, F.lit("preamble")).otherwise(F.col("first_line")))
        .drop("first_line")
    )


def flat_chunks(blocks: DataFrame, target: int = rules.FLAT_TARGET_TOKENS) -> DataFrame:
    """Greedy packing of consecutive blocks up to ``target`` tokens.

    ``blocks``: ``doc_id, pos, raw_text, heading`` (heading text or null).  A
    chunk carries the heading that is current when the next chunk begins.
    Blocks with one position stay in one chunk, in the order of their texts.

    Where chunks begin is a fold over the sizes alone, streamed in document
    order, so no document is ever held as a whole; the texts meet the
    beginnings in a window and are shuffled once.
    """
    kept = blocks.filter(F.col("raw_text") != "").select("doc_id", "pos", "raw_text", "heading")
    size = F.floor(F.length("raw_text") / 4)
    places = kept.groupBy("doc_id", "pos").agg(F.sum(size).alias("size"))
    # the exchange stands next to the sort: an aggregation between them may choose another one
    ordered = spread(places, "doc_id").sortWithinPartitions("doc_id", "pos")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    begins = ordered.mapInArrow(
        partial(_beginnings, target=target), f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, chunk_no int"
    )
    rows = kept.withColumn("is_block", F.lit(1)).unionByName(
        begins.withColumn("is_block", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy("doc_id").orderBy("pos", "is_block", "raw_text", "heading")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    packed = (
        rows.withColumn("chunk_no", F.last("chunk_no", ignorenulls=True).over(run))
        .withColumn("read", F.last("heading", ignorenulls=True).over(run))
        .filter("is_block = 1")
        # headings read so far, including the block that opens the next chunk
        .withColumn("read", F.coalesce(F.lead("read").over(order), "read"))
    )
    item = F.struct("pos", "raw_text", "heading")
    return packed.groupBy("doc_id", "chunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["raw_text"]), "\n\n").alias("content"),
        F.sum(size).cast("int").alias("tokens"),
        F.count(F.lit(1)).cast("int").alias("n_blocks"),
        F.min("pos").alias("first_pos"),
        F.coalesce(F.max_by("read", item), F.lit("")).alias("hierarchy"),
    )


def _beginnings(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    """Places at which a chunk begins; the rows come in document order.

    Between batches only the current document, the tokens used and the chunk's
    number are kept.
    """
    doc, used, number = None, 0, -1
    for batch in batches:
        if batch.num_rows == 0:
            continue
        docs = batch.column("doc_id")
        code = docs.dictionary_encode(null_encoding="encode").indices.to_numpy()
        sums = np.concatenate([[0], np.cumsum(batch.column("size").to_numpy())])
        edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
        at, numbers = [], []
        for first, end in pairwise(edges):
            follows = first == 0 and number >= 0 and docs[0].as_py() == doc
            if not follows:
                used, number = 0, -1
            here = first
            while here < end:
                # the first block that no longer fits, or the document's first block
                full = int(np.searchsorted(sums, sums[here] + target - used, side="right")) - 1
                opens = here if number < 0 else max(here, full)
                if opens >= end:
                    used += int(sums[end] - sums[here])
                    break
                number += 1
                at.append(opens)
                numbers.append(number)
                used, here = int(sums[opens + 1] - sums[opens]), opens + 1
        doc = docs[batch.num_rows - 1].as_py()
        places = batch.select(["doc_id", "pos"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*places.columns, pa.array(numbers, pa.int32())], ["doc_id", "pos", "chunk_no"])


def table_chunks(tables: DataFrame, parents: DataFrame) -> DataFrame:
    """Table texts as chunks linked to the nearest preceding article.

    ``tables``: ``doc_id, table_no, pos, content``; ``parents``: ``doc_id,
    article_no, first_pos``.
    """
    starts = parents.select(
        "doc_id", F.col("first_pos").alias("pos"), F.lit(0).alias("is_table"),
        F.lit(None).cast("int").alias("table_no"), F.lit(None).cast("string").alias("content"), "article_no",
    )
    rows = tables.select(
        "doc_id", F.col("pos").cast("int").alias("pos"), F.lit(1).alias("is_table"), "table_no", "content",
        F.lit(None).cast("int").alias("article_no"),
    )
    run = Window.partitionBy("doc_id").orderBy("pos", "is_table").rowsBetween(Window.unboundedPreceding, 0)
    merged = starts.unionByName(rows).withColumn(
        "parent_article", F.last("article_no", ignorenulls=True).over(run)
    )
    return merged.filter(F.col("is_table") == 1).select(
        "doc_id", "table_no", "content", "parent_article", tx.token_estimate(F.col("content")).alias("tokens")
    )


def attachment_chunks(images: DataFrame) -> DataFrame:
    """Recognised text of attachments; unreadable ones are kept as degraded."""
    text = F.trim(F.coalesce("ocr_text", F.lit("")))
    return images.select(
        "doc_id", "image_no",
        F.when(text == "", F.lit("[unreadable attachment]")).otherwise(text).alias("content"),
        (text == "").alias("degraded"),
    )


def markdown(blocks: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Rendered document: heading levels, list marks, then tables.

    ``blocks``: ``doc_id, pos, raw_text, block_type``.
    """
    t = F.trim("raw_text")
    low = F.lower(t)
    level = (
        F.when(low.rlike(r"(?U)^(?:chương|phần|chapter|part|mẫu|mau|biểu\s+mẫu|bieu\s+mau|phụ\s+lục|form)\s+"), "# ")
        .when(low.rlike(r"(?U)^(?:mục|section)\s+"), "## ")
        .when(low.rlike(r"(?U)^(?:điều|article)\s+"), "### ")
        .otherwise("## ")
    )
    line = (
        F.when(F.col("block_type") == "heading", F.concat(level, t))
        .when(F.col("block_type") == "list_item", F.concat(F.lit("- "), t))
        .when(F.col("block_type") == "quote", F.concat(F.lit("> "), t))
        .otherwise(t)
    )
    rows = blocks.filter(t != "").select("doc_id", F.lit(0).alias("phase"), "pos", line.alias("line"))
    if tables is not None:
        rows = rows.unionByName(
            tables.select("doc_id", F.lit(1).alias("phase"), F.col("table_no").alias("pos"), F.col("content").alias("line"))
        )
    ordered = F.array_sort(F.collect_list(F.struct("phase", "pos", "line")))
    return rows.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n").alias("markdown")
    )
