"""Text and markup to rows: lines, blocks, articles, table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.rules.corpus import HEADER_MAX_LENGTH

# Markers of lines that stand alone, ingest bounds.
HEADING_LINE = r"(?iU)^\s*(?:Điều|Khoản|Chương|Mục|Phần|Điểm)\s+[\w]+"
LIST_LINE = r"^\s*(?:\d+[.)]|[a-zA-Z][.)]|\(\d+\))\s+\S"
ARTICLE_START = r"(?=Điều\s+\d+[\s.:])"
CONTRACT_ARTICLE_START = r"(?iU)(?=\n\s*(?:Điều|Chương|Article|Section)\s+\w+)"
MIN_ARTICLE = 60
MAX_ARTICLE = 900
BLOCK_TAGS = "p|h[1-5]|li"
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Text of paragraphs, headings and list items in document order.

    Block tags are turned into separators, so one split per page replaces a
    tree; an unclosed element ends where the next one starts.
    """
    body = F.regexp_replace(
        F.col(html), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", ""
    )
    body = F.regexp_replace(body, rf"(?i)<({BLOCK_TAGS})(?:\s[^>]*)?>", "\x01$1\x02")
    body = F.regexp_replace(body, rf"(?i)</(?:{BLOCK_TAGS})\s*>", "\x01\x02")
    parts = pages.select(key, F.posexplode(F.split(body, "\x01")).alias("part", "piece"))
    tag = F.lower(F.substring_index("piece", "\x02", 1))
    content = F.regexp_replace(F.substring_index("piece", "\x02", -1), r"<[^>]+>", "")
    return (
        parts.filter(F.contains("piece", F.lit("\x02")))
        .select(key, "part", tag.alias("tag"), tx.collapse_spaces(decode_entities(content)).alias("raw_text"))
        .filter((F.col("tag") != "") & (F.col("raw_text") != ""))
    )


def html_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(table, row, column) text grid of every HTML table."""
    tables = pages.select(
        key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_no", "t")
    )
    rows = tables.select(
        key, "table_no", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "r")
    )
    cells = rows.select(
        key, "table_no", "row_no",
        F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)(<t[dh][^>]*>.*?)</t[dh]>"), F.lit(1))).alias("col_no", "c"),
    )
    return cells.select(
        key, "table_no", "row_no", "col_no",
        F.lower("c").startswith("<th").alias("is_header"),
        F.trim(decode_entities(F.regexp_replace("c", r"<[^>]+>", ""))).alias("text"),
    )


def html_plain(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Crude strip: tags become blanks, blanks collapse."""
    stripped = tx.collapse_spaces(F.regexp_replace(F.col(html), r"<[^>]+>", " "))
    return pages.select(key, stripped.alias("text")).filter(F.col("text") != "")


def line_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trimmed non-empty lines; a short line is kept only at its first place."""
    unix = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.filter(F.transform(F.split(unix, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(key, F.posexplode(lines).alias("pos", "raw_text"))
    norm = F.lower(F.regexp_replace("raw_text", r"\s+", " "))
    place = F.row_number().over(Window.partitionBy(key, "norm").orderBy("pos"))
    return (
        rows.withColumn("norm", norm)
        .withColumn("place", place)
        .filter((F.length("norm") >= HEADER_MAX_LENGTH) | (F.col("place") == 1))
        .select(key, "pos", "raw_text")
    )


def merged_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings and list lines alone, other lines of a paragraph merged.

    ``group`` numbers the blocks of a paragraph; blank lines part paragraphs.
    """
    paragraphs = docs.select(key, F.posexplode(F.split(text, "\n\n")).alias("para", "p"))
    lines = paragraphs.select(key, "para", F.posexplode(F.split("p", "\n")).alias("pos", "line"))
    lines = lines.select(key, "para", "pos", F.trim("line").alias("line")).filter(F.col("line") != "")
    alone = F.col("line").rlike(HEADING_LINE) | F.col("line").rlike(LIST_LINE)
    order = Window.partitionBy(key).orderBy("para", "pos")
    marked = lines.withColumn("alone", alone).withColumn(
        "starts",
        F.col("alone")
        | F.coalesce(F.lag("alone").over(order), F.lit(True))
        | (F.lag("para").over(order) != F.col("para")),
    )
    numbered = marked.withColumn("block_no", F.sum(F.col("starts").cast("int")).over(order))
    return numbered.groupBy(key, "block_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("para", "pos", "line"))), lambda s: s["line"]), " "
        ).alias("raw_text"),
        F.bool_or("alone").alias("standalone"),
    )


def article_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Article-level pieces between 60 and 900 characters.

    A longer article is cut into its paragraphs, and a longer paragraph into
    consecutive slices.  Articles and paragraphs below MIN_ARTICLE characters are
    left out, as the format demands.  A document without any piece yields its whole
    text if that is long enough.
    """
    body = tx.strip_tags(F.col(text))
    base = docs.select(key, body.alias("body"))
    parts = F.filter(
        F.transform(F.split("body", ARTICLE_START), lambda p, i: F.struct(i.alias("i"), F.trim(p).alias("p"))),
        lambda s: F.length(s["p"]) >= MIN_ARTICLE,
    )

    def paragraphs(s):
        long_paragraphs = F.filter(
            F.transform(F.split(s["p"], "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= MIN_ARTICLE
        )
        return F.transform(
            long_paragraphs,
            lambda x, j: F.struct(s["i"].alias("i"), j.alias("j"), x.alias("t")),
        )

    whole = lambda s: F.array(F.struct(s["i"].alias("i"), F.lit(-1).alias("j"), s["p"].alias("t")))
    units = F.flatten(
        F.transform(parts, lambda s: F.when(F.length(s["p"]) > MAX_ARTICLE, paragraphs(s)).otherwise(whole(s)))
    )
    fallback = F.array(F.struct(F.lit(0).alias("i"), F.lit(-1).alias("j"), F.trim("body").alias("t")))
    chosen = F.when(F.size(units) > 0, units).when(F.length(F.trim("body")) >= MIN_ARTICLE, fallback)
    exploded = base.select(key, F.explode(chosen).alias("u"))
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("u.t") - 1) / MAX_ARTICLE).cast("int")),
        lambda k: F.substring(F.col("u.t"), k * MAX_ARTICLE + 1, F.lit(MAX_ARTICLE)),
    )
    return exploded.select(
        key, F.col("u.i").alias("article"), F.col("u.j").alias("paragraph"),
        F.posexplode(slices).alias("slice", "text"),
    )


def table_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells as Markdown rows; a separator follows the header row.

    ``cells``: keys plus ``row_no, col_no, text, is_header``.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda s: s["text"]
    )
    rows = cells.groupBy(*keys, "row_no").agg(
        ordered.alias("texts"), F.bool_or("is_header").alias("is_header")
    )
    line = F.concat(F.lit("| "), F.array_join("texts", " | "), F.lit(" |"))
    rule = F.concat(
        F.lit("| "), F.array_join(F.transform("texts", lambda _: F.lit("---")), " | "), F.lit(" |")
    )
    return rows.select(
        *keys, "row_no", "is_header",
        F.when(F.col("is_header"), F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("markdown"),
    )
