"""Block types, document hierarchy, canonical references and citations.

``blocks``: ``doc_id, pos, raw_text`` (``style`` and ``tag`` are optional).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions import numbers
from folioweave.rules import structure as rules


def is_citation(text: Column) -> Column:
    """A heading-like line that refers to another act, or has open brackets."""
    opened = F.length(F.regexp_replace(text, r"[^(]", ""))
    closed = F.length(F.regexp_replace(text, r"[^)]", ""))
    return text.rlike(rules.CITATION_WORDS) | (opened != closed)


def block_type(text: Column, style: Column | None = None, tag: Column | None = None) -> Column:
    """heading, list_item or paragraph."""
    t = F.trim(text)
    style = F.lit("") if style is None else F.lower(F.coalesce(style, F.lit("")))
    tag = F.lit("") if tag is None else F.lower(F.coalesce(tag, F.lit("")))
    cited = is_citation(t)
    return (
        F.when(style.rlike("heading|title|h1|h2|h3") | tag.rlike("^h[1-6]$"), "heading")
        .when(tag == "li", "list_item")
        .when(t.rlike(rules.GUARDED_HEADING), F.when(cited, "paragraph").otherwise("heading"))
        .when(t.rlike(rules.FORM_START), "heading")
        .when(t.rlike(rules.GUARDED_ITEM), F.when(cited, "paragraph").otherwise("list_item"))
        .when(t.rlike(rules.EN_HEADING), "heading")
        .when(t.rlike(rules.NUMBERED_ITEM) | t.rlike(rules.LETTERED_ITEM), "list_item")
        .when((F.length(t) < rules.COLON_HEADING_LENGTH) & t.endswith(":"), "heading")
        .when(t.rlike(rules.PARENTHESISED_ITEM), "list_item")
        .otherwise("paragraph")
    )


def with_structure(blocks: DataFrame) -> DataFrame:
    """Left-to-right hierarchy as running values over one ordering per document.

    A section resets the article; a Vietnamese article resets the clause, an
    English one does not; only numbered clauses (khoản) become the current
    clause.  Body text belongs to the current clause, else article, else section.

    Adds ``kind, unit, number, section_no, article_no, clause_no`` (own index
    for structural rows), ``cur_section, cur_article, cur_clause``,
    ``clause_article`` and ``in_article`` (the article a row is part of).
    """
    t = F.trim("raw_text")
    kind = F.coalesce(*[F.when(t.rlike(p), F.lit(k)) for k, _, p in rules.HEADINGS], F.lit("body"))
    units = F.create_map(*[F.lit(x) for k, u, _ in rules.HEADINGS for x in (k, u)])
    number = F.coalesce(
        *[F.when(F.col("kind") == k, F.regexp_extract(t, p, 2)) for k, _, p in rules.HEADINGS]
    )
    typed = (
        blocks.filter(t != "")
        .withColumn("kind", kind)
        .withColumns({"unit": F.coalesce(units[F.col("kind")], F.lit("body")), "number": number})
    )
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def count(unit: str) -> Column:
        return F.sum((F.col("unit") == unit).cast("int")).over(run).cast("int")

    def latest(condition: Column) -> Column:
        return F.coalesce(F.max(F.when(condition, F.col("pos"))).over(run), F.lit(-1))

    counted = typed.withColumns(
        {
            "_s": count("section"), "_a": count("article"), "_c": count("clause"),
            "_sp": latest(F.col("unit") == "section"),
            "_ap": latest(F.col("unit") == "article"),
            "_vp": latest(F.col("kind") == "điều"),
            "_kp": latest(F.col("kind") == "khoản"),
        }
    )
    current = counted.withColumns(
        {
            "cur_section": F.when(F.col("_sp") >= 0, F.col("_s") - 1),
            "cur_article": F.when(F.col("_ap") > F.col("_sp"), F.col("_a") - 1),
        }
    )
    last_clause = F.last(
        F.when(
            F.col("kind") == "khoản",
            F.struct((F.col("_c") - 1).alias("no"), F.col("cur_article").alias("article")),
        ),
        ignorenulls=True,
    ).over(run)
    carried = current.withColumn("_k", last_clause).withColumns(
        {
            "cur_clause": F.when(F.col("_kp") > F.col("_vp"), F.col("_k.no")),
            "clause_article": F.when(F.col("_kp") > F.col("_vp"), F.col("_k.article")),
        }
    )
    unit = F.col("unit")
    return carried.withColumns(
        {
            "section_no": F.when(unit == "section", F.col("_s") - 1),
            "article_no": F.when(unit == "article", F.col("_a") - 1),
            "clause_no": F.when(unit == "clause", F.col("_c") - 1),
            "in_article": F.when(unit == "article", F.col("_a") - 1)
            .when(unit == "clause", F.col("cur_article"))
            .when(
                unit == "body",
                F.when(F.col("cur_clause").isNotNull(), F.col("clause_article")).otherwise(
                    F.col("cur_article")
                ),
            ),
        }
    ).drop("_s", "_a", "_c", "_sp", "_ap", "_vp", "_kp", "_k")


def parent_key(df: DataFrame) -> Column:
    """Id of the structure a block belongs to (its own for structural rows)."""

    def key(kind: str, index: str) -> Column:
        return F.concat(
            F.col("doc_id").cast("string"), F.lit(f"__{kind}"), F.lpad(F.col(index).cast("string"), 4, "0")
        )

    return F.coalesce(
        key("sec", "section_no"), key("art", "article_no"), key("cls", "clause_no"),
        key("cls", "cur_clause"), key("art", "cur_article"), key("sec", "cur_section"),
    )


def _canonical(term: Column, number: Column, bracket: Column, suffix: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in rules.REFERENCE_TERMS.items() for x in kv])
    plain = F.rtrim(F.regexp_replace(F.trim(term), r"\.$", ""))
    value = F.when(
        number.rlike(r"^\d+$"), number.cast("bigint").cast("string")
    ).otherwise(
        F.when(number.rlike(rules.ROMAN_FORM), numbers.roman_value(number).cast("string")).otherwise(number)
    )
    sub = F.when(bracket != "", bracket).otherwise(suffix)
    return F.concat(
        table[plain], F.lit("_"), value, F.when(sub != "", F.concat(F.lit("_"), sub)).otherwise(F.lit(""))
    )


def _from_match(match: Column) -> Column:
    """Canonical reference of one matched reference text."""
    return _canonical(*[F.regexp_extract(match, rules.REFERENCE, i) for i in (1, 2, 3, 4)])


def references(text: Column) -> Column:
    """All canonical references of a text, distinct, in order of appearance.

    The long text is scanned once; the parts are read from the short matches.
    """
    matches = F.regexp_extract_all(F.lower(text), F.lit(rules.REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(matches, _from_match))


def label_reference(label: Column) -> Column:
    """Canonical reference of a label, null when there is none."""
    match = F.filter(
        F.array(F.regexp_extract(F.lower(label), rules.REFERENCE, 0)), lambda m: m != ""
    )
    return F.try_element_at(F.transform(match, _from_match), F.lit(1))


def unique_per_document(
    df: DataFrame, base: str, order: list[str], out: str = "ref", scope: list[str] | None = None
) -> DataFrame:
    """Suffixes ``_2, _3 …`` for repeated ids of a document.

    A number that another row of the document already carries literally behind
    the same stem is skipped.  Rows that carry such a literal announce it under
    the stem's key, so one ordering by (document, id) finds both and no join is
    needed; input that is already clustered by document is not shuffled again.
    """
    scope = ["doc_id"] if scope is None else scope
    stem = F.regexp_extract(base, r"^(.+_.+)_(\d+)$", 1)
    taken = F.regexp_extract(base, r"^(.+_.+)_(\d+)$", 2)
    entries = F.array_compact(
        F.array(
            F.struct(F.col(base).alias("key"), F.lit(None).cast("int").alias("taken")),
            F.when(stem != "", F.struct(stem.alias("key"), taken.try_cast("int").alias("taken"))),
        )
    )
    spread = df.withColumn("_e", F.explode(entries)).withColumns(
        {"_key": F.col("_e.key"), "_taken": F.col("_e.taken")}
    )
    whole = Window.partitionBy(*scope, "_key")
    ranked = spread.withColumns(
        {
            "_used": F.array_sort(F.collect_set("_taken").over(whole)),
            "_n": F.row_number().over(whole.orderBy(F.col("_taken").isNotNull(), *order)),
        }
    ).filter(F.col("_taken").isNull())
    # the k-th free number from 2 on
    shifted = F.aggregate(
        "_used",
        F.col("_n"),
        lambda acc, used: F.when((used >= 2) & (used <= acc), acc + 1).otherwise(acc),
    )
    return ranked.withColumn(
        out,
        F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), shifted)),
    ).drop("_e", "_key", "_taken", "_used", "_n")


def units(structured: DataFrame) -> DataFrame:
    """One row per section, article and clause with label and canonical reference.

    Columns: ``doc_id, unit, idx, pos, kind, number, label, parent_section,
    parent_article, parent_clause, ref``.  A clause is named below its article,
    which is the latest article above it, so a running value replaces a join;
    every step keeps the clustering by document.
    """
    own = structured.filter(F.col("unit") != "body").select(
        "doc_id", "unit", "kind", "number", "pos",
        F.coalesce("section_no", "article_no", "clause_no").alias("idx"),
        F.substring(F.trim("raw_text"), 1, rules.LABEL_LENGTH).alias("label"),
        F.when(F.col("unit") == "article", F.col("cur_section")).alias("parent_section"),
        F.when(F.col("unit") == "clause", F.col("cur_article")).alias("parent_article"),
        F.when(F.col("kind") == "điểm", F.col("cur_clause")).alias("parent_clause"),
    )
    parsed = own.withColumn("parsed", label_reference(F.col("label")))
    # labels without a parsable reference are numbered per document and level
    order = Window.partitionBy("doc_id", "unit").orderBy("pos")
    missing = F.sum(F.col("parsed").isNull().cast("int")).over(order)
    based = parsed.withColumns(
        {
            "base": F.coalesce("parsed", F.concat(F.col("unit"), F.lit("_"), missing)),
            "_low": (F.col("unit") == "clause").cast("int"),
            "_lv": F.when(F.col("unit") == "section", 0).otherwise(1),
        }
    )
    # clauses pass through here unused and are named below
    top = unique_per_document(based, "base", ["_lv", "pos"], "_top", ["doc_id", "_low"])
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    above = F.when(
        F.col("parent_article").isNotNull(),
        F.last(F.when(F.col("unit") == "article", F.col("_top")), ignorenulls=True).over(run),
    )
    carried = top.withColumn("_above", above)
    full = (
        F.when(F.col("unit") != "clause", F.col("_top"))
        .when(
            F.col("_above").isNotNull() & ~F.col("base").startswith(F.col("_above")),
            F.concat_ws("_", "_above", "base"),
        )
        .otherwise(F.col("base"))
    )
    named = unique_per_document(
        carried.withColumn("_full", full), "_full", ["pos"], "ref", ["doc_id", "_low"]
    )
    return named.drop("parsed", "base", "_low", "_lv", "_top", "_above", "_full")


def article_citations(structured: DataFrame) -> DataFrame:
    """Articles cited inside each article, one row per (doc, article, number)."""
    found = F.regexp_extract_all("raw_text", F.lit(rules.CITED_ARTICLES), F.lit(1))
    split = F.flatten(F.transform(found, lambda s: F.split(s, r"[\s,]+(?:và\s+)?")))
    digits = F.filter(split, lambda s: s.rlike(r"^\d+$"))
    return (
        structured.filter(F.col("in_article").isNotNull() & (F.col("unit") != "article"))
        .select("doc_id", F.col("in_article").alias("article_no"), "pos", F.explode(digits).alias("cited"))
        .groupBy("doc_id", "article_no", "cited")
        .agg(F.min("pos").alias("first_pos"))
    )


def article_paths(unit_rows: DataFrame, titles: DataFrame) -> DataFrame:
    """``title › section label › article label`` per article.

    ``titles``: ``doc_id, title``.
    """
    articles = unit_rows.filter(F.col("unit") == "article").select(
        "doc_id", F.col("idx").alias("article_no"), "label", "ref", "parent_section"
    )
    sections = unit_rows.filter(F.col("unit") == "section").select(
        "doc_id", F.col("idx").alias("parent_section"), F.col("label").alias("section_label")
    )
    title = F.regexp_replace("title", rules.FILE_EXTENSIONS, "")
    return (
        articles.join(sections, ["doc_id", "parent_section"], "left")
        .join(titles, "doc_id", "left")
        .select(
            "doc_id", "article_no", "label", "ref", "section_label",
            F.array_compact(F.array(title, "section_label", "label")).alias("path"),
        )
    )
