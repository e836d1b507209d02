"""Nodes and edges of the knowledge graph as two DataFrames.

nodes: ``node_id, node_type, label, doc_id, confidence, degraded, ref``;
edges: ``edge_id, edge_type, src, dst, confidence, method, doc_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.ids import digest_id
from folioweave.rules import graph as rules

LABEL = 120


def node_id(doc: Column, node_type: str | Column, source: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return digest_id("node", doc, kind, source)


def edge_id(src: Column, edge_type: Column, dst: Column) -> Column:
    return digest_id("edge", src, edge_type, dst)


def unit_source(unit: str, index: Column) -> Column:
    """Anchor of a section, article or clause inside its document."""
    return F.concat(F.lit(f"__{unit[:3]}"), F.lpad(index.cast("string"), 4, "0"))


def _unit_node(unit: str, index: str) -> Column:
    return node_id(F.col("doc_id"), unit.capitalize(), unit_source(unit, F.col(index)))


def structure_nodes(units: DataFrame, titles: DataFrame) -> DataFrame:
    """Document, section, article and clause nodes."""
    docs = titles.select(
        node_id(F.col("doc_id"), "Document", F.lit("root")).alias("node_id"),
        F.lit("Document").alias("node_type"), F.substring("title", 1, LABEL).alias("label"), "doc_id",
        F.lit(0.9).alias("confidence"), F.lit(False).alias("degraded"), F.lit(None).cast("string").alias("ref"),
    )
    kind = F.initcap("unit")
    source = F.concat(F.lit("__"), F.substring("unit", 1, 3), F.lpad(F.col("idx").cast("string"), 4, "0"))
    parts = units.select(
        digest_id("node", F.col("doc_id"), kind, source).alias("node_id"), kind.alias("node_type"),
        F.substring("label", 1, LABEL).alias("label"), "doc_id", F.lit(0.9).alias("confidence"),
        F.lit(False).alias("degraded"),
        F.when(F.col("unit") != "clause", F.col("ref")).alias("ref"),
    )
    return docs.unionByName(parts)


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """Chunk nodes carry their own confidence and reference.

    ``chunks``: ``doc_id, chunk_id, confidence, degraded, ref``.
    """
    return chunks.select(
        node_id(F.col("doc_id"), "Chunk", F.col("chunk_id")).alias("node_id"), F.lit("Chunk").alias("node_type"),
        F.col("chunk_id").alias("label"), "doc_id", "confidence", "degraded", "ref",
    )


def _edges(df: DataFrame, edge_type: str, confidence: float, method: str) -> DataFrame:
    return df.select(
        edge_id(F.col("src"), F.lit(edge_type), F.col("dst")).alias("edge_id"), F.lit(edge_type).alias("edge_type"),
        "src", "dst", F.lit(confidence).alias("confidence"), F.lit(method).alias("method"), "doc_id",
    )


def containment_edges(units: DataFrame) -> DataFrame:
    """CONTAINS edges; the parent falls back from article to clause to document.

    Parents are named by their position, so their node ids are computed instead
    of looked up and no join is needed.
    """
    root = node_id(F.col("doc_id"), "Document", F.lit("root"))
    kind = F.initcap("unit")
    source = F.concat(F.lit("__"), F.substring("unit", 1, 3), F.lpad(F.col("idx").cast("string"), 4, "0"))
    parent = (
        F.when(F.col("parent_section").isNotNull(), _unit_node("section", "parent_section"))
        .when(F.col("parent_article").isNotNull(), _unit_node("article", "parent_article"))
        .when(F.col("parent_clause").isNotNull(), _unit_node("clause", "parent_clause"))
        .otherwise(root)
    )
    rows = units.select("doc_id", parent.alias("src"), digest_id("node", F.col("doc_id"), kind, source).alias("dst"))
    return _edges(rows, "CONTAINS", 0.9, "structural")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    rows = chunks.select(
        "doc_id", node_id(F.col("doc_id"), "Document", F.lit("root")).alias("src"),
        node_id(F.col("doc_id"), "Chunk", F.col("chunk_id")).alias("dst"),
    )
    return _edges(rows, "DERIVED_TO_CHUNK", 0.95, "structural")


def attachment_nodes(rows: DataFrame, node_type: str) -> DataFrame:
    """Nodes of tables or images: ``doc_id, source, title, confidence, degraded``.

    The label is the title, or the source where a title is null or blank.
    """
    title = F.trim("title")
    return rows.select(
        node_id(F.col("doc_id"), node_type, F.col("source")).alias("node_id"), F.lit(node_type).alias("node_type"),
        F.substring(F.when(title != "", title).otherwise(F.col("source")), 1, LABEL).alias("label"), "doc_id",
        F.col("confidence").cast("double").alias("confidence"), F.coalesce("degraded", F.lit(False)).alias("degraded"),
        F.lit(None).cast("string").alias("ref"),
    )


def attachment_edges(rows: DataFrame, edge_type: str, node_type: str) -> DataFrame:
    """HAS_TABLE / HAS_IMAGE edges from the document to its attachments: ``doc_id, source``."""
    pairs = rows.select(
        "doc_id", node_id(F.col("doc_id"), "Document", F.lit("root")).alias("src"),
        node_id(F.col("doc_id"), node_type, F.col("source")).alias("dst"),
    )
    return _edges(pairs, edge_type, 0.9, "structural")


def line_grids(lines: DataFrame, mark: str = ",", shortest: int = 2) -> DataFrame:
    """Tables in plain text: runs of at least ``shortest`` neighbouring lines that contain ``mark``.

    ``lines``: ``doc_id, pos, raw_text``, one row a position.  Gives ``doc_id, source,
    title, first_pos, n_rows, n_columns``: the title is the run's first line, the
    columns are those of its widest line.  A run's lines keep the same distance
    between their position and their number among all marked lines of the document.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.filter(F.contains("raw_text", F.lit(mark))).select(
        "doc_id", "pos", "raw_text", (F.col("pos") - F.row_number().over(order)).alias("_run"),
        (F.length("raw_text") - F.length(F.replace("raw_text", F.lit(mark), F.lit("")))).alias("_marks"),
    )
    runs = marked.groupBy("doc_id", "_run").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_rows"),
        (F.max("_marks") / len(mark) + 1).cast("int").alias("n_columns"), F.min_by("raw_text", "pos").alias("title"),
    ).filter(F.col("n_rows") >= shortest)
    source = F.concat(F.lit("table_"), F.col("first_pos").cast("string"))
    return runs.select("doc_id", source.alias("source"), "title", "first_pos", "n_rows", "n_columns")


def article_refs(units: DataFrame) -> DataFrame:
    """(doc, ref) to article node; the last article wins on a repeated ref."""
    return (
        units.filter(F.col("unit") == "article")
        .groupBy("doc_id", "ref")
        .agg(F.max("idx").alias("idx"))
        .select("doc_id", "ref", _unit_node("article", "idx").alias("dst"))
    )


def reference_edges(chunks: DataFrame, units: DataFrame) -> DataFrame:
    """REFERS_TO from a chunk to the article it stands for."""
    rows = chunks.filter(F.col("ref").isNotNull()).join(article_refs(units), ["doc_id", "ref"]).select(
        "doc_id", node_id(F.col("doc_id"), "Chunk", F.col("chunk_id")).alias("src"), "dst"
    )
    return _edges(rows, "REFERS_TO", 0.90, "canonical_ref_link")


def citation_edges(citations: DataFrame, units: DataFrame, existing: DataFrame) -> DataFrame:
    """CITES edges to articles of the same document.

    ``citations``: ``doc_id, article_no, cited``.  Self citations and pairs that
    an edge of any type already joins are left out.
    """
    wanted = citations.select(
        "doc_id", _unit_node("article", "article_no").alias("src"),
        F.concat(F.lit("article_"), F.col("cited").cast("bigint")).alias("ref"),
    )
    resolved = (
        wanted.join(article_refs(units), ["doc_id", "ref"])
        .filter(F.col("src") != F.col("dst"))
        .select("doc_id", "src", "dst")
        .distinct()
        .join(existing.select("src", "dst"), ["src", "dst"], "left_anti")
    )
    return _edges(resolved, "CITES", 0.85, "citation_ref_match")


def citation_nodes(citations: DataFrame, per_article: int = 2) -> tuple[DataFrame, DataFrame]:
    """Citation nodes (one per wording and document) and their edges."""
    from folioweave.operators.ranking import top_per_key

    first = top_per_key(
        citations, ["doc_id", "article_no"], [F.asc("first_pos"), F.asc("cited")], per_article
    ).withColumn("wording", F.concat(F.lit("Điều "), "cited"))
    source = F.concat(F.lit("cit_"), F.substring("wording", 1, 50))
    target = node_id(F.col("doc_id"), "Citation", source)
    nodes = first.select(
        target.alias("node_id"), F.lit("Citation").alias("node_type"), F.substring("wording", 1, 80).alias("label"),
        "doc_id", F.lit(0.9).alias("confidence"), F.lit(False).alias("degraded"), F.lit(None).cast("string").alias("ref"),
    ).distinct()
    edges = _edges(
        first.select("doc_id", _unit_node("article", "article_no").alias("src"), target.alias("dst")),
        "REFERS_TO", 0.85, "citation_node",
    )
    return nodes, edges


def concept_edges(articles: DataFrame, concepts=tuple(rules.CONCEPTS)) -> DataFrame:
    """Concept flags of the article text as (type, edge, confidence) rows.

    ``articles``: ``doc_id, article_no, label, text``; all patterns are tested in
    one pass over the text.
    """
    low = F.lower("text")
    flags = F.array_compact(
        F.array(
            *[
                F.when(
                    low.rlike(pattern),
                    F.struct(F.lit(kind).alias("kind"), F.lit(edge).alias("edge"), F.lit(conf).alias("conf")),
                )
                for kind, edge, pattern, conf in concepts
            ]
        )
    )
    rows = articles.select("doc_id", "article_no", "label", F.explode(flags).alias("f"))
    src = _unit_node("article", "article_no")
    dst = node_id(F.col("doc_id"), F.col("f.kind"), F.concat(F.col("f.kind"), F.lit("_"), F.col("article_no")))
    return rows.select(
        edge_id(src, F.col("f.edge"), dst).alias("edge_id"), F.col("f.edge").alias("edge_type"), src.alias("src"),
        dst.alias("dst"), F.col("f.conf").alias("confidence"), F.lit("regex_semantic").alias("method"), "doc_id",
        F.col("f.kind").alias("node_type"), F.concat(F.col("f.kind"), F.lit(" "), "label").alias("label"),
    )


def entity_mentions(articles: DataFrame, pattern: str = rules.LAW_NUMBER, group: int = 1) -> DataFrame:
    """MENTIONS edges to one entity node per number and document."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    rows = articles.select("doc_id", "article_no", F.explode(found).alias("entity"))
    src = _unit_node("article", "article_no")
    dst = node_id(F.col("doc_id"), "Entity", F.concat(F.lit("ent_"), F.substring("entity", 1, 30)))
    return rows.select("doc_id", "article_no", "entity", src.alias("src"), dst.alias("dst"))


def clause_concepts(clauses: DataFrame, max_terms: int = 5) -> DataFrame:
    """Defined terms (at most five) and exceptions stated by a clause's kind.

    ``clauses``: ``doc_id, clause_no, clause_kind, label, defined_terms array``.
    """
    own = F.when(F.size("defined_terms") > 0, F.slice("defined_terms", 1, max_terms)).otherwise(F.array("label"))
    terms = F.when(
        F.col("clause_kind") == "definition",
        F.transform(own, lambda t: F.struct(F.lit("DefinedTerm").alias("kind"), F.lit("DEFINES").alias("edge"), t.alias("label"), F.lit(0.85).alias("conf"))),
    ).when(
        F.col("clause_kind") == "exception",
        F.array(F.struct(F.lit("Exception").alias("kind"), F.lit("EXCEPTED_BY").alias("edge"), F.col("label").alias("label"), F.lit(0.80).alias("conf"))),
    )
    rows = clauses.select("doc_id", "clause_no", F.explode(terms).alias("t"))
    return rows.filter((F.length("t.label") > 0) & (F.length("t.label") <= LABEL)).select(
        "doc_id", "clause_no", F.col("t.kind").alias("node_type"), F.col("t.edge").alias("edge_type"),
        F.col("t.label").alias("label"), F.col("t.conf").alias("confidence"),
    )


def alias_stars(members: DataFrame, scope: list[str]) -> DataFrame:
    """Alias relation of nodes sharing a reference and type, in linear size.

    ``members``: ``node_id, node_type, ref, doc_id``.  Every group is a star
    around its smallest node, which stands for all its symmetric pairs: two
    nodes are aliases when they share the centre.  ``alias_pairs`` is the number
    of ordered pairs the group stands for.  A reference that a third of all
    nodes carry costs one row per node.
    """
    usable = members.filter(F.col("ref").isNotNull() & (F.col("node_type") != "Chunk"))
    groups = usable.groupBy(*scope, "ref", "node_type").agg(
        F.min("node_id").alias("centre"), F.countDistinct("node_id").alias("n")
    ).filter(F.col("n") > 1)
    return (
        usable.join(groups, [*scope, "ref", "node_type"])
        .filter(F.col("node_id") != F.col("centre"))
        .select(
            *scope, "ref", "node_type", F.col("node_id").alias("src"), F.col("centre").alias("dst"),
            (F.col("n") * (F.col("n") - 1)).alias("alias_pairs"),
        )
        .distinct()
    )


def cross_document_stars(members: DataFrame) -> DataFrame:
    """Alias stars over all documents, only for references of several documents."""
    usable = members.filter(F.col("ref").isNotNull() & (F.col("node_type") != "Chunk"))
    per_doc = usable.groupBy("ref", "node_type", "doc_id").agg(
        F.count(F.lit(1)).alias("k"), F.min("node_id").alias("head")
    )
    spread = per_doc.groupBy("ref", "node_type").agg(
        F.min("head").alias("centre"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"),
        F.count(F.lit(1)).alias("docs"),
    ).filter(F.col("docs") > 1)
    return (
        usable.join(spread, ["ref", "node_type"])
        .filter(F.col("node_id") != F.col("centre"))
        .select(
            "ref", "node_type", "doc_id", F.col("node_id").alias("src"), F.col("centre").alias("dst"),
            # ordered pairs across different documents
            (F.col("n") * F.col("n") - F.col("same")).alias("alias_pairs"),
        )
    )


def amendments(docs: DataFrame, laws: DataFrame, number: str = rules.AMENDED_NUMBER,
               phrases=tuple(rules.AMENDMENTS), window: int = rules.AMENDMENT_WINDOW) -> DataFrame:
    """OVERRIDES / INVALIDATES / AMENDS edges between documents.

    ``docs``: ``doc_id, text``; ``laws``: ``law_key, target`` (one per number, upper
    case, its first part without leading zeros).  The number and the text before it,
    cut to the window, are classified by the strongest phrase in them; splitting at
    the numbers keeps everything in the row.
    """
    # pieces that end with a number; a fold carries the last characters read
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).*?{number}"), F.lit(0))
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<law_key:string,seen:string>>").alias("out"))

    def step(acc, piece):
        key = F.regexp_extract(piece, rf"{number}$", 1)
        named = F.regexp_extract(piece, rf"({number})$", 1)
        upto = F.concat(acc["tail"], piece)
        hit = F.struct(key.alias("law_key"), F.right(upto, F.length(named) + window).alias("seen"))
        return F.struct(F.right(upto, F.lit(window)).alias("tail"), F.concat(acc["out"], F.array(hit)).alias("out"))

    joined = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    rows = docs.select("doc_id", F.explode(joined).alias("m")).select(
        "doc_id", F.struct(F.upper(F.regexp_replace("m.law_key", r"^0+(?=\d)", "")).alias("law_key"), F.col("m.seen").alias("seen")).alias("m")
    )
    kind = F.coalesce(*[F.when(F.col("m.seen").rlike(p), F.lit(k)) for k, p in phrases])
    found = rows.select("doc_id", F.col("m.law_key").alias("law_key"), kind.alias("edge_type")).filter(
        F.col("edge_type").isNotNull()
    ).distinct()
    return (
        found.join(laws, "law_key")
        .filter(F.col("doc_id") != F.col("target"))
        .select("doc_id", "edge_type", "target", F.lit(0.80).alias("confidence"))
        .distinct()
    )


def append_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing edges plus new (src, type, dst) triples not yet present."""
    key = ["src", "edge_type", "dst"]
    fresh = new.dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh)


def type_violations(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """How many rows carry a type outside the closed set."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "allowed", F.col(column).isin(*allowed)
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``metric, value``: histograms, density, documents with citations and aliases, type coverage and edge families.

    Coverage is the share, in percent, of the closed type set that occurs; types
    outside it have a histogram row and nothing else.
    """
    by_node = nodes.groupBy("node_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    # a document counts once for each edge type it has, so both document figures come out of one aggregation
    by_edge = edges.groupBy("edge_type").agg(
        F.count(F.lit(1)).cast("double").alias("value"),
        F.countDistinct(F.when(F.col("edge_type").isin("CITES", "ALIAS_OF"), F.col("doc_id"))).cast("double").alias("docs"),
    )
    known = lambda column, kinds: F.round(F.count_if(F.col(column).isin(kinds)) * 100 / len(kinds), 6)
    nothing = F.lit(0.0)
    total = F.coalesce(F.sum("value"), nothing)
    of_type = lambda kind, value: F.coalesce(F.max(F.when(F.col("edge_type") == kind, F.col(value))), nothing)
    family = lambda kinds: F.coalesce(F.sum(F.when(F.col("edge_type").isin(kinds), F.col("value"))), nothing)
    all_nodes = by_node.agg(total.alias("nodes"), known("node_type", rules.NODE_TYPES).alias("node_type_pct"))
    all_edges = by_edge.agg(
        total.alias("edges"), known("edge_type", list(rules.EDGE_WEIGHTS)).alias("edge_type_pct"),
        of_type("CITES", "docs").alias("docs_with_cites"), of_type("ALIAS_OF", "docs").alias("docs_with_alias"),
        *[family(kinds).alias(f"family:{name}") for name, kinds in rules.EDGE_FAMILIES.items()],
    )
    both = all_nodes.withColumn("_one", F.lit(1)).join(all_edges.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn(
        "density", F.round(F.col("edges") / F.greatest("nodes", F.lit(1.0)), 6)
    )
    tall = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in both.columns])))
    named = lambda frame, column, kind: frame.select(F.concat(F.lit(f"{kind}:"), column).alias("metric"), "value")
    return named(by_node, "node_type", "node").unionByName(named(by_edge, "edge_type", "edge")).unionByName(tall)
