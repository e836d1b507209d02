"""Knowledge-graph construction, traversal and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.operators import graph_build as gb
from folioweave.operators import hierarchy, quality, traversal
from folioweave.operators.ranking import top_per_key
from folioweave.plans.fixtures import EV, LN, documents, interactions, line_blocks, structured_blocks, table
from folioweave.plans.registry import query
from folioweave.plans.structure import HI, UN, structured, titles
from folioweave.rules import graph as rules
from folioweave.rules import quality as quality_rules
from folioweave.session import stage_table

CONCEPTS = [
    ("Obligation", "IMPOSES", r"keit|must|queja", 0.75), ("Condition", "QUALIFIED_BY", r" the | si | und ", 0.70),
    ("Exception", "EXCEPTED_BY", r"eaux|heit", 0.70), ("Penalty", "ENFORCED_BY", r"wh|ción", 0.75),
    ("DefinedTerm", "DEFINES", r"tion", 0.75),
]


def nid(doc: str, kind: str, source: str) -> str:
    return f"'node_' || substr(sha256({doc} || '::' || {kind} || '::' || {source}), 1, 16)"


def pad(index: str) -> str:
    return f"lpad(CAST({index} AS VARCHAR), 4, '0')"


ROOT = nid("doc_id", "'Document'", "'root'")
UNODE = nid("doc_id", "upper(unit[1]) || unit[2:]", "'__' || unit[1:3] || " + pad("idx"))
ARTN = lambda i: nid("doc_id", "'Article'", "'__art' || " + pad(i))
SECN = nid("doc_id", "'Section'", "'__sec' || " + pad("parent_section"))
CLSN = nid("doc_id", "'Clause'", "'__cla' || " + pad("parent_clause"))
CHN = nid("doc_id", "'Chunk'", "chunk_id")
GR = UN + f""",
gch AS (SELECT doc_id, doc_id || '__chunk' || lpad(CAST(idx AS VARCHAR), 5, '0') AS chunk_id, 0.5::DOUBLE + (idx % 5) / 10.0::DOUBLE AS confidence, idx % 9 = 4 AS degraded, ref, label FROM un WHERE unit = 'article'),
nodes AS (SELECT {ROOT} AS node_id, 'Document' AS node_type, 'file' || doc_id || '.pdf' AS label, doc_id, 0.9::DOUBLE AS confidence, false AS degraded, NULL AS ref FROM documents
 UNION ALL SELECT {UNODE}, upper(unit[1]) || unit[2:], substr(label, 1, 120), doc_id, 0.9::DOUBLE, false, CASE WHEN unit <> 'clause' THEN ref END FROM un
 UNION ALL SELECT {CHN}, 'Chunk', chunk_id, doc_id, confidence, degraded, ref FROM gch),
aref AS (SELECT doc_id, ref, {ARTN('max(idx)')} AS dst FROM un WHERE unit = 'article' GROUP BY doc_id, ref),
e0 AS (SELECT doc_id, 'CONTAINS' AS edge_type, CASE WHEN parent_section IS NOT NULL THEN {SECN} WHEN parent_article IS NOT NULL THEN {ARTN('parent_article')} WHEN parent_clause IS NOT NULL THEN {CLSN} ELSE {ROOT} END AS src, {UNODE} AS dst, 0.9::DOUBLE AS confidence FROM un
 UNION ALL SELECT doc_id, 'DERIVED_TO_CHUNK', {ROOT}, {CHN}, 0.95::DOUBLE FROM gch
 UNION ALL SELECT c.doc_id, 'REFERS_TO', {CHN.replace('doc_id', 'c.doc_id')}, a.dst, 0.90::DOUBLE FROM gch c JOIN aref a ON a.doc_id = c.doc_id AND a.ref = c.ref),
cm AS (SELECT doc_id, in_article AS article_no, pos, unnest(regexp_split_to_array(g, '[\\s,]+(?:và\\s+)?')) AS cited FROM (SELECT doc_id, in_article, pos, unnest(regexp_extract_all(raw_text, '(?i)(?:khoản\\s+[0-9]+\\s+)?điều\\s+([0-9]+(?:\\s*[,\\s]\\s*(?:và\\s+)?[0-9]+)*)', 1)) AS g FROM hi WHERE in_article IS NOT NULL AND unit <> 'article')),
ci AS (SELECT doc_id, article_no, cited, min(pos) AS first_pos FROM cm WHERE regexp_matches(cited, '^[0-9]+$') GROUP BY 1, 2, 3),
ce AS (SELECT DISTINCT c.doc_id, 'CITES' AS edge_type, {ARTN('c.article_no').replace('doc_id', 'c.doc_id')} AS src, a.dst, 0.85::DOUBLE AS confidence FROM ci c JOIN aref a ON a.doc_id = c.doc_id AND a.ref = 'article_' || CAST(c.cited AS BIGINT)),
cx AS (SELECT * FROM ce WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e0 WHERE e0.src = ce.src AND e0.dst = ce.dst)),
edges AS (SELECT 'edge_' || substr(sha256(src || '::' || edge_type || '::' || dst), 1, 16) AS edge_id, * FROM (SELECT * FROM e0 UNION ALL SELECT * FROM cx))"""


def parts(spark, sf):
    s = stage_table(structured(spark, sf))
    return s, stage_table(hierarchy.units(s))


def chunk_table(units):
    i = F.col("idx")
    return units.filter("unit = 'article'").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("__chunk"), F.lpad(i.cast("string"), 5, "0")).alias("chunk_id"),
        (F.lit(0.5) + i % 5 / 10.0).alias("confidence"), (i % 9 == 4).alias("degraded"), "ref", "label",
    )


def whole_graph(spark, sf):
    s, u = parts(spark, sf)
    chunks = chunk_table(u)
    nodes = gb.structure_nodes(u, titles(spark, sf)).unionByName(gb.chunk_nodes(chunks))
    base = gb.containment_edges(u).unionByName(gb.chunk_edges(chunks)).unionByName(gb.reference_edges(chunks, u))
    cites = gb.citation_edges(hierarchy.article_citations(s), u, base)
    return nodes, base.unionByName(cites)


@query("g01_nodes", f"WITH {GR} SELECT node_id, node_type, label, doc_id, confidence, degraded, ref FROM nodes")
def g01(spark, sf):
    _, u = parts(spark, sf)
    return gb.structure_nodes(u, titles(spark, sf)).unionByName(gb.chunk_nodes(chunk_table(u)))


@query("g02_structural_edges", f"WITH {GR} SELECT 'edge_' || substr(sha256(src || '::' || edge_type || '::' || dst), 1, 16) AS edge_id, edge_type, src, dst, confidence FROM e0 WHERE edge_type <> 'REFERS_TO'")
def g02(spark, sf):
    _, u = parts(spark, sf)
    return gb.containment_edges(u).unionByName(gb.chunk_edges(chunk_table(u))).drop("method", "doc_id")


GRIDS = LN + """,
gr0 AS (SELECT doc_id, pos, raw_text, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM ln WHERE contains(raw_text, ',')),
gr1 AS (SELECT doc_id, min(pos) AS first_pos, count(*) AS n_rows, CAST(max(length(raw_text) - length(replace(raw_text, ',', ''))) + 1 AS INTEGER) AS n_columns, arg_min(raw_text, pos) AS title FROM gr0 GROUP BY doc_id, run HAVING count(*) >= 2),
gt AS (SELECT *, 'table_' || first_pos AS src_id FROM gr1)"""


def attachments(spark, sf):
    """Tables are runs of lines with commas; every document's source stands for its one image."""
    tables = gb.line_grids(line_blocks(spark, sf)).withColumns({"confidence": F.lit(0.8), "degraded": F.col("n_columns") > 9})
    images = documents(spark, sf).select(
        "doc_id", "source", F.when(F.col("doc_id") % 2 == 0, F.lit("scan")).alias("title"), F.lit(0.7).alias("confidence"),
        F.lit(None).cast("boolean").alias("degraded"),
    )
    return tables, images


@query("g02_attachment_edges", f"WITH {GRIDS} SELECT 'HAS_TABLE' AS edge_type, {ROOT} AS src, {nid('doc_id', chr(39) + 'Table' + chr(39), 'src_id')} AS dst FROM gt UNION ALL SELECT 'HAS_IMAGE', {ROOT}, {nid('doc_id', chr(39) + 'ImageEvidence' + chr(39), 'source')} FROM documents")
def g02_attachments(spark, sf):
    tables, images = attachments(spark, sf)
    edges = gb.attachment_edges(tables, "HAS_TABLE", "Table").unionByName(gb.attachment_edges(images, "HAS_IMAGE", "ImageEvidence"))
    return edges.select("edge_type", "src", "dst")


@query("g02_attachment_nodes", f"WITH {GRIDS} SELECT {nid('doc_id', chr(39) + 'Table' + chr(39), 'src_id')} AS node_id, 'Table' AS node_type, substr(CASE WHEN trim(title, ' ') <> '' THEN trim(title, ' ') ELSE src_id END, 1, 120) AS label, doc_id, n_columns > 9 AS degraded FROM gt UNION ALL SELECT {nid('doc_id', chr(39) + 'ImageEvidence' + chr(39), 'source')}, 'ImageEvidence', CASE WHEN doc_id % 2 = 0 THEN 'scan' ELSE source END, doc_id, false FROM documents")
def g02_nodes(spark, sf):
    tables, images = attachments(spark, sf)
    columns = ["doc_id", "source", "title", "confidence", "degraded"]
    nodes = gb.attachment_nodes(tables.select(columns), "Table").unionByName(gb.attachment_nodes(images.select(columns), "ImageEvidence"))
    return nodes.select("node_id", "node_type", "label", "doc_id", "degraded")


@query("g03_reference_edges", f"WITH {GR} SELECT doc_id, src, dst FROM e0 WHERE edge_type = 'REFERS_TO'")
def g03(spark, sf):
    _, u = parts(spark, sf)
    return gb.reference_edges(chunk_table(u), u).select("doc_id", "src", "dst")


@query("g04_citation_edges", f"WITH {GR} SELECT doc_id, src, dst, confidence FROM cx")
def g04(spark, sf):
    s, u = parts(spark, sf)
    chunks = chunk_table(u)
    base = gb.containment_edges(u).unionByName(gb.chunk_edges(chunks)).unionByName(gb.reference_edges(chunks, u))
    return gb.citation_edges(hierarchy.article_citations(s), u, base).select("doc_id", "src", "dst", "confidence")


@query("j07_reference_resolution", f"WITH {GR} SELECT c.doc_id, c.article_no, c.cited, a.dst IS NOT NULL AS resolved FROM ci c LEFT JOIN aref a ON a.doc_id = c.doc_id AND a.ref = 'article_' || CAST(c.cited AS BIGINT)")
def j07(spark, sf):
    s, u = parts(spark, sf)
    c = hierarchy.article_citations(s).withColumn("ref", F.concat(F.lit("article_"), F.col("cited").cast("bigint")))
    return c.join(gb.article_refs(u), ["doc_id", "ref"], "left").select(
        "doc_id", "article_no", "cited", F.col("dst").isNotNull().alias("resolved")
    )


CITN = nid("doc_id", "'Citation'", "'cit_Điều ' || cited")


@query("g05_citation_nodes", f"WITH {GR}, f AS (SELECT * FROM ci QUALIFY row_number() OVER (PARTITION BY doc_id, article_no ORDER BY first_pos, cited) <= 2) SELECT {CITN} AS dst, 'Điều ' || cited AS label, {ARTN('article_no')} AS src FROM f")
def g05(spark, sf):
    s, _ = parts(spark, sf)
    nodes, edges = gb.citation_nodes(hierarchy.article_citations(s))
    return edges.join(nodes.select(F.col("node_id").alias("dst"), "label"), "dst").select("dst", "label", "src")


ATEXT = "atx AS (SELECT doc_id, in_article AS article_no, string_agg(raw_text, ' ' ORDER BY pos) AS text, arg_min(substr(t, 1, 120), pos) AS label FROM hi WHERE in_article IS NOT NULL GROUP BY 1, 2)"


def article_texts(spark, sf, blocks=None):
    from folioweave.operators.chunking import ordered_text

    return (structured(spark, sf) if blocks is None else blocks).filter(F.col("in_article").isNotNull()).groupBy(
        "doc_id", F.col("in_article").alias("article_no")
    ).agg(
        ordered_text(sep=" ").alias("text"),
        F.min_by(F.substring(F.trim("raw_text"), 1, 120), "pos").alias("label"),
    )


@query("g06_concept_edges", f"WITH {HI}, {ATEXT}, c(kind, edge, pat, conf) AS (VALUES " + ", ".join(f"('{k}', '{e}', '{p}', {c}::DOUBLE)" for k, e, p, c in CONCEPTS) + f") SELECT doc_id, edge AS edge_type, kind AS node_type, conf AS confidence, {ARTN('article_no')} AS src, {nid('doc_id', 'kind', 'kind || chr(95) || article_no')} AS dst FROM atx, c WHERE regexp_matches(lower(text), pat)")
def g06(spark, sf):
    return gb.concept_edges(article_texts(spark, sf), CONCEPTS).select(
        "doc_id", "edge_type", "node_type", "confidence", "src", "dst"
    )


@query("g07_entity_mentions", f"WITH {HI}, {ATEXT}, m AS (SELECT DISTINCT doc_id, article_no, unnest(regexp_extract_all(text, '(Điều [0-9]+)', 1)) AS entity FROM atx) SELECT doc_id, article_no, entity, {ARTN('article_no')} AS src, {nid('doc_id', chr(39) + 'Entity' + chr(39), chr(39) + 'ent_' + chr(39) + ' || substr(entity, 1, 30)')} AS dst FROM m")
def g07(spark, sf):
    return gb.entity_mentions(article_texts(spark, sf), r"(Điều \d+)")


@query("g08_clause_concepts", f"""WITH {UN}, c AS (SELECT doc_id, idx AS clause_no, label, CASE idx % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'exception' ELSE 'paragraph' END AS k, list_filter(string_split(label, ' '), lambda w: length(w) > 6) AS terms FROM un WHERE unit = 'clause')
SELECT doc_id, clause_no, 'DefinedTerm' AS node_type, 'DEFINES' AS edge_type, term AS label, 0.85::DOUBLE AS confidence FROM (SELECT doc_id, clause_no, unnest(CASE WHEN len(terms) > 0 THEN list_slice(terms, 1, 5) ELSE [label] END) AS term FROM c WHERE k = 'definition') WHERE length(term) BETWEEN 1 AND 120
UNION ALL SELECT doc_id, clause_no, 'Exception', 'EXCEPTED_BY', label, 0.80::DOUBLE FROM c WHERE k = 'exception' AND length(label) BETWEEN 1 AND 120""")
def g08(spark, sf):
    _, u = parts(spark, sf)
    i = F.col("idx")
    clauses = u.filter("unit = 'clause'").select(
        "doc_id", i.alias("clause_no"), "label",
        F.when(i % 3 == 0, "definition").when(i % 3 == 1, "exception").otherwise("paragraph").alias("clause_kind"),
        F.filter(F.split("label", " "), lambda w: F.length(w) > 6).alias("defined_terms"),
    )
    return gb.clause_concepts(clauses)


MEMB = UN + f""", mb AS (SELECT {UNODE} AS node_id, unit AS node_type, doc_id, regexp_replace(ref, '_[0-9]+$', '') AS ref FROM un)"""


def alias_members(spark, sf):
    """Units with their reference cut to the level above, so that groups form."""
    _, u = parts(spark, sf)
    source = F.concat(F.lit("__"), F.substring("unit", 1, 3), F.lpad(F.col("idx").cast("string"), 4, "0"))
    return u.select(
        gb.node_id(F.col("doc_id"), F.initcap("unit"), source).alias("node_id"), F.col("unit").alias("node_type"),
        "doc_id", F.regexp_replace("ref", r"_\d+$", "").alias("ref"),
    )


@query("g09_alias_within_document", f"WITH {MEMB}, g AS (SELECT doc_id, ref, node_type, min(node_id) AS centre, count(DISTINCT node_id) AS n FROM mb GROUP BY 1, 2, 3) SELECT m.doc_id, m.ref, m.node_type, m.node_id AS src, g.centre AS dst, n * (n - 1) AS alias_pairs FROM mb m JOIN g USING (doc_id, ref, node_type) WHERE n > 1 AND m.node_id <> g.centre")
def g09(spark, sf):
    return gb.alias_stars(alias_members(spark, sf), ["doc_id"])


@query("j09_alias_pair_counts", f"WITH {MEMB} SELECT a.ref, a.node_type, count(*) AS pairs FROM mb a JOIN mb b ON a.ref = b.ref AND a.node_type = b.node_type AND a.doc_id = b.doc_id AND a.node_id <> b.node_id GROUP BY 1, 2")
def j09(spark, sf):
    sizes = alias_members(spark, sf).groupBy("doc_id", "ref", "node_type").agg(F.countDistinct("node_id").alias("n"))
    return sizes.groupBy("ref", "node_type").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).filter("pairs > 0")


@query("g10_alias_across_documents", f"""WITH {UN}, mb AS (SELECT {UNODE} AS node_id, unit AS node_type, doc_id, ref FROM un),
g AS (SELECT ref, node_type, min(node_id) AS centre, count(DISTINCT doc_id) AS docs FROM mb GROUP BY 1, 2),
pc AS (SELECT a.ref, a.node_type, count(*) AS alias_pairs FROM mb a JOIN mb b ON a.ref = b.ref AND a.node_type = b.node_type AND a.doc_id <> b.doc_id GROUP BY 1, 2)
SELECT m.ref, m.node_type, m.doc_id, m.node_id AS src, g.centre AS dst, pc.alias_pairs FROM mb m JOIN g USING (ref, node_type) JOIN pc USING (ref, node_type) WHERE docs > 1 AND m.node_id <> g.centre""")
def g10(spark, sf):
    _, u = parts(spark, sf)
    source = F.concat(F.lit("__"), F.substring("unit", 1, 3), F.lpad(F.col("idx").cast("string"), 4, "0"))
    members = u.select(
        gb.node_id(F.col("doc_id"), F.initcap("unit"), source).alias("node_id"), F.col("unit").alias("node_type"),
        "doc_id", "ref",
    )
    return gb.cross_document_stars(members)


AMEND = """lw AS (SELECT (doc_id % 50 + 1) || '/2015/QH13' AS law_key, min(doc_id) AS target FROM documents GROUP BY 1),
am AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'AMENDS' WHEN 1 THEN 'INVALIDATES' WHEN 2 THEN 'OVERRIDES' END AS e1, (doc_id * 7 % 50 + 1) || '/2015/QH13' AS k1, (doc_id * 3 % 60 + 1) || '/2015/QH13' AS k2, length(text) AS len FROM documents),
ax AS (SELECT doc_id, e1 AS edge_type, k1 AS law_key FROM am WHERE e1 IS NOT NULL UNION SELECT doc_id, coalesce(e1, NULL), k2 FROM am WHERE e1 IS NOT NULL)"""


def amended_texts(spark, sf):
    """Documents with an amendment sentence naming two law numbers appended."""
    d = F.col("doc_id")
    phrase = F.element_at(F.array(*map(F.lit, [" sửa đổi", " bãi bỏ", " thay thế", " theo"])), (d % 4 + 1).cast("int"))
    return documents(spark, sf).select(
        "doc_id",
        F.concat(
            "text", phrase, F.lit(" Luật số "), d * 7 % 50 + 1, F.lit("/2015/QH13 và Luật số "), d * 3 % 60 + 1,
            F.lit("/2015/QH13."),
        ).alias("text"),
    )


def law_targets(spark, sf):
    return documents(spark, sf).groupBy(F.concat(F.col("doc_id") % 50 + 1, F.lit("/2015/QH13")).alias("law_key")).agg(
        F.min("doc_id").alias("target")
    )


@query("g11_amendment_edges", f"WITH {AMEND} SELECT DISTINCT doc_id, edge_type, target, 0.80::DOUBLE AS confidence FROM ax JOIN lw USING (law_key) WHERE doc_id <> target")
def g11(spark, sf):
    return gb.amendments(amended_texts(spark, sf), law_targets(spark, sf))


@query("j08_cross_document_keys", f"WITH {AMEND} SELECT target, count(DISTINCT doc_id) AS citing FROM ax JOIN lw USING (law_key) WHERE doc_id <> target GROUP BY 1")
def j08(spark, sf):
    return gb.amendments(amended_texts(spark, sf), law_targets(spark, sf)).groupBy("target").agg(
        F.countDistinct("doc_id").alias("citing")
    )


@query("g12_edge_append", f"WITH {GR}, nw AS (SELECT DISTINCT src, CASE WHEN doc_id % 2 = 0 THEN edge_type ELSE 'SUPPORTS' END AS edge_type, dst FROM edges) SELECT edge_type, count(*) AS n FROM (SELECT src, edge_type, dst FROM edges UNION ALL SELECT * FROM nw n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.src AND e.edge_type = n.edge_type AND e.dst = n.dst)) GROUP BY 1")
def g12(spark, sf):
    _, edges = whole_graph(spark, sf)
    edges = stage_table(edges)
    new = edges.withColumn(
        "edge_type", F.when(F.col("doc_id") % 2 == 0, F.col("edge_type")).otherwise(F.lit("SUPPORTS"))
    )
    return gb.append_edges(edges, new).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


def _set(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


STATS = f"""cf AS (SELECT * FROM ci QUALIFY row_number() OVER (PARTITION BY doc_id, article_no ORDER BY first_pos, cited) <= 2),
xnodes AS (SELECT node_type FROM nodes UNION ALL SELECT 'Citation' FROM (SELECT DISTINCT doc_id, cited FROM cf)),
xedges AS (SELECT doc_id, edge_type FROM edges UNION ALL SELECT doc_id, 'REFERS_TO' FROM cf UNION ALL SELECT DISTINCT doc_id, 'ALIAS_OF' FROM un WHERE unit = 'article' AND idx % 4 = 3),
nh AS (SELECT node_type, count(*) AS c FROM xnodes GROUP BY 1), eh AS (SELECT edge_type, count(*) AS c, count(DISTINCT doc_id) AS docs FROM xedges GROUP BY 1),
tot AS (SELECT (SELECT sum(c) FROM nh)::DOUBLE AS n, (SELECT sum(c) FROM eh)::DOUBLE AS e),
gst AS (SELECT 'node:' || node_type AS metric, CAST(c AS DOUBLE) AS value FROM nh UNION ALL SELECT 'edge:' || edge_type, CAST(c AS DOUBLE) FROM eh
 UNION ALL SELECT 'nodes', n FROM tot UNION ALL SELECT 'edges', e FROM tot UNION ALL SELECT 'density', round(e / n, 6) FROM tot
 UNION ALL SELECT 'docs_with_cites', coalesce((SELECT docs FROM eh WHERE edge_type = 'CITES'), 0)::DOUBLE UNION ALL SELECT 'docs_with_alias', coalesce((SELECT docs FROM eh WHERE edge_type = 'ALIAS_OF'), 0)::DOUBLE
 UNION ALL SELECT 'node_type_pct', round((SELECT count(*) FROM nh WHERE node_type IN {_set(rules.NODE_TYPES)}) * 100 / {len(rules.NODE_TYPES)}.0::DOUBLE, 6)
 UNION ALL SELECT 'edge_type_pct', round((SELECT count(*) FROM eh WHERE edge_type IN {_set(rules.EDGE_WEIGHTS)}) * 100 / {len(rules.EDGE_WEIGHTS)}.0::DOUBLE, 6)
 {" ".join(f"UNION ALL SELECT 'family:{f}', coalesce((SELECT sum(c) FROM eh WHERE edge_type IN {_set(k)}), 0)::DOUBLE" for f, k in rules.EDGE_FAMILIES.items())})"""


def rated_graph(spark, sf):
    """Types of the whole graph's nodes and edges with citation nodes, and one alias edge for a document with fourth articles."""
    s, u = parts(spark, sf)
    chunks = chunk_table(u)
    nodes = gb.structure_nodes(u, titles(spark, sf)).unionByName(gb.chunk_nodes(chunks))
    base = gb.containment_edges(u).unionByName(gb.chunk_edges(chunks)).unionByName(gb.reference_edges(chunks, u))
    citations = stage_table(hierarchy.article_citations(s))
    cited_nodes, cited_edges = gb.citation_nodes(citations)
    aliases = u.filter("unit = 'article' AND idx % 4 = 3").select("doc_id").distinct().select("doc_id", F.lit("ALIAS_OF").alias("edge_type"))
    edges = base.unionByName(gb.citation_edges(citations, u, base)).unionByName(cited_edges).select("doc_id", "edge_type")
    return nodes.unionByName(cited_nodes).select("node_type"), edges.unionByName(aliases), u


@query("g13_graph_stats", f"WITH {GR}, {STATS} SELECT metric, value FROM gst")
def g13(spark, sf):
    nodes, edges, _ = rated_graph(spark, sf)
    return gb.graph_stats(nodes, edges)


@query("a13_type_histogram", f"WITH {GR} SELECT node_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM nodes GROUP BY 1")
def a13(spark, sf):
    nodes, _ = whole_graph(spark, sf)
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("p08_confidence_predicates", f"WITH {GR} SELECT node_type, count(*) FILTER (confidence < 0.65) AS low, count(*) FILTER (NOT degraded AND confidence >= 0.65) AS authoritative FROM nodes GROUP BY 1")
def p08(spark, sf):
    nodes, _ = whole_graph(spark, sf)
    return nodes.groupBy("node_type").agg(
        F.count_if(F.col("confidence") < 0.65).alias("low"),
        F.count_if(~F.col("degraded") & (F.col("confidence") >= 0.65)).alias("authoritative"),
    )


@query("p09_type_validation", f"WITH {HI} SELECT kind, count(*) AS n, kind IN ('điều', 'khoản', 'chương') AS allowed FROM hi GROUP BY 1")
def p09(spark, sf):
    return gb.type_violations(structured(spark, sf), "kind", ["điều", "khoản", "chương"])


def _points(name, bands, lowest):
    return f"CASE {' '.join(f'WHEN {name} >= {low} THEN {p}' for low, p in bands)} ELSE {lowest} END"


SCORES = f"""qv AS (SELECT (SELECT count(*) FROM nh WHERE node_type IN {_set(rules.NODE_TYPES)}) AS node_types, (SELECT count(*) FROM eh WHERE edge_type IN {_set(rules.EDGE_WEIGHTS)}) AS edge_types,
 coalesce((SELECT sum(c) FROM eh WHERE edge_type IN {_set(rules.EDGE_FAMILIES['cross_document'])}), 0) AS cross_document_edges, coalesce((SELECT sum(c) FROM eh WHERE edge_type = 'CITES'), 0) AS citation_edges,
 coalesce((SELECT sum(c) FROM nh WHERE node_type IN {_set(rules.SEMANTIC_NODES)}), 0) AS semantic_nodes, (SELECT round(count(*) FILTER (parent_section IS NOT NULL) * 100 / greatest(count(*), 1)::DOUBLE, 6) FROM un WHERE unit = 'article') AS chunk_path_pct,
 (SELECT round(count(*) FILTER (starts_with(ref, 'article')) * 100 / greatest(count(*), 1)::DOUBLE, 6) FROM un WHERE unit = 'article') AS chunk_reference_pct, (SELECT round(e / n, 6) FROM tot) AS density, (SELECT count(*) FROM nh WHERE node_type IN {_set(rules.STRUCTURE_NODES)}) AS structure_types),
qd AS ({' UNION ALL '.join(f"SELECT '{n}' AS dimension, CAST({n} AS DOUBLE) AS value, {_points(n, b, low)} AS points FROM qv" for n, b, low in quality_rules.GRAPH_DIMENSIONS)}),
qt AS (SELECT CAST(sum(points) AS INTEGER) AS t FROM qd)"""


@query("q10_graph_scorecard", f"""WITH {GR}, {STATS}, {SCORES} SELECT dimension, value, points, NULL AS grade FROM qd
UNION ALL SELECT 'total', CAST(t AS DOUBLE), t, CASE {' '.join(f"WHEN t >= {low} THEN '{g}'" for low, g in quality_rules.GRADES)} ELSE '{quality_rules.LOWEST_GRADE}' END FROM qt""")
def q10(spark, sf):
    nodes, edges, u = rated_graph(spark, sf)
    chunks = u.filter("unit = 'article'").select(
        F.col("parent_section").isNotNull().alias("has_path"), F.coalesce(F.col("ref").startswith("article"), F.lit(False)).alias("has_ref")
    )
    return quality.graph_scorecard(nodes, edges, chunks)


# --- traversal ----------------------------------------------------------------

@query("v01_neighbours", f"WITH {GR} SELECT src, dst, edge_type, node_type FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE e.confidence >= 0.87 AND edge_type IN ('CONTAINS', 'REFERS_TO')")
def v01(spark, sf):
    nodes, edges = whole_graph(spark, sf)
    return traversal.neighbours(edges, nodes, ["CONTAINS", "REFERS_TO"], 0.87).select("src", "dst", "edge_type", "node_type")


def seeds_of(spark, sf):
    """Every document is one query that starts at its root node."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("query_id"),
        gb.node_id(F.col("doc_id"), "Document", F.lit("root")).alias("node_id"), F.lit(0).alias("seq"),
    )


def expansion(spark, sf):
    nodes, edges = whole_graph(spark, sf)
    nodes, edges = stage_table(nodes), stage_table(edges)
    return nodes, traversal.expand(seeds_of(spark, sf), nodes, edges)


WEIGHTS = "CASE edge_type WHEN 'CONTAINS' THEN 0.90::DOUBLE WHEN 'DERIVED_TO_CHUNK' THEN 0.80::DOUBLE WHEN 'CITES' THEN 0.85::DOUBLE WHEN 'REFERS_TO' THEN 0.75::DOUBLE END"
START = f"SELECT doc_id AS query_id, {ROOT} AS node_id, 0 AS depth, 0.9::DOUBLE AS score, 1 AS place, true AS kept, NULL::BIGINT AS pp, NULL::VARCHAR AS eid FROM documents"
LEVELS = f""",
fe AS (SELECT src, dst, edge_id, {WEIGHTS} * confidence AS gain FROM edges WHERE confidence >= 0.60),
l0 AS ({START})"""
for _d in (1, 2, 3):
    _seen = " UNION ALL ".join(f"SELECT query_id, node_id FROM l{i}" for i in range(_d))
    _used = " UNION ALL ".join(f"SELECT query_id, kept FROM l{i}" for i in range(_d))
    LEVELS += f""",
c{_d} AS (SELECT l.query_id, l.place AS pp, l.score AS ps, f.dst, min(f.edge_id) AS eid, arg_min(f.gain, f.edge_id) AS gain FROM l{_d - 1} l JOIN fe f ON f.src = l.node_id WHERE l.kept AND NOT EXISTS (SELECT 1 FROM ({_seen}) s WHERE s.query_id = l.query_id AND s.node_id = f.dst) GROUP BY 1, 2, 3, 4),
d{_d} AS (SELECT * FROM c{_d} QUALIFY row_number() OVER (PARTITION BY query_id, dst ORDER BY pp) = 1),
f{_d} AS (SELECT *, row_number() OVER (PARTITION BY query_id, pp ORDER BY eid) AS fan FROM d{_d} QUALIFY fan <= 10),
s{_d} AS (SELECT f.query_id, f.dst AS node_id, {_d} AS depth, greatest(CASE WHEN n.degraded THEN (ps * gain - {_d} * 0.1::DOUBLE) * 0.7::DOUBLE ELSE ps * gain - {_d} * 0.1::DOUBLE END, 0.0::DOUBLE) AS score, pp, eid FROM f{_d} f JOIN nodes n ON n.node_id = f.dst),
k{_d} AS (SELECT s.*, score >= 0.20 AS kept, sum(CAST(score >= 0.20 AS INTEGER)) OVER (PARTITION BY s.query_id ORDER BY pp, eid ROWS UNBOUNDED PRECEDING) + u.used AS place FROM s{_d} s JOIN (SELECT query_id, count(*) FILTER (kept) AS used FROM ({_used}) GROUP BY 1) u USING (query_id)),
l{_d} AS (SELECT query_id, node_id, depth, score, place, kept, pp, eid FROM k{_d} WHERE CASE WHEN kept THEN place <= 30 ELSE place < 30 END)"""
LEVELS += ", bfs AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"
BFS = GR + LEVELS
PATHS = ", p0 AS (SELECT *, [node_id] AS pn, []::VARCHAR[] AS pe FROM l0)"
for _d in (1, 2, 3):
    PATHS += f", p{_d} AS (SELECT l.*, list_append(p.pn, l.node_id) AS pn, list_append(p.pe, l.eid) AS pe FROM l{_d} l JOIN p{_d - 1} p ON p.query_id = l.query_id AND p.place = l.pp AND p.kept)"
PATHS += ", pth AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)"


@query("v02_bounded_expansion", f"WITH {BFS} SELECT query_id, node_id, CAST(depth AS INTEGER) AS depth, round(score, 6) AS score, kept FROM bfs")
def v02(spark, sf):
    _, found = expansion(spark, sf)
    return found.select("query_id", "node_id", "depth", F.round("score", 6).alias("score"), "kept")


@query("v02_paths", f"WITH {BFS}{PATHS} SELECT query_id, node_id, array_to_string(pn, '>') AS path_nodes, array_to_string(pe, '>') AS path_edges, kept FROM pth")
def v02_paths(spark, sf):
    _, found = expansion(spark, sf)
    return traversal.with_paths(found).select(
        "query_id", "node_id", F.array_join("path_nodes", ">").alias("path_nodes"),
        F.array_join("path_edges", ">").alias("path_edges"), "kept",
    )


@query("w11_fan_out_cap", f"WITH {BFS} SELECT query_id, CAST(depth AS INTEGER) AS depth, count(*) AS reached FROM bfs GROUP BY 1, 2")
def w11(spark, sf):
    _, found = expansion(spark, sf)
    return found.groupBy("query_id", "depth").agg(F.count(F.lit(1)).alias("reached"))


@query("v03_path_scores", f"WITH {BFS} SELECT CAST(depth AS INTEGER) AS depth, kept, count(*) AS n, round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM bfs GROUP BY 1, 2")
def v03(spark, sf):
    _, found = expansion(spark, sf)
    return found.groupBy("depth", "kept").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("lowest"), F.round(F.max("score"), 6).alias("highest")
    )


@query("v04_stop_reasons", f"WITH {BFS}, c AS (SELECT query_id, count(*) FILTER (kept) AS results, count(*) FILTER (NOT kept) AS suppressed, max(depth) FILTER (kept) AS deepest FROM bfs GROUP BY 1) SELECT query_id, results, suppressed, CASE WHEN results >= 30 THEN 'budget_exhausted' WHEN deepest >= 3 THEN 'depth_limit' ELSE 'complete' END AS stop_reason FROM c")
def v04(spark, sf):
    _, found = expansion(spark, sf)
    return traversal.stop_reasons(seeds_of(spark, sf), found)


BUNDLE = BFS + """,
sd AS (SELECT doc_id AS query_id, chunk_id FROM gch QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, chunk_id) <= 2),
mem AS (SELECT query_id, chunk_id, max(w) AS w FROM (SELECT query_id, chunk_id, 2.0::DOUBLE AS w FROM sd UNION ALL SELECT b.query_id, n.label, 1.0::DOUBLE FROM bfs b JOIN nodes n USING (node_id) WHERE b.kept AND n.node_type = 'Chunk') GROUP BY 1, 2),
bnd AS (SELECT query_id, count(*) AS n_chunks, count(*) FILTER (w = 2) AS n_seeds, count(*) FILTER (degraded) AS n_degraded, count(*) FILTER (NOT degraded AND confidence >= 0.65) AS n_authoritative, round(sum(confidence * w) / sum(w), 6) AS confidence FROM mem JOIN gch USING (chunk_id) GROUP BY 1),
bs AS (SELECT *, CASE WHEN n_seeds = 0 THEN 'unsupported' WHEN n_authoritative = 0 THEN 'partially_supported' WHEN n_degraded > n_chunks // 2 THEN 'partially_supported' ELSE 'supported' END AS status FROM bnd)"""


def bundle_parts(spark, sf):
    s, u = parts(spark, sf)
    chunks = stage_table(chunk_table(u))
    nodes, found = expansion(spark, sf)
    seeds = top_per_key(chunks, ["doc_id"], [F.desc("confidence"), F.asc("chunk_id")], 2).select(
        F.col("doc_id").alias("query_id"), "chunk_id"
    )
    reached = (
        found.filter("kept").join(nodes.filter("node_type = 'Chunk'").select("node_id", F.col("label").alias("chunk_id")), "node_id")
        .select("query_id", "chunk_id")
    )
    return s, chunks, seeds, reached


def bundles(spark, sf):
    _, chunks, seeds, reached = bundle_parts(spark, sf)
    return traversal.evidence_bundles(seeds, reached, chunks.select("chunk_id", "confidence", "degraded"))


@query("v05_evidence_bundles", f"WITH {BUNDLE} SELECT query_id, n_chunks, n_seeds, n_degraded, n_authoritative, confidence, status FROM bs")
def v05(spark, sf):
    return bundles(spark, sf)


# citations of a chunk: its own reference, then the articles its text cites
CONTENTS = """,
cc AS (SELECT g.chunk_id, g.confidence, g.degraded, list_concat(CASE WHEN g.ref IS NULL THEN [] ELSE [g.ref] END, coalesce(x.cits, [])) AS citations FROM gch g LEFT JOIN (SELECT doc_id || '__chunk' || lpad(CAST(article_no AS VARCHAR), 5, '0') AS chunk_id, list('Điều ' || cited ORDER BY first_pos, cited) AS cits FROM ci GROUP BY 1) x USING (chunk_id)),
mm AS (SELECT query_id, chunk_id, min({'part': part, 'below': below, 'no': no}) AS spot FROM (SELECT query_id, chunk_id, 0 AS part, 0.0::DOUBLE AS below, seq::BIGINT AS no FROM seedc UNION ALL SELECT p.query_id, n.label, 1, -p.score, p.place::BIGINT FROM pth p JOIN nodes n USING (node_id) WHERE p.kept AND n.node_type = 'Chunk') GROUP BY 1, 2),
he AS (SELECT query_id, list(chunk_id ORDER BY spot) AS ids, flatten(list(citations ORDER BY spot)) AS cits, count(*) FILTER (NOT degraded AND confidence >= 0.65) AS good, count(*) FILTER (spot.part = 0) AS seeds FROM mm JOIN cc USING (chunk_id) GROUP BY 1),
hcits AS (SELECT query_id, string_agg(c, '|' ORDER BY i) AS citations FROM (SELECT query_id, c, min(i) AS i FROM (SELECT query_id, unnest(cits) AS c, unnest(range(len(cits))) AS i FROM he) GROUP BY 1, 2) WHERE c <> '' GROUP BY 1),
wa AS (SELECT query_id, count(*) AS n_paths, string_agg(array_to_string(pn, '>'), '|' ORDER BY -score, place) AS ways FROM pth WHERE kept AND depth > 0 GROUP BY 1)
SELECT r.query_id, coalesce(array_to_string(ids, '|'), '') AS evidence, coalesce(citations, '') AS citations, CAST(coalesce(n_paths, 0) AS INTEGER) AS n_paths, md5(coalesce(ways, '')) AS paths, array_to_string(list_concat(CASE WHEN good = 0 THEN ['below_authority'] ELSE [] END, CASE WHEN coalesce(seeds, 0) = 0 THEN ['no_seeds'] ELSE [] END), '|') AS warnings FROM rqs r LEFT JOIN he USING (query_id) LEFT JOIN hcits USING (query_id) LEFT JOIN wa USING (query_id)"""


def cited_chunks(structured, chunks):
    """Chunks with their citations."""
    cited = hierarchy.article_citations(structured).groupBy("doc_id", "article_no").agg(
        F.array_sort(F.collect_list(F.struct("first_pos", "cited"))).alias("c")
    ).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("__chunk"), F.lpad(F.col("article_no").cast("string"), 5, "0")).alias("chunk_id"),
        F.transform("c", lambda s: F.concat(F.lit("Điều "), s["cited"])).alias("c"),
    )
    own = F.when(F.col("ref").isNull(), F.array().cast("array<string>")).otherwise(F.array("ref"))
    return chunks.join(cited, "chunk_id", "left").select(
        "chunk_id", "confidence", "degraded",
        F.concat(own, F.coalesce("c", F.array().cast("array<string>"))).alias("citations"),
    )


def shown_contents(bundles):
    """Lists as strings, paths as a digest."""
    return bundles.select(
        "query_id", F.array_join("evidence", "|").alias("evidence"), F.array_join("citations", "|").alias("citations"),
        F.size("paths").alias("n_paths"),
        F.md5(F.array_join(F.transform("paths", lambda p: F.array_join(p, ">")), "|")).alias("paths"),
        F.array_join("warnings", "|").alias("warnings"),
    )


def reached_chunks(nodes, found):
    """Kept nodes with their paths; ``chunk_id`` where the node is a chunk."""
    labels = nodes.select("node_id", F.when(F.col("node_type") == "Chunk", F.col("label")).alias("chunk_id"))
    return traversal.with_paths(found).filter("kept").join(labels, "node_id")


SEEDC = ", seedc AS (SELECT doc_id AS query_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, chunk_id) AS seq FROM gch QUALIFY seq <= 2), rqs AS (SELECT doc_id AS query_id FROM documents)"


@query("v05_bundle_contents", f"WITH {BFS}{PATHS}{SEEDC}{CONTENTS}")
def v05_contents(spark, sf):
    s, u = parts(spark, sf)
    chunks = stage_table(chunk_table(u))
    nodes, found = expansion(spark, sf)
    seeds = top_per_key(chunks, ["doc_id"], [F.desc("confidence"), F.asc("chunk_id")], 2).select(
        F.col("doc_id").alias("query_id"), "chunk_id", F.col("rank").alias("seq")
    )
    out = traversal.bundle_contents(seeds_of(spark, sf), seeds, reached_chunks(nodes, found), cited_chunks(s, chunks))
    return shown_contents(out)


@query("a10_seed_weighted_mean", f"WITH {GR}, s AS (SELECT doc_id, confidence, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, chunk_id) <= 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM gch) SELECT doc_id, round(sum(confidence * w) / sum(w), 6) AS confidence FROM s GROUP BY 1")
def a10(spark, sf):
    _, u = parts(spark, sf)
    chunks = stage_table(chunk_table(u))
    seeds = top_per_key(chunks, ["doc_id"], [F.desc("confidence"), F.asc("chunk_id")], 2)
    out = traversal.evidence_bundles(
        seeds.select(F.col("doc_id").alias("query_id"), "chunk_id"),
        chunks.select(F.col("doc_id").alias("query_id"), "chunk_id"), chunks.select("chunk_id", "confidence", "degraded"),
    )
    return out.select(F.col("query_id").alias("doc_id"), "confidence")


@query("v06_excerpts", r"""WITH c AS (SELECT conv_id AS query_id, turn AS chunk_id, text AS content, 0.5::DOUBLE + (turn % 5) / 10.0::DOUBLE AS confidence, role = 'system' AS degraded FROM conversations),
g AS (SELECT *, NOT degraded AND confidence >= 0.65 AS good, bool_or(NOT degraded AND confidence >= 0.65) OVER (PARTITION BY query_id) AS anyg FROM c),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS rank FROM g WHERE good OR NOT anyg QUALIFY rank <= 5),
h AS (SELECT *, regexp_extract(substr(content, 1, 800), '(?s)^(.*[.!?;])(?:\s|$)', 1) AS whole FROM k)
SELECT query_id, chunk_id, rank, CASE WHEN length(content) <= 800 THEN content WHEN length(whole) > 400 THEN whole ELSE rtrim(substr(content, 1, 800)) || '…' END AS excerpt, CASE WHEN anyg THEN 'authoritative' ELSE 'low_confidence' END AS basis FROM h""")
def v06(spark, sf):
    t = F.col("turn")
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), t.alias("chunk_id"), F.col("text").alias("content"),
        (F.lit(0.5) + t % 5 / 10.0).alias("confidence"), (F.col("role") == "system").alias("degraded"), t.alias("place"),
    )
    return traversal.excerpts(rows)


MODES = "(['summarize', 'compare', 'compliance', 'risk'])[doc_id % 4 + 1]"


@query("v07_gated_reports", f"""WITH {BUNDLE}, rq AS (SELECT doc_id AS request_id, {MODES} AS mode, doc_id AS query_id FROM documents UNION ALL SELECT doc_id, {MODES}, (doc_id + 1) % (SELECT count(*) FROM documents) FROM documents WHERE doc_id % 4 IN (1, 2)),
c AS (SELECT request_id, mode, count(*) AS sides, count(*) FILTER (status = 'supported') AS ful, count(*) FILTER (status = 'partially_supported') AS par FROM rq LEFT JOIN bs USING (query_id) GROUP BY 1, 2),
n AS (SELECT *, CASE mode WHEN 'compare' THEN 2 WHEN 'compliance' THEN sides ELSE 1 END AS need FROM c)
SELECT request_id, mode, CASE WHEN ful + par = 0 THEN 'refused' WHEN ful + par < need THEN 'insufficient' WHEN ful >= need THEN 'complete' ELSE 'partial' END AS outcome FROM n""")
def v07(spark, sf):
    d = F.col("doc_id")
    docs = documents(spark, sf)
    n = docs.count()
    mode = F.element_at(F.array(*map(F.lit, ["summarize", "compare", "compliance", "risk"])), (d % 4 + 1).cast("int"))
    sides = F.when((d % 4).isin(1, 2), F.array(d, (d + 1) % n)).otherwise(F.array(d))
    requests = docs.select(d.alias("request_id"), mode.alias("mode"), F.explode(sides).alias("query_id"))
    return traversal.gated_reports(requests, bundles(spark, sf)).select("request_id", "mode", "outcome")
