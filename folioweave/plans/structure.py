"""Hierarchy and chunk queries over documents with derived statute headings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import chunking, hierarchy, language
from folioweave.plans.corpus import TOPIC_CASE, TOPICS
from folioweave.plans.fixtures import (
    LN,
    SB,
    documents,
    line_blocks,
    structured_blocks,
    structured_texts,
    table,
)
from folioweave.plans.registry import query
from folioweave.rules import structure as rules
from folioweave.session import stage_table

W = r"[\p{L}0-9_]"
KIND_SQL = rf"""CASE
 WHEN regexp_matches(t, '(?i)^(mẫu|mau|biểu\s+mẫu|bieu\s+mau|phụ\s+lục|phu\s+luc|phy\s+luc|phu|phy|phụ|form)\s+(?:số\s+|so\s+)?(?:([a-z0-9.\-/]+)\s+)?(.*)$') THEN 'form'
 WHEN regexp_matches(t, '(?i)^(phần)\s+({W}+)([.:\s]+(.*))?$') THEN 'phần'
 WHEN regexp_matches(t, '(?i)^(chương)\s+({W}+)([.:\s]+(.*))?$') THEN 'chương'
 WHEN regexp_matches(t, '(?i)^(mục)\s+({W}+)([.:\s]+(.*))?$') THEN 'mục'
 WHEN regexp_matches(t, '(?i)^(điều)\s+([0-9]+[a-zđ]?)([.:\s]+(.*))?$') THEN 'điều'
 WHEN regexp_matches(t, '(?i)^(khoản)\s+([0-9]+)([.:\s]+(.*))?$') THEN 'khoản'
 WHEN regexp_matches(t, '(?i)^(điểm)\s+([a-záàảãạăắằẳẵặâấầẩẫậ])([.):\s]+(.*))?$') THEN 'điểm'
 WHEN regexp_matches(t, '(?i)^(chapter|part|title|schedule|annex|exhibit)\s+({W}+)([.:\s]+(.*))?$') THEN 'en_section'
 WHEN regexp_matches(t, '(?i)^(article|section|§)\s*([0-9]+[a-z]?)([.:\s]+(.*))?$') THEN 'en_article'
 WHEN regexp_matches(t, '(?i)^(clause|paragraph|sub-clause|point)\s+([0-9]+[a-z]?|\([a-z]\))([.:\s]+(.*))?$') THEN 'en_clause'
 ELSE 'body' END"""
HI = SB + rf""",
hk AS (SELECT *, {KIND_SQL} AS kind FROM (SELECT *, trim(raw_text) AS t FROM sb) WHERE t <> ''),
hu AS (SELECT *, CASE WHEN kind IN ('form', 'phần', 'chương', 'mục', 'en_section') THEN 'section' WHEN kind IN ('điều', 'en_article') THEN 'article' WHEN kind IN ('khoản', 'điểm', 'en_clause') THEN 'clause' ELSE 'body' END AS unit FROM hk),
hw AS (SELECT *, CAST(sum(CAST(unit = 'section' AS INTEGER)) OVER w AS INTEGER) AS s, CAST(sum(CAST(unit = 'article' AS INTEGER)) OVER w AS INTEGER) AS a, CAST(sum(CAST(unit = 'clause' AS INTEGER)) OVER w AS INTEGER) AS c,
 coalesce(max(CASE WHEN unit = 'section' THEN pos END) OVER w, -1) AS sp, coalesce(max(CASE WHEN unit = 'article' THEN pos END) OVER w, -1) AS ap,
 coalesce(max(CASE WHEN kind = 'điều' THEN pos END) OVER w, -1) AS vp, coalesce(max(CASE WHEN kind = 'khoản' THEN pos END) OVER w, -1) AS kp
 FROM hu WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
hc AS (SELECT *, CASE WHEN sp >= 0 THEN s - 1 END AS cur_section, CASE WHEN ap > sp THEN a - 1 END AS cur_article FROM hw),
hl AS (SELECT x.*, CASE WHEN x.kp > x.vp THEN k.c - 1 END AS cur_clause, CASE WHEN x.kp > x.vp THEN k.cur_article END AS clause_article
 FROM hc x LEFT JOIN hc k ON k.doc_id = x.doc_id AND k.pos = x.kp),
hi AS (SELECT *, CASE WHEN unit = 'section' THEN s - 1 END AS section_no, CASE WHEN unit = 'article' THEN a - 1 END AS article_no, CASE WHEN unit = 'clause' THEN c - 1 END AS clause_no,
 CASE unit WHEN 'article' THEN a - 1 WHEN 'clause' THEN cur_article WHEN 'body' THEN CASE WHEN cur_clause IS NOT NULL THEN clause_article ELSE cur_article END END AS in_article FROM hl)"""
PARENT_SQL = """CASE WHEN section_no IS NOT NULL THEN doc_id || '__sec' || lpad(CAST(section_no AS VARCHAR), 4, '0') WHEN article_no IS NOT NULL THEN doc_id || '__art' || lpad(CAST(article_no AS VARCHAR), 4, '0')
 WHEN clause_no IS NOT NULL THEN doc_id || '__cls' || lpad(CAST(clause_no AS VARCHAR), 4, '0') WHEN cur_clause IS NOT NULL THEN doc_id || '__cls' || lpad(CAST(cur_clause AS VARCHAR), 4, '0')
 WHEN cur_article IS NOT NULL THEN doc_id || '__art' || lpad(CAST(cur_article AS VARCHAR), 4, '0') WHEN cur_section IS NOT NULL THEN doc_id || '__sec' || lpad(CAST(cur_section AS VARCHAR), 4, '0') END"""

REF_PAT = r"(điều|khoản|điểm|chương|mục|phần|article|art\.?|clause|cl\.?|section|sec\.?|sect\.?|chapter|chap\.?|part|annex|paragraph|para\.?|subsection)\s*([ivxlcdm]+|[0-9]+(?:\.[0-9]+)?)\s*(?:\(([a-z0-9]+)\)|([a-z])(?:\s|$))?"
ROMAN_CTE = """rom AS (SELECT n, lower(repeat('M', CAST(n // 1000 AS INTEGER)) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[(n // 100) % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[(n // 10) % 10 + 1]
 || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1]) AS r FROM range(1, 4999) x(n))"""
TERM_CASE = "CASE regexp_replace({t}, '\\.$', '') WHEN 'điều' THEN 'article' WHEN 'article' THEN 'article' WHEN 'art' THEN 'article' WHEN 'khoản' THEN 'clause' WHEN 'clause' THEN 'clause' WHEN 'cl' THEN 'clause' WHEN 'điểm' THEN 'point' WHEN 'chương' THEN 'chapter' WHEN 'chapter' THEN 'chapter' WHEN 'chap' THEN 'chapter' WHEN 'mục' THEN 'section' WHEN 'section' THEN 'section' WHEN 'sec' THEN 'section' WHEN 'sect' THEN 'section' WHEN 'phần' THEN 'part' WHEN 'part' THEN 'part' WHEN 'para' THEN 'paragraph' ELSE {t} END"


def canon_sql(t: str, n: str, b: str, s: str, r: str) -> str:
    """Canonical id from the matched groups; ``r`` is the joined Roman value."""
    return (
        f"{TERM_CASE.format(t=t)} || '_' || CASE WHEN regexp_matches({n}, '^[0-9]+$') THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) "
        f"ELSE coalesce(CAST({r} AS VARCHAR), {n}) END || CASE WHEN {b} <> '' THEN '_' || {b} WHEN {s} <> '' THEN '_' || {s} ELSE '' END"
    )


UN = HI + f""", {ROMAN_CTE},
uo AS (SELECT doc_id, unit, kind, pos, coalesce(section_no, article_no, clause_no) AS idx, substr(t, 1, 120) AS label,
 CASE WHEN unit = 'article' THEN cur_section END AS parent_section, CASE WHEN unit = 'clause' THEN cur_article END AS parent_article, CASE WHEN kind = 'điểm' THEN cur_clause END AS parent_clause FROM hi WHERE unit <> 'body'),
up0 AS (SELECT *, regexp_extract(lower(label), '{REF_PAT}', 1) AS g1, regexp_extract(lower(label), '{REF_PAT}', 2) AS g2, regexp_extract(lower(label), '{REF_PAT}', 3) AS g3, regexp_extract(lower(label), '{REF_PAT}', 4) AS g4 FROM uo),
up AS (SELECT up0.*, CASE WHEN g1 <> '' THEN {canon_sql('g1', 'g2', 'g3', 'g4', 'rom.n')} END AS parsed FROM up0 LEFT JOIN rom ON rom.r = g2),
ub AS (SELECT *, coalesce(parsed, unit || '_' || CAST(sum(CAST(parsed IS NULL AS INTEGER)) OVER (PARTITION BY doc_id, unit ORDER BY pos ROWS UNBOUNDED PRECEDING) AS VARCHAR)) AS base FROM up),
ut0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY CASE unit WHEN 'section' THEN 0 ELSE 1 END, pos) AS n FROM ub WHERE unit <> 'clause'),
ut AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS ref FROM ut0),
uc0 AS (SELECT ub.*, CASE WHEN p.ref IS NOT NULL AND NOT starts_with(ub.base, p.ref) THEN p.ref || '_' || ub.base ELSE ub.base END AS fullref FROM ub LEFT JOIN ut p ON p.doc_id = ub.doc_id AND p.unit = 'article' AND p.idx = ub.parent_article WHERE ub.unit = 'clause'),
uc1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, fullref ORDER BY pos) AS n FROM uc0),
un AS (SELECT doc_id, unit, kind, pos, idx, label, parent_section, parent_article, parent_clause, ref FROM ut
 UNION ALL SELECT doc_id, unit, kind, pos, idx, label, parent_section, parent_article, parent_clause, CASE WHEN n = 1 THEN fullref ELSE fullref || '_' || n END FROM uc1)"""


def structured(spark, sf):
    return hierarchy.with_structure(structured_blocks(spark, sf))


def titles(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.concat(F.lit("file"), "doc_id", F.lit(".pdf")).alias("title")
    )


@query("h01_block_types", rf"""WITH {SB}, b AS (SELECT doc_id, pos, trim(raw_text) AS t FROM sb),
c AS (SELECT *, regexp_matches(t, '(?i)Nghị\s*định|Luật\s+|Thông\s*tư|Quyết\s*định|NĐ-CP|TT-BTC|QH[0-9]+|/20[0-9][0-9]/') OR length(regexp_replace(t, '[^(]', '', 'g')) <> length(regexp_replace(t, '[^)]', '', 'g')) AS cited FROM b)
SELECT doc_id, pos, CASE WHEN regexp_matches(t, '(?i)^(?:chương\s+{W}+|mục\s+{W}+|điều\s+[0-9]+|phần\s+{W}+)') THEN CASE WHEN cited THEN 'paragraph' ELSE 'heading' END
 WHEN regexp_matches(t, '(?i)^(?:mẫu|mau|biểu\s+mẫu|bieu\s+mau|phụ\s+lục|phu\s+luc|phy\s+luc|phu|phy|phụ|form)\s+') THEN 'heading'
 WHEN regexp_matches(t, '(?i)^(?:khoản\s+[0-9]+|điểm\s+[a-z][.):\s])') THEN CASE WHEN cited THEN 'paragraph' ELSE 'list_item' END
 WHEN regexp_matches(t, '(?i)^(?:article|section|chapter|part|schedule|annex|exhibit)\s+{W}+|^§\s*[0-9]+') THEN 'heading'
 WHEN regexp_matches(t, '^[0-9]+[.)]\s+\S') OR regexp_matches(t, '(?i)^[(\[]?[a-záàảãạăắằẳẵặâấầẩẫậ][)\].]\s+\S') THEN 'list_item'
 WHEN length(t) < 150 AND ends_with(t, ':') THEN 'heading' WHEN regexp_matches(t, '^\(?[0-9]+\)\s+[A-ZĐÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬ]') THEN 'list_item' ELSE 'paragraph' END AS block_type FROM c""")
def h01(spark, sf):
    return structured_blocks(spark, sf).select(
        "doc_id", "pos", hierarchy.block_type(F.col("raw_text")).alias("block_type")
    )


@query("h02_hierarchy", f"WITH {HI} SELECT doc_id, pos, kind, unit, cur_section, cur_article, cur_clause, in_article, {PARENT_SQL} AS parent_key FROM hi")
def h02(spark, sf):
    s = structured(spark, sf)
    return s.select(
        "doc_id", "pos", "kind", "unit", "cur_section", "cur_article", "cur_clause", "in_article",
        hierarchy.parent_key(s).alias("parent_key"),
    )


@query("w02_carry_forward_heading", f"WITH {HI} SELECT doc_id, pos, last_value(CASE WHEN unit IN ('section', 'article') THEN substr(t, 1, 100) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM hi")
def w02(spark, sf):
    run = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("unit").isin("section", "article"), F.substring(F.trim("raw_text"), 1, 100))
    return structured(spark, sf).select("doc_id", "pos", F.last(label, ignorenulls=True).over(run).alias("heading"))


@query("h03_canonical_refs", f"WITH {UN} SELECT doc_id, unit, idx, label, ref FROM un")
def h03(spark, sf):
    return hierarchy.units(structured(spark, sf)).select("doc_id", "unit", "idx", "label", "ref")


@query("w08_unique_suffixes", f"WITH {LN}, b AS (SELECT doc_id, pos, 'len_' || (length(raw_text) // 100) AS base FROM ln), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) AS n FROM b) SELECT doc_id, pos, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS ref FROM n")
def w08(spark, sf):
    base = line_blocks(spark, sf).select(
        "doc_id", "pos", F.concat(F.lit("len_"), F.floor(F.length("raw_text") / 100)).alias("base")
    )
    return hierarchy.unique_per_document(base, "base", ["pos"]).select("doc_id", "pos", "ref")


@query("h04_reference_extraction", rf"""WITH {SB}, {ROMAN_CTE}, m0 AS (SELECT doc_id, pos, lower(raw_text) AS low FROM sb),
m AS (SELECT doc_id, pos, unnest(regexp_extract_all(low, '{REF_PAT}', 1)) AS g1, unnest(regexp_extract_all(low, '{REF_PAT}', 2)) AS g2, unnest(regexp_extract_all(low, '{REF_PAT}', 3)) AS g3,
 unnest(regexp_extract_all(low, '{REF_PAT}', 4)) AS g4, unnest(range(len(regexp_extract_all(low, '{REF_PAT}', 1)))) AS i FROM m0),
c AS (SELECT doc_id, pos, i, {canon_sql('g1', 'g2', 'g3', 'g4', 'rom.n')} AS ref FROM m LEFT JOIN rom ON rom.r = g2),
d AS (SELECT doc_id, pos, ref, min(i) AS i FROM c GROUP BY 1, 2, 3)
SELECT doc_id, pos, string_agg(ref, ',' ORDER BY i) AS refs FROM d GROUP BY 1, 2""")
def h04(spark, sf):
    return structured_blocks(spark, sf).select(
        "doc_id", "pos", F.array_join(hierarchy.references(F.col("raw_text")), ",").alias("refs")
    ).filter("refs <> ''")


@query("h05_article_citations", rf"""WITH {HI}, m AS (SELECT doc_id, in_article AS article_no, pos, unnest(regexp_extract_all(raw_text, '(?i)(?:khoản\s+[0-9]+\s+)?điều\s+([0-9]+(?:\s*[,\s]\s*(?:và\s+)?[0-9]+)*)', 1)) AS g FROM hi WHERE in_article IS NOT NULL AND unit <> 'article'),
n AS (SELECT doc_id, article_no, pos, unnest(regexp_split_to_array(g, '[\s,]+(?:và\s+)?')) AS cited FROM m)
SELECT doc_id, article_no, cited, min(pos) AS first_pos FROM n WHERE regexp_matches(cited, '^[0-9]+$') GROUP BY 1, 2, 3""")
def h05(spark, sf):
    return hierarchy.article_citations(structured(spark, sf))


PATHS = UN + """,
pa AS (SELECT a.doc_id, a.idx AS article_no, a.label, a.ref, s.label AS section_label, concat_ws(' › ', 'file' || a.doc_id, s.label, a.label) AS path
 FROM un a LEFT JOIN un s ON s.doc_id = a.doc_id AND s.unit = 'section' AND s.idx = a.parent_section WHERE a.unit = 'article')"""


@query("h06_article_paths", f"WITH {PATHS} SELECT doc_id, article_no, path FROM pa")
def h06(spark, sf):
    paths = hierarchy.article_paths(stage_table(hierarchy.units(structured(spark, sf))), titles(spark, sf))
    return paths.select("doc_id", "article_no", F.array_join("path", " › ").alias("path"))


@query("j06_structural_lookup", f"""WITH {UN} SELECT c.doc_id, c.idx AS clause_no, coalesce(a.ref, p.ref, 'document') AS parent_ref FROM un c LEFT JOIN un a ON a.doc_id = c.doc_id AND a.unit = 'article' AND a.idx = c.parent_article
 LEFT JOIN un p ON p.doc_id = c.doc_id AND p.unit = 'clause' AND p.idx = c.parent_clause WHERE c.unit = 'clause'""")
def j06(spark, sf):
    u = stage_table(hierarchy.units(structured(spark, sf)))
    clauses = u.filter("unit = 'clause'").select("doc_id", F.col("idx").alias("clause_no"), "parent_article", "parent_clause")
    arts = u.filter("unit = 'article'").select("doc_id", F.col("idx").alias("parent_article"), F.col("ref").alias("aref"))
    pars = u.filter("unit = 'clause'").select("doc_id", F.col("idx").alias("parent_clause"), F.col("ref").alias("pref"))
    return (
        clauses.join(arts, ["doc_id", "parent_article"], "left")
        .join(pars, ["doc_id", "parent_clause"], "left")
        .select("doc_id", "clause_no", F.coalesce("aref", "pref", F.lit("document")).alias("parent_ref"))
    )


CP = f"""cp AS (SELECT doc_id, {TOPIC_CASE} AS topic, length(text) // 4 >= 20000 AS is_long, len(string_split(text, chr(10))) > 1 AS has_structure,
 (doc_id % 10) / 10.0::DOUBLE AS td, (doc_id % 7) / 10.0::DOUBLE AS idn, (doc_id % 11) / 10.0::DOUBLE AS lc, (doc_id % 3) / 2.0::DOUBLE AS sq, doc_id % 5 = 0 AS has_tables,
 CASE doc_id % 9 WHEN 0 THEN 'bieu_mau' WHEN 1 THEN 'hop_dong' ELSE 'general' END AS family FROM documents)"""


@query("c01_chunk_strategy", f"""WITH {CP}, s AS (SELECT doc_id, CASE WHEN family = 'bieu_mau' THEN 'mixed_group' WHEN family = 'hop_dong' AND (has_tables OR td > 0.05) THEN 'table_aware' WHEN family = 'hop_dong' THEN 'legal_aware'
 WHEN has_structure AND td <= 0.2 AND idn <= 0.2 THEN CASE WHEN is_long THEN 'long_local_structural' ELSE 'structural' END WHEN has_structure AND is_long THEN 'legal_aware'
 WHEN td >= 0.4 AND lc <= 0.5 THEN 'table_aware' WHEN idn >= 0.3 OR sq < 0.5 THEN 'conservative_fallback' WHEN lc >= 0.7 THEN 'mixed_group' ELSE 'semantic' END AS strategy FROM cp)
SELECT doc_id, strategy, CASE strategy WHEN 'structural' THEN 'legal_aware' WHEN 'long_local_structural' THEN 'legal_aware' WHEN 'legal_aware' THEN 'semantic' WHEN 'table_aware' THEN 'mixed_group' ELSE 'conservative_fallback' END AS fallback FROM s""")
def c01(spark, sf):
    d = F.col("doc_id")
    profile = language.profile(documents(spark, sf)).select(
        "doc_id", "is_long",
        tx.first_label(F.lower("text"), TOPICS, "general").alias("topic"),
        (F.size(F.split("text", "\n")) > 1).alias("has_structure"),
        (d % 10 / 10.0).alias("table_density"), (d % 7 / 10.0).alias("image_density"),
        (d % 11 / 10.0).alias("layout_complexity"), (d % 3 / 2.0).alias("scan_quality"),
        (d % 5 == 0).alias("has_tables"),
        F.when(d % 9 == 0, "bieu_mau").when(d % 9 == 1, "hop_dong").otherwise("general").alias("family"),
        F.lit("general").alias("doc_type"),
    )
    return chunking.strategy(profile).select("doc_id", "strategy", "fallback")


@query("c02_structure_coverage", f"""WITH {HI} SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (unit = 'article') AS n_articles, round(avg(CASE WHEN unit IN ('article', 'clause') OR (unit = 'body' AND (cur_clause IS NOT NULL OR cur_article IS NOT NULL)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage,
 count(*) FILTER (unit = 'article') = 0 OR round(avg(CASE WHEN unit IN ('article', 'clause') OR (unit = 'body' AND (cur_clause IS NOT NULL OR cur_article IS NOT NULL)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) < 0.30 AS flat FROM hi GROUP BY 1""")
def c02(spark, sf):
    return chunking.article_coverage(structured(spark, sf))


@query("c03_form_chunks", f"""WITH {HI}, f AS (SELECT *, sum(CAST(kind = 'form' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS form_no FROM hi)
SELECT doc_id, CAST(form_no AS BIGINT) AS form_no, md5(string_agg(raw_text, chr(10) || chr(10) ORDER BY pos)) AS digest, count(*) AS n_blocks, CASE WHEN form_no = 0 THEN 'preamble' ELSE arg_min(substr(t, 1, 120), pos) END AS label FROM f GROUP BY 1, f.form_no""")
def c03(spark, sf):
    return chunking.form_chunks(structured(spark, sf)).select(
        "doc_id", "form_no", F.md5("content").alias("digest"), "n_blocks", "label"
    )


ACH = PATHS + """,
hold AS (SELECT doc_id, pos, raw_text, t, in_article AS article_no, clause_no FROM hi WHERE unit = 'clause' AND in_article IS NOT NULL
 UNION ALL SELECT doc_id, pos, raw_text, t, clause_article, cur_clause FROM hi WHERE (kind = 'điểm' OR unit = 'body') AND clause_article IS NOT NULL AND cur_clause IS NOT NULL),
bod AS (SELECT doc_id, in_article AS article_no, string_agg(raw_text, chr(10) || chr(10) ORDER BY pos) AS body,
 string_agg(raw_text, chr(10) || chr(10) ORDER BY pos) FILTER (NOT (unit = 'clause' OR ((kind = 'điểm' OR unit = 'body') AND clause_article IS NOT NULL AND cur_clause IS NOT NULL))) AS intro,
 count(*) FILTER (unit = 'clause') AS n_clauses, min(pos) AS first_pos FROM hi WHERE in_article IS NOT NULL GROUP BY 1, 2),
siz AS (SELECT b.*, p.path, p.label, p.ref, p.path || chr(10) || chr(10) || '## ' || p.label AS header, p.path || chr(10) || chr(10) || '## ' || p.label || chr(10) || chr(10) || body AS content FROM bod b JOIN pa p USING (doc_id, article_no)),
big AS (SELECT *, length(content) // 4 > {limit} AND n_clauses > 0 AS over FROM siz),
cg AS (SELECT doc_id, article_no, clause_no, string_agg(raw_text, chr(10) || chr(10) ORDER BY pos) AS clause_text, min(pos) AS first_pos, arg_min(substr(t, 1, 120), pos) AS clause_label FROM hold GROUP BY 1, 2, 3),
ach AS (SELECT doc_id, article_no, CAST(NULL AS INTEGER) AS clause_no, 'article' AS chunk_type, path, ref, content, first_pos FROM big WHERE NOT over
 UNION ALL SELECT doc_id, article_no, NULL, 'parent', path, ref, CASE WHEN intro IS NULL THEN header ELSE header || chr(10) || chr(10) || intro END, first_pos FROM big WHERE over
 UNION ALL SELECT c.doc_id, c.article_no, c.clause_no, 'clause', b.path || ' › ' || c.clause_label, b.ref, b.path || ' › ' || c.clause_label || chr(10) || chr(10) || '[' || b.label || ']' || chr(10) || chr(10) || c.clause_text, c.first_pos FROM cg c JOIN big b USING (doc_id, article_no) WHERE b.over)"""


def chunks_of(spark, sf, limit):
    s = stage_table(structured(spark, sf))
    paths = hierarchy.article_paths(stage_table(hierarchy.units(s)), titles(spark, sf))
    return chunking.article_chunks(s, paths, limit)


@query("c04_article_chunks", f"WITH {ACH.replace('{limit}', '1024')} SELECT doc_id, article_no, chunk_type, path, md5(content) AS digest, CAST(length(content) // 4 AS INTEGER) AS tokens, first_pos FROM ach")
def c04(spark, sf):
    return chunks_of(spark, sf, 1024).select(
        "doc_id", "article_no", "chunk_type", F.array_join("path", " › ").alias("path"),
        F.md5("content").alias("digest"), "tokens", "first_pos",
    )


@query("c05_split_articles", f"""WITH {ACH.replace('{limit}', '150')}, sib AS (SELECT doc_id, article_no, string_agg(CAST(clause_no AS VARCHAR), ',' ORDER BY first_pos, clause_no) AS siblings FROM ach WHERE chunk_type = 'clause' GROUP BY 1, 2)
SELECT a.doc_id, a.article_no, a.clause_no, a.chunk_type, md5(a.content) AS digest, CASE WHEN a.chunk_type = 'parent' THEN s.siblings END AS siblings FROM ach a LEFT JOIN sib s USING (doc_id, article_no)""")
def c05(spark, sf):
    c = chunks_of(spark, sf, 150)
    sib = chunking.siblings(c).select(
        "doc_id", "article_no", F.array_join(F.col("clause_nos").cast("array<string>"), ",").alias("sib")
    )
    return c.join(sib, ["doc_id", "article_no"], "left").select(
        "doc_id", "article_no", "clause_no", "chunk_type", F.md5("content").alias("digest"),
        F.when(F.col("chunk_type") == "parent", F.col("sib")).alias("siblings"),
    )


@query("c10_chunk_numbering", f"""WITH {ACH.replace('{limit}', '150')} SELECT doc_id, doc_id || '__chunk' || lpad(CAST(row_number() OVER w - 1 AS VARCHAR), 5, '0') AS chunk_id, chunk_type, article_no, trim(content) = '' AS degraded FROM ach
WINDOW w AS (PARTITION BY doc_id ORDER BY article_no, CASE WHEN clause_no IS NULL THEN 0 ELSE 1 END, first_pos, clause_no)""")
def c10(spark, sf):
    order = [F.asc("article_no"), F.when(F.col("clause_no").isNull(), 0).otherwise(1), F.asc("first_pos"), F.asc("clause_no")]
    out = chunking.validated(chunking.numbered(chunks_of(spark, sf, 150), order))
    return out.select("doc_id", "chunk_id", "chunk_type", "article_no", "degraded")


FLAT = LN + """,
fb AS (SELECT doc_id, pos, raw_text, length(raw_text) // 4 AS sz, CASE WHEN pos % 7 = 0 THEN substr(raw_text, 1, 100) END AS h FROM ln WHERE raw_text <> ''),
fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS carry FROM fb),
fw AS (WITH RECURSIVE z AS (SELECT doc_id, i, sz AS used, 0 AS chunk_no FROM fr WHERE i = 1
 UNION ALL SELECT r.doc_id, r.i, CASE WHEN z.used + r.sz > 500 THEN r.sz ELSE z.used + r.sz END, CASE WHEN z.used + r.sz > 500 THEN z.chunk_no + 1 ELSE z.chunk_no END FROM z JOIN fr r ON r.doc_id = z.doc_id AND r.i = z.i + 1) SELECT * FROM z),
fg AS (SELECT doc_id, chunk_no, string_agg(raw_text, chr(10) || chr(10) ORDER BY pos) AS content, CAST(sum(sz) AS INTEGER) AS tokens, count(*) AS n_blocks, min(pos) AS first_pos, max(i) AS last_i FROM fr JOIN fw USING (doc_id, i) GROUP BY 1, 2)"""


def heading_lines(spark, sf):
    return line_blocks(spark, sf).select(
        "doc_id", "pos", "raw_text", F.when(F.col("pos") % 7 == 0, F.substring("raw_text", 1, 100)).alias("heading")
    )


@query("c06_flat_chunks", f"WITH {FLAT} SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, md5(content) AS digest, tokens, CAST(n_blocks AS INTEGER) AS n_blocks, first_pos FROM fg")
def c06(spark, sf):
    return chunking.flat_chunks(heading_lines(spark, sf)).select(
        "doc_id", "chunk_no", F.md5("content").alias("digest"), "tokens", "n_blocks", "first_pos"
    )


@query("w03_flat_chunk_headings", f"""WITH {FLAT} SELECT g.doc_id, CAST(g.chunk_no AS INTEGER) AS chunk_no, coalesce(n.carry, l.carry, '') AS hierarchy FROM fg g LEFT JOIN fr n ON n.doc_id = g.doc_id AND n.i = g.last_i + 1 JOIN fr l ON l.doc_id = g.doc_id AND l.i = g.last_i""")
def w03(spark, sf):
    return chunking.flat_chunks(heading_lines(spark, sf)).select("doc_id", "chunk_no", "hierarchy")


@query("c07_table_chunks", f"""WITH {HI}, arts AS (SELECT doc_id, a - 1 AS article_no, pos FROM hi WHERE unit = 'article'), tb AS (SELECT doc_id, pos, pos AS table_no, '| ' || raw_text || ' |' AS content FROM sb WHERE pos % 6 = 3),
j AS (SELECT t.*, (SELECT max(a.article_no) FROM arts a WHERE a.doc_id = t.doc_id AND a.pos <= t.pos) AS parent_article FROM tb t)
SELECT doc_id, table_no, md5(content) AS digest, CAST(length(content) // 4 AS INTEGER) AS tokens, parent_article FROM j""")
def c07(spark, sf):
    s = structured(spark, sf)
    parents = s.filter("unit = 'article'").select("doc_id", "article_no", F.col("pos").alias("first_pos"))
    tables = structured_blocks(spark, sf).filter("pos % 6 = 3").select(
        "doc_id", "pos", F.col("pos").alias("table_no"), F.concat(F.lit("| "), "raw_text", F.lit(" |")).alias("content")
    )
    out = chunking.table_chunks(tables, parents)
    return out.select("doc_id", "table_no", F.md5("content").alias("digest"), "tokens", "parent_article")


@query("c08_attachment_chunks", "SELECT conv_id AS doc_id, turn AS image_no, CASE WHEN role = 'system' THEN '[unreadable attachment]' ELSE trim(text) END AS content, role = 'system' AS degraded FROM conversations")
def c08(spark, sf):
    images = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("image_no"),
        F.when(F.col("role") != "system", F.col("text")).alias("ocr_text"),
    )
    return chunking.attachment_chunks(images)


@query("c09_chunk_validation", "SELECT conv_id, turn, role = 'system' AS degraded, CASE WHEN role = 'system' THEN 'empty_content' END AS reason FROM conversations")
def c09(spark, sf):
    rows = table(spark, sf, "conversations").withColumn(
        "content", F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("text"))
    )
    return chunking.validated(rows).select("conv_id", "turn", "degraded", "reason")


@query("c11_contract_split", rf"""WITH {SB}, st AS (SELECT doc_id, string_agg(raw_text, chr(10) ORDER BY pos) AS text FROM sb GROUP BY 1),
p AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(\n\s*(?:Điều|Chương|Article|Section)\s+[\p{{L}}0-9_]+)', chr(1) || '\1', 'g'), chr(1)) AS a FROM st),
u AS (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS part, trim(unnest(a), E' \n\t\r') AS t FROM p)
SELECT doc_id, part, md5(t) AS digest FROM u WHERE length(t) >= 30""")
def c11(spark, sf):
    from folioweave.operators.contracts import split_articles

    return split_articles(structured_texts(spark, sf)).select("doc_id", "part", F.md5("text").alias("digest"))


@query("t18_markdown", rf"""WITH {SB}, b AS (SELECT doc_id, pos, trim(raw_text) AS t FROM sb), k AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)^(?:chương|chapter|mẫu|form|điều|article|part|section|annex|schedule|exhibit|mục|phần)\s+[\p{{L}}0-9_]+') THEN 'h' WHEN regexp_matches(t, '(?i)^(?:khoản\s+[0-9]+|điểm\s+[a-z][.):\s])') OR regexp_matches(t, '(?i)^[0-9]+[.)]\s+\S|^[(\[]?[a-záàảãạăắằẳẵặâấầẩẫậ][)\].]\s+\S') THEN 'l' WHEN length(t) < 150 AND ends_with(t, ':') THEN 'h' ELSE 'p' END AS k,
 length(regexp_replace(t, '[^(]', '', 'g')) <> length(regexp_replace(t, '[^)]', '', 'g')) AS cited FROM b WHERE t <> ''),
l AS (SELECT doc_id, pos, CASE WHEN k = 'h' AND cited AND regexp_matches(t, '^(?:Chương|Điều) ') THEN t WHEN k = 'l' AND cited AND regexp_matches(t, '^(?:Khoản|Điểm) ') THEN t WHEN k = 'h' THEN CASE WHEN regexp_matches(lower(t), '^(?:chương|phần|chapter|part|mẫu|form)\s+') THEN '# ' WHEN regexp_matches(lower(t), '^(?:mục|section)\s+') THEN '## ' WHEN regexp_matches(lower(t), '^(?:điều|article)\s+') THEN '### ' ELSE '## ' END || t WHEN k = 'l' THEN '- ' || t ELSE t END AS line FROM k)
SELECT doc_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest FROM l GROUP BY 1""")
def t18(spark, sf):
    typed = structured_blocks(spark, sf).withColumn("block_type", hierarchy.block_type(F.col("raw_text")))
    return chunking.markdown(typed).select("doc_id", F.md5("markdown").alias("digest"))
