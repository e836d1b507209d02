"""Fixed values of document checks, risk warnings and scorecards."""

from __future__ import annotations

# Texts that stand in for missing content, and the confidence above which they are suspicious.
PLACEHOLDERS = ["", "...", "[missing]", "N/A", "UNKNOWN"]
PLACEHOLDER_CONFIDENCE = 0.8
LOW_CONFIDENCE = 0.65
LOW_TABLE_CONFIDENCE = 0.7
STRUCTURAL_EDGES = ["CONTAINS", "DERIVED_TO_CHUNK", "HAS_TABLE", "HAS_IMAGE", "PRECEDES"]

# The checks of a document, their severity and condition on its facts.
DOCUMENT_CHECKS = [
    ("blocks_present", "fail", "blocks > 0"),
    ("coverage", "warning", "coverage >= 0.3"),
    ("block_provenance", "warning", "unplaced_blocks = 0"),
    ("no_invented_text", "warning", "placeholder_blocks = 0"),
    ("tables_intact", "warning", "broken_tables = 0"),
    ("low_confidence_rate", "warning", "low_blocks * 10 <= blocks * 3"),
    ("chunks_present", "fail", "chunks > 0"),
    ("no_empty_chunks", "warning", "empty_chunks = 0"),
    ("degraded_chunk_rate", "warning", "degraded_chunks * 2 <= chunks"),
    ("chunk_provenance", "warning", "unplaced_chunks = 0"),
    ("graph_has_nodes", "warning", "graph_nodes > 0"),
    ("structural_edges", "warning", "structural_edges > 0"),
    ("no_orphan_chunks", "warning", "chunks = 0 OR graph_nodes >= chunks"),
]

# Risk warnings of a document and the number that they state; no warning where it is 0.
RISK_WARNINGS = [
    ("low_confidence_blocks", "low_blocks"),
    ("degraded_blocks", "degraded_blocks"),
    ("no_structure_in_large_document", "CASE WHEN structure_units = 0 AND blocks > 20 THEN blocks ELSE 0 END"),
    ("low_confidence_tables", "low_tables"),
]

# Dimensions of the graph scorecard, lower bounds of the bands and their points.
TYPE_BANDS = [(12, 10), (8, 7), (5, 4), (3, 2)]
GRAPH_DIMENSIONS = [
    ("node_types", TYPE_BANDS, 0),
    ("edge_types", TYPE_BANDS, 0),
    ("cross_document_edges", [(50, 15), (20, 10), (5, 5), (1, 2)], 0),
    ("citation_edges", [(100, 10), (30, 7), (5, 4), (1, 2)], 0),
    ("semantic_nodes", [(200, 10), (50, 7), (10, 4), (1, 2)], 0),
    ("chunk_path_pct", [(80, 15), (50, 10), (20, 5), (5, 2)], 0),
    ("chunk_reference_pct", [(70, 10), (40, 7), (15, 4), (5, 2)], 0),
    ("density", [(3, 10), (2, 7), (1.5, 4), (1.1, 2)], 0),
    ("structure_types", [(5, 10), (4, 7), (3, 4)], 2),
]
GRADES = [(85, "A"), (70, "B"), (55, "C"), (40, "D")]
LOWEST_GRADE = "F"

# Hard gates of a release, by what the text of a finding contains; a gate passes without such findings.
HARD_GATES = [
    ("contradictions", ["[p0]"], []),
    ("forbidden_phrases", ["forbidden phrase"], ["[p0]"]),
    ("server_errors", ["http 5", "500"], []),
    ("demo_labels", ["is_demo"], []),
    ("score_leaks", ["threshold", "leak", "< 0.55"], []),
]
SMOKE_SHARE_TENTHS = 9
MANUAL_SCENARIOS = 15

# Smoke queries of a language; asked always, with articles, with clauses, and for words of section labels
# (second word: not on labels that also contain it).  Other languages use the English ones.
SMOKE_QUERIES = {
    "vi": ([], ["điều", "hợp đồng", "bên", "nghĩa vụ", "thanh toán"], ["khoản"], [("chương", None), ("mục", "chương"), ("phần", None)]),
    "mixed": (["điều", "article", "hợp đồng", "agreement"], [], ["khoản", "clause"], []),
    "en": ([], ["article", "agreement", "obligation", "payment"], ["clause"], [("chapter", None), ("section", "chapter"), ("part", None)]),
}
SMOKE_FALLBACK = {"en": ["article", "clause"]}
SMOKE_OTHER_FALLBACK = ["điều", "khoản"]
# The word for an article in the other language, and names of one concept in both.
CROSS_WORDS = {"vi": "Article", "en": "Điều"}
BILINGUAL_ALIASES = [
    ("article", "điều"), ("article", "article"), ("clause", "khoản"), ("clause", "clause"), ("chapter", "chương"),
    ("chapter", "chapter"), ("section", "mục"), ("section", "section"), ("part", "phần"), ("part", "part"),
]
ARTICLE_NUMBER = r"(?iu)^\s*(?:điều|article|section|§)\s*([0-9]+[a-zđ]?)"
PRIMARY_QUERIES, CROSS_QUERIES, CROSS_ARTICLES = 10, 5, 3
SMOKE_PASS_TENTHS = 6
CROSS_WARNING = 0.5
