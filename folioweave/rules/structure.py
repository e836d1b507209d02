"""Fixed values of structure detection: heading patterns, reference terms, limits."""

from __future__ import annotations

# Heading patterns in order of precedence (matched on trimmed text).
FORM = r"(?iU)^(mẫu|mau|biểu\s+mẫu|bieu\s+mau|phụ\s+lục|phu\s+luc|phy\s+luc|phu|phy|phụ|form)\s+(?:số\s+|so\s+)?(?:([a-z0-9.\-/]+)\s+)?(.*)$"
VI_PART = r"(?iU)^(phần)\s+(\w+)([.:\s]+(.*))?$"
VI_CHAPTER = r"(?iU)^(chương)\s+(\w+)([.:\s]+(.*))?$"
VI_SUBCHAPTER = r"(?iU)^(mục)\s+(\w+)([.:\s]+(.*))?$"
VI_ARTICLE = r"(?iU)^(điều)\s+(\d+[a-zđ]?)([.:\s]+(.*))?$"
VI_CLAUSE = r"(?iU)^(khoản)\s+(\d+)([.:\s]+(.*))?$"
VI_POINT = r"(?iU)^(điểm)\s+([a-záàảãạăắằẳẵặâấầẩẫậ])([.):\s]+(.*))?$"
EN_SECTION = r"(?iU)^(chapter|part|title|schedule|annex|exhibit)\s+(\w+)([.:\s]+(.*))?$"
EN_ARTICLE = r"(?iU)^(article|section|§)\s*(\d+[a-z]?)([.:\s]+(.*))?$"
EN_CLAUSE = r"(?iU)^(clause|paragraph|sub-clause|point)\s+(\d+[a-z]?|\([a-z]\))([.:\s]+(.*))?$"

HEADINGS = [
    ("form", "section", FORM),
    ("phần", "section", VI_PART),
    ("chương", "section", VI_CHAPTER),
    ("mục", "section", VI_SUBCHAPTER),
    ("điều", "article", VI_ARTICLE),
    ("khoản", "clause", VI_CLAUSE),
    ("điểm", "clause", VI_POINT),
    ("en_section", "section", EN_SECTION),
    ("en_article", "article", EN_ARTICLE),
    ("en_clause", "clause", EN_CLAUSE),
]

# A heading that names another act is a citation.
CITATION_WORDS = r"(?iU)Nghị\s*định|Luật\s+|Thông\s*tư|Quyết\s*định|NĐ-CP|TT-BTC|QH\d+|/20\d\d/"

# Block types by text, first match wins.
GUARDED_HEADING = r"(?iU)^(?:chương\s+\w+|mục\s+\w+|điều\s+\d+|phần\s+\w+)"
FORM_START = r"(?iU)^(?:mẫu|mau|biểu\s+mẫu|bieu\s+mau|phụ\s+lục|phu\s+luc|phy\s+luc|phu|phy|phụ|form)\s+"
GUARDED_ITEM = r"(?iU)^(?:khoản\s+\d+|điểm\s+[a-z][.):\s])"
EN_HEADING = r"(?iU)^(?:article|section|chapter|part|schedule|annex|exhibit)\s+\w+|^§\s*\d+"
NUMBERED_ITEM = r"^\d+[.)]\s+\S"
LETTERED_ITEM = r"(?iU)^[(\[]?[a-záàảãạăắằẳẵặâấầẩẫậ][)\].]\s+\S"
PARENTHESISED_ITEM = r"(?U)^\(?\d+\)\s+[A-ZĐÁÀẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬ]"
COLON_HEADING_LENGTH = 150

# Reference terms and what they stand for.
REFERENCE = (
    r"(?U)(điều|khoản|điểm|chương|mục|phần|article|art\.?|clause|cl\.?|section|sec\.?|sect\.?"
    r"|chapter|chap\.?|part|annex|paragraph|para\.?|subsection)\s*([ivxlcdm]+|[0-9]+(?:\.[0-9]+)?)"
    r"\s*(?:\(([a-z0-9]+)\)|([a-z])(?:\s|$))?"
)
REFERENCE_TERMS = {
    "điều": "article", "article": "article", "art": "article",
    "khoản": "clause", "clause": "clause", "cl": "clause",
    "điểm": "point",
    "chương": "chapter", "chapter": "chapter", "chap": "chapter",
    "mục": "section", "section": "section", "sec": "section", "sect": "section",
    "phần": "part", "part": "part",
    "annex": "annex", "paragraph": "paragraph", "para": "paragraph", "subsection": "subsection",
}
ROMAN_FORM = r"^(?:m{0,4})(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"
CITED_ARTICLES = r"(?iU)(?:khoản\s+\d+\s+)?điều\s+(\d+(?:\s*[,\s]\s*(?:và\s+)?\d+)*)"

# Chunk limits.
LABEL_LENGTH = 120
PATH_SEPARATOR = " › "
CHUNK_MAX_TOKENS = 1024
FLAT_TARGET_TOKENS = 500
MIN_ARTICLE_COVERAGE = 0.30
FILE_EXTENSIONS = r"(?i)\.(?:pdf|docx|txt|html)$"
