"""Fixed values of the knowledge graph: types, weights, patterns, limits."""

from __future__ import annotations

# Concept patterns, their node type, edge type and confidence.
CONCEPTS = [
    ("Obligation", "IMPOSES", r"phải|có nghĩa vụ|có trách nhiệm|bắt buộc", 0.75),
    ("Condition", "QUALIFIED_BY", r"nếu |trong trường hợp|trường hợp |khi ", 0.70),
    ("Exception", "EXCEPTED_BY", r"trừ trường hợp|ngoại trừ|không áp dụng|trừ khi", 0.70),
    ("Penalty", "ENFORCED_BY", r"xử phạt|bị phạt|phạt tiền|phạt cảnh cáo|xử lý vi phạm", 0.75),
    ("DefinedTerm", "DEFINES", r"có nghĩa là|được hiểu là|được định nghĩa là|là loại|là hành vi|là việc|là tổ chức|là cá nhân", 0.75),
]
LAW_NUMBER = r"(?iU)(?:số\s+)?(\d{1,3}/\d{4}/(?:QH|UBTVQH|HĐNN)\d+)"

# Closed type sets.
NODE_TYPES = [
    "Document", "DocumentVersion", "Section", "Article", "Clause", "Table", "TableRow", "ImageEvidence", "Chunk",
    "DefinedTerm", "Entity", "LegalConcept", "Citation", "Obligation", "Condition", "Exception", "Penalty",
]
EDGE_WEIGHTS = {
    "CONTAINS": 0.90, "PRECEDES": 0.60, "HAS_TABLE": 0.85, "HAS_IMAGE": 0.70, "DERIVED_TO_CHUNK": 0.80,
    "CITES": 0.85, "RESOLVES_TO": 0.80, "REFERS_TO": 0.75, "DEFINES": 0.70, "APPLIES_TO": 0.60,
    "IMPOSES": 0.65, "QUALIFIED_BY": 0.65, "EXCEPTED_BY": 0.65, "ENFORCED_BY": 0.60, "MENTIONS": 0.50,
    "AMENDS": 0.85, "OVERRIDES": 0.92, "INVALIDATES": 0.90, "CONFLICTS_WITH": 0.88, "REQUIRES": 0.82,
    "DEPENDS_ON": 0.78, "ALIAS_OF": 0.70, "SUPPORTS": 0.40, "CONTRADICTS": 0.40,
}
# Families of node and edge types.
SEMANTIC_NODES = ["DefinedTerm", "Entity", "LegalConcept", "Citation", "Obligation", "Condition", "Exception", "Penalty"]
STRUCTURE_NODES = ["Document", "Section", "Article", "Clause", "Chunk"]
EDGE_FAMILIES = {
    "structural": ["CONTAINS", "DERIVED_TO_CHUNK"], "citation": ["CITES"],
    "semantic": ["MENTIONS", "DEFINES", "APPLIES_TO", "IMPOSES", "QUALIFIED_BY", "EXCEPTED_BY", "ENFORCED_BY", "SUPPORTS", "CONTRADICTS"],
    "cross_document": ["AMENDS", "OVERRIDES", "INVALIDATES", "CONFLICTS_WITH", "REQUIRES", "ALIAS_OF"],
}
ALLOWED_EDGES = ["CONTAINS", "HAS_TABLE", "HAS_IMAGE", "DERIVED_TO_CHUNK", "CITES", "REFERS_TO", "RESOLVES_TO"]
BLOCKED_EDGES = ["CONTRADICTS", "SUPPORTS"]

# Traversal policy.
MAX_DEPTH = 3
MIN_EDGE_CONFIDENCE = 0.60
MAX_FAN_OUT = 10
MAX_NODES = 30
MIN_NODE_SCORE = 0.20
DEPTH_PENALTY = 0.10
DEGRADED_FACTOR = 0.7
UNKNOWN_EDGE_WEIGHT = 0.5
AUTHORITY = 0.65

# Amendment phrases around a law number, strongest first, and the number.
AMENDMENT_WINDOW = 200
AMENDMENTS = [
    ("OVERRIDES", r"(?iu)thay\s+thế|thay\s+cho|thay\s+bằng"),
    ("INVALIDATES", r"(?iu)bãi\s+bỏ|hủy\s+bỏ|bãi\s+bỏ\s+toàn\s+bộ"),
    ("AMENDS", r"(?iu)sửa\s+đổi|bổ\s+sung|sửa\s+đổi,?\s+bổ\s+sung"),
]
AMENDED_NUMBER = r"(?iu)(?:số\s+)?(\d{1,3}/\d{4}/(?:QH|UBTVQH|HĐNN)\d+)"
