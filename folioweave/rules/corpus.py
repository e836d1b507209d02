"""Fixed values of the corpus stage: patterns, term lists, thresholds."""

from __future__ import annotations

# Noise lines.
PAGE_NUMBER = (
    r"^[\-–—\s]*\d{1,4}[\-–—\s]*$"
    r"|^[Pp]age\s+\d+(\s+of\s+\d+)?$"
    r"|^[Tt]rang\s+\d+(\s*/\s*\d+)?$"
)
REPEAT_MAX_LENGTH = 120
REPEAT_THRESHOLD = 3
DUPLICATE_MIN_LENGTH = 40
HEADER_MAX_LENGTH = 80
LOW_CONFIDENCE = 0.65

# Profile thresholds.
STRONG_TEXT_LAYER = 0.80
WEAK_TEXT_LAYER = 0.20
LONG_DOCUMENT_PAGES = 30
LONG_DOCUMENT_TOKENS = 20_000
TOKENS_PER_PAGE = 2000

# Repairs of recognition errors, applied in this order.
OCR_REPAIRS = [
    (r"\bDi[eéè]u\b", "Điều"),
    (r"\bDieu\b", "Điều"),
    (r"\bDiu\b", "Điều"),
    (r"\bKho[adáà]n\b", "Khoản"),
    (r"\bKhodn\b", "Khoản"),
    (r"\bKhoan\b", "Khoản"),
    (r"\bCh[uưuơo]ng\b", "Chương"),
    (r"\bChuong\b", "Chương"),
    (r"\bM[uưụ]c\b", "Mục"),
    (r"\bPh[aâ]n\b", "Phần"),
    (r"\bPhan\b", "Phần"),
    (r"\bDi[eéè]m\b", "Điểm"),
    (r"\bDiem\b", "Điểm"),
    (r"\bPhu l[uưụ]c\b", "Phụ lục"),
    (r"\bPhu luc\b", "Phụ lục"),
    (r"\bM[ãa]u\b", "Mẫu"),
    (r"\bMau\b", "Mẫu"),
    (r"\bNghj dinh\b", "Nghị định"),
    (r"\bNghi dinh\b", "Nghị định"),
    (r"\bTh[oôơ]ng t[uưư]\b", "Thông tư"),
    (r"\bThong tu\b", "Thông tư"),
    (r"\bND-CP\b", "NĐ-CP"),
    (r"\bTT-BTC\b", "TT-BTC"),
    (r"\bDoc lap\b", "Độc lập"),
    (r"\bDéc lap\b", "Độc lập"),
    (r"\bTy do\b", "Tự do"),
    (r"\bHanh phuc\b", "Hạnh phúc"),
    (r"\bHanh phic\b", "Hạnh phúc"),
    (r"\bC[oôơ]ng h[oô]a\b", "Cộng hòa"),
    (r"\bCONG HOA\b", "CỘNG HÒA"),
    (r"\bXA HOI\b", "XÃ HỘI"),
    (r"\bCHU NGHIA VIET NAM\b", "CHỦ NGHĨA VIỆT NAM"),
]

# Document family and type, first rule with a term wins.
DOCUMENT_TYPES = [
    ("bieu_mau/bieu_mau", ["phụ lục", "phu luc"]),
    ("bieu_mau/bieu_mau", ["biểu mẫu", "bieu mau", "mẫu số", "mau so"]),
    ("hop_dong/hop_dong", ["bên a:", "bên b:", "ben a:", "ben b:"]),
    ("hop_dong/hop_dong", ["this agreement", "this contract", "party a:", "party b:"]),
    ("hop_dong/hop_dong", ["hợp đồng", "hop dong"]),
    ("luat_phap/bo_luat", ["bộ luật", "bo luat"]),
    ("luat_phap/luat", ["quốc hội ban hành", "căn cứ hiến pháp", "luật này quy định"]),
    ("luat_phap/nghi_dinh", ["nghị định", "nghi dinh", "chính phủ ban hành"]),
    ("luat_phap/thong_tu", ["bộ trưởng ban hành", "thông tư", "thong tu"]),
    ("luat_phap/quyet_dinh", ["quyết định", "quyet dinh"]),
    ("luat_phap/chi_thi", ["chỉ thị", "chi thi"]),
    ("luat_phap/nghi_quyet", ["nghị quyết", "nghi quyet"]),
    ("luat_phap/bo_luat", ["labor code", "civil code", "penal code", "criminal code"]),
    ("luat_phap/nghi_dinh", ["decree no.", "government decree"]),
    ("luat_phap/thong_tu", ["circular no.", "ministry circular"]),
]

# Topic lists, first rule with a term wins.
CHUNK_TOPICS = [
    ("dat_dai", ["đất đai", "quyền sử dụng đất", "sổ đỏ", "sổ hồng", "giấy chứng nhận quyền"]),
    ("hop_dong", ["hợp đồng", "bên mua", "bên bán", "bên thuê", "điều khoản"]),
    ("lao_dong", ["lao động", "người lao động", "người sử dụng lao động", "hợp đồng lao động"]),
    ("doanh_nghiep", ["doanh nghiệp", "công ty", "cổ đông", "vốn điều lệ", "tnhh", "cổ phần"]),
    ("hinh_su", ["tội phạm", "hình sự", "bị can", "bị cáo", "truy tố", "khởi tố"]),
    ("dan_su", ["dân sự", "bồi thường", "tranh chấp", "nguyên đơn", "bị đơn"]),
    ("thue", ["thuế", "thu nhập", "vat", "gtgt", "khai thuế"]),
    ("so_huu_tri_tue", ["sở hữu trí tuệ", "bản quyền", "nhãn hiệu", "sáng chế", "kiểu dáng"]),
]
INGEST_TOPICS = [
    ("dat_dai", ["đất đai", "quyền sử dụng đất", "sổ đỏ", "sổ hồng", "bồi thường đất"]),
    ("hop_dong", ["hợp đồng", "bên mua", "bên bán", "bên thuê", "điều khoản hợp đồng"]),
    ("lao_dong", ["lao động", "người lao động", "hợp đồng lao động", "bảo hiểm xã hội"]),
    ("doanh_nghiep", ["doanh nghiệp", "công ty", "cổ đông", "vốn điều lệ", "tnhh", "cổ phần"]),
    ("hinh_su", ["tội phạm", "hình sự", "bị can", "bị cáo", "truy tố", "khởi tố"]),
    ("dan_su", ["dân sự", "bồi thường", "tranh chấp dân sự", "thừa kế", "di chúc"]),
    ("hanh_chinh", ["hành chính", "khiếu nại", "quyết định hành chính", "ubnd"]),
    ("gia_dinh", ["hôn nhân", "ly hôn", "nuôi con", "cấp dưỡng"]),
    ("thuong_mai", ["thương mại", "mua bán hàng hóa", "kinh doanh"]),
]

# Language and jurisdiction detection.
VI_DIACRITICS = "[àáảãạăắặằẳẵâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ]"
VI_STRUCTURE = r"(?U)\b(?:điều|khoản|điểm|chương|mục|phần|phụ\s*lục)\b"
VI_CONTENT = (
    r"(?U)\b(?:hợp\s*đồng|nghĩa\s*vụ|thanh\s*toán|pháp\s*luật|nghị\s*định|thông\s*tư|quyết\s*định"
    r"|quy\s*định|bên\s*[ab]|cộng\s*hòa|việt\s*nam|tòa\s*án|trọng\s*tài|bồi\s*thường)\b"
)
EN_STRUCTURE = r"\b(?:article|clause|section|chapter|schedule|annex|appendix|paragraph|subsection)\b"
EN_CONTENT = (
    r"\b(?:agreement\b|contract\b|obligation\b|payment\b|warranty\b|indemnif|termination\b"
    r"|governing\s+law\b|arbitration\b|jurisdiction\b|liabilit|confidential"
    r"|intellectual\s+property\b|force\s+majeure\b|party\s+[ab]\b|hereby\b|hereinafter\b"
    r"|whereas\b|notwithstanding\b)"
)
VI_JURISDICTION = r"(?U)\b(?:việt\s*nam|viac|tand|ubnd|hđnd|bộ\s+tư\s+pháp|luật\s+việt\s+nam)\b"
EN_JURISDICTIONS = [
    ("US", r"\b(?:united\s+states|u\.s\.|federal|u\.s\.c\.|u\.s\.\s+code)\b"),
    ("GB", r"\b(?:united\s+kingdom|u\.k\.|england\s+and\s+wales|scots\s+law)\b"),
    ("EU", r"\b(?:european\s+union|eu|gdpr|directive\s+\d{4}/\d+/ec)\b"),
]
EN_QUICK_KEYWORDS = (
    r"\b(?:article|clause|section|chapter|whereas|herein|agreement|contract|shall|obligation)\b"
)
VI_QUICK_KEYWORDS = (
    r"(?U)\b(?:điều|khoản|điểm|chương|mục|nghị định|thông tư|luật|bộ luật|quyết định|nghị quyết)\b"
)

# Redaction rules, applied in this order.
_VI_UPPER = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ"
REDACTIONS = [
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[EMAIL]"),
    (
        "phone",
        r"(?<!\d)(?:0|\+84|84)[\s.\-]?(?:3[2-9]|5[6-9]|7[06-9]|8[0-9]|9[0-9])"
        r"[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\d)",
        "[SĐT]",
    ),
    ("citizen_id", r"(?<!\d)\d{9}(?!\d)|(?<!\d)\d{12}(?!\d)", "[CMND/CCCD]"),
    (
        "address",
        r"(?:số\s*)?\d+(?:[/\-]\d+)*\s+(?:[A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐÊƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ]"
        r"[a-zàáâãèéêìíòóôõùúýăđêơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]+(?:\s+[A-Za-zÀ-ỹ]+){0,3})",
        "[ĐỊA CHỈ]",
    ),
    (
        "name",
        r"((?:[Tt]ôi\s+tên|[Tt]ên\s+tôi)\s+(?:là\s+)?|(?:[Vv]ợ|[Cc]hồng)\s+tôi\s+tên\s+(?:là\s+)?"
        r"|(?:[Ôô]ng|[Bb]à|[Aa]nh|[Cc]hị|[Ee]m|[Cc]ô|[Cc]hú|[Bb]ác)\s+)"
        rf"[A-Z{_VI_UPPER}]\p{{Ll}}+(?:\s+[A-Z{_VI_UPPER}]\p{{Ll}}+){{1,3}}(?=[,.\s]|$)",
        "$1[TÊN]",
    ),
]
SAFE_SUMMARY_MIN_LENGTH = 10
SAFE_SUMMARY_DEFAULT = "Tình huống pháp lý cần tư vấn."
SAFE_SUMMARIES = {
    "dat_dai": "Tình huống liên quan đến đất đai và quyền sử dụng đất.",
    "hop_dong": "Tình huống liên quan đến hợp đồng và tranh chấp hợp đồng.",
    "lao_dong": "Tình huống liên quan đến quan hệ lao động và quyền lợi người lao động.",
    "doanh_nghiep": "Tình huống liên quan đến doanh nghiệp và hoạt động kinh doanh.",
    "dan_su": "Tình huống liên quan đến dân sự và nghĩa vụ pháp lý.",
    "hinh_su": "Tình huống liên quan đến vụ việc hình sự.",
    "hanh_chinh": "Tình huống liên quan đến khiếu nại hành chính.",
    "gia_dinh": "Tình huống liên quan đến hôn nhân và gia đình.",
}

# Scrubbing of control tokens and instruction injections.
SCRUB_MARK = "[đã lọc]"
SCRUB_RULES = [
    ("format", r"(?i)<\|(?:system|user|assistant)\|>|\[/?(?:INST|SYS|SYSTEM)\]|(?:^|\n)\s*(?:system|assistant)\s*:"),
    (
        "injection",
        r"(?is)\b(?:ignore|forget|disregard|override|bypass)\b.{0,40}"
        r"(?:previous|prior|above|all|system|instruction|rule|prompt|constraint)",
    ),
    (
        "role_switch",
        r"(?i)\b(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be|from\s+now\s+on\s+you\s+are"
        r"|your\s+new\s+(?:role|persona|identity))\b",
    ),
]
FIELD_LIMITS = {"name": 80, "occupation": 100, "location": 100, "notes": 500, "summary": 150}

# Personal facts (group 1 is the value).
FACT_PATTERNS = {
    "name": r"(?iU)(?:tên tôi là|tên của tôi là|tôi tên là|mình tên là|gọi tôi là)\s+(\p{L}[\p{L} ]{1,34})",
    "age": r"(?iU)(?:(?:tôi|mình)\s+)?\b(\d{1,2})\s*tuổi\b",
    "occupation": (
        r"(?iU)(?:tôi là|tôi đang làm|nghề nghiệp|chức vụ|tôi làm)\s*:?\s*"
        r"(luật sư|kế toán|giám đốc|nhân viên|kỹ sư|bác sĩ|giáo viên|chủ doanh nghiệp|chủ công ty"
        r"|nhân sự|hr|kinh doanh|lập trình viên|cán bộ|công chức|nông dân|thợ|thư ký|trưởng phòng)"
    ),
    "location": (
        r"(?iU)(?:tôi ở|sống tại|ở tại|địa chỉ tại|tại)\s+"
        r"(TP\.?HCM|Hà Nội|Thành phố Hồ Chí Minh|Đà Nẵng|Hải Phòng|Cần Thơ|Bình Dương|Đồng Nai"
        r"|Bắc Ninh|Hưng Yên|Hà Nam|Thái Bình|Vĩnh Phúc|Long An|Tiền Giang|An Giang|Khánh Hòa"
        r"|Lâm Đồng|Đắk Lắk)"
    ),
}
# Fixed value: a self-introduction by one word, used where no name is declared.
SINGLE_NAME = r"(?iU)(?:tôi là|mình là)\s+(\p{L}{2,20})"
NAME_STOPWORDS = [
    "giáo", "viên", "kỹ", "sư", "luật", "bác", "sĩ", "sinh", "học", "công", "nhân", "nông", "dân",
    "kế", "toán", "giám", "đốc", "nạn", "bị", "đơn", "nguyên", "chủ", "người", "ai", "gì", "thợ",
    "cán", "bộ", "chức", "trưởng", "phòng", "lập", "trình", "thư", "ký", "hr", "nhà", "doanh",
    "nghiệp", "khách", "hàng", "mẹ", "bố", "cha", "vợ", "chồng", "con", "năm", "nay", "tuổi", "hiện",
]
