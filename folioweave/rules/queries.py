"""Fixed values of query understanding, retrieval and ranking."""

from __future__ import annotations

# Keywords per domain; ties go to the earlier domain.
DOMAIN_KEYWORDS = [
    ("dat_dai", ["đất", "sổ đỏ", "quyền sử dụng đất", "qsd đất", "thửa đất", "mảnh đất", "lấn chiếm", "tranh chấp đất", "thu hồi đất", "bồi thường đất", "giải phóng mặt bằng", "ranh giới", "đất đai", "giấy chứng nhận qsd", "gcn", "luật đất đai", "so do", "ranh gioi", "tranh chap dat"]),
    ("hop_dong", ["hợp đồng", "điều khoản", "ký kết", "vi phạm hợp đồng", "phạt vi phạm", "bồi thường thiệt hại", "đơn phương chấm dứt", "bên mua", "bên bán", "thanh toán", "giao hàng", "dịch vụ", "thuê nhà", "mua bán", "xây dựng"]),
    ("lao_dong", ["lao động", "người lao động", "người sử dụng lao động", "sa thải", "thôi việc", "nghỉ việc", "lương", "tiền lương", "bảo hiểm xã hội", "bhxh", "hợp đồng lao động", "nghỉ phép", "kỷ luật", "tai nạn lao động", "luật lao động"]),
    ("doanh_nghiep", ["doanh nghiệp", "công ty", "cổ đông", "cổ phần", "thành lập công ty", "giải thể", "phá sản", "vốn điều lệ", "điều lệ công ty", "hội đồng quản trị", "ban giám đốc", "tnhh", "cổ phần"]),
    ("dan_su", ["dân sự", "tranh chấp dân sự", "tài sản", "thừa kế", "di chúc", "hôn nhân", "ly hôn", "nuôi con", "quyền tài sản", "bồi thường", "thiệt hại ngoài hợp đồng"]),
    ("hinh_su", ["hình sự", "tội phạm", "bị cáo", "truy tố", "xét xử", "tù giam", "phạt tù", "điều tra", "khởi tố", "cơ quan điều tra", "viện kiểm sát"]),
    ("hanh_chinh", ["hành chính", "cơ quan nhà nước", "khiếu nại hành chính", "tố cáo", "quyết định hành chính", "ủy ban nhân dân", "ubnd", "giấy phép", "xử phạt vi phạm hành chính", "khiếu nại"]),
    ("gia_dinh", ["hôn nhân", "ly hôn", "nuôi con", "cấp dưỡng", "tài sản chung", "thừa kế", "gia đình", "vợ chồng", "con cái", "nhận con nuôi"]),
]
# Words that force a domain, in order of application.
DOMAIN_OVERRIDES = [
    ("lao_dong", ["lao_dong"], ["sa thải", "bị sa thải", "đuổi việc", "nợ lương", "chậm lương", "không trả lương", "trợ cấp thôi việc", "bồi thường sa thải", "chấm dứt hợp đồng lao động", "tai nạn lao động", "bhxh chưa đóng", "chưa đóng bhxh"]),
    ("gia_dinh", ["gia_dinh", "lao_dong"], ["ly hôn", "ly hôn đơn phương", "quyền nuôi con", "tranh chấp nuôi con", "con dưới 36 tháng", "sau ly hôn", "vợ chồng ly hôn", "bạo lực gia đình", "cấp dưỡng con", "phán quyết ly hôn"]),
]
# Dispute classes, first hit wins.
DISPUTES = [
    ("tranh_chap_ranh_gioi", ["ranh giới", "lấn chiếm", "tranh chấp đất"]),
    ("thu_hoi_dat_boi_thuong", ["thu hồi", "bồi thường", "giải phóng mặt bằng"]),
    ("vi_pham_hop_dong", ["vi phạm", "không thực hiện", "đơn phương chấm dứt", "phạt vi phạm"]),
    ("tranh_chap_lao_dong", ["sa thải", "thôi việc", "tranh chấp lao động", "lương"]),
    ("tranh_chap_thua_ke", ["thừa kế", "di chúc", "chia tài sản", "di sản"]),
    ("tranh_chap_hop_dong_mua_ban", ["mua bán", "thanh toán", "giao hàng", "bên mua", "bên bán"]),
    ("tranh_chap_thuong_mai", ["thương mại", "kinh doanh", "hợp đồng thương mại"]),
    ("khieu_nai_hanh_chinh", ["khiếu nại", "tố cáo", "quyết định hành chính"]),
    ("tranh_chap_hinh_su", ["hình sự", "tố giác", "khởi tố", "tội phạm"]),
]
# First context term added to a query variant.
CONTEXT_TERMS = {
    "dat_dai": "quyền sử dụng đất", "hop_dong": "điều khoản hợp đồng", "lao_dong": "bộ luật lao động",
    "doanh_nghiep": "luật doanh nghiệp", "dan_su": "bộ luật dân sự", "hinh_su": "bộ luật hình sự",
    "hanh_chinh": "pháp luật hành chính",
}
# Domains that add a retrieval strategy.
GRAPH_DOMAINS = ["dat_dai", "dan_su", "doanh_nghiep"]
RISK_DOMAINS = ["hop_dong", "doanh_nghiep", "lao_dong"]
CASE_MARKS = ["tranh_chap", "vi_pham", "khieu_nai"]
# Entity patterns and how many of each are kept.
ENTITIES = [
    ("laws", r"(?iU)(?:Luật|Nghị định|Thông tư|Điều|Khoản|Điểm)\s+[\w\s/\-.]+?\d{4}", 4),
    ("amounts", r"(?iU)\d[\d.,]*\s*(?:tỷ|triệu|nghìn|ngàn|đồng|VNĐ|USD|%)", 4),
    ("dates", r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|(?U)\b(?:năm\s*)?\d{4}\b", 3),
    ("parties", r"(?iU)(?:nguyên đơn|bị đơn|người bán|người mua|chủ nhà|người thuê|công ty\s+\w+|ông\s+\w+|bà\s+\w+)", 3),
    ("locations", r"(?iU)(?:tại|ở|tỉnh|huyện|xã|phường|quận|thành phố)\s+[\w\s]{2,30}", 3),
]
# Follow-up length, continuity hits.
FOLLOW_UP_WORDS = 15
STRONG_HITS = 2
GENERAL = "general"

# Retrieval scoring.
MATCH_BASE = {"canonical_ref": 1.0, "alias_keyword": 0.75, "keyword": 0.5, "semantic": 0.6}
SEMANTIC_THRESHOLD = 0.65
MAX_RESULTS = 20
FUSION_WEIGHTS = {"vector": 0.45, "tf": 0.20, "graph": 0.25, "behavior": 0.10}
FUSION_VECTOR_THRESHOLD = 0.55
GRAPH_SCORE = 0.75
RANK_WEIGHTS = {"semantic": 0.35, "behavior": 0.15, "graph": 0.20, "freshness": 0.15, "popularity": 0.10, "accepted": 0.05}
DOCUMENT_WEIGHTS = {"vector": 0.40, "collab": 0.25, "item": 0.20, "peer": 0.15}
SIMILARITY_BANDS = [(0.85, "Rất tương đồng"), (0.70, "Khá tương đồng"), (0.55, "Tương đồng một phần")]
SIMILARITY_LOWEST = "Có điểm chung"
RELATED_DOMAINS = {
    "gia_dinh": ["gia_dinh", "dan_su"], "dan_su": ["dan_su", "gia_dinh", "dat_dai"], "dat_dai": ["dat_dai", "dan_su"],
    "hop_dong": ["hop_dong", "dan_su", "doanh_nghiep"], "doanh_nghiep": ["doanh_nghiep", "hop_dong"], "lao_dong": ["lao_dong"],
}
