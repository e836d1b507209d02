"""Fixed values of evidence, stage and risk assessment."""

from __future__ import annotations

# Possession cues on folded text.
POSITIVE_BEFORE = [
    "toi da co", "toi co", "minh da co", "minh co", "chung toi da co", "chung toi co", "da co", "hien co", "co san",
    "san co", "dang co", "da chuan bi", "da nop", "da cung cap", "dang giu", "luu giu", "giu", "nam giu",
    "toi dang nam giu", "dung ten toi", "do toi dung ten", "cua toi", "cua gia dinh toi", "co",
]
POSSESSIVE_AFTER = ["cua toi", "cua gia dinh toi", "do toi giu", "do toi dang giu", "thuoc ve toi", "dung ten toi", "bi tranh chap"]
NEGATIVE_BEFORE = [
    "chua co", "khong co", "khong co ban goc", "khong giu", "khong giu ban goc", "thieu", "bi mat", "mat",
    "chua xin duoc", "khong tim thay", "chua nop",
]
NEGATIVE_AFTER = ["bi mat", "mat ban goc", "khong con", "khong giu ban goc", "khong co ban goc", "that lac"]
UNCERTAIN_BEFORE = ["khong ro co", "khong biet co", "chua ro co", "hinh nhu co", "co the co", "nghe noi co", "khong chac"]
UNCERTAIN_AFTER = ["khong", "khong ro", "khong chac"]
HOLDER_WORD = "giu"
OTHER_HOLDERS = ["anh trai", "chi gai", "em trai", "em gai", "bo toi", "me toi", "ben kia", "nguoi khac", "nguoi ban", "anh ay", "chi ay"]
BARE_POSITIVE = "co"
NEGATORS = ["khong", "chua", "chang", "chua tung"]
CONTEXT = 80
# Furthest distance of a cue.
LIMITS = {"uncertain_before": 45, "uncertain_after": 18, "positive": 90, "negative_before": 45, "negative_after": 42, "possessive": 30}

# Coverage weights.
PRIORITY_WEIGHTS = {"high": 2.0, "medium": 1.0, "low": 0.5}
CONTRADICTED_SHARE = 0.2
UNCERTAIN_SHARE = 0.1

# Stages in order and their risk.
STAGES = [
    "preparation", "dispute_emerging", "negotiation", "violation_occurred", "pre_litigation", "in_litigation",
    "awaiting_decision", "post_decision",
]
DEFAULT_STAGE = "dispute_emerging"
STAGE_RISK = {
    "preparation": 10, "dispute_emerging": 35, "negotiation": 45, "violation_occurred": 65, "pre_litigation": 75,
    "in_litigation": 80, "awaiting_decision": 70, "post_decision": 30,
}
GAP_PENALTY = 4
COVERAGE_PENALTY = 25
RISK_BANDS = [(80, "critical"), (60, "high"), (35, "medium")]
JOURNEY_BANDS = [(60, "high"), (30, "medium")]

# Clause coaching.
SEVERITY_WEIGHTS = {"critical": 30, "high": 20, "medium": 10, "low": 5}
COACH_BANDS = [(70, "critical"), (45, "high"), (20, "medium")]

# Stages whose risk is high or medium.
HIGH_RISK_STAGES = ["violation_occurred", "pre_litigation", "in_litigation", "awaiting_decision"]
MEDIUM_RISK_STAGES = ["dispute_emerging", "negotiation", "post_decision"]
COURT_STAGES = ["pre_litigation", "in_litigation"]

# Usual deadlines of a stage, as (what, number, unit).
DEADLINES = {
    "preparation": [("Thời gian ký kết hợp đồng nên có công chứng", 0, "không giới hạn")],
    "dispute_emerging": [
        ("Gửi thông báo vi phạm bằng văn bản", 7, "ngày"),
        ("Thời hiệu khởi kiện dân sự (tính từ khi biết quyền bị xâm phạm)", 1095, "ngày"),
    ],
    "negotiation": [
        ("Thời hạn hoà giải theo quy trình (nếu bắt buộc)", 30, "ngày"), ("Lưu giữ biên bản họp, thư từ trao đổi", 0, "liên tục"),
    ],
    "violation_occurred": [
        ("Ghi nhận thiệt hại ngay lập tức", 3, "ngày"), ("Gửi thông báo vi phạm chính thức", 15, "ngày"),
        ("Thời hiệu khởi kiện hợp đồng", 1095, "ngày"),
    ],
    "pre_litigation": [
        ("Nộp đơn khởi kiện tại toà án có thẩm quyền", 30, "ngày"), ("Nộp phí tạm ứng án phí", 15, "ngày"),
        ("Chuẩn bị chứng cứ và danh sách nhân chứng", 30, "ngày"),
    ],
    "in_litigation": [
        ("Nộp văn bản, chứng cứ bổ sung theo yêu cầu toà", 15, "ngày"), ("Chuẩn bị tham dự phiên toà", 7, "ngày"),
        ("Phản hồi luận cứ của bên đối lập", 10, "ngày"),
    ],
    "awaiting_decision": [
        ("Theo dõi thông báo từ toà", 3, "ngày"), ("Chuẩn bị hồ sơ kháng cáo phòng trường hợp cần", 15, "ngày"),
    ],
    "post_decision": [
        ("Thời hạn kháng cáo bản án dân sự", 15, "ngày"), ("Thời hạn kháng cáo bản án hình sự (bị cáo)", 15, "ngày"),
        ("Thời hạn yêu cầu thi hành án", 1825, "ngày"),
    ],
}

# Alerts of a stage.
ALERTS = {
    "preparation": [
        "Nên công chứng tất cả giao dịch quan trọng để tránh tranh chấp sau này.",
        "Đọc kỹ hợp đồng trước khi ký, đặc biệt các điều khoản phạt và chấm dứt.",
    ],
    "dispute_emerging": [
        "Ghi lại tất cả trao đổi với bên kia bằng văn bản từ thời điểm này.",
        "Bắt đầu thu thập và lưu giữ chứng cứ sớm — chứng cứ có thể biến mất theo thời gian.",
    ],
    "negotiation": [
        "Mọi thoả thuận trong quá trình thương lượng phải được ký xác nhận.",
        "Không giao thêm tài sản hoặc tiền cho bên kia trong khi đang tranh chấp.",
    ],
    "violation_occurred": [
        "Đây là giai đoạn quan trọng — cần tư vấn luật sư ngay nếu thiệt hại lớn.",
        "Kiểm tra thời hiệu khởi kiện — đừng để quá thời hạn.",
        "Thu thập chứng cứ về thiệt hại thực tế (hoá đơn, biên lai, ước tính).",
    ],
    "pre_litigation": [
        "Xác định đúng toà án có thẩm quyền (theo địa bàn và loại tranh chấp).",
        "Chuẩn bị đủ số lượng bản sao chứng cứ theo yêu cầu của toà.",
        "Tư vấn luật sư trước khi nộp đơn để tránh sai sót về hình thức.",
    ],
    "in_litigation": [
        "Tuân thủ nghiêm ngặt lịch tố tụng của toà — bỏ qua có thể bất lợi.",
        "Không tiếp xúc riêng với thẩm phán hoặc thư ký toà ngoài phòng xét xử.",
    ],
    "awaiting_decision": [
        "Chuẩn bị sẵn hồ sơ kháng cáo trong trường hợp kết quả không như mong đợi.",
        "Thời hạn kháng cáo thường rất ngắn — cần hành động ngay khi có phán quyết.",
    ],
    "post_decision": [
        "Thời hạn kháng cáo thường chỉ 15 ngày — hành động ngay.",
        "Nếu thắng kiện, yêu cầu cơ quan thi hành án hỗ trợ nếu bên thua không tự nguyện thi hành.",
    ],
}

# What a domain's words say for or against a case, and words that take a strength back.
STRENGTHS = {
    "dat_dai": [
        (["sổ đỏ", "giấy chứng nhận", "gcn"], "Có giấy chứng nhận quyền sử dụng đất hợp lệ"),
        (["công chứng", "chứng thực"], "Giao dịch đã được công chứng/chứng thực"),
        (["thanh toán", "biên lai", "chuyển khoản"], "Có chứng từ thanh toán rõ ràng"),
        (["hợp đồng", "giấy tay"], "Có văn bản giao dịch bằng chữ viết"),
        (["ubnd", "địa chính"], "Có xác nhận của cơ quan nhà nước"),
    ],
    "hop_dong": [
        (["hợp đồng ký", "hợp đồng có chữ ký"], "Có hợp đồng ký kết đầy đủ"),
        (["công chứng"], "Hợp đồng đã công chứng"),
        (["thanh toán", "biên lai"], "Có bằng chứng thanh toán"),
        (["bàn giao", "biên bản"], "Có biên bản bàn giao"),
        (["thông báo", "gửi thư"], "Đã thực hiện thông báo vi phạm"),
    ],
    "lao_dong": [
        (["hợp đồng lao động"], "Có hợp đồng lao động bằng văn bản"),
        (["bảng lương", "phiếu lương"], "Có tài liệu lương thưởng"),
        (["bảo hiểm xã hội", "bhxh"], "Có sổ BHXH làm bằng chứng"),
        (["quyết định", "sa thải"], "Có văn bản quyết định chính thức"),
    ],
    "dan_su": [
        (["di chúc", "công chứng"], "Có di chúc hợp lệ"),
        (["biên bản", "thỏa thuận"], "Có thỏa thuận bằng văn bản"),
        (["nhân chứng"], "Có nhân chứng xác nhận"),
    ],
}
WEAKNESSES = {
    "dat_dai": [
        (["giấy tay", "không công chứng"], "Giao dịch chưa qua công chứng, dễ bị tranh cãi"),
        (["mượn", "nhờ đứng tên"], "Đứng tên hộ tạo rủi ro pháp lý cao"),
        (["không có biên lai"], "Thiếu chứng từ thanh toán chính thức"),
    ],
    "hop_dong": [
        (["miệng", "nói miệng", "không ký"], "Giao dịch bằng miệng thiếu giá trị pháp lý"),
        (["thiếu điều khoản"], "Hợp đồng thiếu điều khoản quan trọng"),
        (["quá hạn", "hết hạn"], "Hợp đồng đã quá thời hạn hiệu lực"),
    ],
    "lao_dong": [
        (["không có hợp đồng", "thỏa thuận miệng"], "Không có hợp đồng lao động bằng văn bản"),
        (["thử việc"], "Hợp đồng thử việc có nhiều hạn chế pháp lý"),
    ],
}
TAKEN_BACK = ["không có ", "chưa có "]
LITTLE_EVIDENCE = "Thiếu nhiều chứng cứ quan trọng theo tiêu chuẩn pháp lý"
