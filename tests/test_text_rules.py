"""Cleaning, language, structure and privacy on small bilingual examples."""

from pyspark.sql import functions as F

from folioweave.functions import numbers
from folioweave.functions import text as tx
from folioweave.operators import chunking, cleaning, contracts, hierarchy, language
from folioweave.rules import corpus as rules
from folioweave.sources import texts


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_fold_accents(spark):
    assert one(spark, "Hợp Đồng ĐẤT", tx.fold_accents) == "hop dong dat"


def test_nfkc_only_touches_suspects(spark):
    rows = spark.createDataFrame([("ﬁle ①",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(tx.nfkc(F.col("t"))).collect()] == ["file 1", "plain", None]


def test_roman_numbers(spark):
    rows = spark.createDataFrame([("III",), ("iv",), ("XLIX",), ("12A",), ("abc",)], "t string")
    assert [r[0] for r in rows.select(numbers.plain_number(F.col("t"))).collect()] == ["3", "4", "49", "12a", "abc"]


def test_freshness_of_unknown_age_is_neutral(spark):
    rows = spark.createDataFrame([(0.0,), (180.0,), (None,)], "a double")
    got = [round(r[0], 4) for r in rows.select(numbers.freshness(F.col("a"))).collect()]
    assert got == [1.0, 0.5, 0.65]


def test_excerpt_cuts_at_sentence_end(spark):
    long = "Một câu dài. " * 80
    cut = one(spark, long, lambda c: tx.excerpt(c, 800))
    assert cut.endswith(".") and 400 < len(cut) <= 800
    assert one(spark, "short", lambda c: tx.excerpt(c, 800)) == "short"


def test_noise_and_duplicates(spark):
    body = "Bên A có nghĩa vụ thanh toán đầy đủ cho Bên B đúng hạn."
    lines = ["Trang 1/3", "Cộng hòa", body, "Cộng hòa", body.upper(), "- 12 -", "Cộng hòa", "khác"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, pos int, raw_text string")
    got = {r["pos"]: (r["noise"], r["duplicate_of"]) for r in cleaning.flag_blocks(blocks).collect()}
    assert got[0][0] == got[5][0] == "noise_page_number"
    assert {got[i][0] for i in (1, 3, 6)} == {"noise_repeated_line"}
    assert got[4] == (None, 2) and got[2] == (None, None) and got[7] == (None, None)


def test_recognition_repairs(spark):
    docs = spark.createDataFrame([(1, "Dieu 5. Nghi dinh 12/ND-CP, Khoan 2")], "doc_id int, text string")
    assert cleaning.repair_tokens(docs).first()["fixed"] == "Điều 5. Nghị định 12/NĐ-CP, Khoản 2"


def test_recognised_text_cleanup(spark):
    raw = "hop-\nđồng thuê nhà ở\n*** ### $$$ %%%\na b\nmột hai ba bốn"
    assert one(spark, raw, cleaning.clean_recognised_text) == "hopđồng thuê nhà ở\nmột hai ba bốn"


def test_redaction_of_personal_data(spark):
    rows = [
        (1, "Liên hệ an.nguyen@mail.vn hoặc 0912345678 để biết thêm.", 2, "[EMAIL]|[SĐT]"),
        (2, "Số CMND 123456789 và CCCD 001099012345 của tôi.", 2, "[CMND/CCCD]"),
        (3, "Ông Nguyễn Văn An, tranh chấp đất với hàng xóm.", 1, "Ông [TÊN]"),
        (4, "Không có thông tin cá nhân trong câu này.", 0, "Không có"),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id int, text string")
    got = {r["doc_id"]: r for r in cleaning.redact(docs).collect()}
    for key, _, count, parts in rows:
        assert got[key]["redaction_count"] == count
        for part in parts.split("|"):
            assert part in got[key]["safe_summary"]


def test_short_redacted_text_falls_back(spark):
    docs = spark.createDataFrame([(1, "a@b.vn")], "doc_id int, text string")
    got = cleaning.redact(docs, topic=F.lit("dat_dai")).first()
    assert got["safe_summary"] == rules.SAFE_SUMMARIES["dat_dai"]


def test_personal_facts_keep_the_first_value(spark):
    turns = [("u1", 1, "Tôi tên là Lan, năm nay 30 tuổi"), ("u1", 2, "tên tôi là Hoa"), ("u1", 3, "tôi là kế toán, sống tại Hà Nội"), ("u2", 1, "tôi tên là luật sư")]
    rows = spark.createDataFrame(turns, "user_id string, seq int, text string")
    got = {(r["user_id"], r["fact"]): r["value"] for r in cleaning.personal_facts(rows).collect()}
    assert got[("u1", "name")] == "Lan" and got[("u1", "age")] == "30"
    assert got[("u1", "occupation")] == "kế toán" and got[("u1", "location")] == "Hà Nội"
    assert ("u2", "name") not in got


def test_language_and_jurisdiction(spark):
    rows = [
        (1, "Điều 1. Hợp đồng này theo pháp luật Việt Nam. Khoản 2. Điểm a. Nghĩa vụ thanh toán.", "vi", "VN"),
        (2, "Article 1. This Agreement and the contract hereby state the payment obligation in the United States. Section 2. Clause 3.", "en", "US"),
        (3, "12345", "unknown", None),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id int, text string")
    got = {r["doc_id"]: (r["language"], r["jurisdiction"]) for r in language.detect_language(df).collect()}
    assert got == {i: (lang, j) for i, _, lang, j in rows}


def test_document_types_first_rule_wins(spark):
    cases = {"Phụ lục kèm theo hợp đồng": "bieu_mau/bieu_mau", "HỢP ĐỒNG thuê nhà": "hop_dong/hop_dong", "Nghị định 01": "luat_phap/nghi_dinh", "hello": "general/general"}
    for text, label in cases.items():
        assert one(spark, text, lambda c: tx.first_label(F.lower(c), rules.DOCUMENT_TYPES, "general/general")) == label


DECREE = [
    "Chương I. QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "Nghị định này quy định về đất.", "Khoản 1. Đối tượng", "Điểm a) Cá nhân",
    "nội dung của khoản", "Điều 2. Giải thích", "theo Điều 1 và Điều 7", "Chương II. QUY ĐỊNH KHÁC", "nội dung mở đầu",
    "Article 3. Scope", "Clause 2. Terms", "body text",
]


def decree(spark):
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(DECREE)], "doc_id int, pos int, raw_text string")
    return hierarchy.with_structure(blocks)


def test_hierarchy_resets(spark):
    got = {r["pos"]: r for r in decree(spark).collect()}
    assert got[2]["in_article"] == 0 and got[2]["cur_clause"] is None
    assert got[4]["kind"] == "điểm" and got[4]["cur_clause"] == 0
    assert got[5]["cur_clause"] == 0 and got[5]["in_article"] == 0
    assert got[7]["in_article"] == 1 and got[7]["cur_clause"] is None
    assert got[9]["cur_section"] == 1 and got[9]["cur_article"] is None
    assert got[10]["unit"] == "article" and got[12]["in_article"] == 2


def test_units_are_named_below_their_article(spark):
    rows = hierarchy.units(decree(spark)).collect()
    refs = {(r["unit"], r["idx"]): r["ref"] for r in rows}
    assert refs[("section", 0)] == "chapter_1" and refs[("section", 1)] == "chapter_2"
    assert refs[("article", 0)] == "article_1" and refs[("article", 2)] == "article_3"
    assert refs[("clause", 0)] == "article_1_clause_1"


def test_unique_suffixes_skip_literal_ones(spark):
    rows = [(1, 0, "a_b"), (1, 1, "a_b"), (1, 2, "a_b_2"), (1, 3, "a_b")]
    df = spark.createDataFrame(rows, "doc_id int, pos int, base string")
    got = {r["pos"]: r["ref"] for r in hierarchy.unique_per_document(df, "base", ["pos"]).collect()}
    assert got == {0: "a_b", 1: "a_b_3", 2: "a_b_2", 3: "a_b_4"}


def test_references_in_order(spark):
    got = one(spark, "See Article 5, Clause 2(a) and Section IV; điều 5", hierarchy.references)
    assert got == ["article_5", "clause_2_a", "section_4"]


def test_citations_of_articles(spark):
    got = {(r["article_no"], r["cited"]) for r in hierarchy.article_citations(decree(spark)).collect()}
    assert got == {(1, "1"), (1, "7")}


def test_headings_that_cite_other_acts_are_paragraphs(spark):
    cases = {"Điều 47 Nghị định số 96/2026/NĐ-CP": "paragraph", "Điều 5. Nghĩa vụ": "heading", "Khoản 1. Nội dung": "list_item", "Tổng quan:": "heading", "1. mục": "list_item", "thường": "paragraph"}
    for text, kind in cases.items():
        assert one(spark, text, hierarchy.block_type) == kind


def test_flat_chunks_cover_every_block_once(spark):
    rows = [(1, i, "x" * (400 * (i % 5 + 1)), "H" if i == 3 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, raw_text string, heading string")
    got = chunking.flat_chunks(df).orderBy("chunk_no").collect()
    assert sum(r["n_blocks"] for r in got) == 40
    assert all(r["tokens"] <= 500 or r["n_blocks"] == 1 for r in got)
    assert got[-1]["hierarchy"] == "H"


def test_article_pieces_lose_no_text(spark):
    text = "Điều 1. " + "a" * 2000 + "\nĐiều 2. " + "b" * 100
    docs = spark.createDataFrame([(1, text), (2, "ngắn"), (3, "c" * 80)], "doc_id int, text string")
    got = texts.article_pieces(docs).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 8 + 2000 + 8 + 100, 3: 80}


def test_contract_clauses_and_score(spark):
    text = "Mở đầu hợp đồng giữa hai bên ký kết\nĐiều 1. Thanh toán tiền thuê hàng tháng đầy đủ\nĐiều 2. Phạt 200% nếu vi phạm hợp đồng thuê"
    parts = contracts.split_articles(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = contracts.classify_clauses(
        parts, [("payment", ["thanh toán", "tiền"]), ("penalty", ["phạt"])], [(r"phạt \d{3}%", "excessive")], [("vi phạm", "breach")]
    )
    rows = {r["part"]: (r["clause_type"], r["risk_level"]) for r in got.collect()}
    assert rows == {0: ("general_provisions", "low"), 1: ("payment", "low"), 2: ("penalty", "high")}
    assert contracts.contract_summary(got).first()["compliance_score"] == 85
