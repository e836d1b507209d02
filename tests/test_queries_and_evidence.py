"""Query planning, continuity, evidence status and recommendation bounds."""

from pyspark.sql import functions as F

from folioweave.operators import evidence as ev
from folioweave.operators import interactions as ix
from folioweave.operators import query_features as qf
from folioweave.functions import text as tx


def domains(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r["domain"] for r in qf.domain_scores(df).orderBy("id").collect()]


def test_domains_and_overrides(spark):
    got = domains(spark, [
        "Hàng xóm lấn đất, tôi đã có sổ đỏ", "Tôi bị sa thải không báo trước", "Ly hôn và chia tài sản là đất đai, sổ đỏ",
        "Công ty phá sản, cổ đông và vốn điều lệ", "xin chào",
    ])
    assert got == ["dat_dai", "lao_dong", "gia_dinh", "doanh_nghiep", "general"]


def test_short_follow_up_inherits(spark):
    rows = [
        ("s", 1, 30, "dat_dai", 3, False), ("s", 2, 5, "hop_dong", 1, False), ("s", 3, 4, "general", 0, False),
        ("s", 4, 6, "lao_dong", 1, True), ("s", 5, 20, "dan_su", 1, False), ("t", 1, 3, "hop_dong", 1, False), ("t", 2, 3, "dat_dai", 1, False),
    ]
    df = spark.createDataFrame(rows, "session_id string, turn int, words int, domain string, domain_hits int, primary boolean")
    got = [r["session_domain"] for r in qf.session_domains(df).orderBy("session_id", "turn").collect()]
    assert got == ["dat_dai", "dat_dai", "dat_dai", "lao_dong", "dan_su", "hop_dong", "hop_dong"]


def test_variants_and_strategy(spark):
    df = spark.createDataFrame([("Tôi muốn kiện hàng xóm", "dat_dai")], "text string, domain string")
    laws = F.array(F.lit("Luật Đất đai 2024"))
    row = df.select(
        qf.variants(F.col("text"), F.col("domain"), laws).alias("v"),
        qf.strategies(F.col("domain"), F.lit("tranh_chap_dat_dai"), F.size(laws)).alias("s"),
    ).first()
    assert row["v"][0] == "Tôi muốn kiện hàng xóm" and len(row["v"]) == 3
    assert row["s"] == ["vector", "bm25", "graph", "cases", "behavior"]


ALIASES = [("dat_dai", "title", "so do"), ("dat_dai", "payment", "bien lai")]
REQUIRED = [("dat_dai", "title", "high"), ("dat_dai", "payment", "high"), ("dat_dai", "photo", "low")]


def status(spark, text):
    df = spark.createDataFrame([(1, "dat_dai", text)], "text_id int, domain string, text string")
    df = df.withColumn("folded", tx.fold_for_matching(F.col("text"))).withColumn("has_input", F.lit(True))
    merged = ev.merge_facts(ev.possession(ev.mentions(df, ALIASES)))
    return {r["evidence_id"]: r["status"] for r in merged.collect()}, ev.assess_gaps(df, merged, REQUIRED)


def test_possession_status(spark):
    cases = {
        "Tôi đã có sổ đỏ": "present", "Tôi chưa có sổ đỏ": "missing", "Tôi không có sổ đỏ": "missing",
        "Hình như có sổ đỏ": "uncertain", "Anh trai giữ sổ đỏ": "uncertain", "Tôi có sổ đỏ nhưng bị mất": "contradicted",
        "Sổ đỏ của tôi": "present", "Nghe về sổ đỏ": "uncertain",
    }
    for text, want in cases.items():
        assert status(spark, text)[0] == {"title": want}, text


def test_gap_defaults_and_coverage(spark):
    merged, gaps = status(spark, "Tôi đã có sổ đỏ")
    rows = {r["evidence_id"]: r["status"] for r in gaps.collect()}
    assert rows == {"title": "present", "payment": "missing", "photo": "uncertain"}
    cover = ev.coverage(gaps).first()
    assert cover["coverage"] == round((2 + 0.5 * 0.1) / 4.5, 6) and cover["priority_gaps"] == 1


def test_feedback_is_bounded(spark):
    rows = [(i, 1, "2024-01-30 00:00:00", "useful", 5, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id int, user_id int, ts string, action string, item int, topic int")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = ix.feedback_scores(df, "2024-01-31 00:00:00", {"useful": 0.09}).collect()
    assert {r["score"] for r in got} == {0.18}


def test_openings_of_every_length_are_found_anywhere(spark):
    import random

    from folioweave.operators import query_features as qf

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c.D") for _ in range(rng.choice([0, 3, 7, 8, 9, 30, 31, 90]))) for _ in range(120)] + [None, "", "aaaaaaaa" * 9]
    rows = list(enumerate(texts))
    got = {r["id"]: (r["opening"], r["n_similar"]) for r in qf.prefix_counts(spark.createDataFrame(rows, "id int, text string")).collect()}
    for i, text in rows:
        opening = None if text is None else text.lower()[:60].replace(".", "").strip(" ")[:30]
        assert got[i] == (opening, 0 if opening is None else sum(t is not None and opening in t.lower() for t in texts))
