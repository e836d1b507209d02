"""Stage outlook, stated facts and risk reports with the default rules."""

from pyspark.sql import functions as F

from folioweave.operators import evidence as ev
from folioweave.rules import evidence as rules


def test_every_stage_has_deadlines_alerts_and_a_next_stage(spark):
    staged = spark.createDataFrame([(s, i) for i, s in enumerate(rules.STAGES)] + [("unknown", 1)], "stage string, stage_index int")
    got = {r.stage: r for r in ev.stage_outlook(staged).collect()}
    for i, s in enumerate(rules.STAGES):
        assert got[s].next_stage == rules.STAGES[min(i + 1, 7)]
        assert [tuple(d) for d in got[s].deadlines] == rules.DEADLINES[s] and got[s].alerts == rules.ALERTS[s]
    assert got["unknown"].deadlines == [] and got["unknown"].alerts == []


def test_facts_are_long_clauses_with_a_cue(spark):
    texts = [
        ("Tôi đã ký hợp đồng mua nhà; ngắn đã, bên bán không giao nhà. ABC", ["Đã trả đủ tiền", "đã trả đủ tiền", "có", "TÔI ĐÃ KÝ HỢP ĐỒNG MUA NHÀ"]),
        (None, None), ("", []), ("đã có một sự việc dài." * 9, ["một điều khác nữa"]),
    ]
    df = spark.createDataFrame(texts, "text string, extra array<string>")
    got = [r.f for r in df.select(ev.stated_facts(F.col("text"), ["đã", "không"], F.col("extra")).alias("f")).collect()]
    assert got[0] == ["Tôi đã ký hợp đồng mua nhà", "bên bán không giao nhà", "Đã trả đủ tiền"]
    assert got[1] == [] and got[2] == [] and got[3] == ["đã có một sự việc dài"] * 6


def report(spark, text, assessed=(), stage="negotiation", coverage=0.5, gaps=0, score=40.0, level="medium"):
    cases = spark.createDataFrame(
        [(1, "dat_dai", text, stage, coverage, gaps, score, level)],
        "text_id int, domain string, text string, stage string, coverage double, priority_gaps int, risk_score double, risk_level string",
    )
    rows = spark.createDataFrame([(1, e, s) for e, s in assessed], "text_id int, evidence_id string, status string")
    return ev.risk_report(cases, rows).first()


def test_reports_say_what_speaks_for_and_against(spark):
    r = report(spark, "Tôi không có sổ đỏ nhưng có biên lai, nhờ đứng tên")
    assert r.strengths == ["Có chứng từ thanh toán rõ ràng"] and r.weaknesses == ["Đứng tên hộ tạo rủi ro pháp lý cao"] and r.warnings == []
    kinds = [("d", "present"), ("a", "present"), ("b", "present"), ("c", "present"), ("x", "uncertain"), ("y", "contradicted"), ("z", "missing")]
    r = report(spark, "có sổ đỏ", kinds, "in_litigation", 0.39, 3, 80.0, "critical")
    assert r.strengths == ["present:a", "present:b", "present:c"] and r.weaknesses == ["uncertain:x", "contradicted:y"]
    assert r.missing_points == ["z"] and r.warnings == ["high_risk", "weak_evidence", "court", "priority_gaps"]
    assert report(spark, None, score=50.0).weaknesses == [rules.LITTLE_EVIDENCE]
    assert report(spark, "", score=49.9) == (1, [], [], [], [])
