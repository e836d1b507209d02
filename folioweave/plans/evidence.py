"""Evidence, contract, stage, risk and compliance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import contracts, evidence as ev
from folioweave.operators import query_features as qf
from folioweave.operators.bounded_search import half_up_column
from folioweave.plans.fixtures import SB, conversations, structured_texts
from folioweave.plans.registry import query
from folioweave.plans.search import DOM, ENT, domains
from folioweave.rules import evidence as rules

CUES = ev.Cues(
    positive=("the", "of the", "les", "des", "la", "der", "co"), possessive=("and", "et", "und"),
    negative_before=("in", "dans", "de co", "que"), negative_after=("is", "qui", "ist"),
    uncertain_before=("re", "un", "ein"), uncertain_after=("or", "ou"), holder_word="er",
    other_holders=("thing", "zu der"), bare="co", negators=("de", "que"),
)
ALIASES = [
    ("english", "e_title", "ing"), ("english", "e_title", "ed"), ("english", "e_payment", "ion"), ("english", "e_photo", "that"),
    ("french", "f_title", "de"), ("french", "f_payment", "ai"), ("french", "f_photo", "avec"),
    ("german", "g_title", "die"), ("german", "g_payment", "er"), ("spanish", "s_title", "el"), ("spanish", "s_payment", "los"),
]
REQUIRED = [
    ("english", "e_title", "high"), ("english", "e_payment", "medium"), ("english", "e_photo", "low"),
    ("french", "f_title", "high"), ("french", "f_payment", "medium"), ("french", "f_photo", "low"),
    ("german", "g_title", "high"), ("german", "g_payment", "medium"), ("spanish", "s_title", "high"),
    ("spanish", "s_payment", "medium"), ("general", "x_any", "low"),
]
STAGE_WORDS = [
    ("preparation", ["ing ", "ment"]), ("dispute_emerging", [" the ", "les "]), ("negotiation", [" and ", " und "]),
    ("violation_occurred", ["tion", "ung"]), ("pre_litigation", ["wh", "qui"]), ("in_litigation", ["ción", "eaux"]),
    ("awaiting_decision", ["keit"]), ("post_decision", ["heit", "ble"]),
]
STAGE_RISK = rules.STAGE_RISK


def _either(phrases):
    return "|".join(sorted(phrases, key=len, reverse=True))


def _values(rows):
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


FOLD = r"trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9_\s/.\-]', ' ', 'g'), '\s+', ' ', 'g'))"
A = r"(?s)^(.*?[^a-z0-9_]|)(?:{p})(?:[^a-z0-9_].*)?$"


def _near(ctx, phrases, limit, hidden=None):
    """SQL of the phrase that ends nearest to the end of ctx, by trying every place."""
    spots = []
    for nth, p in enumerate(phrases):
        t = (hidden or {}).get(p, ctx)
        places = (
            f"list_max(list_filter(range(1, length({t}) + 1), lambda i: substr({t}, i, {len(p)}) = '{p}'"
            f" AND NOT regexp_matches(CASE WHEN i > 1 THEN substr({t}, i - 1, 1) ELSE '' END || '.', '^[a-z0-9_]')"
            f" AND NOT regexp_matches(substr({t}, i + {len(p)}, 1), '[a-z0-9_]')))"
        )
        spots.append(f"{{'gap': length({t}) - ({places} + {len(p) - 1}), 'nth': {nth}, 'phrase': '{p}'}}")
    return f"list_min(list_filter([{', '.join(spots)}], lambda s: s.gap <= {limit}))"


def _a(phrases, limit):
    pat = A.format(p=_either(phrases))
    return f"(regexp_matches(after, '{pat}') AND length(regexp_extract(after, '{pat}', 1)) <= {limit})"


MENT = DOM + rf""",
tt AS (SELECT conv_id * 1000 + turn AS text_id, domain, text, low, {FOLD} AS folded FROM dm),
al(domain, evidence_id, alias) AS (VALUES {_values(ALIASES)}),
ap AS (SELECT t.text_id, t.folded, a.evidence_id, a.alias, string_split(t.folded, a.alias) AS parts FROM tt t JOIN al a ON a.domain = t.domain AND contains(t.folded, a.alias)),
ao AS (SELECT *, unnest(range(1, len(parts))) AS i FROM ap),
ast AS (SELECT text_id, folded, evidence_id, alias, CAST(list_sum(list_transform(list_slice(parts, 1, i), lambda p: length(p))) + (i - 1) * length(alias) AS BIGINT) AS start FROM ao),
ac AS (SELECT text_id, evidence_id, alias, CAST(start AS INTEGER) AS start, substr(folded, greatest(start - 80, 0) + 1, least(start, 80)) AS before, substr(folded, start + length(alias) + 1, 80) AS after FROM ast),
ment AS (SELECT * FROM ac WHERE NOT regexp_matches(before, '[a-z0-9_]$') AND NOT regexp_matches(after, '^[a-z0-9_]')),
mk AS (SELECT *, regexp_replace(before, '({'|'.join(CUES.negators)}) co([^a-z0-9_]|$)', '\1 xx\2', 'g') AS masked FROM ment),
mz AS (SELECT *, {_near('before', CUES.positive, 90, {'co': 'masked'})}.phrase AS p, {_near('before', CUES.negative_before, 45)}.phrase AS n, {_near('before', CUES.uncertain_before, 45)} IS NOT NULL OR {_a(CUES.uncertain_after, 18)} AS u,
 {_a(CUES.negative_after, 42)} AS nf, {_a(CUES.possessive, 30)} AS po, contains(before, 'er') AND (contains(before, 'thing') OR contains(before, 'zu der')) AS h FROM mk),
mr AS (SELECT *, length(string_split(before, p)[-1]) AS pa, length(string_split(before, n)[-1]) AS na, n IS NOT NULL AND NOT coalesce(p = 'co' AND ends_with(n, 'co'), false) AS rn FROM mz),
st AS (SELECT text_id, evidence_id, alias, start, CASE WHEN h OR u THEN 'uncertain' WHEN p IS NOT NULL AND nf THEN 'contradicted' WHEN rn AND p IS NOT NULL AND pa <= na THEN 'present' WHEN rn THEN 'missing' WHEN nf THEN 'missing' WHEN p IS NOT NULL THEN 'present' WHEN po AND n IS NULL THEN 'present' ELSE 'uncertain' END AS status,
 CASE WHEN h OR u THEN 0.72::DOUBLE WHEN p IS NOT NULL AND nf THEN 0.82::DOUBLE WHEN rn AND p IS NOT NULL AND pa <= na THEN 0.86::DOUBLE WHEN rn THEN 0.88::DOUBLE WHEN nf THEN 0.80::DOUBLE WHEN p IS NOT NULL THEN 0.90::DOUBLE WHEN po AND n IS NULL THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS status_confidence FROM mr),
mg0 AS (SELECT text_id, evidence_id, count(*) AS mentions, max(status_confidence) FILTER (status = 'contradicted') AS c, max(status_confidence) FILTER (status = 'missing') AS m, max(status_confidence) FILTER (status = 'present') AS p, max(status_confidence) AS a FROM st GROUP BY 1, 2),
mg AS (SELECT text_id, evidence_id, mentions, CASE WHEN c IS NOT NULL OR (m IS NOT NULL AND p IS NOT NULL) THEN 'contradicted' WHEN m IS NOT NULL THEN 'missing' WHEN p IS NOT NULL THEN 'present' ELSE 'uncertain' END AS status,
 CASE WHEN c IS NOT NULL OR (m IS NOT NULL AND p IS NOT NULL) THEN 0.8::DOUBLE ELSE coalesce(m, p, a) END AS status_confidence FROM mg0),
rq(domain, evidence_id, priority) AS (VALUES {_values(REQUIRED)}),
ga AS (SELECT t.text_id, r.evidence_id, r.priority, coalesce(m.status, CASE WHEN length(t.text) <= 20 OR r.priority = 'high' THEN 'missing' ELSE 'uncertain' END) AS status, coalesce(m.status_confidence, CASE WHEN length(t.text) <= 20 OR r.priority = 'high' THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END) AS status_confidence
 FROM tt t JOIN rq r ON r.domain = t.domain LEFT JOIN mg m ON m.text_id = t.text_id AND m.evidence_id = r.evidence_id),
cv AS (SELECT text_id, count(*) AS required, count(*) FILTER (status = 'present') AS n_present, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (status = 'uncertain') AS n_uncertain, count(*) FILTER (status = 'contradicted') AS n_contradicted, count(*) FILTER (priority = 'high' AND status <> 'present') AS priority_gaps,
 round(least(sum(w * s) / sum(w), 1.0::DOUBLE), 6) AS coverage FROM (SELECT *, CASE priority WHEN 'high' THEN 2.0::DOUBLE WHEN 'medium' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w, CASE status WHEN 'present' THEN 1.0::DOUBLE WHEN 'contradicted' THEN 0.2::DOUBLE WHEN 'uncertain' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS s FROM ga) GROUP BY 1)"""


def texts_of(spark, sf):
    return domains(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), "domain", "text",
        tx.fold_for_matching(F.col("text")).alias("folded"), (F.length("text") > 20).alias("has_input"),
    )


def facts_of(spark, sf):
    return ev.possession(ev.mentions(texts_of(spark, sf), ALIASES), CUES)


def assessed(spark, sf):
    return ev.assess_gaps(texts_of(spark, sf), ev.merge_facts(facts_of(spark, sf)), REQUIRED)


@query("e01_mentions", f"WITH {MENT} SELECT text_id, evidence_id, alias, start FROM ment")
def e01(spark, sf):
    return ev.mentions(texts_of(spark, sf), ALIASES).select("text_id", "evidence_id", "alias", "start")


@query("e02_possession_status", f"WITH {MENT} SELECT text_id, evidence_id, alias, start, status, status_confidence FROM st")
def e02(spark, sf):
    return facts_of(spark, sf).select("text_id", "evidence_id", "alias", "start", "status", "status_confidence")


@query("e03_fact_merge", f"WITH {MENT} SELECT text_id, evidence_id, mentions, status, status_confidence FROM mg")
def e03(spark, sf):
    return ev.merge_facts(facts_of(spark, sf))


@query("a11_status_lattice", f"WITH {MENT} SELECT evidence_id, status, count(*) AS texts, max(status_confidence) AS best FROM mg GROUP BY 1, 2")
def a11(spark, sf):
    return ev.merge_facts(facts_of(spark, sf)).groupBy("evidence_id", "status").agg(
        F.count(F.lit(1)).alias("texts"), F.max("status_confidence").alias("best")
    )


@query("e04_gap_assessment", f"WITH {MENT} SELECT text_id, evidence_id, priority, status, status_confidence FROM ga")
def e04(spark, sf):
    return assessed(spark, sf)


@query("e05_coverage", f"WITH {MENT} SELECT text_id, required, n_present, n_missing, n_uncertain, n_contradicted, priority_gaps, coverage FROM cv")
def e05(spark, sf):
    return ev.coverage(assessed(spark, sf))


def present_aliases(spark, sf):
    return facts_of(spark, sf).filter("status = 'present'").select("text_id", "alias").distinct()


@query("e06_consistent_advice", rf"""WITH {MENT}, pr AS (SELECT text_id, list(DISTINCT alias) AS aliases FROM st WHERE status = 'present' GROUP BY 1),
ad AS (SELECT text_id, CAST(unnest(range(len(s))) AS INTEGER) AS place, unnest(s) AS advice FROM (SELECT text_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) >= 1) AS s FROM tt)),
j AS (SELECT text_id, place, advice, (contains(f, 'the') OR contains(f, 'les') OR contains(f, 'die')) AND coalesce(len(list_filter(aliases, lambda a: contains(f, a))) > 0, false) AS clash FROM (SELECT ad.*, aliases, replace(strip_accents(lower(advice)), 'đ', 'd') AS f FROM ad LEFT JOIN pr USING (text_id))),
w AS (SELECT text_id, place, clash, CASE WHEN clash THEN 'check: ' || advice ELSE advice END AS advice FROM j)
SELECT text_id, min(place) AS place, arg_min(advice, place) AS advice, bool_or(clash) AS reworded FROM w GROUP BY text_id, lower(trim(regexp_replace(advice, '\s+', ' ', 'g')))""")
def e06(spark, sf):
    advice = texts_of(spark, sf).select("text_id", F.posexplode(tx.sentences(F.col("text"))).alias("place", "advice"))
    return ev.consistent_advice(advice, present_aliases(spark, sf), ["the", "les", "die"], "check: ")


@query("e07_contradicting_prose", rf"""WITH {MENT}, pr AS (SELECT text_id, list(DISTINCT alias) AS aliases FROM st WHERE status = 'present' GROUP BY 1),
s AS (SELECT t.text_id, aliases, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM tt t LEFT JOIN pr USING (text_id)),
u AS (SELECT text_id, aliases, unnest(s) AS x, unnest(range(len(s))) AS i FROM s),
f AS (SELECT *, (contains(y, 'the') OR contains(y, 'les') OR contains(y, 'die')) AND NOT contains(y, 'ever') AND coalesce(len(list_filter(aliases, lambda a: contains(y, a))) > 0, false) AS bad FROM (SELECT *, replace(strip_accents(lower(x)), 'đ', 'd') AS y FROM u))
SELECT text_id, CAST(count(*) AS INTEGER) AS sentences, CAST(count(*) FILTER (bad) AS INTEGER) AS flagged, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (NOT bad), '') AS clean FROM f GROUP BY 1""")
def e07(spark, sf):
    return ev.contradicting_sentences(
        texts_of(spark, sf).select("text_id", "text"), present_aliases(spark, sf), ["the", "les", "die"], ["ever"]
    )


def _sum(terms):
    return " + ".join(f"CAST(contains(low, '{t}') AS INTEGER)" for t in terms)


STG = (
    "sg0 AS (SELECT conv_id * 1000 + turn AS text_id, lower(text) AS low FROM conversations), sg1 AS (SELECT *, "
    + ", ".join(f"{_sum(ws)} AS s{i}" for i, (_, ws) in enumerate(STAGE_WORDS))
    + " FROM sg0), sg2 AS (SELECT *, greatest(s0, s1, s2, s3, s4, s5, s6, s7) AS mx, s0 + s1 + s2 + s3 + s4 + s5 + s6 + s7 AS tot FROM sg1), sg3 AS (SELECT *, CASE WHEN mx = 0 THEN 1 "
    + " ".join(f"WHEN s{i} = mx THEN {i}" for i in range(8))
    + " END AS idx FROM sg2), sg AS (SELECT text_id, low, (['"
    + "', '".join(s for s, _ in STAGE_WORDS)
    + "'])[idx + 1] AS stage, CAST(idx AS INTEGER) AS stage_index, CASE WHEN mx = 0 THEN 0.4::DOUBLE ELSE round(least(0.95::DOUBLE, mx / greatest(tot, 1)::DOUBLE + 0.3::DOUBLE), 6) END AS stage_confidence, CAST(round(idx / 7.0::DOUBLE * 100) AS INTEGER) AS progress FROM sg3)"
)


def staged(spark, sf):
    return ev.detect_stage(texts_of(spark, sf), "text", STAGE_WORDS)


@query("e08_stage_detection", f"WITH {STG} SELECT text_id, stage, stage_index, stage_confidence, progress FROM sg")
def e08(spark, sf):
    return staged(spark, sf).select("text_id", "stage", "stage_index", "stage_confidence", "progress")


DUE = "du(stage, what, number, unit) AS (VALUES " + ", ".join(f"('{s}', '{w}', {n}, '{u}')" for s, rows in rules.DEADLINES.items() for w, n, u in rows) + ")"
WARN = "wa(stage, alert) AS (VALUES " + ", ".join(f"('{s}', '{a}')" for s, rows in rules.ALERTS.items() for a in rows) + ")"
NEXT = "(['" + "', '".join(s for s, _ in STAGE_WORDS) + "'])[least(stage_index + 2, 8)]"


@query("e08_stage_deadlines", f"WITH {STG}, {DUE} SELECT text_id, stage, {NEXT} AS next_stage, what, CAST(number AS INTEGER) AS number, unit FROM sg JOIN du USING (stage)")
def e08_deadlines(spark, sf):
    return ev.stage_outlook(staged(spark, sf)).select("text_id", "stage", "next_stage", F.inline("deadlines"))


@query("e08_stage_alerts", f"WITH {STG}, {WARN} SELECT text_id, stage, alert FROM sg JOIN wa USING (stage)")
def e08_alerts(spark, sf):
    return ev.stage_outlook(staged(spark, sf)).select("text_id", "stage", F.explode("alerts").alias("alert"))


FACT_CUES = ["the ", "les ", "der ", "los "]
DISPUTES = [("boundary", ["keit", "wh"]), ("payment", ["tion", "eaux"])]


@query("e09_situation_profile", rf"""WITH {DOM}, {STG}, f AS (SELECT conv_id * 1000 + turn AS text_id, *, list_slice(list_filter(list_transform(regexp_split_to_array(text, '[.!?;,\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 15 AND ({' OR '.join(f"contains(lower(x), '{c}')" for c in FACT_CUES)})), 1, 6) AS facts FROM dm)
SELECT f.text_id, domain, stage, CASE WHEN contains(f.low, 'must') OR contains(f.low, 'keit') THEN 'compliance' WHEN contains(f.low, 'than') OR contains(f.low, 'que') THEN 'comparison' ELSE 'explanation' END AS intent,
 CASE WHEN contains(f.low, 'keit') OR contains(f.low, 'wh') THEN 'boundary' WHEN contains(f.low, 'tion') OR contains(f.low, 'eaux') THEN 'payment' ELSE 'general' END AS dispute,
 {", ".join(f"CAST(least(len(list_distinct(regexp_extract_all(text, '{p}'))), {n}) AS INTEGER) AS n_{k}" for k, p, n in ENT)},
 CAST(len(facts) AS INTEGER) AS n_facts, md5(array_to_string(facts, chr(10))) AS facts_md5,
 CASE WHEN stage IN ({', '.join(f"'{s}'" for s in rules.HIGH_RISK_STAGES)}) THEN 'high' WHEN stage IN ({', '.join(f"'{s}'" for s in rules.MEDIUM_RISK_STAGES)}) THEN 'medium' ELSE 'low' END AS risk,
 floor(((CASE WHEN domain = 'general' THEN 0.25::DOUBLE ELSE round(hits / greatest(total, 1)::DOUBLE, 3) END + stage_confidence) / 2) * 100 + 0.5::DOUBLE) / 100 AS confidence
FROM f JOIN sg ON sg.text_id = f.text_id""")
def e09(spark, sf):
    rows = domains(spark, sf).withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    s = ev.detect_stage(rows, "text", STAGE_WORDS).withColumn("facts", ev.stated_facts(F.col("text"), FACT_CUES))
    found = qf.entities(F.col("text"), ENT)
    low = F.lower("text")
    return s.select(
        "text_id", "domain", "stage",
        qf.intent(F.col("text"), [("compliance", ["must", "keit"]), ("comparison", ["than", "que"])], "explanation").alias("intent"),
        tx.first_label(low, DISPUTES, "general").alias("dispute"),
        *[F.size(c).alias(f"n_{k}") for k, c in found.items()],
        F.size("facts").alias("n_facts"), F.md5(F.array_join("facts", "\n")).alias("facts_md5"),
        ev.stage_risk_level(F.col("stage")).alias("risk"),
        half_up_column((F.col("domain_confidence") + F.col("stage_confidence")) / 2, 2).alias("confidence"),
    )


def cases(spark, sf):
    stage = staged(spark, sf).select("text_id", "stage", "stage_index")
    return ev.coverage(assessed(spark, sf)).join(stage, "text_id")


@query("e10_risk_scores", f"""WITH {MENT}, {STG}, r AS (SELECT text_id, stage, round(least(100.0::DOUBLE, CASE stage {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STAGE_RISK.items())} END + (1.0::DOUBLE - coverage) * 25 + priority_gaps * 4), 4) AS risk_score FROM cv JOIN sg USING (text_id))
SELECT text_id, stage, risk_score, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS risk_level FROM r""")
def e10(spark, sf):
    return ev.risk_scores(cases(spark, sf), STAGE_RISK).select("text_id", "stage", "risk_score", "risk_level")


GOOD_WORDS = {"english": [(["ing ", "that"], "in writing"), (["ed "], "paid")], "french": [(["eau"], "in writing")], "german": [(["ung"], "signed")]}
BAD_WORDS = {"english": [(["wh"], "only oral"), (["tion"], "expired")], "spanish": [(["que"], "only oral")]}
UNDO = ["no ", "un"]


def _words_sql(table, undone):
    plain = lambda w: f"contains(tt.low, '{w}')"
    test = lambda w: plain(w) + "".join(f" AND NOT contains(tt.low, '{u}{w}')" for u in undone)
    rows = lambda entries: ", ".join(f"CASE WHEN {' OR '.join(f'({test(w)})' for w in words)} THEN '{label}' END" for words, label in entries)
    return "list_filter(CASE tt.domain " + " ".join(f"WHEN '{d}' THEN [{rows(e)}]" for d, e in table.items()) + " ELSE [] END, lambda x: x IS NOT NULL)"


def _ids_sql(status, n):
    return f"coalesce(list_slice(list_sort(list(evidence_id) FILTER (status = '{status}')), 1, {n}), [])"


@query("e10_risk_report", f"""WITH {MENT}, {STG}, r AS (SELECT text_id, stage, coverage, priority_gaps, round(least(100.0::DOUBLE, CASE stage {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STAGE_RISK.items())} END + (1.0::DOUBLE - coverage) * 25 + priority_gaps * 4), 4) AS risk_score FROM cv JOIN sg USING (text_id)),
li AS (SELECT text_id, {_ids_sql('present', 3)} AS p, {_ids_sql('uncertain', 2)} AS u, {_ids_sql('contradicted', 2)} AS c, {_ids_sql('missing', 6)} AS m FROM ga GROUP BY 1),
x AS (SELECT r.*, p, m, {_words_sql(GOOD_WORDS, UNDO)} AS g, list_concat({_words_sql(BAD_WORDS, [])}, list_concat(list_transform(u, lambda e: 'uncertain:' || e), list_transform(c, lambda e: 'contradicted:' || e))) AS w FROM r JOIN tt USING (text_id) JOIN li USING (text_id))
SELECT text_id, array_to_string(CASE WHEN len(p) > 0 THEN list_transform(p, lambda e: 'present:' || e) ELSE g END, ';') AS strengths, array_to_string(CASE WHEN len(w) = 0 AND risk_score >= 50 THEN ['little evidence'] ELSE w END, ';') AS weaknesses, array_to_string(m, ';') AS missing_points,
 concat_ws(';', CASE WHEN risk_score >= 60 THEN 'high_risk' END, CASE WHEN coverage < 0.4 THEN 'weak_evidence' END, CASE WHEN stage IN ('pre_litigation', 'in_litigation') THEN 'court' END, CASE WHEN priority_gaps >= 3 THEN 'priority_gaps' END) AS warnings FROM x""")
def e10_report(spark, sf):
    texts = texts_of(spark, sf).select("text_id", "domain", "text")
    scored = ev.risk_scores(cases(spark, sf), STAGE_RISK).join(texts, "text_id")
    report = ev.risk_report(scored, assessed(spark, sf), GOOD_WORDS, BAD_WORDS, UNDO, "little evidence")
    return report.select("text_id", *[F.array_join(c, ";").alias(c) for c in report.columns[1:]])


TYPES = [("payment", ["article", "the [a-z]+ed"]), ("term", ["khoản", "tion"]), ("liability", ["clause", "eaux"]), ("penalty", ["keit|heit", "ung "])]
HIGH = [("ción", "one_sided"), ("wh[aeo]", "unlimited")]
MEDIUM = [("les ", "vague"), (" of ", "open_ended")]
CL = SB + r""",
sx AS (SELECT doc_id, string_agg(raw_text, chr(10) ORDER BY pos) AS text FROM sb GROUP BY 1),
sp AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(\n\s*(?:Điều|Chương|Article|Section)\s+[\p{L}0-9_]+)', chr(1) || '\1', 'g'), chr(1)) AS a FROM sx),
cl AS (SELECT doc_id, part, t AS text, lower(t) AS low FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS part, trim(unnest(a), E' \n\t\r') AS t FROM sp) WHERE length(t) >= 30),
ct AS (SELECT *, CAST(contains(low, 'article') AS INTEGER) + CAST(regexp_matches(low, 'the [a-z]+ed') AS INTEGER) AS n0, CAST(contains(low, 'khoản') AS INTEGER) + CAST(contains(low, 'tion') AS INTEGER) AS n1, CAST(contains(low, 'clause') AS INTEGER) + CAST(contains(low, 'eaux') AS INTEGER) AS n2, CAST(regexp_matches(low, 'keit|heit') AS INTEGER) + CAST(contains(low, 'ung ') AS INTEGER) AS n3 FROM cl),
cc AS (SELECT doc_id, part, text, low, CASE greatest(n0, n1, n2, n3) WHEN 0 THEN 'general_provisions' WHEN n0 THEN 'payment' WHEN n1 THEN 'term' WHEN n2 THEN 'liability' ELSE 'penalty' END AS clause_type,
 CASE WHEN contains(low, 'ción') OR regexp_matches(low, 'wh[aeo]') THEN 'high' WHEN contains(low, 'les ') OR contains(low, ' of ') THEN 'medium' ELSE 'low' END AS risk_level,
 CASE WHEN contains(low, 'ción') THEN 'one_sided' WHEN regexp_matches(low, 'wh[aeo]') THEN 'unlimited' WHEN contains(low, 'les ') THEN 'vague' WHEN contains(low, ' of ') THEN 'open_ended' END AS risk_reason FROM ct)"""


def clauses(spark, sf):
    return contracts.split_articles(structured_texts(spark, sf))


@query("e11_clause_risk", f"WITH {CL} SELECT doc_id, part, clause_type, risk_level, risk_reason FROM cc")
def e11(spark, sf):
    return contracts.classify_clauses(clauses(spark, sf), TYPES, HIGH, MEDIUM).drop("text")


@query("e11_contract_compliance", f"WITH {CL}, s AS (SELECT doc_id, count(*) AS clauses, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low FROM cc GROUP BY 1) SELECT *, greatest(0, 100 - high * 15 - medium * 5) AS compliance_score FROM s")
def e11_summary(spark, sf):
    return contracts.contract_summary(contracts.classify_clauses(clauses(spark, sf), TYPES, HIGH, MEDIUM))


COACH = [("one_sided", "critical", ["ción", "keit"]), ("vague", "high", ["les ", "wh"]), ("open", "medium", [" of "]), ("late", "low", ["ment"])]
LACK = [("eaux ung", "required"), ("that", "recommended"), ("khoản tion", "required")]


@query("e12_clause_coaching", f"""WITH {CL}, k AS (SELECT *, contains(low, 'ción') OR contains(low, 'keit') AS a, contains(low, 'les ') OR contains(low, 'wh') AS b, contains(low, ' of ') AS c, contains(low, 'ment') AS d,
 NOT (contains(low, 'eaux') OR contains(low, 'ung')) AS x, NOT contains(low, 'that') AS y, NOT (contains(low, 'khoản') OR contains(low, 'tion')) AS z FROM cl),
s AS (SELECT *, least(100.0::DOUBLE, a::INT * 30 + b::INT * 20 + c::INT * 10 + d::INT * 5 + (x::INT * 10 + y::INT * 3 + z::INT * 10) * 0.5::DOUBLE) AS coach_score FROM k)
SELECT doc_id, part, concat_ws(',', CASE WHEN a THEN 'one_sided' END, CASE WHEN b THEN 'vague' END, CASE WHEN c THEN 'open' END, CASE WHEN d THEN 'late' END) AS risks, concat_ws(',', CASE WHEN x THEN 'eaux ung' END, CASE WHEN y THEN 'that' END, CASE WHEN z THEN 'khoản tion' END) AS missing,
coach_score, CASE WHEN coach_score >= 70 THEN 'critical' WHEN coach_score >= 45 THEN 'high' WHEN coach_score >= 20 THEN 'medium' ELSE 'low' END AS coach_level FROM s""")
def e12(spark, sf):
    return contracts.coach(clauses(spark, sf), COACH, LACK).drop("text")


TEMPLATES = {
    "shop_sale": [("licence", "critical", ["tion", "ung"]), ("tax", "high", [" the ", "les "]), ("stock", "low", ["wh"])],
    "shop_general": [("licence", "critical", ["ment"]), ("tax", "medium", ["en"])],
    "general_general": [("identity", "critical", ["er"]), ("record", "low", ["que", "der"])],
}


@query("e13_compliance", """WITH t AS (SELECT conv_id * 1000 + turn AS text_id, lower(text) AS low, CASE role WHEN 'user' THEN 'shop_sale' WHEN 'assistant' THEN 'shop_general' ELSE 'general_general' END AS template FROM conversations),
i AS (SELECT text_id, template, NOT (contains(low, 'tion') OR contains(low, 'ung')) AS m, 'critical' AS p FROM t WHERE template = 'shop_sale' UNION ALL SELECT text_id, template, NOT (contains(low, ' the ') OR contains(low, 'les ')), 'high' FROM t WHERE template = 'shop_sale' UNION ALL SELECT text_id, template, NOT contains(low, 'wh'), 'low' FROM t WHERE template = 'shop_sale'
 UNION ALL SELECT text_id, template, NOT contains(low, 'ment'), 'critical' FROM t WHERE template = 'shop_general' UNION ALL SELECT text_id, template, NOT contains(low, 'en'), 'medium' FROM t WHERE template = 'shop_general' UNION ALL SELECT text_id, template, NOT contains(low, 'er'), 'critical' FROM t WHERE template = 'general_general' UNION ALL SELECT text_id, template, NOT (contains(low, 'que') OR contains(low, 'der')), 'low' FROM t WHERE template = 'general_general')
SELECT text_id, template, CAST(count(*) AS INTEGER) AS items, CAST(count(*) FILTER (m) AS INTEGER) AS missing, CAST(count(*) FILTER (m AND p = 'critical') AS INTEGER) AS critical, round(1.0::DOUBLE - count(*) FILTER (m) / count(*)::DOUBLE, 6) AS score FROM i GROUP BY 1, 2""")
def e13(spark, sf):
    key = F.when(F.col("role") == "user", "shop_sale").when(F.col("role") == "assistant", "shop_general").otherwise("other_sale")
    rows = conversations(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), key.alias("template_key"), "text")
    return ev.compliance(rows, TEMPLATES, "general_general")


@query("e14_action_plan", f"""WITH {MENT}, {STG}, c AS (SELECT text_id, 0 AS place, 'stage:' || stage AS step, 'immediate' AS priority FROM sg UNION ALL SELECT text_id, 1, 'domain:' || domain, 'optional' FROM tt
 UNION ALL SELECT text_id, 2 + row_number() OVER (PARTITION BY text_id ORDER BY evidence_id), 'collect:' || evidence_id, CASE WHEN priority = 'high' THEN 'immediate' ELSE 'important' END FROM ga WHERE status <> 'present' QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY evidence_id) <= 3),
f AS (SELECT text_id, step, arg_min(priority, place) AS priority, min(place) AS place FROM c GROUP BY 1, 2)
SELECT text_id, coalesce(string_agg(step, '; ' ORDER BY place, step) FILTER (priority = 'immediate'), '') AS immediate, coalesce(string_agg(step, '; ' ORDER BY place, step) FILTER (priority = 'important'), '') AS important, coalesce(string_agg(step, '; ' ORDER BY place, step) FILTER (priority = 'optional'), '') AS optional FROM f GROUP BY 1""")
def e14(spark, sf):
    from folioweave.operators.ranking import top_per_key

    s = staged(spark, sf)
    stage = s.select("text_id", F.lit(0).alias("place"), F.concat(F.lit("stage:"), "stage").alias("step"), F.lit("immediate").alias("priority"))
    domain = s.select("text_id", F.lit(1).alias("place"), F.concat(F.lit("domain:"), "domain").alias("step"), F.lit("optional").alias("priority"))
    gaps = top_per_key(assessed(spark, sf).filter("status <> 'present'"), ["text_id"], [F.asc("evidence_id")], 3).select(
        "text_id", (F.lit(2) + F.col("rank")).alias("place"), F.concat(F.lit("collect:"), "evidence_id").alias("step"),
        F.when(F.col("priority") == "high", "immediate").otherwise("important").alias("priority"),
    )
    return ev.action_plan(stage.unionByName(domain).unionByName(gaps))


@query("e15_journey", f"""WITH {MENT}, {STG}, j AS (SELECT text_id, coverage, CAST(stage_index * 10 + priority_gaps * 20 + greatest(0, CAST(floor((0.6::DOUBLE - coverage) * 50) AS INTEGER)) AS BIGINT) AS journey_score FROM cv JOIN sg USING (text_id))
SELECT text_id, journey_score, CASE WHEN journey_score >= 60 THEN 'high' WHEN journey_score >= 30 THEN 'medium' ELSE 'low' END AS journey_risk, CASE WHEN coverage >= 0.7 THEN 'done' WHEN coverage >= 0.4 THEN 'in_progress' ELSE 'pending' END AS evidence_milestone, CASE WHEN journey_score >= 60 THEN 'warning' WHEN journey_score >= 30 THEN 'in_progress' ELSE 'done' END AS risk_milestone FROM j""")
def e15(spark, sf):
    return ev.journey(cases(spark, sf)).select("text_id", "journey_score", "journey_risk", "evidence_milestone", "risk_milestone")
