"""Scalar, cleaning, language and ingest queries over documents, pages, conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioweave.functions import ids, numbers, sql_functions
from folioweave.functions import text as tx
from folioweave.operators import cleaning, language
from folioweave.operators.ranking import top_per_key
from folioweave.plans.fixtures import (
    LN,
    SB,
    ST,
    conversations,
    documents,
    line_blocks,
    structured_texts,
    table,
)
from folioweave.plans.registry import query
from folioweave.sources import texts

# Rule sets in the vocabulary of the test texts.
OCR_FIX = [("rn", "m"), ("vv", "w"), ("([a-z])0([a-z])", "$1o$2"), ("tth", "th"), ("eea", "ea")]
PII = [
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", "[PHONE]"),
    ("card", r"\d{16}", "[CARD]"),
    ("address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "[ADDRESS]"),
]
TOPICS = [
    ("licence", ["license", "copyright"]),
    ("contact", ["example.com", "555-"]),
    ("german", [" und ", " der ", " die "]),
    ("french", [" les ", " une ", " du "]),
    ("spanish", [" los ", " para ", " el "]),
    ("english", [" the ", " of "]),
]
TOPIC_CASE = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + f" THEN '{label}'"
        for label, terms in TOPICS
    )
    + " ELSE 'general' END"
)
LANG = language.LanguageRules(
    first="fr",
    second="en",
    diacritics="[àâçèéêëîïôùûü]",
    first_structure=r"[^a-zàâçèéêëîïôùûü](?:les|des|une|dans)[^a-zàâçèéêëîïôùûü]",
    first_content=r"(?:ment|tion|eaux)[ ,.]",
    second_structure=r"[^a-z](?:the|that|with|from)[^a-z]",
    second_content=r"[^a-z](?:of|and|is|was)[^a-z]",
    first_jurisdiction=("FR", "eau"),
    second_jurisdictions=(("US", "wh"), ("GB", "sh"), ("EU", "th")),
)
LANG_SQL = """ld AS (SELECT doc_id, source, {t} AS text, lower({t}) AS low FROM {src}),
lc AS (SELECT *, length(text) AS len, len(regexp_extract_all(low, '[àâçèéêëîïôùûü]')) AS dia,
 len(regexp_extract_all(low, '[^a-zàâçèéêëîïôùûü](?:les|des|une|dans)[^a-zàâçèéêëîïôùûü]')) AS fs,
 len(regexp_extract_all(low, '(?:ment|tion|eaux)[ ,.]')) AS fc,
 len(regexp_extract_all(low, '[^a-z](?:the|that|with|from)[^a-z]')) AS ss,
 len(regexp_extract_all(low, '[^a-z](?:of|and|is|was)[^a-z]')) AS sc FROM ld),
ls AS (SELECT *, dia / greatest(len, 1)::DOUBLE AS den,
 CASE WHEN ss >= 3 THEN 0.35 WHEN ss >= 1 THEN 0.2 ELSE 0 END + CASE WHEN sc >= 3 THEN 0.3 WHEN sc >= 1 THEN 0.15 ELSE 0 END AS plain FROM lc),
lf AS (SELECT *, CAST(least(1, CASE WHEN den > 0.05 THEN 0.5 WHEN den > 0.01 THEN 0.25 ELSE 0 END + CASE WHEN fs >= 3 THEN 0.3 WHEN fs >= 1 THEN 0.15 ELSE 0 END
 + CASE WHEN fc >= 3 THEN 0.25 WHEN fc >= 1 THEN 0.1 ELSE 0 END) AS DECIMAL(9,3)) AS f,
 CAST(least(1, plain + CASE WHEN dia = 0 AND plain > 0 THEN 0.1 ELSE 0 END) AS DECIMAL(9,3)) AS s FROM ls),
lang0 AS (SELECT *, CASE WHEN trim(text) = '' OR (f = 0 AND s = 0) THEN 'unknown' WHEN f - s >= 0.25 THEN 'fr' WHEN s - f >= 0.25 THEN 'en' ELSE 'mixed' END AS language FROM lf),
lang AS (SELECT doc_id, source, language, CAST(CASE language WHEN 'unknown' THEN 0 WHEN 'fr' THEN f WHEN 'en' THEN s ELSE round((f + s) / 2, 3) END AS DOUBLE) AS lang_confidence,
 coalesce(CASE WHEN f > 0 AND contains(low, 'eau') THEN 'FR' WHEN s > 0 THEN CASE WHEN contains(low, 'wh') THEN 'US' WHEN contains(low, 'sh') THEN 'GB' WHEN contains(low, 'th') THEN 'EU' END END,
  CASE WHEN language = 'fr' OR (language = 'mixed' AND f > 0) THEN 'FR' END) AS jurisdiction,
 fs, ss FROM lang0)"""
NORM = r"lower(trim(regexp_replace(raw_text, '\s+', ' ', 'g')))"


# --- scalar functions ---------------------------------------------------------

@query("f01_normalize", r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM documents")
def f01(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@query("f02_strip_control", r"SELECT doc_id, length(regexp_replace(text || chr(7), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS n FROM documents")
def f02(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.length(tx.strip_control(F.concat("text", F.lit("\x07")))).cast("bigint").alias("n")
    )


@query("f03_fold_accents", "SELECT doc_id, md5(replace(strip_accents(lower(text)), 'đ', 'd')) AS digest FROM documents")
def f03(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.fold_accents(F.col("text"))).alias("digest"))


@query("f04_fold_for_matching", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9_\s/.\-]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def f04(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.fold_for_matching(F.col("text"))).alias("digest"))


@query("f05_nfkc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def f05(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.nfkc(F.col("text"))).alias("digest"))


@query("f06_roman_numbers", """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, q AS value, CAST(q AS VARCHAR) AS number FROM r""")
def f06(spark, sf):
    q = F.col("l_quantity").cast("int")
    tens = F.element_at(F.array(*map(F.lit, ["", "X", "XX", "XXX", "XL", "L"])), F.floor(q / 10).cast("int") + 1)
    ones = F.element_at(
        F.array(*map(F.lit, ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"])), (q % 10) + 1
    )
    roman = F.concat(tens, ones)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.roman_value(roman).alias("value"),
        numbers.plain_number(roman).alias("number"),
    ).distinct()


@query("f07_occurrences", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS INTEGER) AS n_the, CAST((length(text) - length(replace(text, 'e', ''))) AS INTEGER) AS n_e FROM documents")
def f07(spark, sf):
    return documents(spark, sf).select(
        "doc_id", tx.occurrences(F.col("text"), "the").alias("n_the"), tx.occurrences(F.col("text"), "e").alias("n_e")
    )


@query("f08_token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def f08(spark, sf):
    return documents(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("f09_content_ids", """SELECT doc_id, 'doc_' || substr(sha256(source || '::' || sha256(text)), 1, 16) AS document_key,
doc_id || '__chunk' || lpad(CAST(n_chars % 100000 AS VARCHAR), 5, '0') AS chunk_key, substr(md5(text), 1, 12) AS short_key FROM documents""")
def f09(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        ids.digest_id("doc", F.col("source"), F.sha2("text", 256)).alias("document_key"),
        ids.positional_id(F.col("doc_id"), "_chunk", F.col("n_chars") % 100000, 5).alias("chunk_key"),
        ids.short_md5(F.col("text")).alias("short_key"),
    )


@query("f11_decay_and_penalty", """SELECT doc_id, round(exp(-ln(2.0::DOUBLE) / 180.0::DOUBLE * (doc_id % 400)), 6) AS fresh,
round(least(0.2::DOUBLE, log10(greatest(1, length(text))::DOUBLE) / 20.0::DOUBLE), 6) AS penalty FROM documents""")
def f11(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.round(numbers.freshness((F.col("doc_id") % 400).cast("double")), 6).alias("fresh"),
        F.round(F.least(F.lit(0.2), F.log10(F.greatest(F.lit(1), F.length("text"))) / 20.0), 6).alias("penalty"),
    )


@query("f12_time_parts", """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%Y-%m-%d') AS day,
round(date_diff('microsecond', ts, TIMESTAMP '2024-01-31 00:00:00') / 8.64e10::DOUBLE, 6) AS age_days FROM events""")
def f12(spark, sf):
    from folioweave.operators.interactions import days_between, instant

    return table(spark, sf, "events").select(
        "event_id", F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.round(days_between(instant("2024-01-31 00:00:00"), F.col("ts")), 6).alias("age_days"),
    )


@query("f13_parse_timestamps", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events""")
def f13(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    parsed = F.try_to_timestamp(text)
    return table(spark, sf, "events").select("event_id", F.unix_micros(parsed).alias("us"))


@query("f14_all_matches", """SELECT doc_id, array_to_string(list_slice(x, 1, 4), '|') AS found, CAST(len(x) AS INTEGER) AS n FROM (SELECT doc_id,
 (SELECT list(v ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(m) AS v, unnest(range(len(m))) AS i) GROUP BY v)) AS x
 FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m FROM documents)) WHERE len(x) > 0""")
def f14(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.array_join(tx.all_matches(F.col("text"), r"[0-9]+", cap=4), "|").alias("found"),
        F.size(tx.all_matches(F.col("text"), r"[0-9]+")).alias("n"),
    ).filter("n > 0")


@query("f15_sentences", r"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n, s[1] AS first_sentence, s[len(s)] AS last_sentence FROM (SELECT doc_id,
 list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) >= 5) AS s FROM documents) WHERE len(s) > 0""")
def f15(spark, sf):
    s = tx.sentences(F.col("text"), 5)
    return documents(spark, sf).select("doc_id", s.alias("s")).filter(F.size("s") > 0).select(
        "doc_id", F.size("s").alias("n"), F.element_at("s", 1).alias("first_sentence"),
        F.element_at("s", -1).alias("last_sentence"),
    )


@query("f16_clamp_and_round", "SELECT event_id, round(greatest(-5.0::DOUBLE, least(20.0::DOUBLE, value - 10)), 3) AS v FROM events")
def f16(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(numbers.clamp(F.col("value") - 10, -5.0, 20.0), 3).alias("v")
    )


@query("f17_array_operators", """SELECT doc_id, w[1] AS first_word, w[len(w)] AS last_word, CAST(len(w) AS INTEGER) AS n_words,
array_to_string(list_transform(range(1, least(4, len(w))), lambda i: w[i] || '>' || w[i + 1]), ' ') AS pairs FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def f17(spark, sf):
    w = F.col("w")
    last = F.least(F.lit(3), F.size(w) - 1)
    pairs = F.when(last < 1, F.lit("")).otherwise(
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                lambda i: F.concat(F.element_at(w, i), F.lit(">"), F.try_element_at(w, i + 1)),
            ),
            " ",
        )
    )
    return documents(spark, sf).select("doc_id", F.split("text", " ").alias("w")).select(
        "doc_id", F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"),
        F.size("w").alias("n_words"), pairs.alias("pairs"),
    )


@query("f18_map_counters", """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS total, max(n) AS best, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters FROM c GROUP BY 1""")
def f18(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m")
    )
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select(
        "user_id",
        F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"),
        F.array_max(F.map_values("m")).alias("best"),
        F.array_join(pairs, ",").alias("counters"),
    )


@query("f19_json_columns", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
'{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc FROM events""")
def f19(spark, sf):
    broken = F.when(F.col("event_id") % 5 == 0, F.lit("{oops")).otherwise(F.col("props"))
    parsed = F.from_json(broken, "k int", {"mode": "PERMISSIVE"})
    return table(spark, sf, "events").select(
        "event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"),
    )


@query("f20_ellipsis", r"""SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), '\s+\S*$', '') || '…' END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def f20(spark, sf):
    return documents(spark, sf).select("doc_id", tx.ellipsis(tx.collapse_spaces(F.col("text")), 60).alias("short"))


@query("f21_strip_tags", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'))) AS digest FROM pages")
def f21(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("digest"))


@query("f22_alnum_ratio", rf"WITH {LN} SELECT doc_id, pos, round(length(regexp_replace(raw_text, '[^\p{{L}}\p{{N}}]', '', 'g')) / greatest(length(raw_text), 1)::DOUBLE, 6) AS ratio FROM ln")
def f22(spark, sf):
    return line_blocks(spark, sf).select("doc_id", "pos", F.round(tx.alnum_ratio(F.col("raw_text")), 6).alias("ratio"))


@query("f23_percent_rounding", "SELECT source, round(100.0::DOUBLE * count(*) FILTER (lang = 'en') / count(*), 4) AS pct_en, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def f23(spark, sf):
    return documents(spark, sf).groupBy("source").agg(
        F.round(F.lit(100.0) * F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 4).alias("pct_en"),
        F.round(F.avg("n_chars"), 4).alias("mean_chars"),
    )


@query("sql_function_library", """SELECT doc_id, CAST(length(replace(strip_accents(lower(text)), 'đ', 'd')) AS INTEGER) AS folded,
CAST((length(text) - length(replace(text, 'an', ''))) // 2 AS INTEGER) AS n_an, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents""")
def sql_library(spark, sf):
    sql_functions.register(spark)
    return documents(spark, sf).selectExpr(
        "doc_id", "length(fold_accents(text)) AS folded", "count_term(text, 'an') AS n_an",
        "token_estimate(text) AS tokens",
    )


# --- sources ------------------------------------------------------------------

@query("s02_html_blocks", r"""WITH b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
 '(?i)<(p|h[1-5]|li)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(?:p|h[1-5]|li)\s*>', chr(1) || chr(2), 'g'), chr(1)) AS parts FROM pages),
p AS (SELECT page_id, CAST(unnest(range(len(parts))) AS INTEGER) AS part, unnest(parts) AS piece FROM b),
x AS (SELECT page_id, part, lower(split_part(piece, chr(2), 1)) AS tag, regexp_replace(split_part(piece, chr(2), 2), '<[^>]+>', '', 'g') AS c FROM p WHERE contains(piece, chr(2)))
SELECT page_id, part, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS raw_text
FROM x WHERE tag <> '' AND trim(regexp_replace(replace(c, '&nbsp;', ' '), '\s+', ' ', 'g')) <> ''""")
def s02(spark, sf):
    return texts.html_blocks(table(spark, sf, "pages"))


def order_html():
    """One HTML table per order, built from its lines."""
    return F.concat(
        F.lit("<p>order</p><table class=\"g\"><tr><th>part</th><th>quantity &amp; flag</th></tr>"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag"))),
                lambda s: F.concat(
                    F.lit("<tr><td>"), s["l_partkey"], F.lit("</td><td> <b>"), s["l_quantity"].cast("int"),
                    F.lit("</b> "), s["l_returnflag"], F.lit("</td></tr>"),
                ),
            ),
            "",
        ),
        F.lit("</table>"),
    )


CELLS = """cells AS (SELECT l_orderkey, CAST(0 AS INTEGER) AS row_no, CAST(c AS INTEGER) AS col_no, CASE c WHEN 0 THEN 'part' ELSE 'quantity & flag' END AS text, true AS is_header
 FROM (SELECT DISTINCT l_orderkey FROM lineitem), (VALUES (0), (1)) v(c)
 UNION ALL SELECT l_orderkey, CAST(rn AS INTEGER), CAST(c AS INTEGER), CASE c WHEN 0 THEN CAST(l_partkey AS VARCHAR) ELSE CAST(l_quantity AS INTEGER) || ' ' || l_returnflag END, false
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS rn FROM lineitem), (VALUES (0), (1)) v(c))"""


def order_cells(spark, sf):
    html = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(order_html().alias("html"))
    return texts.html_cells(html, "l_orderkey")


@query("s03_html_table_cells", f"WITH {CELLS} SELECT l_orderkey, row_no, col_no, text, is_header FROM cells")
def s03(spark, sf):
    return order_cells(spark, sf).drop("table_no")


@query("s08_table_rows", f"""WITH {CELLS}, r AS (SELECT l_orderkey, row_no, bool_or(is_header) AS is_header, '| ' || string_agg(text, ' | ' ORDER BY col_no) || ' |' AS line FROM cells GROUP BY 1, 2)
SELECT l_orderkey, row_no, is_header, CASE WHEN is_header THEN line || chr(10) || '| --- | --- |' ELSE line END AS markdown FROM r""")
def s08(spark, sf):
    return texts.table_rows(order_cells(spark, sf), ["l_orderkey"])


@query("s04_html_plain", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def s04(spark, sf):
    return texts.html_plain(table(spark, sf, "pages")).select("page_id", F.md5("text").alias("digest"))


@query("s05_line_units", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(len(a))) AS INTEGER) AS pos, unnest(a) AS raw_text FROM l),
n AS (SELECT *, lower(regexp_replace(raw_text, '\s+', ' ', 'g')) AS norm FROM u)
SELECT doc_id, pos, raw_text FROM n QUALIFY length(norm) >= 80 OR row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) = 1""")
def s05(spark, sf):
    return texts.line_units(documents(spark, sf))


@query("s06_merged_blocks", rf"""WITH {SB}, l AS (SELECT doc_id, pos, trim(raw_text) AS line FROM sb WHERE trim(raw_text) <> ''),
m AS (SELECT *, regexp_matches(line, '(?i)^\s*(?:Điều|Khoản|Chương|Mục|Phần|Điểm)\s+[\p{{L}}0-9_]+') OR regexp_matches(line, '^\s*(?:[0-9]+[.)]|[a-zA-Z][.)]|\([0-9]+\))\s+\S') AS alone FROM l),
s AS (SELECT *, alone OR coalesce(lag(alone) OVER (PARTITION BY doc_id ORDER BY pos), true) AS starts FROM m),
g AS (SELECT *, CAST(sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS block_no FROM s)
SELECT doc_id, block_no, string_agg(line, ' ' ORDER BY pos) AS raw_text, bool_or(alone) AS standalone FROM g GROUP BY 1, 2""")
def s06(spark, sf):
    return texts.merged_blocks(structured_texts(spark, sf))


@query("s07_article_pieces", rf"""WITH {ST}, b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g')) AS body FROM st),
p0 AS (SELECT doc_id, string_split(regexp_replace(body, '(Điều\s+[0-9]+[\s.:])', chr(1) || '\1', 'g'), chr(1)) AS a FROM b),
p AS (SELECT doc_id, unnest(range(len(a))) AS i, trim(unnest(a)) AS p FROM p0),
ok AS (SELECT * FROM p WHERE length(p) >= 60),
u AS (SELECT doc_id, i, -1 AS j, p AS t FROM ok WHERE length(p) <= 900
 UNION ALL SELECT doc_id, i, unnest(range(len(x))), unnest(x) FROM (SELECT doc_id, i, list_filter(list_transform(string_split(p, chr(10)), lambda y: trim(y)), lambda y: length(y) >= 60) AS x FROM ok WHERE length(p) > 900)),
f AS (SELECT * FROM u UNION ALL SELECT doc_id, 0, -1, body FROM b WHERE length(body) >= 60 AND doc_id NOT IN (SELECT doc_id FROM u)),
k AS (SELECT doc_id, i, j, t, unnest(range((length(t) - 1) // 900 + 1)) AS k FROM f)
SELECT doc_id, CAST(i AS INTEGER) AS article, CAST(j AS INTEGER) AS paragraph, CAST(k AS INTEGER) AS slice, md5(substr(t, CAST(k * 900 + 1 AS BIGINT), 900)) AS digest,
CASE WHEN contains(lower(substr(t, CAST(k * 900 + 1 AS BIGINT), 900)), 'license') THEN 'licence' ELSE 'general' END AS topic FROM k""")
def s07(spark, sf):
    pieces = texts.article_pieces(structured_texts(spark, sf))
    return pieces.select(
        "doc_id", "article", "paragraph", "slice", F.md5("text").alias("digest"),
        tx.first_label(F.lower("text"), [("licence", ["license"])], "general").alias("topic"),
    )


# --- cleaning -----------------------------------------------------------------

FLAGS = LN + rf""",
n0 AS (SELECT doc_id, source, pos, raw_text, {NORM} AS norm, regexp_matches(trim(raw_text), '^[\-–—\s]*[0-9]{{1,4}}[\-–—\s]*$|^[Pp]age\s+[0-9]+(\s+of\s+[0-9]+)?$|^[Tt]rang\s+[0-9]+(\s*/\s*[0-9]+)?$') AS pg FROM ln),
n1 AS (SELECT *, CASE WHEN pg THEN 'noise_page_number' WHEN length(norm) <= 120 AND count(*) OVER (PARTITION BY doc_id, norm) >= 3 THEN 'noise_repeated_line' END AS noise FROM n0),
fl AS (SELECT *, CASE WHEN noise IS NULL AND length(norm) > 40 AND pos > min(CASE WHEN noise IS NULL THEN pos END) OVER (PARTITION BY doc_id, norm)
  THEN min(CASE WHEN noise IS NULL THEN pos END) OVER (PARTITION BY doc_id, norm) END AS duplicate_of FROM n1)"""


@query("t01_page_number_noise", f"WITH {FLAGS} SELECT doc_id, pos, raw_text FROM fl WHERE noise = 'noise_page_number' UNION ALL SELECT -1, CAST(count(*) AS INTEGER), 'lines' FROM fl")
def t01(spark, sf):
    flagged = cleaning.flag_blocks(line_blocks(spark, sf))
    total = flagged.agg(F.count(F.lit(1)).cast("int").alias("pos")).select(
        F.lit(-1).cast("bigint").alias("doc_id"), "pos", F.lit("lines").alias("raw_text")
    )
    return flagged.filter(F.col("noise") == "noise_page_number").select("doc_id", "pos", "raw_text").unionByName(total)


@query("t02_repeated_lines", f"WITH {FLAGS} SELECT doc_id, norm, count(*) AS n FROM fl WHERE noise = 'noise_repeated_line' GROUP BY 1, 2")
def t02(spark, sf):
    flagged = cleaning.flag_blocks(line_blocks(spark, sf))
    return flagged.filter(F.col("noise") == "noise_repeated_line").groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"))


@query("t03_duplicate_blocks", f"WITH {FLAGS} SELECT doc_id, pos, duplicate_of FROM fl WHERE duplicate_of IS NOT NULL")
def t03(spark, sf):
    flagged = cleaning.flag_blocks(line_blocks(spark, sf))
    return flagged.filter(F.col("duplicate_of").isNotNull()).select("doc_id", "pos", "duplicate_of")


@query("t04_cleaning_summary", f"""WITH {FLAGS}, c AS (SELECT doc_id, count(*) AS n_blocks, count(noise) AS n_noise, count(duplicate_of) AS n_duplicates FROM fl GROUP BY 1)
SELECT doc_id, n_blocks, n_noise, n_duplicates, round(least(1.0::DOUBLE, n_blocks / greatest(1, greatest(1, (length(text) // 4) // 2000) * 3)::DOUBLE), 3) AS coverage,
CASE WHEN n_blocks = 0 THEN 'fail' WHEN n_noise > 0 OR n_duplicates > 0 THEN 'warning' ELSE 'pass' END AS status FROM documents JOIN c USING (doc_id)""")
def t04(spark, sf):
    pages = language.profile(documents(spark, sf)).select("doc_id", "page_count")
    return cleaning.cleaning_summary(cleaning.flag_blocks(line_blocks(spark, sf)), pages)


@query("t05_recognised_text_cleanup", r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '-\s*\n\s*', '', 'g'), '([^.?!])\n\s+(\p{Ll}+)', '\1 \2', 'g') AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: len(regexp_split_to_array(trim(x), '\s+')) >= 3
 AND length(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(x), 1)::DOUBLE >= 0.3), lambda x: trim(x)), chr(10))) AS digest FROM a""")
def t05(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(cleaning.clean_recognised_text(F.col("text"))).alias("digest"))


FIXED = "replace(regexp_replace(replace(replace(text, 'rn', 'm'), 'vv', 'w'), '([a-z])0([a-z])', '\\1o\\2', 'g'), 'tth', 'th')"


@query("t06_token_repair", f"SELECT doc_id, md5(replace({FIXED}, 'eea', 'ea')) AS digest, replace({FIXED}, 'eea', 'ea') <> text AS changed FROM documents")
def t06(spark, sf):
    return cleaning.repair_tokens(documents(spark, sf), OCR_FIX).select("doc_id", F.md5("fixed").alias("digest"), "changed")


@query("t06_repair_report", r"""WITH s AS (SELECT text AS t0, replace(text, 'rn', 'm') AS t1, replace(replace(text, 'rn', 'm'), 'vv', 'w') AS t2 FROM documents),
s3 AS (SELECT *, regexp_replace(t2, '([a-z])0([a-z])', '\1o\2', 'g') AS t3 FROM s), s4 AS (SELECT *, replace(t3, 'tth', 'th') AS t4 FROM s3),
c AS (SELECT CAST(sum(len(regexp_extract_all(t0, 'rn'))) AS BIGINT) a, CAST(sum(len(regexp_extract_all(t1, 'vv'))) AS BIGINT) b, CAST(sum(len(regexp_extract_all(t2, '([a-z])0([a-z])'))) AS BIGINT) d,
 CAST(sum(len(regexp_extract_all(t3, 'tth'))) AS BIGINT) e, CAST(sum(len(regexp_extract_all(t4, 'eea'))) AS BIGINT) f FROM s4)
SELECT unnest(['rule_00', 'rule_01', 'rule_02', 'rule_03', 'rule_04']) AS rule, unnest([a, b, d, e, f]) AS hits FROM c""")
def t06_report(spark, sf):
    return cleaning.repair_report(documents(spark, sf), OCR_FIX)


@query("t07_confident_words", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents), u AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS word FROM w)
SELECT doc_id, md5(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (trim(word) <> '' AND (i * 37) % 101 >= 60), '')) AS digest FROM u GROUP BY 1""")
def t07(spark, sf):
    words = F.split("text", " ")
    conf = F.transform(words, lambda _, i: (i * 37) % 101)
    return documents(spark, sf).select(
        "doc_id", F.md5(cleaning.confident_words(words, conf, 60)).alias("digest")
    )


# --- profile, language, classification ---------------------------------------

@query("t08_document_profile", r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(length(text) // 4 AS INTEGER) AS tokens, CAST(greatest(1, (length(text) // 4) // 2000) AS INTEGER) AS page_count,
contains(lower(text), '<table') OR regexp_matches(text, '\|.*\||\t.*\t') AS has_tables, contains(lower(text), '<img') AS has_images,
length(text) // 4 >= 20000 OR greatest(1, (length(text) // 4) // 2000) >= 30 AS is_long FROM documents""")
def t08(spark, sf):
    return language.profile(documents(spark, sf)).select(
        "doc_id", "chars", "tokens", "page_count", "has_tables", "has_images", "is_long"
    )


@query("t09_extraction_route", """SELECT doc_id, CASE WHEN ft IN ('docx', 'html') OR cov >= 0.8 THEN CASE WHEN length(text) // 4 >= 20000 THEN 'long_local' ELSE 'simple_local' END WHEN cov < 0.2 THEN 'scan_recovery' ELSE 'hybrid_region_precision' END AS route
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'docx' ELSE 'pdf' END AS ft, least(1.0::DOUBLE, length(text) / (greatest(1, (length(text) // 4) // 2000) * 500)::DOUBLE) AS cov FROM documents)""")
def t09(spark, sf):
    p = language.profile(documents(spark, sf))
    kind = F.when(F.col("doc_id") % 4 == 0, "html").when(F.col("doc_id") % 4 == 1, "docx").otherwise("pdf")
    coverage = F.least(F.lit(1.0), F.col("chars") / (F.col("page_count") * 500))
    return p.select("doc_id", language.extraction_route(kind, coverage, F.col("is_long")).alias("route"))


@query("t10_language", f"WITH {LANG_SQL.format(t='text', src='documents')} SELECT doc_id, language, lang_confidence, jurisdiction FROM lang")
def t10(spark, sf):
    return language.detect_language(documents(spark, sf), "text", LANG).select(
        "doc_id", "language", "lang_confidence", "jurisdiction"
    )


@query("t11_language_rollup", f"""WITH {LANG_SQL.format(t='text', src='documents')}, m AS (SELECT source, count(*) AS n, avg(CASE language WHEN 'fr' THEN lang_confidence WHEN 'mixed' THEN lang_confidence * 0.5::DOUBLE ELSE 0 END) AS f,
 avg(CASE language WHEN 'en' THEN lang_confidence WHEN 'mixed' THEN lang_confidence * 0.5::DOUBLE ELSE 0 END) AS s FROM lang GROUP BY 1),
v AS (SELECT source, jurisdiction FROM lang WHERE jurisdiction IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, jurisdiction) = 1),
l AS (SELECT *, CASE WHEN round(f - s, 6) >= 0.15 THEN 'fr' WHEN round(f - s, 6) <= -0.15 THEN 'en' ELSE 'mixed' END AS language FROM m)
SELECT source, n, language, round(CASE language WHEN 'fr' THEN least(f, 1.0::DOUBLE) WHEN 'en' THEN least(s, 1.0::DOUBLE) ELSE (f + s) / 2 END, 3) AS lang_confidence, coalesce(jurisdiction, CASE WHEN language = 'fr' THEN 'FR' END) AS jurisdiction FROM l LEFT JOIN v USING (source)""")
def t11(spark, sf):
    detected = language.detect_language(documents(spark, sf), "text", LANG)
    return language.language_rollup(detected, "source", "fr", "en", "FR")


@query("t12_quick_language", """SELECT doc_id, CASE WHEN a AND b THEN 'fr,en' WHEN a THEN 'fr' ELSE 'en' END AS langs, len(list_intersect(regexp_split_to_array(lower(text), '\\s+'), ['the', 'of', 'and'])) > 0 AS english_words FROM (SELECT doc_id, text, regexp_matches(lower(text), '[àâçèéêëîïôùûü]') OR contains(lower(text), ' les ') AS a, contains(lower(text), ' the ') OR contains(lower(text), ' and ') AS b FROM documents)""")
def t12(spark, sf):
    langs = language.quick_languages(F.col("text"), "[àâçèéêëîïôùûü]", " les ", " the | and ", "fr", "en")
    return documents(spark, sf).select(
        "doc_id", F.array_join(langs, ",").alias("langs"),
        language.stop_word_overlap(F.col("text"), ["the", "of", "and"]).alias("english_words"),
    )


@query("t13_document_type", f"SELECT doc_id, {TOPIC_CASE} AS label FROM documents")
def t13(spark, sf):
    return documents(spark, sf).select("doc_id", tx.first_label(F.lower("text"), TOPICS, "general").alias("label"))


@query("t14_topic_tags", f"WITH t AS (SELECT source, {TOPIC_CASE} AS topic, n_chars FROM documents) SELECT source, topic, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM t GROUP BY 1, 2")
def t14(spark, sf):
    return (
        documents(spark, sf)
        .select("source", "n_chars", tx.first_label(F.lower("text"), TOPICS, "general").alias("topic"))
        .groupBy("source", "topic")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    )


REDACT = r"""r0 AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')) AS n_email, regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS t1 FROM documents),
r1 AS (SELECT *, len(regexp_extract_all(t1, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS n_phone, regexp_replace(t1, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}', '[PHONE]', 'g') AS t2 FROM r0),
r2 AS (SELECT *, len(regexp_extract_all(t2, '[0-9]{16}')) AS n_card, regexp_replace(t2, '[0-9]{16}', '[CARD]', 'g') AS t3 FROM r1),
r3 AS (SELECT *, len(regexp_extract_all(t3, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS n_address, regexp_replace(t3, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[ADDRESS]', 'g') AS t4 FROM r2)"""


@query("t15_redaction", rf"""WITH {REDACT}, rs AS (SELECT *, trim(regexp_replace(t4, '\s{{2,}}', ' ', 'g')) AS s FROM r3) SELECT doc_id, md5(CASE WHEN length(s) < 10 THEN 'Tình huống pháp lý cần tư vấn.' ELSE s END) AS digest, CAST(n_email + n_phone + n_card + n_address AS INTEGER) AS redaction_count,
concat_ws(',', CASE WHEN n_email > 0 THEN 'email' END, CASE WHEN n_phone > 0 THEN 'phone' END, CASE WHEN n_card > 0 THEN 'card' END, CASE WHEN n_address > 0 THEN 'address' END) AS flags FROM rs""")
def t15(spark, sf):
    out = cleaning.redact(documents(spark, sf), PII)
    return out.select("doc_id", F.md5("safe_summary").alias("digest"), "redaction_count", F.array_join("risk_flags", ",").alias("flags"))


@query("t15_redaction_report", rf"""WITH {REDACT} SELECT source, CAST(sum(n_email) AS BIGINT) AS email, CAST(sum(n_phone) AS BIGINT) AS phone, CAST(sum(n_card) AS BIGINT) AS card, CAST(sum(n_address) AS BIGINT) AS address,
count(*) FILTER (n_email + n_phone + n_card + n_address > 0) AS docs_redacted, count(*) AS docs FROM r3 GROUP BY 1""")
def t15_report(spark, sf):
    return cleaning.redaction_report(
        cleaning.redact(documents(spark, sf), PII), "source", [f for f, _, _ in PII]
    )


SCRUB = [("format", r"(?i)</?(?:system|user)>"), ("injection", r"(?i)\b(?:the|that) (?:and|of)\b"), ("role_switch", r"(?i)\bis the\b")]


@query("t16_scrub", r"""WITH a AS (SELECT conv_id, turn, '<' || role || '>' || text AS t FROM conversations),
b AS (SELECT *, len(regexp_extract_all(t, '(?i)</?(?:system|user)>')) AS h1, regexp_replace(t, '(?i)</?(?:system|user)>', '[đã lọc]', 'g') AS t1 FROM a),
c AS (SELECT *, len(regexp_extract_all(t1, '(?i)\b(?:the|that) (?:and|of)\b')) AS h2, regexp_replace(t1, '(?i)\b(?:the|that) (?:and|of)\b', '[đã lọc]', 'g') AS t2 FROM b),
d AS (SELECT *, len(regexp_extract_all(t2, '(?i)\bis the\b')) AS h3, regexp_replace(t2, '(?i)\bis the\b', '[đã lọc]', 'g') AS t3 FROM c)
SELECT conv_id, turn, nullif(trim(substr(t3, 1, 500)), '') AS clean, CAST(h1 + h2 + h3 AS INTEGER) AS hits FROM d""")
def t16(spark, sf):
    turns = conversations(spark, sf).withColumn("t", F.concat(F.lit("<"), "role", F.lit(">"), "text"))
    clean, hits = cleaning.scrub(F.col("t"), "notes", SCRUB)
    return turns.select("conv_id", "turn", clean.alias("clean"), hits.alias("hits"))


FACTS = {"topic": r"(?:of|the|that) ([a-z]{4,10})[ .,]", "age": r"\b(\d{1,2})\b", "place": r"(?: in| à| zu) ([a-z]{5,12})"}


@query("t17_personal_facts", r"""WITH m AS (SELECT conv_id AS user_id, turn AS seq, 'topic' AS fact, regexp_extract(text, '(?:of|the|that) ([a-z]{4,10})[ .,]', 1) AS value FROM conversations
 UNION ALL SELECT conv_id, turn, 'age', regexp_extract(text, '\b([0-9]{1,2})\b', 1) FROM conversations
 UNION ALL SELECT conv_id, turn, 'place', regexp_extract(text, '(?: in| à| zu) ([a-z]{5,12})', 1) FROM conversations)
SELECT user_id, fact, arg_min(value, seq) AS value, min(seq) AS seq FROM m WHERE value <> '' AND (fact <> 'age' OR TRY_CAST(value AS INTEGER) BETWEEN 10 AND 100) GROUP BY 1, 2""")
def t17(spark, sf):
    turns = conversations(spark, sf).select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), "text")
    return cleaning.personal_facts(turns, FACTS)


# --- windows and aggregates over the corpus ----------------------------------

@query("w06_line_frequency", f"WITH {LN}, n AS (SELECT doc_id, pos, {NORM} AS norm FROM ln) SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, norm) AS n, min(pos) OVER (PARTITION BY doc_id, norm) AS first_pos FROM n")
def w06(spark, sf):
    same = Window.partitionBy("doc_id", "norm")
    rows = line_blocks(spark, sf).select("doc_id", "pos", tx.normalize(F.col("raw_text")).alias("norm"))
    return rows.select("doc_id", "pos", F.count(F.lit(1)).over(same).alias("n"), F.min("pos").over(same).alias("first_pos"))


@query("a12_corpus_metrics", """SELECT source, count(*) AS docs, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars,
round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_en FROM documents GROUP BY 1""")
def a12(spark, sf):
    return documents(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
        F.round(F.avg(F.when(F.col("lang") == "en", 1.0).otherwise(0.0)), 6).alias("share_en"),
    )


@query("a14_upper_median", """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, n_chars AS median_chars, n FROM r WHERE rn = n // 2 + 1""")
def a14(spark, sf):
    # lengths are pre-counted, so a hot language sends one row per distinct length
    counts = documents(spark, sf).groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lang")
    run = counts.withColumns(
        {"upto": F.sum("c").over(w.orderBy("n_chars")), "n": F.sum("c").over(w)}
    )
    target = F.floor(F.col("n") / 2) + 1
    return run.filter((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target)).select(
        "lang", F.col("n_chars").alias("median_chars"), "n"
    )


@query("a15_ordered_text", """SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, substr(string_agg(role, '; ' ORDER BY turn), 1, 300) AS roles FROM conversations GROUP BY 1""")
def a15(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = conversations(spark, sf).groupBy("conv_id").agg(ordered.alias("t"))
    return rows.select(
        "conv_id",
        F.md5(F.array_join(F.transform("t", lambda s: s["text"]), "\n\n")).alias("digest"),
        F.substring(F.array_join(F.transform("t", lambda s: s["role"]), "; "), 1, 300).alias("roles"),
    )


@query("a16_majority_vote", "WITH c AS (SELECT source, lang, count(*) AS votes FROM documents GROUP BY 1, 2) SELECT source, lang, votes FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY votes DESC, lang) = 1")
def a16(spark, sf):
    votes = documents(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("votes"))
    return top_per_key(votes, ["source"], [F.desc("votes"), F.asc("lang")], 1).drop("rank")


@query("q12_topic_inventory", f"""WITH t AS (SELECT doc_id, {TOPIC_CASE} AS topic, contains(text, 'License') AS phrase FROM documents)
SELECT topic, count(*) AS n, count(*) FILTER (phrase) AS with_phrase, min(doc_id) FILTER (phrase) AS sample FROM t GROUP BY 1""")
def q12(spark, sf):
    rows = documents(spark, sf).select(
        "doc_id", tx.first_label(F.lower("text"), TOPICS, "general").alias("topic"),
        F.contains("text", F.lit("License")).alias("phrase"),
    )
    return rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("phrase").alias("with_phrase"),
        F.min(F.when(F.col("phrase"), F.col("doc_id"))).alias("sample"),
    )
