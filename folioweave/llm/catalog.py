"""Queries of the training-data operators with their check SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm import bpe, chat, clustering, decontaminate, hard_negatives, html_extract, packing, ppm, quality_rules, sharding, simhash, token_counts, warc
from folioweave.llm.common import table, word_bpe_path
from folioweave.plans.registry import QueryFn, prepared

#: The vocabulary of the token counts, where the public package keeps it.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The byte-level vocabulary of the packed sequences.
BYTES = public_tokenizers.path("byte_bpe_50k.json")

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = prepared(fn)
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return register


@query("op1_byte_ppm")
def code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return ppm.score_documents(table(spark, sf_dir, "documents"), fold != 2)


@query("op2_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score_quality(docs, model)


@query("op3_latent_decontamination")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_trie_token_counts")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


@query("op5_article_text")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
     w AS (SELECT h, max(page_id) AS first FROM d GROUP BY h),
     b AS (SELECT h, first, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || h[i])::INTEGER), 4, '0')), lambda x, y: x || y) AS bits FROM w)
SELECT d.page_id, d.n AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + 16 * bits[5*i+1]::INTEGER + 8 * bits[5*i+2]::INTEGER + 4 * bits[5*i+3]::INTEGER + 2 * bits[5*i+4]::INTEGER + bits[5*i+5]::INTEGER]),
         lambda x, y: x || y) AS payload_digest,
       CASE WHEN d.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d JOIN b USING (h)
"""


@query("op6_range_warc", OP6)
def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder).select(
        # the record of a page without an id is called null
        F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (
  SELECT *, row_number() OVER w AS i, lead(1) OVER w IS NULL AS last,
         sum(15 + length(role) + length(text) + 3 * length(role || text) - length(replace(role || text, chr(92), ''))
           - length(replace(role || text, '<', '')) - length(replace(role || text, '>', ''))) OVER (
           PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


@query("op7_prefix_targets", OP7)
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said)
    )
    return chat.read_back(chat.expand_replies(turns.union(probe)))


@query("op8_two_pass_shuffle")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op9_simhash_blocks")
def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query("op10_verified_bpe")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe_path())


@query("op11_best_two_fit")
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTES)


def cluster_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The rounds of ``op12`` one after another, every vector against every centroid."""
    steps = [
        f"""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS x
  FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < {k}))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, c, s FROM (SELECT vec_id, c, sum((e.x - c{i}.x) * (e.x - c{i}.x))::BIGINT AS s FROM e JOIN c{i} USING (d) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s, c) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS MATERIALIZED (SELECT c, d, sum(x) AS t, count(*) AS n FROM a{i} JOIN e USING (vec_id) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT c, d, coalesce((t - ((t % n) + n) % n) // n, x)::BIGINT AS x FROM c{i} LEFT JOIN m{i} USING (c, d))""")
    return f"""
WITH {",".join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)
"""


@query("op12_rotated_centroids", cluster_sql())
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.cluster_vectors(table(spark, sf_dir, "embeddings")))


OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 3
"""


@query("op13_strassen_negatives", OP13)
def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def all_queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
