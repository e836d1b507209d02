"""Archives, chat examples and shards: round trips, skew and edge cases."""

import base64
import glob
import gzip
import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioweave.llm import chat, sharding, warc
from folioweave.llm.catalog import all_queries


def pages(spark):
    same = "<p>copy</p>" * 30
    rows = [(i, f"http://h/{i}", same) for i in range(0, 60, 3)] + [(1, None, None), (2, "u v\r\nx", ""), (4, "é", "ü日" * 5000), (None, "n", "only"), (7, "q", "once")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string").repartition(3)


def test_archive_round_trip_over_small_ranges(spark):
    rows, df = pages(spark)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    folder = warc.write_archives(df)
    for path in glob.glob(folder.removeprefix("file:") + "/part-*"):
        with open(path, "rb") as file:  # plain gzip readers understand the files
            assert gzip.decompress(file.read()).startswith(b"WARC/1.1\r\n")
    try:
        for size in ("300", "4k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read_archives(spark, folder).collect()
            assert len(got) == len(rows)
            largest = {}
            for i, _, h in rows:
                if i is not None:
                    largest[h or ""] = max(largest.get(h or "", i), i)
            for r in got:
                i = None if r.record_id == "null" else int(r.record_id)
                payload = next((h or "").encode() for j, _, h in rows if j == i)
                assert r.payload_bytes == len(payload)
                assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
                first = largest.get(payload.decode())
                assert (r.record_type, r.refers_to) == (("response", None) if i == first or i is None else ("revisit", str(first)))
                assert r.payload == (payload if r.record_type == "response" else None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_magic_inside_compressed_data(spark, tmp_path):
    """Stored blocks keep payloads as they are, so the magic stands inside a member and across ranges."""
    records = []
    for i in range(12):
        payload = (warc.MAGIC + bytes([i, 0]) * 40 + b"WARC/1.1\r\n") * 30
        head = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        raw = (
            f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: u\r\n"
            f"WARC-Payload-Digest: sha1:{warc.payload_digest(payload)}\r\nContent-Length: {len(head) + len(payload)}\r\n\r\n"
        ).encode() + head + payload + b"\r\n\r\n"
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        records.append(packer.compress(raw) + packer.flush())
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "5k", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read_archives(spark, str(tmp_path)).collect()
            assert Counter(r.record_id for r in got) == Counter(str(i) for i in range(12))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_payloads_are_all_responses(spark):
    _, df = pages(spark)
    got = warc.read_archives(spark, warc.write_archives(df, min_bytes=1000)).collect()
    assert {r.record_type for r in got} == {"response"}
    assert warc.read_archives(spark, warc.write_archives(df.limit(0))).count() == 0


def test_large_member_ends_in_zero():
    out = warc.member("response", "1", None, "u", b"\x01" * (17 << 20), "d")
    assert out[-1] == 0
    state = warc.Members()
    first, *more = out.split(warc.MAGIC)[1:]
    found = [record for m in (first, *more) for record in state.feed(m)[0]]
    assert [f["payload_bytes"] for f in found] == [17 << 20]


TALKS = [
    (1, 0, "system", "be <kind>"), (1, 1, "user", "a\\l b"), (1, 2, "assistant", r"\### Assistant: </turn> ok"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 0, "user", "no answer"), (3, 1, "assistant", "first"), (3, 1, "assistant", "first"), (3, 0, None, "<turn x>"), (None, 0, "assistant", "日本\\s"),
    (4, None, "a>b", "x\ny"), (4, 5, "assistant", "z" * 5000), (4, 6, "user", "</turn>\n"),
]


def test_chat_digests_match_plain_python(spark):
    df = spark.createDataFrame([(*t, "extra") for t in TALKS], "conv_id bigint, turn bigint, role string, text string, example string")
    examples = chat.expand_replies(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    for conv in {t[0] for t in TALKS}:
        turns = sorted([(-1 if n is None else n, r or "", x or "") for c, n, r, x in TALKS if c == conv])
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        reply = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(reply), hashlib.sha256(reply.encode()).hexdigest())
    rows = [r for r in examples.collect() if r.conv_id == 1]
    assert sorted(r.loss_chars for r in rows) == [0, len(r"\s### Assistant: \l/turn\g ok")]
    for r in rows:  # only the reply is trainable, and it ends the example
        assert r.formatted[r.loss_start + r.loss_chars :] == chat.SHUT
    assert got[1].formatted_chars == sum(len(r.formatted) for r in rows)
    assert chat.read_back(chat.expand_replies(df.limit(0))).count() == 0


@pytest.mark.parametrize("bucket_bytes", [200, 1 << 20])
def test_shards(spark, bucket_bytes):
    rows = [(i, None if i % 9 == 0 else "t" * (i % 40), "s") for i in range(501)] + [(7, "twin", "s"), (7, "twin", "s"), (None, "n", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = sharding.shuffle_into_shards(docs, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    again = sharding.shuffle_into_shards(docs.repartition(5), bucket_bytes=bucket_bytes).collect()
    place = lambda found: sorted((r.shard, r.slot, r.doc_id or -1, r.text or "") for r in found)
    assert place(again) == place(got)  # independent of the input's partitions
    other = sharding.shuffle_into_shards(docs, seed=3, bucket_bytes=bucket_bytes).collect()
    assert place(other) != place(got)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    rises = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.4 < rises / len(order) < 0.6


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    assert sorted(r.slot for r in sharding.shuffle_into_shards(docs).collect()) == [0, 0]
    assert sharding.shuffle_into_shards(docs.where(F.lit(False))).count() == 0


def test_one_id_spreads_over_buckets(spark, tmp_path, monkeypatch):
    rows = [(None if i % 3 else i, "the same text " * 4) for i in range(600)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = sharding.shuffle_into_shards(docs, shards=4, bucket_bytes=4000, folder=str(tmp_path / "out")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    # one bucket would hold all 400 rows of the null id without a break of two buckets' own rows
    nulls = [sum(i is None for i in order[at : at + 75]) for at in range(0, 600, 75)]
    assert all(25 <= n <= 70 for n in nulls)


def test_archive_query_on_pages_without_ids(spark, tmp_path):
    rows = [(1, "u", "<p>a</p>"), (None, "v", "<p>b</p>"), (None, None, None), (3, "w", "<p>a</p>"), (3, "w", "<p>a</p>"), (None, "x", "<p>a</p>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = all_queries()["op6_range_warc"](spark, str(tmp_path)).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, "revisit", 3), (None, "response", None), (None, "response", None), (3, "response", None), (3, "response", None), (None, "revisit", 3)]
    )
