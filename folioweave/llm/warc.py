"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioweave.llm.common import map_slices, slices
from folioweave.session import new_folder

MAGIC = b"\x1f\x8b\x08"
_GZIP = 31  # window bits of a gzip member
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_RECORD = "record_id string, record_type string, refers_to string, uri string, payload_digest string, payload_bytes bigint, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(kind: str, record: str, refers_to: str | None, uri: str, payload: bytes, date: str) -> bytes:
    """One record as a gzip member of its own; a revisit has the HTTP head only.

    The last byte is always zero, see :func:`write_archives`.
    """
    head = _HTTP.format(len(payload)).encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{quote(record)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(uri, safe='!#$%&()*+,/:;=?@[]~-._')}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines[5:5] = [
            f"WARC-Refers-To: <urn:page:{quote(refers_to)}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    out = packer.compress(raw) + packer.flush()
    if out[-1]:  # a record of 16 MiB or more: an empty member follows
        packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
        out += packer.compress(b"") + packer.flush()
    return out


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    date: str = "2020-01-01T00:00:00Z", folder: str | None = None,
) -> str:
    """Write one record per row as archives below a new folder and return its path.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    largest id is a response and the others revisit it; rows that repeat the
    largest id are responses too.  Null html is the empty payload, a null url an
    empty URI, a null id the record id ``null``.

    The files are written by Spark's own text writer, so they land in any store
    that Spark writes, and a failed task leaves nothing behind.  That writer ends
    each value by a separator; here it is the zero byte that ends every member.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    shared = (
        pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
        .where(F.col("n") >= min_bytes)
        .groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("sha1", "first")
    )
    typed = rows.join(shared, "sha1", "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), F.coalesce("url", F.lit("")).alias("url"), "payload",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"),
    )

    def start():
        def step(piece):
            made = [
                member("response" if to is None else "revisit", i, to, u, p, date)[:-1]
                for i, u, p, to in zip(*(c.to_pylist() for c in piece.columns))
            ]
            return {"member": made}

        return step

    folder = folder or new_folder(spark, "warc")
    packed = map_slices(typed, "member binary", start, rows=64)
    packed.select(F.col("member").cast("string")).write.option("lineSep", "\0").text(folder)
    return folder


def parse_record(raw: bytes) -> dict | None:
    """The fields of one decoded record, or None if it isn't one."""
    if not raw.startswith(b"WARC/"):
        return None
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
    named = lambda key: fields[key][1:-1].removeprefix("urn:page:") if key in fields else None
    return {
        "record_id": named("WARC-Record-ID"), "record_type": kind, "refers_to": named("WARC-Refers-To"),
        "uri": fields["WARC-Target-URI"], "payload_digest": digest, "payload_bytes": length,
        "payload": payload if kind == "response" else None,
    }


class Members:
    """Turns the byte runs that follow each magic into records.

    A run is taken as a record if the members before it are complete and it
    decodes to a WARC header; otherwise the magic was part of compressed data and
    the run continues the open member.  Until the first record of a byte range is
    certain, runs that are none belong to a member that began in an earlier range.
    """

    def __init__(self):
        self.open: list[bytes] = []  # the runs of an unfinished member
        self.decoder, self.text, self.begun = None, b"", False

    def feed(self, run: bytes, carried: bool = False) -> tuple[list[dict], list[bytes]]:
        """Records that the run completes, and runs that only an earlier range can place."""
        records: list[dict] = []
        rests: list[bytes] = []
        waiting = [run if carried else MAGIC + run]
        while waiting:
            data = waiting.pop(0)
            if not self.open:
                self.decoder, self.text = zlib.decompressobj(_GZIP), b""
            self.open.append(data)
            try:
                self.text += self.decoder.decompress(data)
                good = b"WARC/".startswith(self.text[:5])
            except zlib.error:
                good = False
            if not good:  # no member began here, or it is damaged; the later runs are looked at anew
                first, *later = self.open
                if not self.begun:
                    rests.append(first)
                self.open, waiting = [], later + waiting
                continue
            self.begun = self.begun or len(self.text) >= 5
            if self.decoder.eof:
                record = parse_record(self.text)
                if record is not None:
                    records.append(record)
                elif not self.begun:
                    rests += self.open
                self.open = []
        return records, rests


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records below ``folder``, with their payloads (null for revisits).

    The files are cut into byte ranges by Spark; a task scans its range for gzip
    magic, checks each candidate by decoding it, and owns the records that start
    inside.  A record whose compressed data happens to contain the magic may reach
    into the next range; such rare runs are put together in a second step by their
    place in the file.  ``spark.sql.files.maxPartitionBytes`` bounds the ranges.
    """
    runs = (
        spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
        .select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("run"))
    )
    extra = "path string, start bigint, seq bigint, rest binary"
    struct = StructType.fromDDL(f"{extra}, {_RECORD}")
    target = to_arrow_schema(struct)
    names = target.names

    def out(rows):
        return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=target)

    def left_over(place, state, seq):
        return [{"path": place[0], "start": place[1], "seq": seq + 1 + i, "rest": r} for i, r in enumerate(state.open)]

    def scan(batches):
        place, state, seq = None, None, 0
        for piece in slices(batches, 64):
            rows = []
            for path, start, run in zip(*(c.to_pylist() for c in piece.columns)):
                if (path, start) != place:
                    if state is not None:
                        rows += left_over(place, state, seq)
                    place, state, seq = (path, start), Members(), 0
                    if start == 0:  # what stands before the first magic
                        continue
                records, rests = state.feed(run)
                for rest in rests:
                    seq += 1
                    rows.append({"path": path, "start": start, "seq": seq, "rest": rest})
                rows += records
            yield out(rows)
        if state is not None:
            yield out(left_over(place, state, seq))

    def join_up(batches):
        path, state = None, None
        for piece in slices(batches, 64):
            rows = []
            for at, rest in zip(piece.column(0).to_pylist(), piece.column(3).to_pylist()):
                if at != path:
                    path, state = at, Members()
                rows += state.feed(rest, carried=True)[0]
            yield out(rows)

    found = runs.mapInArrow(scan, struct)
    rests = found.where("rest is not null").repartition("path").sortWithinPartitions("path", "start", "seq")
    fields = [f.name for f in StructType.fromDDL(_RECORD)]
    whole = found.where("rest is null").select(*fields)
    return whole.unionByName(rests.select(*names).mapInArrow(join_up, struct).select(*fields))
