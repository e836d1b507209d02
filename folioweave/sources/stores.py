"""Keyed tables: upsert, first-write preservation, delete, stats, reports, traces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import new_folder

# File types by extension.
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "doc": "doc", "html": "html", "htm": "html", "txt": "txt", "parquet": "table"}

TRACE_SCHEMA = (
    "event_id string, trace_id string, module string, stage string, status string, "
    "ts string, duration_ms double, _corrupt string"
)


#: A text file may begin with it; Spark's line reader leaves it out.
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def _file_type(path: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    return kinds[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", digest: bool = True) -> DataFrame:
    """Supported files below a path with type, size and content hash.

    Without ``digest`` no content is read at all; with it, files are read line by line.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    listed = spark.read.format("binaryFile").options(**options).load(path)
    files = listed.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), _file_type(F.col("path")).alias("file_type"),
        F.col("length").alias("size"), F.col("_metadata.file_path").alias("file"),
    ).filter(F.col("file_type").isNotNull())
    if not digest:
        return files.drop("file")
    # Spark lists no empty file, so one without a line is a mark alone
    mark = F.when(F.col("size") == len(BYTE_ORDER_MARK), hashlib.sha256(BYTE_ORDER_MARK).hexdigest())
    found = files.join(file_digests(files, path, options), "file", "left")
    return found.select("name", "file_type", "size", F.coalesce("sha256", mark).alias("sha256"))


def file_digests(files: DataFrame, path: str, options: dict[str, str]) -> DataFrame:
    """``file, sha256`` of the listed files that have a line, without holding one whole.

    The digest is a chain over the bytes.  Files are dealt to tasks uncut as far as the
    session lets them be, and the task that reads a file takes its digest; a file that
    is cut after all goes on in pieces, which a task puts in order.
    """
    spark = files.sparkSession
    largest, total = files.agg(F.max("size"), F.sum("size")).first()
    reading = spark.newSession()
    if largest:
        reading.conf.set("spark.sql.files.maxPartitionBytes", str(max(largest, 1 << 27)))
        reading.conf.set("spark.sql.files.minPartitionNum", str(max(1, min(spark.sparkContext.defaultParallelism, total // largest))))
    lines = reading.read.options(**options).text(path, lineSep="\n").where(_file_type(F.col("_metadata.file_path")).isNotNull()).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"),
        (F.col("_metadata.file_block_length") == F.col("_metadata.file_size")).alias("whole"),
        F.concat(F.col("value").cast("binary"), F.lit("\n").cast("binary")).alias("data"),
    )
    pieces = lines.mapInArrow(_digests_or_pieces, "file string, size bigint, start bigint, at bigint, data binary, sha256 string")
    ordered = pieces.repartition("file").sortWithinPartitions("file", "start", "at")
    folder = new_folder(spark, "digests")
    ordered.mapInArrow(_digests, "file string, sha256 string").write.parquet(folder)
    return spark.read.schema("file string, sha256 string").parquet(folder)


class LineDigest:
    """SHA-256 of a file whose lines come with an end each, also the last, and without a byte order mark.

    Only the size of the file tells in the end what its first and last bytes are.
    """

    def __init__(self):
        self.bytes, self.plain, self.marked = 0, hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)

    def add(self, data: memoryview) -> None:
        for sums in (self.plain, self.marked):
            if self.bytes:
                sums.update(b"\n")
            sums.update(data[:-1])
        self.bytes += len(data)

    def result(self, size: int) -> str:
        more = size - self.bytes
        if more not in (-1, 0, 2, 3):
            raise ValueError(f"read {self.bytes} bytes of a file of {size}")
        sums = self.marked if more > 0 else self.plain
        if more in (0, 3):
            sums.update(b"\n")
        return sums.hexdigest()


def _runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[int, int]]:
    """First row and end of each run of equal values in the first columns."""
    if not batch.num_rows:
        return
    new = np.ones(batch.num_rows, bool)
    new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:n_keys]])
    edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
    yield from zip(edges, edges[1:])


def _joined(column: pa.Array, first: int, end: int) -> memoryview:
    """The bytes of neighbouring values, which lie one after another."""
    column = column.slice(first, end - first).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[offsets[0] : offsets[-1]]


def _digests_or_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the files that are read whole, and the bytes of the others in the order of ``at``, from lines in order."""
    names, key, taken, at = ["file", "size", "start", "at", "data", "sha256"], None, None, 0

    def row(*values):
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    for batch in batches:
        for first, end in _runs(batch, 3):
            file, size, start, whole = (batch.column(i)[first].as_py() for i in range(4))
            if taken and key != (file, size):
                yield row(*key, 0, 0, None, taken.result(key[1]))
                taken = None
            if whole:
                key, taken = (file, size), taken or LineDigest()
                taken.add(_joined(batch.column(4), first, end))
            else:
                at += 1
                yield row(file, size, start, at, _joined(batch.column(4), first, end).tobytes(), None)
    if taken:
        yield row(*key, 0, 0, None, taken.result(key[1]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each file, from digests and ordered pieces."""
    key, taken = None, None

    def row(file, sha256):
        return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.string()), "sha256": pa.array([sha256], pa.string())})

    for batch in batches:
        for i in range(batch.num_rows):
            file, size, sha256 = (batch.column(n)[i].as_py() for n in (0, 1, 5))
            if taken and key[0] != file:
                yield row(key[0], taken.result(key[1]))
                taken = None
            if sha256 is not None:
                yield row(file, sha256)
            else:
                key, taken = (file, size), taken or LineDigest()
                taken.add(_joined(batch.column(4), i, i + 1))
    if taken:
        yield row(key[0], taken.result(key[1]))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Latest row per key of two tables.

    ``max_by`` combines on the map side, so a key that is written over and over
    sends one row per task.
    """
    values = [c for c in old.columns if c not in key]
    both = old.unionByName(new)
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*version)).alias("_v"))
    return picked.select(*key, *[F.col(f"_v.{c}").alias(c) for c in values])


def upsert_keep_created(rows: DataFrame, key: Sequence[str], at: str, version: Sequence[str]) -> DataFrame:
    """Latest values per key with the first time the key was written."""
    values = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(
        F.min(at).alias("created_at"), F.max_by(F.struct(*values), F.struct(*version)).alias("_v")
    )
    return picked.select(*key, "created_at", *[F.col(f"_v.{c}").alias(c) for c in values])


def delete_keys(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), list(key), "left_anti")


def visible(rows: DataFrame, owner: str, me: str, is_global: str) -> DataFrame:
    """Own rows or rows open to all."""
    return rows.filter((F.col(owner) == me) | F.col(is_global))


def collection_stats(tables: dict[str, DataFrame], global_flag: dict[str, str]) -> DataFrame:
    """Row counts per table, with the share open to all where a flag exists."""
    out = None
    for name, frame in tables.items():
        flag = global_flag.get(name)
        open_rows = F.count_if(F.expr(flag)) if flag else F.lit(None).cast("bigint")
        row = frame.agg(F.count(F.lit(1)).alias("n"), open_rows.alias("n_global")).withColumn("collection", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def write_json_reports(reports: DataFrame, path: str) -> None:
    """One JSON object per line, written by the tasks."""
    reports.write.mode("overwrite").json(path)


def markdown_reports(metrics: DataFrame, key: str) -> DataFrame:
    """Per-run Markdown from tall metrics: ``key, metric, value``."""
    lines = F.array_sort(F.collect_list(F.struct("metric", "value")))
    body = F.array_join(
        F.transform(lines, lambda s: F.concat(F.lit("| "), s["metric"], F.lit(" | "), s["value"].cast("string"), F.lit(" |"))), "\n"
    )
    return metrics.groupBy(key).agg(F.concat(F.lit("| metric | value |\n| --- | --- |\n"), body).alias("markdown"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace lines with an explicit schema; broken lines keep their text."""
    return (
        spark.read.schema(TRACE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )


def seed(target: DataFrame, seeds: DataFrame, key: Sequence[str]) -> DataFrame:
    """Reference rows added once: existing keys stay as they are."""
    return target.unionByName(seeds.join(target.select(*key), list(key), "left_anti").dropDuplicates(list(key)))
