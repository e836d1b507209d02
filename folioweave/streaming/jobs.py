"""Streaming intake, counters, sessions, bounded keyed state and trends.

Inputs arrive through any streaming DataFrame.  ``drain`` runs one with the
available-now trigger: the checkpoint remembers which files were done, so a
failed or repeated run resumes instead of starting over.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.session import new_folder, remove_folders, shared_folder
from folioweave.streaming.ordered import (
    ContextStep,
    PreferenceStep,
    ProfileStep,
    SpacingStep,
    keyed_in_order,
)

SESSION_GAP = "24 hours"
LATENESS = "1 hour"
#: Batches of counters between two compactions.
COMPACT_EVERY = 16
#: Keyed state lives in a store on the executors' disks, with a log of changes in the checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, schema, pattern: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet tables of a folder as a stream; a table is one file or a folder of files.

    ``pattern`` is a glob in the path itself: a filter on file names would miss the parts
    of a table that is a folder.  In braces it stays a glob without a wildcard, as Spark
    takes no single file as the base of a stream.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{pattern}}}")


@contextlib.contextmanager
def _state_store(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(
    stream: DataFrame,
    mode: str,
    sink: Callable[[DataFrame, int, str], None],
    folder: str | None = None,
    progress: list | None = None,
) -> str:
    """Process everything available into ``folder`` and return its path.

    ``progress`` receives the reports of the batches, with the sizes of their state.
    """
    spark = stream.sparkSession
    target = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{target}/_progress")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, epoch: sink(batch, epoch, f"{target}/rows"))
    )
    with _state_store(spark):
        query = writer.start()
        query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return f"{target}/rows"


def append_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """One folder per epoch: a replayed epoch overwrites its own rows only."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def update_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Changed rows of an epoch; readers take the newest row of a key."""
    batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def latest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Update-mode results: the value of the newest epoch per key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "epoch")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
    return picked.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def with_event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less timestamps cannot carry a watermark; the session zone is UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def intake(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Append-only intake without repeated event ids."""
    return with_event_time(events).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def late_rows(events: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows that were too late for the intake, for the side table.

    A repeated event has its first occurrence among the accepted ones; what has none came late.
    """
    return events.join(accepted.select("event_id"), "event_id", "left_anti")


def take_in(events: DataFrame, arrived: DataFrame, folder: str | None = None, lateness: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """Run the intake; the accepted rows, and the late ones as a table of their own beside them.

    ``arrived`` reads the files of the stream ``events`` as a table.
    """
    spark = events.sparkSession
    path = drain(intake(events, lateness), "append", append_batch, folder)
    accepted = spark.read.parquet(path)
    side = f"{path.removesuffix('/rows')}/late"
    late_rows(arrived, accepted).write.mode("overwrite").parquet(side)
    return accepted, spark.read.parquet(side)


def drain_windows(
    job: Callable[[DataFrame, str], DataFrame], events: DataFrame, end: str, folder: str | None = None, progress: list | None = None,
) -> str:
    """Run a windowed ``job`` in append mode over a stream that has an end, and return its path.

    Windows in append mode appear when the watermark has passed them.  A stream that
    has ended never moves its watermark again, so its last windows would stay open.
    When everything is read, a row that has only its time, ``end``, arrives from a
    second source and closes them.
    """
    spark = events.sparkSession
    closing, schema = new_folder(spark, "closing"), events.schema
    spark.createDataFrame([], schema).write.parquet(closing)
    whole = job(events.unionByName(spark.readStream.schema(schema).parquet(closing)), end)
    target = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    drain(whole, "append", append_batch, target, progress)
    row = [(F.lit(end) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*row).write.mode("append").parquet(closing)
    return drain(whole, "append", append_batch, target, progress)


def _timed(events: DataFrame, end: str | None) -> DataFrame:
    """With a watermark, and without the closing row; another filter than one on the time would be moved below the watermark."""
    timed = with_event_time(events).withWatermark("ts", LATENESS)
    return timed if end is None else timed.where(F.col("ts") < F.lit(end).cast("timestamp"))


def sessions(events: DataFrame, end: str | None = None, gap: str = SESSION_GAP) -> DataFrame:
    """Sessions that end after a period without activity, for append mode: state holds open sessions only."""
    timed = _timed(events, end)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events"
    )


def popularity(events: DataFrame) -> DataFrame:
    return events.groupBy("item", "action").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(keys: list[str], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int, str], None]:
    """A sink that writes the changed counters of a batch and merges them now and then.

    A batch costs what it changed.  Every ``every`` batches the newest value of each
    key becomes the new base, and the files before it are deleted.
    """

    def sink(batch: DataFrame, epoch: int, path: str) -> None:
        spark = batch.sparkSession
        batch.withColumn("version", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if (epoch + 1) % every == 0:
            merged = merged_counts(spark, path, keys, with_version=True)
            merged.write.mode("overwrite").parquet(f"{path.removesuffix('/rows')}/base/epoch={epoch}")
            first = max(0, epoch + 1 - every)
            remove_folders(spark, *[f"{path}/epoch={e}" for e in range(first, epoch)], f"{path.removesuffix('/rows')}/base/epoch={first - 1}")

    return sink


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def merged_counts(spark: SparkSession, path: str, keys: list[str], with_version: bool = False) -> DataFrame:
    """The newest value of every key in the base and the batches after it."""
    rows = spark.read.parquet(path).drop("epoch")
    base = f"{path.removesuffix('/rows')}/base"
    if _exists(spark, base):
        rows = rows.unionByName(spark.read.parquet(base).drop("epoch"))
    values = [c for c in rows.columns if c not in (*keys, "version")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("_v"), F.max("version").alias("version"))
    kept = newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values], "version")
    return kept if with_version else kept.drop("version")


def sliding_topics(events: DataFrame, end: str | None = None, length: str = "14 days", slide: str = "1 day") -> DataFrame:
    """Topic counts per sliding window, for append mode: state holds open windows only."""
    timed = _timed(events, end)
    return timed.groupBy(F.window("ts", length, slide).alias("w"), "topic").agg(F.count(F.lit(1)).alias("n")).select(
        F.unix_micros("w.start").alias("start_us"), "topic", "n"
    )


def expiring_context(events: DataFrame) -> DataFrame:
    """Latest cached context per session with the time it expires; a timer then deletes it."""
    return keyed_in_order(events, "user_id", ["item"], "user_id bigint, item int, expires_us bigint", ContextStep(), LATENESS, F.unix_micros("expires_at"))


def running_profiles(events: DataFrame) -> DataFrame:
    return keyed_in_order(
        events, "user_id", ["topic", "action", "item"],
        "user_id bigint, last_action string, total bigint, counters string, recent string", ProfileStep(), LATENESS,
    )


def session_preferences(events: DataFrame) -> DataFrame:
    return keyed_in_order(events, "user_id", ["topic"], "user_id bigint, turns bigint, preferences string", PreferenceStep(), LATENESS)


def spaced_reflections(events: DataFrame, gap_seconds: float = 60.0) -> DataFrame:
    return keyed_in_order(events, "user_id", [], "user_id bigint, allowed bigint, refused bigint", SpacingStep(gap_seconds), LATENESS)


def domain_continuity(turns: DataFrame) -> DataFrame:
    """Domain a session is about; short weak turns inherit it.

    ``turns``: ``session_id, turn, words, domain, domain_hits, primary``.  A firm turn
    decides for all weak ones after it, and the first named turn where none is firm.
    So the first named and the last firm turn are the whole state, in whatever order
    turns arrive.
    """
    named = F.col("domain") != "general"
    firm = named & ((F.col("words") > 15) | (F.col("domain_hits") >= 2) | F.col("primary").cast("boolean"))
    when = lambda c: F.when(c, F.col("turn"))
    return turns.groupBy("session_id").agg(
        F.max("turn").cast("bigint").alias("turn"),
        F.coalesce(F.max_by("domain", when(firm)), F.min_by("domain", when(named)), F.lit("general")).alias("session_domain"),
    )


def incremental_corpus(spark: SparkSession, folder: str, schema, pattern: str, transform, target: str | None = None) -> DataFrame:
    """Corpus job over new files only; a second run finds nothing left to do."""
    path = drain(transform(file_stream(spark, folder, schema, pattern)), "append", append_batch, target)
    return spark.read.parquet(path).drop("epoch")


def job_status(log: DataFrame) -> DataFrame:
    """Latest status per job: ``job_id, status, at``."""
    return log.groupBy("job_id").agg(F.max_by("status", "at").alias("status"), F.count(F.lit(1)).alias("changes"))
