"""Streams over files in any order, late rows, and state that goes away."""

import os
import random

import pytest
from pyspark.sql import functions as F

from folioweave.streaming import jobs

SCHEMA = "event_id bigint, user_id bigint, ts string, action string, item int, topic int"
SIX_HOURS = 6 * 3600


def events(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        minute = i * 2 + rng.randint(0, 1)
        rows.append((i, rng.choice([0, 0, 1, 2]), f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", f"a{i % 7}", i * 7 % 50, rng.randint(0, 6)))
    return rows


def files(spark, folder, parts):
    """One file a part, read one by one in this order."""
    folder.mkdir()
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).toPandas().to_parquet(folder / f"f{n}.parquet")
        os.utime(folder / f"f{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = jobs.file_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, "*.parquet", 1)
    return stream.withColumn("ts", F.to_timestamp("ts"))


def shuffled_parts(rows):
    """Files that overlap by half an hour, each in no order: less than what the watermark allows."""
    rng = random.Random(7)
    cuts = [rows[i : i + 15] for i in range(0, len(rows), 15)]
    for a, b in zip(cuts, cuts[1:]):
        a[-5:], b[:5] = b[:5], a[-5:]
    for c in cuts:
        rng.shuffle(c)
    return cuts


def ordered(rows, user):
    return sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))


def plain_preferences(rows, user):
    held = []
    for r in ordered(rows, user):
        if r[5] not in held[:3]:
            held = ([r[5]] + held)[:10]
    return ",".join(map(str, held))


def plain_spacing(rows, user, gap_minutes):
    last, allowed = None, 0
    for r in ordered(rows, user):
        at = int(r[2][11:13]) * 60 + int(r[2][14:16])
        if last is None or at - last >= gap_minutes:
            last, allowed = at, allowed + 1
    return allowed


@pytest.mark.parametrize("in_order", [True, False])
def test_keyed_state_equals_a_batch_over_files_out_of_order(spark, tmp_path, in_order):
    rows = events()
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)] if in_order else shuffled_parts(rows)
    for name, job, check in (
        ("p", jobs.session_preferences, lambda r: r["preferences"] == plain_preferences(rows, r["user_id"])),
        ("s", lambda s: jobs.spaced_reflections(s, 1200.0), lambda r: r["allowed"] == plain_spacing(rows, r["user_id"], 20)),
        ("r", jobs.running_profiles, lambda r: (r["total"], r["last_action"]) == (len(ordered(rows, r["user_id"])), ordered(rows, r["user_id"])[-1][3])
         and r["recent"] == ",".join(str(x[4]) for x in ordered(rows, r["user_id"])[-30:])),
    ):
        path = jobs.drain(job(files(spark, tmp_path / name, parts)), "update", jobs.update_batch)
        got = jobs.latest_per_key(spark, path, ["user_id"]).collect()
        assert len(got) == 3 and all(check(r) for r in got), name


def test_rows_later_than_the_watermark_are_written_aside(spark, tmp_path):
    rows = events()
    late = (999, 0, "2024-01-01 00:00:30", "late", 1, 1)
    stream = files(spark, tmp_path / "f", [rows, rows[-1:], [late, rows[-1]]])
    arrived = spark.read.parquet(str(tmp_path / "f"))
    accepted, side = jobs.take_in(stream, arrived)
    assert sorted(r["event_id"] for r in accepted.collect()) == [r[0] for r in rows]
    assert [(r["event_id"], r["action"]) for r in side.collect()] == [(999, "late")]


def state_rows(progress):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]


def test_state_of_idle_keys_disappears(spark, tmp_path):
    first = [(i, i, f"2024-01-01 00:{i % 60:02d}:00", "a", 1, 1) for i in range(50)]
    last = [(100, 7000, "2024-12-01 00:00:00", "a", 1, 1)]
    progress = []
    jobs.drain(jobs.session_preferences(files(spark, tmp_path / "f", [first, last])), "update", jobs.update_batch, progress=progress)
    sizes = state_rows(progress)
    assert max(sizes) >= 50 and sizes[-1] < 10


def test_expired_contexts_are_deleted(spark, tmp_path):
    first = [(i, i, f"2024-01-01 00:{i % 60:02d}:00", "a", 1, 1) for i in range(50)]
    stream = files(spark, tmp_path / "f", [first, [(100, 7000, "2024-01-02 00:00:00", "a", 1, 1)]])
    progress = []
    cached = stream.withColumn("expires_at", F.expr("ts + interval 2 hours"))
    path = jobs.drain(jobs.expiring_context(cached), "update", jobs.update_batch, progress=progress)
    assert jobs.latest_per_key(spark, path, ["user_id"]).count() == 51
    assert max(state_rows(progress)) >= 50 and state_rows(progress)[-1] < 10


@pytest.mark.parametrize("job", [jobs.sessions, jobs.sliding_topics])
def test_closed_windows_leave_the_state(spark, tmp_path, job):
    rows = [(i, i % 20, f"2024-{1 + i // 60:02d}-{1 + i % 28:02d} 00:00:00", "a", 1, i % 5) for i in range(240)]
    rows.sort(key=lambda r: r[2])
    progress = []
    stream = files(spark, tmp_path / "f", [rows[i : i + 40] for i in range(0, 240, 40)])
    path = jobs.drain_windows(job, stream, "2100-01-01 00:00:00", progress=progress)
    sizes = state_rows(progress)
    assert sizes[-1] == 0 < max(sizes)
    got = spark.read.parquet(path)
    total = got.agg(F.sum("events" if "events" in got.columns else "n")).first()[0]
    assert total == (240 if job is jobs.sessions else 240 * 14)
    assert got.select(*got.columns[:2]).distinct().count() == got.count()


def test_counters_write_what_changed_and_are_merged(spark, tmp_path):
    target = str(tmp_path / "counts")
    sink = jobs.merge_counts(["item", "action"], every=4)
    want = {}
    for epoch in range(10):
        changed = [(i, "a", epoch * 100 + i) for i in range(500 if epoch == 0 else 3)]
        want |= {(i, a): n for i, a, n in changed}
        sink(spark.createDataFrame(changed, "item int, action string, n bigint"), epoch, f"{target}/rows")
        if epoch == 5:  # an epoch that is run again changes nothing
            sink(spark.createDataFrame(changed, "item int, action string, n bigint"), epoch, f"{target}/rows")
        assert spark.read.parquet(f"{target}/rows/epoch={epoch}").count() == len(changed)
    got = {(r["item"], r["action"]): r["n"] for r in jobs.merged_counts(spark, f"{target}/rows", ["item", "action"]).collect()}
    assert got == want
    assert sorted(os.listdir(f"{target}/base")) == ["epoch=7"]
    assert "epoch=0" not in os.listdir(f"{target}/rows") and "epoch=9" in os.listdir(f"{target}/rows")


def test_continuity_does_not_depend_on_the_order(spark):
    turns = [(1, 0, 3, "general", 0, False), (1, 1, 3, "x", 1, False), (1, 2, 3, "y", 1, False), (2, 0, 3, "x", 1, False), (2, 3, 20, "z", 1, False), (2, 5, 3, "y", 1, False), (3, 0, 1, "general", 0, False)]
    kind = "session_id bigint, turn int, words int, domain string, domain_hits int, primary boolean"
    for rows in (turns, turns[::-1]):
        got = jobs.domain_continuity(spark.createDataFrame(rows, kind)).orderBy("session_id").collect()
        assert [tuple(r) for r in got] == [(1, 2, "x"), (2, 5, "z"), (3, 0, "general")]
