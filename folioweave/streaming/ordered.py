"""Keyed state over rows that may arrive in any order."""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# State bounds.
RECENT_QUERIES = 30
HISTORY_TURNS = 50
PREFERENCES = 10
PREFERENCE_WINDOW = 3
#: State of a key without rows for this long is deleted.
IDLE_MS = 90 * 24 * 3600 * 1000


class InOrder(StatefulProcessor):
    """Applies a step to the rows of a key in the order of their time and tie.

    Rows wait in a list until the watermark has passed them, as nothing can come
    before them then; they are applied to the settled state and forgotten.  What is
    returned counts the waiting rows in their present order as well, so it is what a
    batch job over all rows received so far would say.  An event-time timer deletes
    the key once it has been idle, or once its last row has expired.
    """

    def __init__(self, step, columns: list[str], idle_ms: int):
        self.step, self.columns, self.idle_ms = step, columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "state string")
        self.waiting = handle.getListState("waiting", "us bigint, tie bigint, expires_us bigint, row string")

    def _apply(self, state: dict, rows: list[tuple]) -> dict:
        for us, tie, expires, row in rows:
            self.step.apply(state, us, tie, expires, json.loads(row))
        return state

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = json.loads(self.settled.get()[0]) if self.settled.exists() else {"state": self.step.start(), "last": 0}
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for part in rows:
            expires = part["expires_us"].astype(object).where(part["expires_us"].notna(), None)
            held += zip(part["us"].tolist(), part["tie"].tolist(), expires.tolist(), part["row"].tolist())
        held.sort(key=lambda r: r[:2])
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done = [r for r in held if r[0] < passed]
        known["state"] = self._apply(known["state"], done)
        known["last"] = max(known["last"], *(self._until(r) for r in held))
        self.settled.update((json.dumps(known),))
        rest = held[len(done) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(known["last"], timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([self.step.finish(key[0], self._apply(json.loads(json.dumps(known["state"])), rest))])

    def _until(self, row: tuple) -> int:
        return row[0] // 1000 + self.idle_ms if row[2] is None else int(row[2]) // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.settled.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed_in_order(
    events: DataFrame, key: str, columns: list[str], output: str, step, lateness: str, expires_us: Column | None = None, idle_ms: int = IDLE_MS,
) -> DataFrame:
    """The result of ``step`` per key, returned again whenever rows of the key arrive (update mode).

    ``events`` has ``ts`` and ``event_id``, which give the order, and ``columns`` for
    the step.  Rows later than ``lateness`` are left out by the watermark.  The state
    of a key is deleted when the watermark reaches ``expires_us`` of the row that
    expires last, or ``idle_ms`` after its last row.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    until = F.lit(None) if expires_us is None else expires_us
    # keys without a value name nobody
    rows = timed.where(F.col(key).isNotNull()).select(
        key, "ts", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(-1)).cast("bigint").alias("tie"),
        until.cast("bigint").alias("expires_us"), F.to_json(F.struct(F.lit(0).alias("_"), *columns)).alias("row"),
    )
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=InOrder(step, columns, idle_ms), outputStructType=output, outputMode="Update", timeMode="EventTime"
    )


class ProfileStep:
    """Counters per topic, last action and the last queries of a user."""

    @staticmethod
    def start():
        return {"counts": {}, "last": None, "recent": []}

    @staticmethod
    def apply(state, us, tie, expires, row):
        topic = str(row.get("topic"))
        state["counts"][topic] = state["counts"].get(topic, 0) + 1
        state["last"] = row.get("action")
        insort(state["recent"], [us, tie, row.get("item")], key=lambda r: r[:2])
        del state["recent"][:-RECENT_QUERIES]

    @staticmethod
    def finish(key, state):
        counts = sorted(((k, n) for k, n in state["counts"].items() if k != "None"), key=lambda kv: int(kv[0]))
        return {
            "user_id": key, "last_action": state["last"], "total": sum(state["counts"].values()),
            "counters": ",".join(f"{k}={v}" for k, v in counts), "recent": ",".join(str(r[2]) for r in state["recent"] if r[2] is not None),
        }


class PreferenceStep:
    """Turn count (bounded history) and the preference list of a session."""

    @staticmethod
    def start():
        return {"turns": 0, "preferences": []}

    @staticmethod
    def apply(state, us, tie, expires, row):
        state["turns"] = min(state["turns"] + 1, HISTORY_TURNS)
        topic = row.get("topic")
        if topic is not None and topic not in state["preferences"][:PREFERENCE_WINDOW]:
            state["preferences"] = ([topic] + state["preferences"])[:PREFERENCES]

    @staticmethod
    def finish(key, state):
        return {"user_id": key, "turns": state["turns"], "preferences": ",".join(map(str, state["preferences"]))}


class SpacingStep:
    """How often an expensive job may run: at least ``gap`` seconds apart."""

    def __init__(self, gap: float):
        self.gap_us = round(gap * 1e6)

    @staticmethod
    def start():
        return {"last": None, "allowed": 0, "refused": 0}

    def apply(self, state, us, tie, expires, row):
        if state["last"] is None or us - state["last"] >= self.gap_us:
            state["last"], state["allowed"] = us, state["allowed"] + 1
        else:
            state["refused"] += 1

    @staticmethod
    def finish(key, state):
        return {"user_id": key, "allowed": state["allowed"], "refused": state["refused"]}


class ContextStep:
    """The latest cached context of a session and when it expires."""

    @staticmethod
    def start():
        return {"item": None, "expires": None}

    @staticmethod
    def apply(state, us, tie, expires, row):
        state["item"], state["expires"] = row.get("item"), expires

    @staticmethod
    def finish(key, state):
        return {"user_id": key, "item": state["item"], "expires_us": state["expires"]}
