"""Streams of events: deduplicated tails, upserts into a store, back-off state, session windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from heronlake.operators.store import EventStore


def deduplicated(events: DataFrame, time: str = "ts", key: str = "id", late: str = "2 hours") -> DataFrame:
    """Each event once while it is within ``late`` of the newest; state older than that is dropped."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def live(events: DataFrame, store: EventStore, checkpoint: str, on_new: Callable[[DataFrame], None] | None = None, delete: bool = True, **trigger: Any) -> StreamingQuery:
    """Save a stream of events batch by batch, apply deletions, and call ``on_new`` with what was stored.

    Saving is idempotent by id, so a batch that is replayed after a failure
    changes nothing.  ``trigger`` is passed on: the default micro-batch is 300 ms.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            stored = store.save(batch).where("stored")
            if on_new is not None:
                on_new(batch.join(stored.select("id"), "id", "left_semi"))
            # Also without a new deletion: a stored one may meet an event that arrives late.
            if delete:
                store.apply_deletions(batch=batch)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "300 milliseconds"})).start()


def backoff_step(failures: int, last: int, what: str, now: int) -> tuple[bool | None, int, int]:
    """(allowed, failures, last attempt) after a ``failure``, a ``success`` or an ``ask``.

    A failure adds one; a success clears; an ask is allowed when the rest of
    two minutes for each failure (ten at most) is over, and then takes one off.
    """
    if what == "failure":
        return None, failures + 1, now
    if what == "success":
        return None, 0, 0
    if failures == 0:
        return True, 0, 0
    if last + min(failures * 120, 600) >= now:
        return False, failures, last
    return True, failures - 1, now if failures > 1 else 0


def backoff_fold(rows: Column) -> Column:
    """The state (failures, last_attempt, allowed) after all (ts, what) of an array sorted by time.

    The batch form of the stateful stream: an ordered fold, JVM-side.
    """
    start = F.struct(F.lit(0).cast("long").alias("failures"), F.lit(0).cast("long").alias("last_attempt"), F.lit(None).cast("boolean").alias("allowed"))

    def step(s: Column, r: Column) -> Column:
        over = s["last_attempt"] + F.least(s["failures"] * 120, F.lit(600)) < r["ts"]
        fewer = F.when(over & (s["failures"] > 0), s["failures"] - 1).otherwise(s["failures"])
        failures = F.when(r["what"] == "failure", s["failures"] + 1).when(r["what"] == "success", F.lit(0)).otherwise(fewer)
        kept = F.when(fewer == 0, F.lit(0)).when(over, r["ts"]).otherwise(s["last_attempt"])
        last = F.when(r["what"] == "failure", r["ts"]).when(r["what"] == "success", F.lit(0)).otherwise(kept)
        allowed = F.when(r["what"] == "ask", over | (s["failures"] == 0))
        return F.struct(failures.cast("long").alias("failures"), last.cast("long").alias("last_attempt"), allowed.cast("boolean").alias("allowed"))

    return F.aggregate(rows, start, step)


def backoff_latest(attempts: DataFrame, key: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``key``, failures, last_attempt and allowed after all rows of each key; ``attempts`` has ``ts``, ``what`` and the columns of ``order``.

    The rows of a key stream by, sorted by ``order`` (a sort that can spill),
    and only the state's two numbers are kept: no key is held in memory.
    """
    rows = attempts.repartition(key).sortWithinPartitions(key, *order).select(key, "ts", "what")
    schema = attempts.select(key).schema.add("failures", "long").add("last_attempt", "long").add("allowed", "boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_row = None, (None, 0, 0), False
        for batch in batches:
            out = []
            for k, ts, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if any_row and k != now:
                    out.append((now, state[1], state[2], state[0]))
                if not any_row or k != now:
                    now, state, any_row = k, (None, 0, 0), True
                state = backoff_step(state[1], state[2], what, ts)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, state[1], state[2], state[0]), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


class Backoff(StatefulProcessor):
    """A value state for each URL: failures and the last attempt."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("backoff", "failures long, last_attempt long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        failures, last = self.state.get() if self.state.exists() else (0, 0)
        out = []
        for part in rows:
            for ts, what in sorted(zip(part["at"], part["what"], strict=True)):
                allowed, failures, last = backoff_step(int(failures), int(last), what, int(ts))
                out.append((key[0], int(ts), what, allowed, failures))
        if failures:
            self.state.update((failures, last))
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=["url", "at", "what", "allowed", "failures"])

    def close(self) -> None:
        pass


BACKOFF = "url string, at long, what string, allowed boolean, failures long"


def backoff_stream(attempts: DataFrame) -> DataFrame:
    """Answers to a stream of (url, at, what): whether an ask is allowed, and the failures after it."""
    return attempts.groupBy("url").transformWithStateInPandas(Backoff(), BACKOFF, "Append", "none")


def sessions(events: DataFrame, user: str, time: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(user, start, end, n) of each user's sessions; works on streams with a watermark too."""
    w = F.session_window(F.col(time).cast("timestamp"), gap)
    return events.groupBy(user, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
