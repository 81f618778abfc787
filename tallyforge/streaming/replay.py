"""Replay of a journal against a manifest: a keyed, stateful stream with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import shared_folder

RESULT = "job long, expected long, seen long, missing long, repeated long, foreign long, late long, status string"


AT_ONCE = 10_000


def joined(a: tuple[int, int, int] | None, b: tuple[int, int, int]) -> tuple[int, int, int]:
    """(due, times, first) of an entry from two parts of its rows, b the later one; -1 stands for none."""
    if a is None:
        return b
    first = a[2] if b[2] < 0 else b[2] if a[2] < 0 else min(a[2], b[2])
    return b[0] if b[0] >= 0 else a[0], a[1] + b[1], first


class Replay(StatefulProcessor):
    """Counts of a job's entries: the manifest's (kind ``expected``) and the journal's (``seen``), each with its time.

    A job is reported once, ``grace`` milliseconds after its last expected entry was due. Entries of the journal that the manifest doesn't
    name are foreign, those past the job's due time and half the grace are late, the second and later of one name are repeated.

    A batch's counts of a job are appended to its state in calls of at most AT_ONCE entries; nothing is read before the job's timer.
    """

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "entry long, due long, times long, first long")
        self.deadline = handle.getValueState("deadline", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        deadline = self.deadline.get()
        deadline = last = deadline[0] if deadline else None
        own: dict[int, tuple[int, int, int]] = {}
        for row in rows:
            kind, entry, at = row["kind"], row["entry"], row["at"]
            if kind == "expected":
                last = at if last is None else max(last, at)
                seen = (at, 0, -1)
            else:
                seen = (-1, 1, at)
            own[entry] = joined(own.get(entry), seen)
            if len(own) == AT_ONCE:
                self.entries.appendList([(e, *x) for e, x in own.items()])
                own.clear()
        if own:
            self.entries.appendList([(e, *x) for e, x in own.items()])
        if last is not None and last != deadline:
            if deadline is not None:
                self.handle.deleteTimer(deadline + self.grace)
            self.handle.registerTimer(last + self.grace)
            self.deadline.update((last,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        deadline = self.deadline.get()[0]
        expected = seen = repeated = foreign = late = 0
        own: dict[int, tuple[int, int, int]] = {}
        for entry, *counts in self.entries.get():
            own[entry] = joined(own.get(entry), tuple(counts))
        for due, times, first in own.values():
            expected += due >= 0
            seen += due >= 0 and times > 0
            foreign += due < 0
            repeated += max(0, times - 1)
            late += due >= 0 and times > 0 and first > deadline + self.grace // 2
        missing = expected - seen
        status = "complete" if not (missing or foreign or repeated or late) else "incomplete" if missing else "complete_with_findings"
        self.entries.clear()
        self.deadline.clear()
        yield Row(job=key[0], expected=expected, seen=seen, missing=missing, repeated=repeated, foreign=foreign, late=late, status=status)


def replayed(entries: DataFrame, grace_ms: int, delay: str) -> DataFrame:
    """RESULT for each job of a stream (job, kind, entry, at in milliseconds, ts) whose timer the watermark has passed."""
    keyed = entries.withWatermark("ts", delay).groupBy("job")
    return keyed.transformWithState(Replay(grace_ms), RESULT, "Append", "EventTime")


def replayed_once(spark: SparkSession, path: str, schema, grace_ms: int, delay: str) -> DataFrame:
    """What a stream over the files of a folder has reported when they are used up, as a written table."""
    out, key = shared_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = replayed(spark.readStream.schema(schema).parquet(path), grace_ms, delay)
        running = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark)).outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(RESULT).parquet(out)
