"""Events and counters of a store."""

from __future__ import annotations

import time
from collections import deque
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT

#: Events kept until they are read; more are dropped, never waited for.
BUFFER = 1024

STATS = "total_keys long, live_keys long, memtable_keys long, run_rows long, run_tombstones long, memtable_rows long, wal_segments long, sstables long, last_write_ms long, last_read_ns long, last_recovery_ms long, compactions long, flushes long"


def counts(events: DataFrame) -> DataFrame:
    """type, n of rows of events (TL5)."""
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


class Telemetry:
    def __init__(self, spark: SparkSession, buffer: int = BUFFER) -> None:
        self._spark, self._limit = spark, buffer
        self._events: deque = deque()
        self.dropped = 0
        self._write_ms = self._read_ns = self._recovery_ms = 0

    def publish(self, kind: str, message: str, stage: str, ms: int, key: str | None = None, value: str | None = None) -> None:
        """Keep an event, or drop it if the buffer is full (TL2)."""
        if len(self._events) >= self._limit:
            self.dropped += 1
            return
        self._events.append((datetime.now(timezone.utc), kind, message, key, value, stage, ms))

    @staticmethod
    def _ms(began: float) -> int:
        return int((time.monotonic() - began) * 1000)

    def recovered(self, began: float, n: int) -> None:
        self._recovery_ms = self._ms(began)
        self.publish("recover", f"{n} changes to replay", "recovery", self._recovery_ms)

    def wrote(self, kind: str, began: float, n: int) -> None:
        self._write_ms = self._ms(began)
        self.publish(kind, f"{n} changes appended", "wal", self._write_ms)

    def flushed(self, began: float, run) -> None:
        self.publish("flush", f"run {run.run_seq}: {run.n_records} keys", "flush", self._ms(began))

    def compacted(self, began: float, level: int, inputs, run) -> None:
        self.publish("compact", f"{len(inputs)} runs of level {level} into run {run.run_seq}", "maintenance", self._ms(began))

    def read(self, began: float, found: bool) -> None:
        self._read_ns = int((time.monotonic() - began) * 1e9)
        self.publish("get", "found" if found else "not found", "sstable" if found else "lookup", self._ms(began))

    def events(self) -> DataFrame:
        """The buffered events, which are taken out of the buffer."""
        rows = [self._events.popleft() for _ in range(len(self._events))]
        return self._spark.createDataFrame(rows, EVENT)

    def snapshot(self, total: int | None, live: int | None, memtable: int | None, m) -> DataFrame:
        stored = (sum(r.n_records for r in m.runs), sum(r.n_tombstones for r in m.runs), sum(s.n_records for s in m.pending()))
        times = (self._write_ms, self._read_ns, self._recovery_ms)
        return self._spark.createDataFrame([(total, live, memtable, *stored, len(m.segments), len(m.runs), *times, m.compactions, m.flushes)], STATS)
