"""Streams into a store."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, name: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Apply a stream of changes (key, value, ts, is_deleted) to a store, each micro-batch once.

    The manifest records the batch with its rows in one commit, so a batch that runs again
    after a failure is recognised and skipped. Batches are known by the stream's own id,
    which lives in its checkpoint: any number of streams can feed a store, and with a new
    checkpoint a stream is a new one. name replaces the id; two streams must not share it.
    """
    started, query = threading.Event(), None

    def apply(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        store.apply(batch, batch=(name or query.id, batch_id))

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    started.set()
    return query


def latest(changes: DataFrame, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The valid change of each key as a streaming aggregate, for update or complete mode.

    State is one row for each key and never expires, as late changes may still win.
    """
    columns = [c for c in changes.columns if c != "key"]
    winner = F.max_by(F.struct(*columns), F.struct(*order)).alias("w")
    return changes.where(F.col("key").isNotNull()).groupBy("key").agg(winner).select("key", "w.*")
