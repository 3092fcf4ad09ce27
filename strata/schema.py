"""Row types and options."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("is_deleted", T.BooleanType()),
    ]
)

CHANGE = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("is_deleted", T.BooleanType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Options:
    """Settings of a store; out-of-range values fall back as documented.

    memtable_threshold: distinct unflushed keys that trigger a flush; <= 0 never does.
    memtable_rows: unflushed rows that trigger a flush however few their keys; <= 0 never does.
    sparse_index_gap: rows between sparse-index entries; <= 0 means 10.
    fanout: runs of one level that trigger its compaction; <= 1 means 4.
    buckets: hash buckets of every run, fixed when the store is created;
        None takes spark.sql.shuffle.partitions. See buckets_for.
    bloom: write Parquet Bloom filters on the key.
    background: flush and compact on a thread of the store; barrier() waits for it.
    """

    memtable_threshold: int = 2000
    memtable_rows: int = 0
    sparse_index_gap: int = 10
    fanout: int = 4
    buckets: int | None = None
    bloom: bool = True
    background: bool = False

    def __post_init__(self) -> None:
        if self.sparse_index_gap <= 0:
            object.__setattr__(self, "sparse_index_gap", 10)
        if self.fanout <= 1:
            object.__setattr__(self, "fanout", 4)
        if self.buckets is not None and not 1 <= self.buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets must be from 1 to {MOST_BUCKETS}")


#: Spark refuses more buckets, unless spark.sql.sources.bucketing.maxBuckets says otherwise.
MOST_BUCKETS = 100_000
#: Bytes of live state for one bucket, and the most buckets that buckets_for gives: 2 GB each at 100 TB.
BUCKET_BYTES, BUCKETS_AT_MOST = 256 << 20, 50_000


def buckets_for(live_bytes: int) -> int:
    """Buckets for a store of so many bytes of live state; larger buckets spill while they are merged, and stay correct."""
    return min(BUCKETS_AT_MOST, max(1, -(-live_bytes // BUCKET_BYTES)))
