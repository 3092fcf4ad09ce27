"""Applying a feed of inserts, updates and deletes (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import Store
from ..schema import Options
from ..sources.shared import work_dir

#: Runs that a bulk feed is appended in, whatever its size.
RUNS = 5
#: Of the quantiles that part the runs: their ranks are wrong by a share of 1 / ACCURACY at most.
ACCURACY = 1000
#: Runs of a level that are compacted into one of the next.
FANOUT = 4


def apply_feed(
    feed: DataFrame,
    path: str | None = None,
    columns: tuple[str, ...] | None = None,
    runs: int = RUNS,
    options: Options | None = None,
) -> Store:
    """Append a change feed to a log-structured merge store and return the store.

    feed has key BINARY, ts, seq BIGINT, is_deleted BOOLEAN and any payload; columns
    restricts the payload. It is cut into `runs` ranges of seq (the order of arrival), of about
    as many rows each whatever the gaps between numbers; each is folded to one row per key,
    written as a run sorted by key in hash buckets, and compacted with its level when `fanout`
    runs are there. Store.latest and Store.state then merge the runs bucket by bucket, without
    a shuffle. The bounds are approximate quantiles of seq, from a scan of that column alone;
    each range is then a scan of its own, which skips the row groups of other ranges.
    Without a path the store lies in the shared work folder, keeps only what its manifest
    names, and goes when the application ends.

    Repeated and late changes need no care: the fold takes the greatest (ts, seq) of a
    key whatever the order of arrival. The partial fold before the shuffle leaves one
    row per key and map task, so a key with a third of all changes is no hot spot.
    Rows with a null key are left out; a null is_deleted counts as a put, null ts or
    seq as smallest (rows with a null seq are in the first range). An empty feed gives
    an empty store. Columns not asked for are never read. Equal rows count once.
    """
    spark: SparkSession = feed.sparkSession
    names = ("key", "ts", "seq", "is_deleted")
    payload = [c for c in (columns if columns is not None else feed.columns) if c not in names]
    rows = feed.select(*[F.col(f"`{c}`") for c in (*names, *payload)])
    schema = T.StructType([rows.schema[c] for c in (*names, *payload)])
    store = Store.open(spark, path or work_dir(spark, "feed"), options or Options(fanout=FANOUT), schema)
    shares = [i / runs for i in range(1, runs)]
    cuts = rows.agg(F.percentile_approx("seq", shares, ACCURACY)).first()[0] if shares else None
    bounds = sorted(set(cuts or []))  # the last number of each range but the last
    seq = F.col("seq")
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = F.lit(True) if lo is None else seq > lo
        part = part if hi is None else part & (seq <= hi)
        store.add_run(rows.where(part | seq.isNull() if lo is None else part))
    if path is None:
        store.vacuum()
    return store


def current_state(store: Store) -> DataFrame:
    """key_hex, seq and the payload of each live key, null or empty value included."""
    state = store.state()
    payload = [c for c in state.columns if c not in ("key", "ts", "seq", "is_deleted")]
    return state.select(F.hex("key").alias("key_hex"), "seq", *payload)
