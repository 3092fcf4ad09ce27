"""Queries over the test tables, each with the operators of the survey it runs, and their SQL.

The change log of these queries is the events table: key = user_id as text,
value = props, seq = ts = event_id, a tombstone for each error event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import decode_record, encode_record
from ..operators.change_feed import apply_feed, current_state
from ..operators.fold import fold, live, merge
from ..operators.lookup import index_seek, multi_get, sparse_index
from ..sources.manifest import level_stats
from ..sources.native import level_and_seq
from ..sources.runs import run_stats
from ..telemetry import counts
from . import lifecycle

Query = Callable[[SparkSession, str], DataFrame]

#: Consecutive changes that make one run.
RUN = 100


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clog(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("is_deleted"),
    )


def run_rows(spark: SparkSession, d: str) -> DataFrame:
    runs = clog(spark, d).withColumn("run_id", F.floor(F.col("seq") / RUN).cast("int"))
    return fold(runs, ("run_id", "key"), ("seq",)).select("key", "value", "seq", "is_deleted", "run_id")


def change_log(spark, d):
    """SK1, SK2, FN8: events as put and tombstone rows."""
    return clog(spark, d)


def memtable_latest(spark, d):
    """AG1, AG2: the latest change per key, tombstones included."""
    return fold(clog(spark, d), order=("seq",))


def live_state(spark, d):
    """LK1, LK6: the live keys."""
    return live(clog(spark, d), order=("seq",)).select("key", "value")


def tombstones(spark, d):
    """LK6 complement, Q5: keys whose latest change is a delete."""
    return fold(clog(spark, d), order=("seq",)).where(F.col("is_deleted")).select("key", "seq")


def get_point(spark, d):
    """LK1, LK4: one key; the predicate reaches the scan before the fold."""
    return live(clog(spark, d).where(F.col("key") == "7"), order=("seq",)).select("key", "value")


def multi_get_query(spark, d):
    """LK7: every customer key looked up in the live state."""
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return multi_get(keys, live_state(spark, d))


def flush_runs(spark, d):
    """SK5, SK7, SC6: one row per run and key."""
    return run_rows(spark, d)


def compact_merge(spark, d):
    """AG3, MT2, SO8: all runs, as three inputs, merged."""
    r = run_rows(spark, d).withColumn("ts", F.col("seq"))
    return merge([r.where(F.col("run_id") % 3 == i).drop("run_id") for i in range(3)]).select("key", "value", "seq", "is_deleted")


def compact_merge_ties(spark, d):
    """AG3 tie rule, Q4: coarse times, among equal times the first run wins."""
    r = run_rows(spark, d).withColumn("ts", F.floor(F.col("seq") / 5000).cast("int"))
    return fold(r.withColumn("tie", -F.col("run_id")), order=("ts", "tie"), columns=("run_id", "seq"))


def levels_overfull(spark, d):
    """AG6: levels with at least 34 runs."""
    runs = run_rows(spark, d).select((F.col("run_id") % 3).cast("int").alias("level"), F.col("run_id").alias("run_seq"), F.lit(1).alias("n_records")).distinct()
    return level_stats(runs, 34).where("overfull").select(F.col("level").alias("lvl"), F.col("n_runs").alias("n"))


def layered_get(spark, d):
    """LK1, SO5: newest layer first; its key and value equal live_state."""
    r = run_rows(spark, d).withColumn("layer", F.when(F.col("run_id") >= 80, 1).otherwise(0))
    return live(r, order=("layer", "run_id"), columns=("value", "run_id", "is_deleted")).select("key", "value", "run_id")


def sparse_index_query(spark, d):
    """SO7: every tenth key of each run."""
    return sparse_index(run_rows(spark, d).select("run_id", "key"), 10).select("run_id", "key", "pos")


def index_seek_query(spark, d):
    """LK5: where a forward scan for each key begins in the merged runs, an as-of lookup."""
    merged = fold(run_rows(spark, d).drop("run_id"), order=("seq",)).select(F.lit(0).alias("run_id"), "key")
    return index_seek(clog(spark, d).select("key").distinct(), sparse_index(merged, 10).select("key", "pos"))


def index_seek_bytes(spark, d):
    """LK5, SO7: every key of the change log looked up in the sparse index of all stored runs, merged."""
    merged = fold(table(spark, d, "run_row").where("key IS NOT NULL")).select("key", F.lit(0).alias("run_id"))
    found = index_seek(table(spark, d, "change_log"), sparse_index(merged, 10).select("key", "pos"))
    return found.select(F.hex("key").alias("key_hex"), "start_pos")


def snapshot_size(spark, d):
    """AG5, SC9, AG8: manifest columns of each run."""
    return run_rows(spark, d).groupBy("run_id").agg(*run_stats(n="n_records", t="n_tomb", lo="min_key", hi="max_key"))


def replay_suffix(spark, d):
    """MT5: the fold of the changes after checkpoint 6000."""
    return fold(clog(spark, d).where("seq > 6000"), order=("seq",))


def space_amp(spark, d):
    """MT2: rows in runs that a merge would drop. Counted from one shuffle on the key."""
    per_key = run_rows(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), (F.sum("n") - F.count(F.lit(1))).alias("n_dead"))


def telemetry_counts(spark, d):
    """TL5: events by type."""
    return counts(table(spark, d, "events").withColumnRenamed("event_type", "type")).withColumnRenamed("type", "event_type")


def record_codec(spark, d):
    """FN6, FN7, SK3: change_log rows encoded as framed log entries and decoded again."""
    c = table(spark, d, "change_log")
    e = encode_record(F.col("key"), F.col("value"), F.col("ts"), F.coalesce("is_deleted", F.lit(False)))
    frames = c.where(F.col("key").isNotNull()).select("seq", e.alias("e"))
    r = frames.select("seq", decode_record(F.col("e")).alias("r"), F.length("e").alias("n_bytes"))
    return r.select("seq", F.hex("r.key").alias("key_hex"), F.hex("r.value").alias("value_hex"), "r.ts", "r.is_deleted", "n_bytes")


def run_merge(spark, d):
    """AG3, MT2: all stored runs merged to one row per key, tombstones kept."""
    r = fold(table(spark, d, "run_row").where("key IS NOT NULL"))
    return r.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "ts", "seq", "is_deleted")


def manifest_levels(spark, d):
    """SC9, AG6-AG8: finished runs, their rows, the newest one and overfullness by level."""
    return level_stats(table(spark, d, "run_manifest").where("n_records IS NOT NULL"), 4)


def manifest_check(spark, d):
    """Q16: recorded row count of each finished run beside the rows that are stored, repeated ones once."""
    r = table(spark, d, "run_row").distinct().groupBy(F.col("run_id").cast("long").alias("run_seq")).agg(F.count(F.lit(1)).alias("n_stored"))
    m = table(spark, d, "run_manifest").where("n_records IS NOT NULL").select("path", "run_seq", "n_records")
    return m.join(r, "run_seq", "left").withColumn("wrong", ~F.col("n_records").eqNullSafe(F.col("n_stored")))


def segment_names(spark, d):
    """SC11, SC12, SK11, FN10: level and sequence out of run file names."""
    level, seq = level_and_seq(F.col("path"), "run", "parquet")
    named = table(spark, d, "run_manifest").select("path", level.alias("lvl"), seq.alias("seq"))
    return named.where("seq IS NOT NULL").withColumn("padded", F.format_string("%020d", "seq"))


def p3_found(spark, d):
    """Problem 3: live keys after all changes of change_log, by the log-structured merge store."""
    return current_state(apply_feed(table(spark, d, "change_log"), columns=()))


def p3_current_state(spark, d):
    """Problem 3: each live key with the value of its valid change."""
    state = current_state(apply_feed(table(spark, d, "change_log"), columns=("value",)))
    return state.select("key_hex", "seq", F.hex("value").alias("value_hex"))


QUERIES: dict[str, Query] = {
    "change_log": change_log,
    "memtable_latest": memtable_latest,
    "live_state": live_state,
    "tombstones": tombstones,
    "get_point": get_point,
    "multi_get": multi_get_query,
    "flush_runs": flush_runs,
    "compact_merge": compact_merge,
    "compact_merge_ties": compact_merge_ties,
    "levels_overfull": levels_overfull,
    "layered_get": layered_get,
    "sparse_index": sparse_index_query,
    "index_seek": index_seek_query,
    "index_seek_bytes": index_seek_bytes,
    "snapshot_size": snapshot_size,
    "replay_suffix": replay_suffix,
    "space_amp": space_amp,
    "telemetry_counts": telemetry_counts,
    "record_codec": record_codec,
    "run_merge": run_merge,
    "manifest_levels": manifest_levels,
    "manifest_check": manifest_check,
    "segment_names": segment_names,
    "p3_found": p3_found,
    "p3_current_state": p3_current_state,
} | lifecycle.QUERIES

CL = "clog AS (SELECT CAST(user_id AS VARCHAR(20)) AS key, props AS value, event_id AS seq, event_type='error' AS is_deleted FROM events)"
RUNS = (
    CL
    + ", runs AS (SELECT key,value,seq,is_deleted, CAST(floor(seq/100) AS INT) AS run_id FROM clog),"
    + " run_rows AS (SELECT key,value,seq,is_deleted,run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id,key ORDER BY seq DESC) rn FROM runs) t WHERE rn=1)"
)
LATEST = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM clog) t WHERE rn=1"
VALID = "(SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) rn FROM {} WHERE key IS NOT NULL) t WHERE rn=1"
STATE = "SELECT upper(hex(key)) AS key_hex, seq{} FROM " + VALID.format("change_log") + " AND NOT coalesce(is_deleted, FALSE)"
DEAD_VALUE = "CASE WHEN NOT coalesce(is_deleted, FALSE) THEN value END"

SQL: dict[str, str] = {
    "change_log": f"WITH {CL} SELECT * FROM clog",
    "memtable_latest": f"WITH {CL} SELECT key,value,seq,is_deleted FROM {LATEST}",
    "live_state": f"WITH {CL} SELECT key,value FROM {LATEST} AND NOT is_deleted",
    "tombstones": f"WITH {CL} SELECT key,seq FROM {LATEST} AND is_deleted",
    "get_point": f"WITH {CL} SELECT key,value FROM {LATEST} AND NOT is_deleted AND key='7'",
    "multi_get": f"WITH {CL} SELECT CAST(c_custkey AS VARCHAR(20)) AS key, l.value, l.key IS NOT NULL AS found FROM customer LEFT JOIN (SELECT key,value FROM {LATEST} AND NOT is_deleted) l ON l.key=CAST(c_custkey AS VARCHAR(20))",
    "flush_runs": f"WITH {RUNS} SELECT * FROM run_rows",
    "compact_merge": f"WITH {RUNS} SELECT key,value,seq,is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM run_rows) t WHERE rn=1",
    "compact_merge_ties": f"WITH {RUNS} SELECT key,run_id,seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CAST(floor(seq/5000) AS INT) DESC, run_id ASC) rn FROM run_rows) t WHERE rn=1",
    "levels_overfull": f"WITH {RUNS} SELECT lvl, n FROM (SELECT CAST(run_id % 3 AS INT) lvl, count(DISTINCT run_id) n FROM run_rows GROUP BY CAST(run_id % 3 AS INT)) t WHERE n>=34",
    "layered_get": f"WITH {RUNS} SELECT key,value,run_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN run_id>=80 THEN 0 ELSE 1 END, run_id DESC) rn FROM run_rows) t WHERE rn=1 AND NOT is_deleted",
    "sparse_index": f"WITH {RUNS} SELECT run_id,key,pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key)-1 AS pos FROM run_rows) t WHERE pos % 10 = 0",
    "index_seek": f"WITH {RUNS}, merged AS (SELECT DISTINCT key FROM run_rows), idx AS (SELECT key,pos FROM (SELECT key, row_number() OVER (ORDER BY key)-1 AS pos FROM merged) t WHERE pos % 10 = 0) SELECT k.key, max(i.pos) AS start_pos FROM (SELECT DISTINCT key FROM clog) k LEFT JOIN idx i ON i.key<=k.key GROUP BY k.key",
    "index_seek_bytes": f"WITH idx AS (SELECT key,pos FROM (SELECT key, row_number() OVER (ORDER BY key)-1 AS pos FROM {VALID.format('run_row')}) t WHERE pos % 10 = 0) SELECT upper(hex(k.key)) AS key_hex, i.pos AS start_pos FROM (SELECT DISTINCT key FROM change_log) k ASOF LEFT JOIN idx i ON i.key<=k.key",
    "snapshot_size": f"WITH {RUNS} SELECT run_id, count(*) n_records, sum(CASE WHEN is_deleted THEN 1 ELSE 0 END) n_tomb, min(key) min_key, max(key) max_key FROM run_rows GROUP BY run_id",
    "replay_suffix": f"WITH {CL} SELECT key,value,seq,is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM clog WHERE seq>6000) t WHERE rn=1",
    "space_amp": f"WITH {RUNS} SELECT count(*) AS n_rows, count(DISTINCT key) n_keys, count(*)-count(DISTINCT key) n_dead FROM run_rows",
    "telemetry_counts": "SELECT event_type, count(*) n FROM events GROUP BY event_type",
    "record_codec": f"SELECT seq, upper(hex(key)) AS key_hex, CASE WHEN coalesce(is_deleted, FALSE) THEN NULL ELSE upper(hex(coalesce(value, ''::BLOB))) END AS value_hex, ts, coalesce(is_deleted, FALSE) AS is_deleted, CAST(25 + octet_length(key) + coalesce(octet_length({DEAD_VALUE}), 0) AS INT) AS n_bytes FROM change_log WHERE key IS NOT NULL",
    "run_merge": f"SELECT upper(hex(key)) AS key_hex, upper(hex(value)) AS value_hex, ts, seq, is_deleted FROM {VALID.format('run_row')}",
    "manifest_levels": "SELECT level, count(*) AS n_runs, sum(n_records) AS n_rows, max(run_seq) AS max_run, count(*) >= 4 AS overfull FROM run_manifest WHERE n_records IS NOT NULL GROUP BY level",
    "manifest_check": "SELECT m.path, m.run_seq, m.n_records, r.n_stored, m.n_records IS DISTINCT FROM r.n_stored AS wrong FROM run_manifest m LEFT JOIN (SELECT run_id, count(*) n_stored FROM (SELECT DISTINCT * FROM run_row) d GROUP BY run_id) r ON r.run_id = m.run_seq WHERE m.n_records IS NOT NULL",
    "segment_names": r"SELECT path, CAST(regexp_extract(path, '^l(\d+)-run-(\d+)\.parquet$', 1) AS BIGINT) AS lvl, CAST(regexp_extract(path, '^l(\d+)-run-(\d+)\.parquet$', 2) AS BIGINT) AS seq, lpad(regexp_extract(path, '^l(\d+)-run-(\d+)\.parquet$', 2), 20, '0') AS padded FROM run_manifest WHERE regexp_matches(path, '^l(\d+)-run-(\d+)\.parquet$')",
    "p3_found": STATE.format(""),
    "p3_current_state": STATE.format(", upper(hex(value)) AS value_hex"),
} | lifecycle.SQL
