"""Queries that run the store, the native files, the filter and the command line over change_log, and their SQL.

change_log is cut into BATCHES batches by its numbers; rows with a null key are stored nowhere.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import bloom
from ..operators.fold import fold, is_put
from ..schema import CHANGE, Options
from ..sources.native import Corrupt, NativeFiles, frames, level_and_seq
from ..sources.shared import Fs, work_dir
from ..streaming.ingest import ingest
from .store import Store

BATCHES = 3


def changes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/change_log.parquet")


def batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """The change log in BATCHES ranges of seq of the same width."""
    c = changes(spark, d)
    lo, hi = c.agg(F.min("seq"), F.max("seq")).first()
    number = F.expr(f"(seq - {lo}) * {BATCHES} div ({hi} - {lo} + 1)")
    return [c.where(number == i) for i in range(BATCHES)]


def opened(spark: SparkSession, **options) -> Store:
    return Store.open(spark, work_dir(spark, "store"), Options(**({"memtable_threshold": 0} | options)), CHANGE)


def _live(store: Store) -> DataFrame:
    return store.state().select(F.hex("key").alias("key_hex"), "ts", F.hex("value").alias("value_hex"))


def store_put_delete(spark, d):
    """SK1, SK2, FN8, LK6: the latest put of each key, then a tombstone for each key that ends deleted."""
    c = changes(spark, d).where("key IS NOT NULL")
    store = opened(spark)
    store.put(fold(c.where(is_put())).select("key", "value", "ts"))
    store.delete(fold(c).where("is_deleted").select("key", "ts"))
    return _live(store)


def store_log(spark, d):
    """SC1, SC2, SC4, SK3, SK4, SK10, MT10, MT11: batches appended, the store closed and opened, the log replayed."""
    store = opened(spark)
    for b in batches(spark, d):
        store.apply(b)
    store.close()
    log = Store.open(spark, store.path).log()
    return log.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "ts", "seq", "is_deleted")


def store_segments(spark, d):
    """SC4, SC12, SK4, SK11, SO4: the segments of the log in order, with padded names."""
    store = opened(spark)
    for b in batches(spark, d):
        store.apply(b)
    rows = [(s.segment, s.path.rsplit("/", 1)[1].rsplit("-", 1)[0], s.n_records, s.min_seq, s.max_seq) for s in store.manifest.pending()]
    return spark.createDataFrame(rows, "segment long, name string, n_records long, min_seq long, max_seq long")


def store_recover(spark, d):
    """MT5, MT6, MT7, LK2, LK3: two batches flushed, a third appended; after opening again only the third is replayed."""
    first, second, third = batches(spark, d)
    store = opened(spark)
    store.apply(first)
    store.apply(second)
    store.flush()
    store.apply(third)
    store.close()
    again = Store.open(spark, store.path).recover()
    return again.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "ts", "seq", "is_deleted")


def store_flush(spark, d):
    """SK5, SK7-SK9, SC9, SC10, AG5, AG8, SO2: one run a batch, with its place and statistics."""
    store = opened(spark)
    for b in batches(spark, d):
        store.apply(b)
        store.flush()
    return store.manifest_df().drop("path")


def store_compaction(spark, d):
    """MT1-MT4, MT12, AG3, AG6, AG7, SO2, SO3, SO8, SO9: a flush a batch in the background, two runs of a level merge; what runs are there in the end."""
    store = opened(spark, memtable_threshold=1, fanout=2, background=True)
    for b in batches(spark, d):
        store.apply(b)
        store.barrier()
    return store.manifest_df().drop("path", "run_seq")


def store_state(spark, d):
    """LK1, SO5, SO8: log and runs of several levels, opened again and merged on read."""
    store = opened(spark, fanout=2)
    for i, b in enumerate(batches(spark, d)):
        store.apply(b)
        if i < BATCHES - 1:
            store.flush()
    store.close()
    return _live(Store.open(spark, store.path))


def store_get(spark, d):
    """LK1, LK4, SO5, SO6: single keys, from the runs and the log: the first, the last, the first deleted one and one that is not there."""
    first, second, third = batches(spark, d)
    store = opened(spark)
    store.apply(first.unionByName(second))
    store.flush()
    store.apply(third)
    lo, hi = changes(spark, d).agg(F.min("key"), F.max("key")).first()
    gone = store.latest().where("is_deleted").agg(F.min("key")).first()[0]
    rows = [(bytes(k).hex().upper(), None if v is None else v.hex().upper(), found) for k in (lo, hi, gone, b"no such key") for v, found in [store.get(bytes(k))]]
    return spark.createDataFrame(rows, "key_hex string, value_hex string, found boolean")


def store_multi_get(spark, d):
    """LK7: the key of every incoming record looked up in runs and log."""
    first, second, third = batches(spark, d)
    store = opened(spark)
    store.apply(first.unionByName(second))
    store.flush()
    store.apply(third)
    found = store.multi_get(spark.read.parquet(f"{d}/incoming_record.parquet").select("key"))
    return found.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "found")


def store_vacuum(spark, d):
    """MT8, SC12: what a vacuum leaves of the log and the runs; numbers go on, and the state stays."""
    first, second, third = batches(spark, d)
    store = opened(spark, fanout=2)
    for b in (first, second):
        store.apply(b)
        store.flush()
    store.apply(third)
    gone = store.vacuum()
    again = Store.open(spark, store.path)
    left = [len([n for n in Fs(spark, store.path).names(x) if not n.startswith((".", "_"))]) for x in ("log", "runs")]
    m = again.manifest
    counts = again.state().agg(F.count(F.lit(1)).alias("n_live"))
    return counts.select("n_live", *[F.lit(v).alias(n) for n, v in (("n_gone", len(gone)), ("n_segments", left[0]), ("n_runs", left[1]), ("next_segment", m.next_segment))])


def store_snapshot(spark, d):
    """TL3, TL4, AG5, AG7: the counters with two batches flushed and one in the log."""
    first, second, third = batches(spark, d)
    store = opened(spark)
    for b in (first, second):
        store.apply(b)
        store.flush()
    store.apply(third)
    n = ("total_keys", "live_keys", "memtable_keys", "run_rows", "run_tombstones", "memtable_rows", "wal_segments", "sstables", "compactions", "flushes")
    return store.snapshot(exact=True).select(*n)


def store_events(spark, d):
    """TL1, TL2, TL5, FN11: what the store told of its work, by type and stage, with no negative time."""
    store = opened(spark, fanout=2)
    for b in batches(spark, d):
        store.apply(b)
        store.flush()
    store.delete(changes(spark, d).select("key").limit(1))
    store.get(b"no such key")
    return store.events().groupBy("type", "stage").agg(F.count(F.lit(1)).alias("n"), (F.min("duration_ms") >= 0).alias("timed"))


def store_index(spark, d):
    """SO7, SC8, LK5: every tenth key of each run with its place."""
    store = opened(spark, sparse_index_gap=10)
    for b in batches(spark, d):
        store.apply(b)
        store.flush()
    return store.index().select("run_id", F.hex("key").alias("key_hex"), "pos")


def ingest_state(spark, d):
    """Stream of the replay callback, SK3, SK7: the change log as a stream into a store, each micro-batch once."""
    store = opened(spark)
    stream = spark.readStream.schema(CHANGE).option("pathGlobFilter", "*.parquet").parquet(_streamed(spark, d, "change_log"))
    query = ingest(stream.drop("seq"), store, work_dir(spark, "ingest"))
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return store.latest().select(F.hex("key").alias("key_hex"), "ts")


def _streamed(spark: SparkSession, d: str, name: str) -> str:
    """A table's path as streams take it: a folder, or a pattern with a single match."""
    path = f"{d}/{name}.parquet"
    return f"{path[:-1]}[{path[-1]}]" if Fs(spark, path).is_file() else path


def _records(c: DataFrame) -> DataFrame:
    return c.where("key IS NOT NULL").select("key", F.when(is_put(), F.col("value")).alias("value"), "ts", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"))


def _native(spark: SparkSession, folder: str, **options):
    spark.dataSource.register(NativeFiles)
    return spark.read.format("strata_native").options(**options).load(folder)


def _written(spark: SparkSession, rows: DataFrame, kind: str) -> str:
    spark.dataSource.register(NativeFiles)
    folder = work_dir(spark, "native")
    rows.write.format("strata_native").option("kind", kind).mode("append").save(folder)
    return folder


def _run_folder(spark: SparkSession, d: str) -> str:
    rows = _records(fold(changes(spark, d))).repartitionByRange(4, "key").sortWithinPartitions("key")
    return _written(spark, rows, "run")


def native_log(spark, d):
    """SC3, SC4, SK3, FN6, FN7, FN12: all changes written as framed log files and replayed."""
    r = _native(spark, _written(spark, _records(changes(spark, d)), "log"))
    return r.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "ts", "is_deleted")


def native_torn(spark, d):
    """SC3, FN6: a log cut within its last record ends before it; a changed byte is told."""
    folder = _written(spark, _records(changes(spark, d)).coalesce(1), "log")
    files = Fs(spark, folder)
    name = files.names()[0]
    whole = files.read_bytes(name)
    files.delete(name)
    files.write_bytes(name, whole[:-3])
    n = _native(spark, folder).count()
    damaged = whole[:10] + bytes([whole[10] ^ 1]) + whole[11:]
    try:
        told = not any(True for _ in frames(damaged, len(damaged), True))
    except Corrupt:
        told = True
    return spark.createDataFrame([(n, told)], "n_records long, told boolean")


def native_run(spark, d):
    """SK5, SC5-SC8, SC11, SO1: the folded changes as run files with filter, index and footer, read back."""
    level, seq = level_and_seq(F.col("file"))
    r = _native(spark, _run_folder(spark, d), kind="run").withColumns({"level": level, "seq": seq})
    return r.where("seq > 0").select("level", F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "ts", "is_deleted")


def native_get(spark, d):
    """LK4, LK5, FN3, FN4, SO6: single keys by filter, index and a bounded scan of each run file."""
    folder = _run_folder(spark, d)
    lo, hi = changes(spark, d).agg(F.min("key"), F.max("key")).first()
    found = None
    for k in (lo, hi, b"no such key"):
        one = _native(spark, folder, kind="run", key=bytes(k).hex())
        found = one if found is None else found.unionByName(one)
    return found.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "ts", "is_deleted")


def bloom_places(spark, d):
    """FN2, FN3, FN5: the bits of every key in a filter of 16 bits a key."""
    keys = changes(spark, d).select("key").where("key IS NOT NULL").distinct()
    bits, hashes = bloom.size_for(keys.count())
    return keys.select(F.hex("key").alias("key_hex"), F.posexplode(bloom.bit_places(F.col("key"), bits, hashes)).alias("hash", "place"))


def bloom_probe(spark, d):
    """FN1-FN5: a filter of the changed keys asked for every incoming key: none is missed, few are wrong."""
    keys = changes(spark, d).select("key").where("key IS NOT NULL").distinct()
    b = bloom.Bloom.unpack(bloom.build(keys, "key", *bloom.size_for(keys.count())).pack())
    asked = spark.read.parquet(f"{d}/incoming_record.parquet").select("key").where("key IS NOT NULL").distinct()
    asked = asked.join(keys.withColumn("there", F.lit(True)), "key", "left").withColumn("maybe", bloom.might_contain(spark, F.col("key"), b))
    n = asked.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("there").alias("n_there"),
        F.count(F.when(F.col("there") & F.col("maybe"), 1)).alias("n_found"),
        F.count(F.when(F.col("there").isNull() & F.col("maybe"), 1)).alias("n_wrong"),
    )
    return n.select("n_keys", "n_there", "n_found", (F.col("n_wrong") <= 2 + 0.005 * F.col("n_keys")).alias("few_wrong"))


def cli_lines(spark, d):
    """CLI: what the command line prints for a put, a read, a delete with a read, and a compaction."""
    folder, out = work_dir(spark, "cli"), []
    for args in (["-put-key", "k", "-put-value", "v"], ["-get-key", "k"], ["-get-key", "k", "-del-key", "k"], ["-compact"]):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            code = cli.main(["-data-dir", folder, *args], spark)
        out += [(line, code) for line in said.getvalue().splitlines()]
    return spark.createDataFrame([(i, line, code) for i, (line, code) in enumerate(out)], "n int, line string, code int")


QUERIES = {
    f.__name__: f
    for f in (
        store_put_delete, store_log, store_segments, store_recover, store_flush, store_compaction, store_state, store_get, store_multi_get,
        store_vacuum, store_snapshot, store_events, store_index, ingest_state, native_log, native_torn, native_run, native_get, bloom_places,
        bloom_probe, cli_lines,
    )
}

_C = (
    "c AS (SELECT key, CASE WHEN NOT coalesce(is_deleted, FALSE) THEN value END AS value, ts, seq, coalesce(is_deleted, FALSE) AS is_deleted,"
    f" (seq - lo) * {BATCHES} // (hi - lo + 1) AS b FROM change_log, (SELECT min(seq) AS lo, max(seq) AS hi FROM change_log) q WHERE key IS NOT NULL)"
)
_LAST = "(SELECT *, row_number() OVER (PARTITION BY {} key ORDER BY ts DESC, seq DESC) AS rn FROM c {}) t WHERE rn = 1"
_ALL, _BY_BATCH = _LAST.format("", ""), _LAST.format("b,", "")
_RECORD = "upper(hex(key)) AS key_hex, upper(hex(value)) AS value_hex, ts"
_NATIVE = "upper(hex(key)) AS key_hex, CASE WHEN NOT is_deleted THEN upper(hex(coalesce(value, ''::BLOB))) END AS value_hex, ts, is_deleted"
_STATS = "count(*) AS n_records, count(*) FILTER (WHERE is_deleted) AS n_tombstones, upper(hex(min(key))) AS min_key, upper(hex(max(key))) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq"
_ASKED = "SELECT min(key) AS k FROM c UNION ALL SELECT max(key) FROM c UNION ALL"
_LIVE = f"SELECT {_RECORD} FROM {_ALL} AND NOT is_deleted"
#: FNV-1a of the bytes of a key, of 64 and 32 bits.
_FNV = "list_reduce(list_prepend({0}::UHUGEINT, bytes), lambda x, y: (xor(x, y) * {1}::UHUGEINT) % {2}::UHUGEINT)"
_FNV64, _FNV32 = _FNV.format(*bloom.FNV64, 1 << 64), _FNV.format(*bloom.FNV32, 1 << 32)

SQL = {
    "store_put_delete": f"WITH {_C} {_LIVE}",
    "store_state": f"WITH {_C} {_LIVE}",
    "store_log": f"WITH {_C} SELECT {_RECORD}, seq, is_deleted FROM c",
    "store_segments": f"WITH {_C} SELECT b + 1 AS segment, 'seg-' || lpad(CAST(b + 1 AS VARCHAR), 12, '0') AS name, count(*) AS n_records, min(seq) AS min_seq, max(seq) AS max_seq FROM c GROUP BY b",
    "store_recover": f"WITH {_C} SELECT {_RECORD}, seq, is_deleted FROM {_BY_BATCH} AND b = {BATCHES - 1}",
    "store_flush": f"WITH {_C} SELECT CAST(0 AS INT) AS level, b + 1 AS run_seq, {_STATS} FROM {_BY_BATCH} GROUP BY b",
    "store_compaction": f"""WITH {_C}, two AS (SELECT * FROM {_LAST.format("", "WHERE b < 2")}), three AS (SELECT * FROM {_LAST.format("", "WHERE b = 2")})
SELECT CAST(1 AS INT) AS level, {_STATS} FROM two UNION ALL SELECT 0, {_STATS} FROM three""",
    "store_get": f"""WITH {_C}, last AS (SELECT * FROM {_ALL}),
asked AS ({_ASKED} SELECT min(key) FROM last WHERE is_deleted UNION ALL SELECT 'no such key'::BLOB)
SELECT upper(hex(k)) AS key_hex, upper(hex(value)) AS value_hex, key IS NOT NULL AS found FROM asked LEFT JOIN last ON k = key AND NOT is_deleted""",
    "store_multi_get": f"WITH {_C}, last AS (SELECT * FROM {_ALL}) SELECT upper(hex(r.key)) AS key_hex, upper(hex(l.value)) AS value_hex, l.key IS NOT NULL AS found FROM incoming_record r LEFT JOIN last l ON r.key = l.key AND NOT l.is_deleted",
    # Gone: the two flushed segments, and the two runs that were merged.
    "store_vacuum": f"WITH {_C} SELECT count(*) AS n_live, CAST(4 AS INT) AS n_gone, CAST(1 AS INT) AS n_segments, CAST(1 AS INT) AS n_runs, CAST({BATCHES + 1} AS INT) AS next_segment FROM {_ALL} AND NOT is_deleted",
    "store_snapshot": f"""WITH {_C}, last AS (SELECT * FROM {_ALL}), runs AS (SELECT * FROM {_BY_BATCH})
SELECT (SELECT count(*) FROM last) AS total_keys, (SELECT count(*) FROM last WHERE NOT is_deleted) AS live_keys, (SELECT count(*) FROM runs WHERE b = 2) AS memtable_keys,
(SELECT count(*) FROM runs WHERE b < 2) AS run_rows, (SELECT count(*) FROM runs WHERE b < 2 AND is_deleted) AS run_tombstones, (SELECT count(*) FROM c WHERE b = 2) AS memtable_rows,
CAST(3 AS BIGINT) AS wal_segments, CAST(2 AS BIGINT) AS sstables, CAST(0 AS BIGINT) AS compactions, CAST(2 AS BIGINT) AS flushes""",
    # Three batches and flushes; the first two runs are merged.
    "store_events": "SELECT type, stage, CAST(n AS BIGINT) AS n, TRUE AS timed FROM (VALUES ('recover', 'recovery', 1), ('put', 'wal', 3), ('flush', 'flush', 3), ('compact', 'maintenance', 1), ('delete', 'wal', 1), ('get', 'lookup', 1)) v (type, stage, n)",
    "store_index": f"WITH {_C} SELECT b + 1 AS run_id, upper(hex(key)) AS key_hex, pos FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY key) - 1 AS pos FROM {_BY_BATCH}) p WHERE pos % 10 = 0",
    "ingest_state": f"WITH {_C} SELECT upper(hex(key)) AS key_hex, ts FROM {_ALL}",
    "native_log": f"WITH {_C} SELECT {_NATIVE} FROM c",
    "native_torn": f"WITH {_C} SELECT count(*) - 1 AS n_records, TRUE AS told FROM c",
    "native_run": f"WITH {_C} SELECT CAST(0 AS BIGINT) AS level, {_NATIVE} FROM {_ALL}",
    "native_get": f"WITH {_C}, last AS (SELECT * FROM {_ALL}) SELECT {_NATIVE} FROM ({_ASKED} SELECT 'no such key'::BLOB) a JOIN last ON k = key",
    "bloom_places": f"""WITH k AS (SELECT DISTINCT key FROM change_log WHERE key IS NOT NULL), m AS (SELECT greatest({bloom.LEAST_BITS}, {bloom.BITS_PER_KEY} * count(*)) AS bits FROM k),
x AS (SELECT upper(hex(key)) AS key_hex, list_transform(range(0, octet_length(key)), lambda i: ('0x' || substr(hex(key), CAST(2 * i + 1 AS BIGINT), 2))::INT::UHUGEINT) AS bytes FROM k),
h AS (SELECT key_hex, {_FNV64} AS h1, {_FNV32} AS h2 FROM x)
SELECT key_hex, CAST(i AS INT) AS hash, CAST((h1 + i::UHUGEINT * h2) % {1 << 64}::UHUGEINT % bits::UHUGEINT AS BIGINT) AS place FROM h, m, range(0, {bloom.HASHES}) r (i)""",
    "bloom_probe": "WITH k AS (SELECT DISTINCT key FROM change_log WHERE key IS NOT NULL), a AS (SELECT DISTINCT key FROM incoming_record WHERE key IS NOT NULL) SELECT count(*) AS n_keys, count(k.key) AS n_there, count(k.key) AS n_found, TRUE AS few_wrong FROM a LEFT JOIN k ON a.key = k.key",
    "cli_lines": "SELECT CAST(n AS INT) AS n, line, CAST(0 AS INT) AS code FROM (VALUES (0, 'put ok'), (1, 'k => v'), (2, 'delete ok'), (3, 'not found'), (4, 'compaction ok')) v (n, line)",
}
