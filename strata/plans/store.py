"""The store: put, delete, get, flush, compact, recover, vacuum over a manifest."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fold import fold, is_put, newest
from ..operators.lookup import sparse_index
from ..schema import CHANGE, Options
from ..sources import manifest as M
from ..sources.runs import PARTITION, ddl, prepare, read_runs, write_run
from ..sources.shared import Fs
from ..telemetry import Telemetry

#: Keys that multi_get writes into the plan, at most: they choose buckets and row groups. More are joined.
FEW_KEYS = 1000

#: Times that a commit is tried again after another writer committed first.
TRIES = 20


class Closed(RuntimeError):
    """The store is closed."""


class Store:
    """A log-structured merge store of key changes.

    Layout below its path: log/seg-N-X (committed batches as they came), runs/strata_run=N-X
    (folded, bucketed and sorted), _manifest/vN.json. The valid change of a key is
    the one with the greatest (ts, seq) over all layers; tombstones are kept in
    the runs and filtered after the fold. Null keys are never stored. Flush and compaction
    run inside the call, or with Options.background on a thread of the store.

    A commit that another writer was faster with is put on top of that one's version;
    what was written stays written. Only a batch whose numbers were taken meanwhile, and a
    merge whose runs another process has merged, are given up, the first to be written again.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options, fs: Fs, state: M.Manifest) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._fs, self._m, self._open = fs, state, True
        # Appends take turns, and so do flushes and merges; each holds the last lock only to commit.
        self._appending, self._working, self._committing = threading.RLock(), threading.RLock(), threading.RLock()
        self._pool: ThreadPoolExecutor | None = None
        self._tasks: list[Future] = []
        self._next_count = 0
        self.telemetry = Telemetry(spark)

    # -- open and close

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, schema: T.StructType = CHANGE) -> Store:
        """Open or create a store (MT10). schema has key, ts, seq, is_deleted and any further columns.

        Files that the manifest does not name are ignored (a torn batch, leftovers of
        a failed write); a damaged manifest raises. Sets how the session reads runs, see runs.prepare.
        """
        if not path:
            raise ValueError("a store needs a path")
        options = options or Options()
        prepare(spark)
        fs = Fs(spark, path)
        began = time.monotonic()
        state = M.load(fs)
        if state is None:
            missing = {"key", "ts", "seq", "is_deleted"} - set(schema.fieldNames())
            if missing:
                raise ValueError(f"schema lacks {sorted(missing)}")
            if PARTITION in schema.fieldNames():
                raise ValueError(f"{PARTITION} is no column name of a store")
            buckets = options.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            state = M.commit(fs, M.Manifest(), buckets=buckets, columns=ddl(schema))
        store = cls(spark, path, options, fs, state)
        store.telemetry.recovered(began, sum(s.n_records for s in state.pending()))
        return store

    def close(self) -> None:
        """Wait for background work and refuse further calls; unflushed changes stay in the log (MT11). Idempotent."""
        try:
            self._wait()
        finally:
            self._open = False
            if self._pool is not None:
                self._pool.shutdown()
                self._pool = None

    def barrier(self) -> None:
        """Wait until all background flushes and merges have ended, and raise what one of them raised (MT12)."""
        self._check()
        self._wait()

    def _wait(self) -> None:
        while self._tasks:
            self._tasks.pop(0).result()

    def _check(self) -> None:
        if not self._open:
            raise Closed(self.path)

    def refresh(self) -> None:
        """Take the newest version, with what other processes have committed since."""
        self._check()
        with self._committing:
            self._m = M.load(self._fs)

    @property
    def manifest(self) -> M.Manifest:
        return self._m

    def _commit(self, change: Callable[[M.Manifest], dict | None]) -> bool:
        """Publish what change makes of the newest version; False if it makes nothing of it."""
        with self._committing:
            for left in range(TRIES, 0, -1):
                fields = change(self._m)
                if fields is None:
                    return False
                try:
                    self._m = M.commit(self._fs, self._m, **fields)
                    return True
                except M.Conflict:
                    if left == 1:
                        raise
                    time.sleep(random.random() * 0.1)
                    self._m = M.load(self._fs)
        return False

    def _drop(self, path: str) -> None:
        self._fs.delete(path[len(self.path) + 1 :])

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self._m.columns)

    # -- writing

    def put(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append rows of key, value and optionally ts, seq (SK1). Returns the rows appended.

        Without ts the time of the call is taken, in nanoseconds. Without seq rows are
        numbered after all earlier ones; numbers are stored with the rows, unique and
        growing from batch to batch, with gaps. A given seq must be unique and above
        those before it. Extra columns are ignored and rows with a null key left out. An empty
        batch changes nothing. batch names a stream and the number of this batch of it,
        which grow; a number that is not above the stream's last is a repeat and appends nothing.
        """
        return self._append(df.withColumn("is_deleted", F.lit(False)), batch, "put")

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append a tombstone for each row of key (SK2); whether the key exists is not asked."""
        return self._append(keys.withColumn("is_deleted", F.lit(True)), batch, "delete")

    def apply(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append puts and tombstones as their is_deleted says."""
        return self._append(changes, batch, "put")

    def _append(self, df: DataFrame, batch: tuple[str, int] | None, kind: str) -> int:
        with self._appending:
            self._check()
            n = None
            for _ in range(TRIES):
                if (n := self._append_once(df, batch, kind)) is not None:
                    break
            else:
                raise M.Conflict("other writers took the numbers of this batch each time")
            full = n and self._is_full()
        if full:
            self._maintain()
        return n

    def _append_once(self, df: DataFrame, batch: tuple[str, int] | None, kind: str) -> int | None:
        """Rows appended, None if another process took the numbers of the rows meanwhile."""
        repeat = lambda m: batch is not None and m.batches.get(batch[0], -1) >= batch[1]
        if repeat(self._m):
            return 0
        began = time.monotonic()
        base = self._m.next_seq
        if "ts" not in df.columns:
            df = df.withColumn("ts", F.lit(time.time_ns()))
        numbered = "seq" not in df.columns
        if numbered:
            df = df.withColumn("seq", F.lit(base) + F.monotonically_increasing_id())
        cols = []
        for f in self.schema.fields:
            col = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
            col = F.coalesce(col, F.lit(False)) if f.name == "is_deleted" else col
            if f.name == "value":  # a tombstone carries no value
                col = F.when(is_put(), col)
            cols.append(col.cast(f.dataType).alias(f.name))
        path = f"{self.path}/log/seg-{self._m.next_segment:012d}-{uuid.uuid4().hex}"
        seen = Observation()
        out = df.where(F.col("key").isNotNull()).select(*cols).observe(
            seen, F.count(F.lit(1)).alias("n"), F.min("seq").alias("s0"), F.max("seq").alias("s1")
        )
        out.write.mode("overwrite").parquet(path)
        m = seen.get
        if m["n"] and (m["s0"] is None or m["s0"] < base):
            self._drop(path)
            raise ValueError(f"seq must be at least {base}, the batch begins at {m['s0']}")
        taken = False

        def change(new: M.Manifest) -> dict | None:
            nonlocal taken
            taken = bool(m["n"]) and m["s0"] < new.next_seq and not repeat(new)
            if taken or repeat(new):
                return None
            fields: dict = {"batches": new.batches | {batch[0]: batch[1]}} if batch is not None else {}
            if m["n"]:
                segment = M.Segment(path, new.next_segment, m["n"], m["s0"], m["s1"])
                fields |= {"segments": (*new.segments, segment), "next_segment": new.next_segment + 1, "next_seq": m["s1"] + 1}
            return fields or None

        done = self._commit(change)
        if not done or not m["n"]:
            self._drop(path)
            if taken and not numbered:
                raise ValueError(f"seq must be at least {self._m.next_seq}, the batch begins at {m['s0']}")
            return None if taken else 0
        self.telemetry.wrote(kind, began, m["n"])
        return m["n"]

    def _is_full(self) -> bool:
        """Whether the unflushed log has enough distinct keys, or rows, to be flushed (SK7).

        A row adds one key at most, so after a count nothing is counted before the missing keys could have come.
        """
        pending = self._m.pending()
        rows = sum(s.n_records for s in pending)
        if 0 < self.options.memtable_rows <= rows:
            return True
        threshold = self.options.memtable_threshold
        if threshold <= 0 or rows < max(threshold, self._next_count):
            return False
        keys = self._log(pending).select("key").distinct().limit(threshold).count()
        self._next_count = rows + threshold - keys
        return keys >= threshold

    def _maintain(self) -> None:
        """Flush, here or on the store's thread."""
        if not self.options.background:
            self.flush()
            return
        self._tasks.append(self._start(self.flush))

    def _start(self, work: Callable[[], object]) -> Future:
        if self._pool is None:
            self._pool = ThreadPoolExecutor(1, thread_name_prefix="strata")
        return self._pool.submit(work)

    def _log(self, segments: Sequence[M.Segment]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in segments])

    def log(self) -> DataFrame:
        """All stored changes of the log in no particular order; order by seq to replay (SC1, SC2)."""
        self._check()
        return self._log(self._m.segments) if self._m.segments else self.spark.createDataFrame([], self.schema)

    def flush(self) -> M.Run | None:
        """Fold the unflushed log into a level-0 run and advance the checkpoint (SK7-SK9, MT6).

        Run and checkpoint are published in one commit, so there is no moment at which
        a change is in neither or in both, and the checkpoint only covers flushed segments.
        Batches that are appended meanwhile stay in the log.
        """
        with self._working:
            self._check()
            pending = self._m.pending()
            run = self._add_run(self._log(pending), max(s.max_seq for s in pending)) if pending else None
            self._next_count = 0
            if run is not None:
                self.compact()
        return run

    def add_run(self, changes: DataFrame) -> M.Run | None:
        """Fold a batch of changes straight into a sorted level-0 run: the bulk form of put and flush.

        Rows with a null key are left out. An empty batch writes no run. Compaction follows
        when a level is full.
        """
        with self._working:
            self._check()
            run = self._add_run(changes)
            if run is not None:
                self.compact()
        return run

    def _add_run(self, changes: DataFrame, checkpoint_seq: int = 0) -> M.Run | None:
        began = time.monotonic()
        rows = changes.where(F.col("key").isNotNull()).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields])
        run = self._write(rows, 0)
        named = None

        def change(new: M.Manifest) -> dict | None:
            nonlocal named
            if checkpoint_seq and new.checkpoint_seq >= checkpoint_seq:  # another process flushed these segments
                return None
            fields = {"checkpoint_seq": checkpoint_seq} if checkpoint_seq else {}
            if run is None:
                return fields or None
            named = replace(run, run_seq=new.next_run)
            # A null seq is smallest; such rows come in by add_run alone.
            following = max(new.next_seq, (run.max_seq if run.max_seq is not None else 0) + 1)
            return fields | {"runs": (*new.runs, named), "next_run": new.next_run + 1, "next_seq": following, "flushes": new.flushes + 1}

        if not self._commit(change):
            if run is not None:
                self._drop(run.path)
            return None
        if named is not None:
            self.telemetry.flushed(began, named)
        return named

    def _write(self, rows: DataFrame, level: int) -> M.Run | None:
        path = f"{self.path}/runs/{PARTITION}={self._m.next_run}-{uuid.uuid4().hex}"  # no writer touches another's files
        run = write_run(fold(rows), path, level, self._m.next_run, self._m.buckets, self.options.bloom)
        if run is None:
            self._drop(path)
        return run

    # -- compaction

    def compact(self) -> int:
        """Merge every full level into one run of the next level, lowest first, until none is full (MT1, MT2).

        Tombstones are kept, as older runs may still hold their keys. The merge reads
        the runs bucket by bucket and shuffles nothing. Returns the merges done.
        """
        done = 0
        with self._working:
            self._check()
            while (level := self._m.overfull(self.options.fanout)) is not None:
                began = time.monotonic()
                inputs = self._m.levels()[level]
                run = self._write(self._scan(inputs).drop(PARTITION), level + 1)
                gone = {r.path for r in inputs}

                def change(new: M.Manifest) -> dict | None:
                    if not gone <= {r.path for r in new.runs}:  # another process has merged some of them
                        return None
                    kept = tuple(r for r in new.runs if r.path not in gone)
                    return {"runs": (*kept, replace(run, run_seq=new.next_run)), "next_run": new.next_run + 1, "compactions": new.compactions + 1}

                if self._commit(change):
                    self.telemetry.compacted(began, level, inputs, self._m.runs[-1])
                    done += 1
                else:
                    self._drop(run.path)
        return done

    def vacuum(self) -> list[str]:
        """Delete segments at or below the checkpoint, and files that no manifest names (MT8).

        Waits for background work. Only for times without readers or writers of older versions
        in other processes. Returns what was deleted.
        """
        self.barrier()
        with self._appending, self._working:
            self._commit(lambda new: {"segments": tuple(new.pending())} if len(new.pending()) != len(new.segments) else None)
            keep = {x.path.rsplit("/", 1)[1] for x in (*self._m.segments, *self._m.runs)}
            gone = [f"{d}/{n}" for d in ("log", "runs") for n in self._fs.names(d) if n not in keep]
            for name in gone:
                self._fs.delete(name)
            newest = M.versions(self._fs)[-1]
            for n in self._fs.names(M.DIR):
                if n != f"v{newest:08d}.json":
                    self._fs.delete(f"{M.DIR}/{n}")
        return gone

    def remove(self) -> None:
        """Close the store and delete all its files."""
        self.close()
        self._fs.delete()

    # -- reading

    def _scan(self, runs: Iterable[M.Run]) -> DataFrame:
        return read_runs(self.spark, [(r.run_seq, r.path) for r in runs], self._m.columns, self._m.buckets)

    def _rows(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """All layers; of the runs only those whose keys can lie in [lo, hi], in hexadecimal."""
        runs = [r for r in self._m.runs if lo is None or (r.min_key <= hi and r.max_key >= lo)]
        pending = self._m.pending()
        out = self._scan(runs).drop(PARTITION) if runs else None
        if pending:
            log = self._log(pending)
            out = log if out is None else out.unionByName(log)
        return out if out is not None else self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        """The valid change of every key, tombstones included. Over runs alone it shuffles nothing.

        A run has a row for each key, so one run is read as it is, and two are merged as they
        stream by, each in its order. More runs, or a log, are folded.
        """
        self._check()
        runs = self._m.runs
        if self._m.pending() or not 1 <= len(runs) <= 2:
            return fold(self._rows())
        scans = [self._scan([r]).drop(PARTITION) for r in runs]
        return scans[0] if len(scans) == 1 else newest(*scans)

    def state(self) -> DataFrame:
        """The live keys with their values (LK6)."""
        return self.latest().where(is_put())

    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        """(value, found) of one key (LK1, LK4): reads one bucket of the runs that may hold it."""
        self._check()
        began = time.monotonic()
        key = bytes(key)
        code = key.hex().upper()
        rows = self._rows(code, code).where(F.col("key") == F.lit(key))
        found = fold(rows).where(is_put()).head()
        self.telemetry.read(began, found is not None)
        return (bytes(found.value) if found.value is not None else None, True) if found else (None, False)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value, found for every row of keys (LK7), repeated keys as often as given; a null key is not found.

        Up to FEW_KEYS keys are read once and written into the plan, where they choose the runs, buckets and row
        groups that are read. More are joined: runs keep their buckets, the keys are shuffled to them.
        """
        self._check()
        wanted = keys.select(F.col("key").cast("binary").alias("key"))
        few = [r.key for r in wanted.limit(FEW_KEYS + 1).collect()]
        if len(few) <= FEW_KEYS:
            wanted = self.spark.createDataFrame([(k,) for k in few], "key binary")
            codes = sorted(bytes(k).hex().upper() for k in few if k is not None)
            rows = self._rows(codes[0], codes[-1]) if codes else self._rows().where(F.lit(False))
            rows = rows.where(F.col("key").isin([F.unhex(F.lit(c)) for c in dict.fromkeys(codes)])) if codes else rows
        else:
            rows = self._rows().join(wanted.where(F.col("key").isNotNull()).distinct(), "key", "left_semi")
        state = fold(rows).where(is_put()).select("key", "value", F.lit(True).alias("found"))
        return wanted.join(state, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))

    def recover(self) -> DataFrame:
        """Fold of the changes after the checkpoint, tombstones included (MT5)."""
        self._check()
        pending = self._m.pending()
        return fold(self._log(pending)) if pending else self.spark.createDataFrame([], self.schema)

    def index(self) -> DataFrame:
        """run_id, key, pos: the sparse index of every run (SO7)."""
        self._check()
        if not self._m.runs:
            return self.spark.createDataFrame([], "run_id long, key binary, pos long")
        keys = self._scan(self._m.runs).select(F.col(PARTITION).alias("run_id"), "key")
        return sparse_index(keys, self.options.sparse_index_gap)

    def manifest_df(self) -> DataFrame:
        """One row per live run (SC9, SC10)."""
        fields = "path string, level int, run_seq long, n_records long, n_tombstones long, min_key string, max_key string, min_seq long, max_seq long"
        return self.spark.createDataFrame([tuple(vars(r)[c.split()[0]] for c in fields.split(", ")) for r in self._m.runs], fields)

    def verify(self) -> None:
        """Read every live file whole and compare row counts; damage or a wrong count raises (Q10, Q16)."""
        self._check()
        for r in self._m.runs:
            if (n := self._count(self.spark.read.parquet(r.path))) != r.n_records:
                raise RuntimeError(f"{r.path}: {n} rows, the manifest has {r.n_records}")
        for s in self._m.segments:
            if (n := self._count(self._log([s]))) != s.n_records:
                raise RuntimeError(f"{s.path}: {n} rows, the manifest has {s.n_records}")

    @staticmethod
    def _count(df: DataFrame) -> int:
        # The sum of hashes makes the scan read every column.
        return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).first().n

    # -- telemetry

    def snapshot(self, exact: bool = False) -> DataFrame:
        """One row of counters (TL3, TL4): rows and tombstones of the runs, unflushed rows, runs and times, from the manifest alone.

        With exact=True also the keys, live keys and unflushed keys, which take a fold; else they are null.
        """
        self._check()
        counts = (None, None, None)
        if exact:
            n = self.latest().agg(F.count(F.lit(1)).alias("total"), F.count(F.when(is_put(), 1)).alias("live")).first()
            counts = (n.total, n.live, self.recover().count())
        return self.telemetry.snapshot(*counts, self._m)

    def events(self) -> DataFrame:
        """The buffered events (TL1)."""
        return self.telemetry.events()
