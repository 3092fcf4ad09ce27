import random

import pytest
from pyspark.sql import functions as F

from strata.operators.change_feed import apply_feed, current_state
from strata.operators.fold import fold
from strata.plans.store import Closed, Store
from strata.schema import Options
from strata.sources import manifest as M
from strata.sources.shared import Fs, work_root

NEVER = Options(memtable_threshold=0, buckets=2)
CHANGES = "key binary, value binary, ts long, is_deleted boolean"


def put(store, *pairs, **kw):
    return store.put(store.spark.createDataFrame(list(pairs), "key binary, value binary"), **kw)


def delete(store, *keys):
    return store.delete(store.spark.createDataFrame([(k,) for k in keys], "key binary"))


def state(store):
    return {bytes(r.key): None if r.value is None else bytes(r.value) for r in store.state().collect()}


def test_restart(spark, folder):
    s = Store.open(spark, folder, NEVER)
    put(s, (b"name", b"v"))
    s.close()
    assert Store.open(spark, folder, NEVER).get(b"name") == (b"v", True)


def test_flush_at_the_threshold(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=2, buckets=2))
    put(s, (b"a", b"1"))
    assert not s.manifest.runs
    put(s, (b"a", b"1b"))
    assert not s.manifest.runs  # still one key
    put(s, (b"b", b"2"))
    assert len(s.manifest.runs) == 1 and not s.manifest.pending()
    put(s, (b"c", b"3"))
    assert s.get(b"a") == (b"1b", True) and s.get(b"c") == (b"3", True) and s.get(b"d") == (None, False)


def test_delete_hides_flushed_value(spark, folder):
    s = Store.open(spark, folder, NEVER)
    put(s, (b"k", b"v"))
    s.flush()
    delete(s, b"k")
    assert s.get(b"k") == (None, False)
    s.flush()
    assert s.get(b"k") == (None, False) and state(s) == {}
    assert s.latest().count() == 1  # the tombstone is kept


def test_compaction_promotes(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=1, fanout=2, buckets=2))
    for i in range(4):
        put(s, (b"k%d" % i, b"v%d" % i))
    assert {r.level for r in s.manifest.runs} == {2}
    assert state(s) == {b"k%d" % i: b"v%d" % i for i in range(4)}


def test_compaction_of_overwrites_and_deletes(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=1, fanout=4, buckets=2))
    put(s, (b"k1", b"v1"))
    put(s, (b"k1", b"v2"))
    put(s, (b"k2", b"v3"))
    delete(s, b"k2")
    assert len(s.manifest.runs) == 1 and s.manifest.runs[0].n_tombstones == 1
    assert state(s) == {b"k1": b"v2"}
    assert s.compact() == 0


def test_newest_wins_in_deep_levels(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=1, fanout=2, buckets=2))
    for v in (b"1", b"2", b"3", b"4", b"5", b"6"):
        put(s, (b"k", v))
    assert s.get(b"k") == (b"6", True)


def test_late_and_equal_times(spark, folder):
    s = Store.open(spark, folder, NEVER)
    rows = lambda *r: spark.createDataFrame(list(r), CHANGES)
    s.apply(rows((b"a", b"new", 10, False), (b"t", b"x", 5, False)))
    s.flush()
    s.apply(rows((b"a", b"old", 3, False), (b"t", b"y", 5, False)))
    assert state(s) == {b"a": b"new", b"t": b"y"}


def test_recovery_replays_only_what_no_run_covers(spark, folder):
    s = Store.open(spark, folder, NEVER)
    put(s, (b"k", b"v1"))
    s.flush()
    put(s, (b"k", b"v2"))
    s = Store.open(spark, folder, NEVER)
    assert [bytes(r.value) for r in s.recover().collect()] == [b"v2"]
    s.flush()
    assert s.recover().count() == 0 and s.vacuum() and state(s) == {b"k": b"v2"}
    again = Store.open(spark, folder, NEVER)
    assert state(again) == {b"k": b"v2"} and again.manifest.next_segment == 3


def test_leftovers_are_ignored_and_vacuumed(spark, folder, tmp_path):
    s = Store.open(spark, folder, NEVER)
    put(s, (b"k", b"v"))
    s.flush()
    for p in ("log/seg-000000000099-1", "runs/strata_run=99", "runs/x.tmp"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "part.parquet").write_bytes(b"torn")
    s = Store.open(spark, folder, NEVER)
    assert state(s) == {b"k": b"v"}
    assert "runs/strata_run=99" in s.vacuum()
    assert not (tmp_path / "runs/strata_run=99").exists() and state(s) == {b"k": b"v"}


def test_closed_store_refuses(spark, folder):
    s = Store.open(spark, folder, NEVER)
    s.close()
    s.close()
    for call in (lambda: s.get(b"k"), s.flush, s.compact, s.state, lambda: put(s, (b"k", b"v"))):
        with pytest.raises(Closed):
            call()
    with pytest.raises(ValueError):
        Store.open(spark, "")


def test_a_version_is_taken_once(spark, folder):
    a = Store.open(spark, folder, NEVER)
    old = a.manifest
    put(a, (b"k", b"a"))
    with pytest.raises(M.Conflict):
        M.commit(Fs(spark, folder), old)


def test_writers_of_two_processes(spark, folder):
    a, b = Store.open(spark, folder, NEVER), Store.open(spark, folder, NEVER)
    put(a, (b"k", b"a"))
    put(b, (b"k", b"b"), (b"x", b"b"))  # tried again on what a committed
    a.flush()
    put(b, (b"y", b"b"))
    a.refresh()
    assert state(a) == state(Store.open(spark, folder, NEVER)) == {b"k": b"b", b"x": b"b", b"y": b"b"}


def test_concurrent_writers(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    s = Store.open(spark, folder, Options(memtable_threshold=60, fanout=2, buckets=2))
    with ThreadPoolExecutor(5) as pool:
        list(pool.map(lambda w: put(s, *[(b"w%d-k%d" % (w, i), b"v%d" % i) for i in range(50)]), range(5)))
    assert state(s) == {b"w%d-k%d" % (w, i): b"v%d" % i for w in range(5) for i in range(50)}
    assert s.manifest.runs and len({r.run_seq for r in s.manifest.runs}) == len(s.manifest.runs)


def test_batches_apply_once_and_empty_ones_nothing(spark, folder):
    s = Store.open(spark, folder, NEVER)
    assert put(s, (b"k", b"1"), batch=("b", 1)) == 1
    assert put(s, (b"k", b"2"), batch=("b", 1)) == 0
    assert s.put(spark.createDataFrame([], "key binary, value binary")) == 0
    assert s.put(spark.createDataFrame([], "key binary, value binary"), batch=("b", 2)) == 0
    assert put(s, (b"k", b"2"), batch=("b", 2)) == 0
    assert state(s) == {b"k": b"1"} and s.manifest.batches == {"b": 2}


def test_a_repeat_is_known_however_many_batches_others_applied(spark, folder):
    s = Store.open(spark, folder, NEVER)
    assert put(s, (b"k", b"old"), batch=("rests", 7)) == 1
    # As 3,000 commits of other streams would leave the manifest.
    s._commit(lambda m: {"batches": m.batches | {f"other{i}": 1000 for i in range(3000)}})
    assert put(s, (b"k", b"new"), batch=("works", 0)) == 1
    s = Store.open(spark, folder)
    assert put(s, (b"k", b"old"), batch=("rests", 7)) == 0
    assert state(s) == {b"k": b"new"}


def test_null_keys_are_stored_nowhere(spark, folder):
    s = Store.open(spark, folder, NEVER)
    assert put(s, (None, b"x"), (b"k", b"v")) == 1
    assert state(s) == {b"k": b"v"}
    s.flush()
    assert state(s) == {b"k": b"v"}
    assert put(s, (None, b"x")) == 0 and s.manifest.next_segment == 2


def test_background_work_and_barrier(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=1, fanout=2, buckets=2, background=True))
    for i in range(4):
        put(s, (b"k%d" % i, b"v%d" % i))
    s.barrier()
    assert not s.manifest.pending() and s.manifest.flushes >= 1
    assert state(s) == {b"k%d" % i: b"v%d" % i for i in range(4)}
    s._tasks.append(s._start(lambda: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        s.barrier()
    put(s, (b"k9", b"v9"))
    s.close()  # waits
    assert Store.open(spark, folder).get(b"k9") == (b"v9", True)


def test_a_flush_lets_batches_in(spark, folder, monkeypatch):
    """What is appended while a run is written stays in the log; nothing is written twice."""
    s = Store.open(spark, folder, NEVER)
    put(s, (b"a", b"1"))
    write, runs = s._write, []

    def slow(rows, level):
        runs.append(write(rows, level))
        put(s, (b"b", b"2"))
        other = Store.open(spark, folder, NEVER)  # as another process would
        put(other, (b"c", b"3"))
        return runs[-1]

    monkeypatch.setattr(s, "_write", slow)
    s.flush()
    assert len(runs) == 1 and len(s.manifest.runs) == 1
    assert [x.n_records for x in s.manifest.pending()] == [1, 1]
    assert state(s) == {b"a": b"1", b"b": b"2", b"c": b"3"}


def test_a_merge_of_merged_runs_is_given_up(spark, folder, monkeypatch):
    options = Options(memtable_threshold=0, fanout=2, buckets=2)
    s = Store.open(spark, folder, Options(memtable_threshold=0, fanout=9, buckets=2))
    for i in range(2):
        put(s, (b"k%d" % i, b"v"))
        s.flush()
    a, b = Store.open(spark, folder, options), Store.open(spark, folder, options)
    write = a._write
    monkeypatch.setattr(a, "_write", lambda rows, level: (write(rows, level), b.compact())[0])
    assert a.compact() == 0 and b.manifest.compactions == 1
    a.refresh()
    assert len(a.manifest.runs) == 1 and state(a) == {b"k0": b"v", b"k1": b"v"}


def test_rows_of_few_keys_are_flushed(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=5, memtable_rows=3, buckets=2))
    for i in range(3):
        put(s, (b"k", b"%d" % i))
    assert len(s.manifest.runs) == 1 and state(s) == {b"k": b"2"}


def test_keys_are_counted_only_when_they_can_suffice(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=3, buckets=2))
    for i in range(4):
        put(s, (b"k", b"%d" % i))
    assert s._next_count == 5 and not s.manifest.runs  # counted at three rows, one key
    put(s, (b"l", b""), (b"m", b""))
    assert len(s.manifest.runs) == 1


def test_runs_of_a_feed_hold_as_many_rows_whatever_the_gaps(spark):
    df = spark.range(1000).selectExpr("cast(cast(id as string) as binary) as key", "id as ts", "if(id < 900, id, id << 33) as seq", "false as is_deleted")
    sizes = [r.n_records for r in apply_feed(df, options=Options(fanout=9)).manifest.runs]
    assert sum(sizes) == 1000 and len(sizes) == 5 and max(sizes) < 300


def test_damage_raises(spark, folder, tmp_path):
    s = Store.open(spark, folder, NEVER)
    s.put(spark.range(2000).selectExpr("cast(cast(id as string) as binary) as key", "cast(cast(id * 7 as string) as binary) as value"))
    s.flush()
    s.verify()
    f = next((tmp_path / "runs").rglob("*.parquet"))
    data = bytearray(f.read_bytes())
    data[200] ^= 0xFF
    f.write_bytes(data)
    for crc in f.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        s.verify()


def test_multi_get_and_point_reads_use_one_bucket(spark, folder, monkeypatch):
    s = Store.open(spark, folder, Options(memtable_threshold=0, buckets=4))
    put(s, *[(b"k%d" % i, b"v%d" % i) for i in range(50)])
    s.flush()
    put(s, (b"k1", b"new"))
    keys = spark.createDataFrame([(b"k1",), (b"k2",), (b"no",), (b"k2",), (None,)], "key binary")
    want = [(b"", None, False), (b"k1", b"new", True), (b"k2", b"v2", True), (b"k2", b"v2", True), (b"no", None, False)]
    read = lambda: sorted((r.key and bytes(r.key) or b"", r.value and bytes(r.value), r.found) for r in s.multi_get(keys).collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert read() == want
    assert "SelectedBucketsCount: 1 out of 4" in plan(fold(s._rows().where("key = X'6B31'")))
    one = plan(s.multi_get(keys.limit(1)))
    assert "SelectedBucketsCount: 1 out of 4" in one and "PushedFilters: [In(key" in one or "EqualTo(key" in one
    monkeypatch.setattr("strata.plans.store.FEW_KEYS", 2)
    assert read() == want
    assert s.multi_get(keys.where("false")).count() == 0 and s.multi_get(keys.where("key is null")).first().found is False


def test_merge_on_read_has_no_shuffle(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=1, fanout=9, buckets=2))
    for v in (b"1", b"2", b"3"):
        put(s, (b"k", v))
    assert len(s.manifest.runs) == 3
    assert "Exchange" not in s.state()._jdf.queryExecution().executedPlan().toString()
    assert state(s) == {b"k": b"3"}


def test_two_runs_are_merged_as_they_stream_by(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=0, fanout=9, buckets=2))
    rows = lambda *r: spark.createDataFrame(list(r), "key binary, value binary, ts long, is_deleted boolean")
    s.apply(rows((b"a", b"1", 5, False), (b"b", b"1", None, False), (b"c", b"1", 1, False), (b"", b"1", 1, False)))
    s.flush()
    assert "Aggregate" not in s.latest()._jdf.queryExecution().executedPlan().toString()
    s.apply(rows((b"a", b"late", 4, False), (b"b", b"2", 1, False), (b"c", None, 1, True), (b"d", None, 7, False)))
    s.flush()
    plan = s.state()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert state(s) == {b"a": b"1", b"b": b"2", b"": b"1", b"d": None}
    assert s.latest().columns == s.schema.fieldNames() and s.latest().count() == 5


def test_index_manifest_and_telemetry(spark, folder):
    s = Store.open(spark, folder, Options(memtable_threshold=0, sparse_index_gap=10, buckets=2))
    put(s, *[(b"k%02d" % i, b"v") for i in range(25)])
    s.flush()
    delete(s, b"k00")
    s.get(b"k01")
    assert sorted(r.pos for r in s.index().collect()) == [0, 10, 20]
    m = s.manifest_df().collect()[0]
    assert (m.n_records, m.level, bytes.fromhex(m.min_key), bytes.fromhex(m.max_key)) == (25, 0, b"k00", b"k24")
    stats = s.snapshot(exact=True).collect()[0]
    assert (stats.total_keys, stats.live_keys, stats.memtable_keys, stats.sstables, stats.flushes) == (25, 24, 1, 1, 1)
    quick = s.snapshot().collect()[0]
    assert (quick.run_rows, quick.run_tombstones, quick.memtable_rows, quick.total_keys) == (25, 0, 1, None)
    kinds = [r.type for r in s.events().collect()]
    assert kinds == ["recover", "put", "flush", "delete", "get"] and s.events().count() == 0


def test_events_are_dropped_when_full(spark):
    from strata.telemetry import Telemetry

    t = Telemetry(spark, buffer=2)
    for _ in range(5):
        t.publish("put", "m", "wal", 0)
    assert t.dropped == 3 and t.events().count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_random_work_against_a_dictionary(spark, folder, seed):
    rnd = random.Random(seed)
    s = Store.open(spark, folder, Options(memtable_threshold=0, fanout=2, buckets=2))
    want, seq = {}, 0
    for _ in range(5):
        rows = []
        for _ in range(30):
            seq += 1
            rows.append((bytes([rnd.randrange(12)]), bytes([rnd.randrange(256)]), rnd.randrange(40), seq, rnd.random() < 0.3))
        s.apply(spark.createDataFrame(rows, "key binary, value binary, ts long, seq long, is_deleted boolean"))
        for k, v, ts, q, d in rows:
            if k not in want or (ts, q) > want[k][:2]:
                want[k] = (ts, q, d, v)
        step = rnd.choice(("flush", "open", "none", "vacuum"))
        if step == "flush":
            s.flush()
        elif step == "open":
            s = Store.open(spark, folder, Options(memtable_threshold=0, fanout=2, buckets=2))
        elif step == "vacuum":
            s.vacuum()
        assert state(s) == {k: v for k, (_, _, d, v) in want.items() if not d}


def test_feed_handles_dirt(spark):
    rows = [
        (b"a", b"1", 5, 1, False, "x"), (b"a", b"1", 5, 3, False, "x"), (b"a", b"0", 4, 4, False, "x"),
        (b"b", b"1", 5, 2, False, "x"), (b"b", b"del", 6, 5, True, "x"),
        (None, b"1", 9, 6, False, "x"), (b"", None, 1, 7, None, "x"), (b"n", b"", None, 8, False, "x"),
        (b"a", b"1", 5, 3, False, "x"),
    ]
    df = spark.createDataFrame(rows, "key binary, value binary, ts long, seq long, is_deleted boolean, key_hex string")
    got = {(r.key_hex, r.seq) for r in current_state(apply_feed(df, columns=("value",))).collect()}
    assert got == {("61", 3), ("", 7), ("6E", 8)}
    clash = apply_feed(df.withColumn("run_id", F.lit(1)).withColumn("level", F.lit(2)))
    assert clash.state().select("run_id", "level").distinct().count() == 1
    empty = apply_feed(df.where("false"))
    assert current_state(empty).count() == 0


def test_hot_key_is_folded_before_the_shuffle(spark):
    df = spark.range(20000).selectExpr(
        "cast(if(id % 3 = 0, 'hot', concat('k', id)) as binary) as key", "id as ts", "id as seq", "false as is_deleted"
    )
    store = apply_feed(df, runs=3)
    assert current_state(store).count() == 13334
    hot = store.latest().where("key = X'686F74'").head()
    assert hot.seq == 19998


def test_work_root_reads_the_setting(spark, monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return {"spark.checkpoint.dir": "file:///shared/x/"}.get(name, default)

    class Session:
        conf = Conf()

    assert work_root(Session()) == "file:///shared/x"
    assert Fs(spark, work_root(spark)).root
