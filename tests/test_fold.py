import random

import pytest

from strata.operators.fold import fold, live, merge
from strata.operators.lookup import index_seek, multi_get, sparse_index

SCHEMA = "key binary, value binary, ts long, seq long, is_deleted boolean"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    return {tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows}


def test_latest_by_time_then_arrival(spark):
    df = frame(spark, [(b"k", b"new", 5, 1, False), (b"k", b"late", 3, 2, False), (b"t", b"a", 7, 3, False), (b"t", b"b", 7, 4, False)])
    assert plain(live(df).select("key", "value").collect()) == {(b"k", b"new"), (b"t", b"b")}


def test_tombstone_hides_and_comes_back(spark):
    df = frame(spark, [(b"k", b"v", 1, 1, False), (b"k", None, 2, 2, True), (b"x", b"v", 3, 3, False), (b"x", None, 2, 4, True)])
    assert plain(live(df).select("key").collect()) == {(b"x",)}
    assert fold(df).count() == 2


def test_null_value_of_the_winner_stays(spark):
    df = frame(spark, [(b"k", b"v", 1, 1, False), (b"k", None, 2, 2, False), (b"e", b"v", 1, 3, False), (b"e", b"", 2, 4, None)])
    assert plain(live(df).select("key", "value").collect()) == {(b"k", None), (b"e", b"")}


def test_keys_that_differ_in_a_byte_and_the_empty_key(spark):
    keys = [b"", b"\x00", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff"]
    df = frame(spark, [(k, b"v", 1, i, False) for i, k in enumerate(keys)])
    assert [bytes(r.key) for r in live(df).orderBy("key").collect()] == sorted(keys)


def test_empty_and_extra_columns(spark):
    df = frame(spark, [])
    assert live(df).count() == 0
    odd = spark.createDataFrame([(b"k", b"v", 1, 1, False, "x", 2)], SCHEMA + ", `_winner` string, `a.b` int")
    assert live(odd).collect()[0]["a.b"] == 2


def test_merge_ties(spark):
    a, b = frame(spark, [(b"k", b"first", 1, 1, False)]), frame(spark, [(b"k", b"second", 1, 2, False)])
    assert bytes(merge([a, b]).head().value) == b"second"
    assert bytes(merge([a, b], ties="first").head().value) == b"first"
    assert merge([]) is None


@pytest.mark.parametrize("seed", range(3))
def test_fold_against_a_dictionary(spark, seed):
    rnd = random.Random(seed)
    rows = [(bytes([rnd.randrange(20)]), bytes([rnd.randrange(256)]), rnd.randrange(30), i, rnd.random() < 0.3) for i in range(400)]
    want = {}
    for r in rows:
        if r[0] not in want or (r[2], r[3]) > want[r[0]][2:4]:
            want[r[0]] = r
    assert plain(fold(frame(spark, rows)).collect()) == set(want.values())


def test_multi_get_keeps_rows(spark):
    state = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    keys = spark.createDataFrame([(k, "x", 1) for k in ("a", "a", "b", "z", None)], "key string, value string, found int")
    got = sorted(map(tuple, multi_get(keys, state).collect()), key=str)
    assert got == sorted([("a", "1", True), ("a", "1", True), ("b", None, True), ("z", None, False), (None, None, False)], key=str)


def test_sparse_index_and_seek(spark):
    keys = [f"k{i:03d}" for i in range(97)]
    run = spark.createDataFrame([(0, k) for k in keys], "run_id int, key string")
    idx = sparse_index(run, 10)
    assert sorted(r.pos for r in idx.collect()) == list(range(0, 97, 10))
    probes = ["a", "k000", "k009", "k010", "k0105", "z", None]
    got = {r.key: r.start_pos for r in index_seek(spark.createDataFrame([(p,) for p in probes], "key string"), idx).collect()}
    assert got == {"a": None, "k000": 0, "k009": 0, "k010": 10, "k0105": 10, "z": 90, None: None}


def test_positions_over_ranges_of_many_runs(spark):
    rows = [(r, f"k{i:04d}") for r, n in ((0, 1), (1, 500), (2, 77)) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = {(r.run_id, r.key): r.pos for r in sparse_index(spark.createDataFrame(rows, "run_id int, key string").repartition(5), 7).collect()}
    assert got == {(r, f"k{i:04d}"): i for r, n in ((0, 1), (1, 500), (2, 77)) for i in range(0, n, 7)}


def test_seek_against_a_search(spark):
    import bisect

    rnd = random.Random(2)
    entries = sorted({rnd.randrange(10**6) for _ in range(300)})
    probes = [rnd.randrange(10**6) for _ in range(1000)] + entries[:5]
    idx = spark.createDataFrame([(f"{k:07d}", p * 10) for p, k in enumerate(entries)], "key string, pos int")
    got = {r.key: r.start_pos for r in index_seek(spark.createDataFrame([(f"{p:07d}",) for p in probes], "key string").repartition(4), idx).collect()}
    want = {f"{p:07d}": (j - 1) * 10 if (j := bisect.bisect_right(entries, p)) else None for p in probes}
    assert got == want
    none = index_seek(spark.createDataFrame([("a",)], "key string"), idx.where("false")).collect()
    assert [(r.key, r.start_pos) for r in none] == [("a", None)]
