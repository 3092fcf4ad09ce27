import random
from collections import Counter

import pytest

from strata.llm import heavy as H


def found(df, **kw):
    return {(r.g, bytes(r.key)): (r.n, r.approx) for r in H.frequent(df, "key", "g", **kw).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_counting(spark, seed):
    rnd = random.Random(seed)
    keys = [bytes([rnd.randrange(256) for _ in range(rnd.randrange(6))]) for _ in range(40)]
    rows = [("t", rnd.choice(keys) if rnd.random() < 0.5 else b"k%d" % rnd.randrange(10**6)) for _ in range(6000)]
    rows += [("u", k) for _, k in rows[:500]] + [("u", None)] * 100
    df = spark.createDataFrame(rows, "g string, key binary").repartition(3)
    want = {}
    for g in ("t", "u"):
        c = Counter(k for t, k in rows if t == g and k is not None)
        n = sum(c.values())
        want |= {(g, k): v for k, v in c.items() if v * 100 >= n}
    got = found(df)
    assert {k: v for k, (v, _) in got.items()} == want
    assert all(a >= n for n, a in got.values())


def test_threshold_itself_counts(spark):
    rows = [("g", b"x")] * 7 + [("g", b"y%d" % i) for i in range(693)]  # 7 of 700 is 1 %
    assert set(found(spark.createDataFrame(rows, "g string, key binary"))) == {("g", b"x")}


def test_dominant_key_and_empty_key(spark):
    rows = [("g", b"")] * 700 + [("g", b"\x00")] * 200 + [(None, b"n")] * 3
    assert {k: v for k, (v, _) in found(spark.createDataFrame(rows, "g string, key binary")).items()} == {("g", b""): 700, ("g", b"\x00"): 200, (None, b"n"): 3}


def test_empty_and_null_tables(spark):
    df = spark.createDataFrame([("g", None)], "g string, key binary")
    assert found(df) == {} and found(df.where("false")) == {}


def test_sketches_add(spark):
    df = spark.range(5000).selectExpr("'g' as g", "cast(cast(id % 50 as string) as binary) as key")
    whole = H.sketch(df, "key", "g", 2, 64)
    parts = H.add(H.sketch(df.where("key < '3'"), "key", "g", 2, 64).unionByName(H.sketch(df.where("key >= '3'"), "key", "g", 2, 64)), "g")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_many_candidates_are_joined(spark, monkeypatch):
    rows = [(f"g{i % 7}", b"k%d" % (i % 3)) for i in range(300)] + [(None, b"n")]
    df = spark.createDataFrame(rows, "g string, key binary")
    want = found(df)
    monkeypatch.setattr(H, "MAX_BROADCAST", 3)
    assert found(df) == want and len(want) == 22
