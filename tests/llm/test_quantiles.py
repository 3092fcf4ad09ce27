import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import quantiles as Q

BIG = 2**63 - 1


def test_quantize_keeps_order_and_small_values(spark):
    values = sorted({*range(-2047, 2048, 13), *[s * (2**k + d) for k in range(11, 63) for d in (-1, 0, 1, 77) for s in (1, -1)], BIG, -BIG, -BIG - 1})
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", Q.quantize(F.col("v")).alias("c")).select("v", "c", Q.dequantize(F.col("c")).alias("b")).collect()
    codes = [r.c for r in sorted(rows, key=lambda r: r.v)]
    assert codes == sorted(codes) and 0 < min(codes) and max(codes) < 1 << Q.DEPTH
    for r in rows:
        assert r.b == r.v if abs(r.v) < 2048 else abs(r.b - r.v) <= abs(r.v) / 1024 + 1


def check(values, row, eps=Q.EPS):
    s = np.sort(np.array(values, dtype=object))
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
        target, v = -(-len(s) * round(q * 100) // 100), row[name]
        slack = abs(v) // 1024 + 1 if abs(v) >= 2048 else 0
        under, upto = sum(x < v - slack for x in s), sum(x <= v + slack for x in s)
        assert upto >= target and under <= target + row.max_rank_error
    assert row.max_rank_error <= eps * len(s)


@pytest.mark.parametrize("seed", range(3))
def test_rank_error(spark, seed):
    rnd = random.Random(seed)
    values = [int(rnd.lognormvariate(3, 4)) * rnd.choice((1, 1, 1, -1)) for _ in range(30000)] + [7] * 3000
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)] * 5, "g string, v long")
    d = Q.digests(df, "v", ["g"])
    row = Q.quantiles(d, ["g"]).head()
    assert row.n == len(values) and d.count() <= 3 * Q._shape(Q.EPS)
    check(values, row)


def test_merged_days_keep_the_bound(spark):
    rnd = random.Random(5)
    rows = [(i % 6, int(rnd.expovariate(1 / 900))) for i in range(40000)]
    days = Q.digests(spark.createDataFrame(rows, "d int, v long"), "v", ["d"], 0.02)
    row = Q.quantiles(Q.merge(days, [], 0.02), [], eps=0.02).head()
    check([v for _, v in rows], row, 0.02)


def test_compression_respects_the_limit():
    rng = np.random.default_rng(1)
    node = np.unique(rng.integers(1 << Q.DEPTH, 1 << (Q.DEPTH + 1), 5000))
    n = rng.integers(1, 50, len(node))
    a, c = Q.compress_nodes(node, n, 100)
    assert c.sum() == n.sum() and len(set(a.tolist())) == len(a) <= 300
    assert (c[a < 1 << Q.DEPTH] <= n.sum() // 100).all()


def test_nulls_empty_and_cube(spark):
    df = spark.createDataFrame([(None, "t", 5), ("d", None, -3), ("d", "t", None)], "day string, type string, v long")
    c = Q.cube(Q.digests(df, "v", ["day", "type"]), ["day", "type"], ["day"])
    rows = {(r.by_day, r.by_type, r.day, r.type): (r.n, r.p50) for r in Q.quantiles(c, ["day", "type", "by_day", "by_type"]).collect()}
    assert rows == {
        (False, False, None, None): (2, -3), (True, False, "d", None): (1, -3), (False, True, None, "t"): (1, 5),
        (False, True, None, None): (1, -3), (True, True, "d", None): (1, -3),
    }
    assert Q.quantiles(Q.digests(df.where("false"), "v", ["day"]), ["day"]).count() == 0


def test_map_tasks_compress_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(Q, "HELD", 3000)
    rnd = random.Random(8)
    values = [rnd.randrange(10**6) for _ in range(40000)]
    df = spark.createDataFrame([("g", v) for v in values] + [(None, 5), ("g", None)], "g string, v long").repartition(2)
    eps = 0.05
    parts = Q.partials(df, "v", ["g"], eps)
    # Each task compresses its two batches one by one, as the second would be too much.
    assert parts.where("g = 'g'").count() <= 4 * 3 * Q._shape(eps) and parts.agg({"n": "sum"}).first()[0] == 40001
    rows = {r.g: r for r in Q.quantiles(Q.digests(df, "v", ["g"], eps), ["g"], eps=eps).collect()}
    assert rows[None].p50 == 5
    check(values, rows["g"], eps)
    assert Q.digests(df.where("false"), "v", ["g"]).count() == 0
