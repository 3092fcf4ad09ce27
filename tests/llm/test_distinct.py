import pytest
from pyspark.sql import functions as F

from strata.llm import distinct as D


def counts(df, groups, **kw):
    return {tuple(r[g] for g in groups): r for r in D.estimate(D.registers(df, "key", groups, **kw), groups, kw.get("p", D.P)).collect()}


@pytest.mark.parametrize("kind", ["xxhash64", "md5"])
def test_error_is_as_stated(spark, kind):
    sizes = {"a": 10, "b": 3000, "c": 20000, "d": 100000}
    df = None
    for g, n in sizes.items():
        part = spark.range(n).select(F.lit(g).alias("g"), F.concat(F.lit(g), F.col("id")).alias("key"))
        df = part if df is None else df.union(part)
    got = counts(df.union(df.where("g = 'c'")), ["g"], hash=kind)  # repeated rows add nothing
    for g, n in sizes.items():
        assert abs(got[(g,)].n_distinct - n) <= 4 * D.standard_error() * n + 0.5
        assert got[(g,)].low <= got[(g,)].n_distinct <= got[(g,)].high


def test_merge_equals_whole(spark):
    df = spark.range(30000).select((F.col("id") % 7).alias("g"), (F.col("id") % 9000).cast("string").alias("key"))
    whole = D.registers(df.select("key"), "key", [])
    parts = D.merge(D.registers(df, "key", ["g"]), [])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), ("g", None), ("g", ""), ("g", ""), ("h", None)], "g string, key string")
    got = counts(df, ["g"])
    assert {k: r.n_distinct for k, r in got.items()} == {(None,): 1, ("g",): 1, ("h",): 0}
    assert counts(df.where("false"), ["g"]) == {}


def test_cube_leaves_out_the_missing_day(spark):
    df = spark.createDataFrame([("d", "t", "1"), (None, "t", "2"), ("d", None, "3")], "day string, type string, key string")
    c = D.cube(D.registers(df, "key", ["day", "type"]), ["day", "type"], ["day"])
    rows = {(r.by_day, r.by_type, r.day, r.type): r.n_distinct for r in D.estimate(c, ["day", "type", "by_day", "by_type"]).collect()}
    assert rows == {
        (False, False, None, None): 3, (True, False, "d", None): 2, (False, True, None, "t"): 2, (False, True, None, None): 1,
        (True, True, "d", "t"): 1, (True, True, "d", None): 1,
    }


def test_precision_and_names_are_checked(spark):
    with pytest.raises(ValueError):
        D.registers(spark.createDataFrame([("a", 1)], "key string, rank int"), "key", ["rank"])
    with pytest.raises(ValueError):
        D.registers(spark.createDataFrame([("a",)], "key string"), "key", [], p=3)
