import random

import pytest

from strata.llm import seen as S

HISTORY, INCOMING = "key binary, value string, rec_id int", "rec_id long, key binary, value string, first string"


def write(spark, folder, history, incoming, files=1):
    h, i = f"{folder}/h.parquet", f"{folder}/i.parquet"
    spark.createDataFrame([(k, "v", 0) for k in history], HISTORY).repartition(files).write.mode("append").parquet(h)
    spark.createDataFrame([(r, k, "v", "x") for r, k in incoming], INCOMING).repartition(files).write.mode("append").parquet(i)
    return h, i


def answers(df):
    return {r.rec_id: r.is_repeat for r in df.collect()}


@pytest.mark.parametrize("batch", [S.BATCH_BYTES, 1])
def test_exact_whatever_the_batches(spark, folder, batch):
    rnd = random.Random(3)
    history = [b"%d" % rnd.randrange(200) for _ in range(300)] + [None, b""]
    incoming = [(i, b"%d" % rnd.randrange(600)) for i in range(500)] + [(500, b""), (501, None), (502, b"\x00"), (503, b"\x00")]
    rnd.shuffle(incoming)
    before, want = {k for k in history if k is not None}, {}
    for i, k in sorted(incoming):
        if k is not None:
            want[i] = k in before
            before.add(k)
    h, i = write(spark, folder, history, incoming, files=3)
    assert answers(S.classify(spark, h, i, batch_bytes=batch)) == want


def test_state_goes_on(spark, folder):
    h, i = write(spark, folder, [b"a"], [(1, b"a"), (2, b"b")])
    at = f"{folder}/state"
    assert answers(S.classify(spark, h, i, at=at)) == {1: True, 2: False}
    write(spark, folder, [], [(3, b"b"), (4, b"c")])
    assert answers(S.classify(spark, h, i, at=at)) == {1: True, 2: False, 3: True, 4: False}


def test_each_batch_emits_answers_and_later_files_may_be_earlier_records(spark, folder):
    h, i = write(spark, folder, [b"a"], [(10, b"a"), (11, b"b"), (12, b"b"), (13, b"d")])
    at = f"{folder}/state"
    assert answers(S.classify(spark, h, i, at=at, partitions=2)) == {10: True, 11: False, 12: True, 13: False}
    emitted = spark.read.schema(S.ANSWERS).parquet(f"{at}/answers/*")
    # Records are told in a micro-batch of their own, after that of history.
    assert {r.batch: r.n for r in spark.read.parquet(f"{at}/answers").where("rec_id > 0").groupBy("batch").count().withColumnRenamed("count", "n").collect()} == {1: 4}
    assert {r.rec_id for r in emitted.where("is_repeat").collect()} == {10, 12}
    # A record with a smaller id, and history, for keys that were told before.
    write(spark, folder, [b"d"], [(5, b"b"), (14, b"d")])
    assert answers(S.classify(spark, h, i, at=at)) == {5: False, 10: True, 11: True, 12: True, 13: True, 14: True}
    import os

    assert len([n for n in os.listdir(f"{at.removeprefix('file://')}/checkpoint/state/0") if n.isdecimal()]) == 2  # state partitions


def test_empty_and_settings(spark, folder):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    h, i = write(spark, folder, [], [])
    assert answers(S.classify(spark, h, i)) == {}
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == before


def test_wrong_rate_sees_wrong_answers(spark):
    h = spark.createDataFrame([(b"a",)], "key binary")
    i = spark.createDataFrame([(1, b"a"), (2, b"b")], "rec_id long, key binary")
    right = spark.createDataFrame([(1, True), (2, False)], "rec_id long, is_repeat boolean")
    wrong = spark.createDataFrame([(1, False), (2, False)], "rec_id long, is_repeat boolean")
    assert tuple(S.wrong_rate(right, h, i).head()) == (2, 1, 0, 0.0)
    assert tuple(S.wrong_rate(wrong, h, i).head()) == (2, 0, 1, 0.5)
