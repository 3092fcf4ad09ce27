from strata.cli import main
from strata.plans.store import Store
from strata.schema import Options
from strata.streaming.ingest import ingest, latest

SCHEMA = "key binary, value binary, ts long, seq long, is_deleted boolean"


def test_stream_into_a_store_once(spark, folder, tmp_path):
    src = str(tmp_path / "in")
    store = Store.open(spark, folder + "/store", Options(memtable_threshold=0, buckets=2))
    rows = [(b"a", b"1", 1, 1, False), (b"b", b"2", 2, 2, False)], [(b"a", None, 3, 3, True), (b"c", b"3", 4, 4, False)]
    for batch in rows:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        q = ingest(spark.readStream.schema(SCHEMA).parquet(src), store, folder + "/ck")
        q.awaitTermination()
    assert {bytes(r.key) for r in store.state().collect()} == {b"b", b"c"}
    assert store.manifest.batches == {q.id: 1}
    # A batch that runs again changes nothing.
    assert store.apply(spark.createDataFrame(rows[0], SCHEMA), batch=(q.id, 0)) == 0


def test_streams_do_not_take_each_other_for_repeats(spark, folder, tmp_path):
    store = Store.open(spark, folder + "/store", Options(memtable_threshold=0, buckets=2))
    short = "key binary, value binary, ts long, is_deleted boolean"
    for n in ("a", "b"):
        spark.createDataFrame([(n.encode(), b"1", 1, False)], short).write.parquet(str(tmp_path / n))
        ingest(spark.readStream.schema(short).parquet(str(tmp_path / n)), store, f"{folder}/ck-{n}").awaitTermination()
    assert {bytes(r.key) for r in store.state().collect()} == {b"a", b"b"} and len(store.manifest.batches) == 2
    # A new checkpoint makes a new stream, whose batches count.
    again = ingest(spark.readStream.schema(short).parquet(str(tmp_path / "a")), store, f"{folder}/ck-new")
    again.awaitTermination()
    assert store.manifest.batches[again.id] == 0 and store.log().count() == 3


def test_streaming_fold(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(b"a", b"1", 5, 1, False), (b"a", b"late", 3, 2, False), (None, b"x", 1, 3, False)], SCHEMA).write.parquet(src)
    q = latest(spark.readStream.schema(SCHEMA).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [bytes(r.value) for r in spark.table("folded").collect()] == [b"1"]


def test_command_line(spark, tmp_path, capsys):
    d = ["-data-dir", str(tmp_path / "data")]
    assert main([*d, "-get-key", "k", "-put-value", "v", "-put-key", "k"], spark) == 0
    assert capsys.readouterr().out == "put ok\nk => v\n"
    assert main([*d, "-compact", "-get-key", "k", "-del-key", "k"], spark) == 0
    assert capsys.readouterr().out == "delete ok\nnot found\ncompaction ok\n"
