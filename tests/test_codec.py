import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions.bloom import Bloom, bit_places, build, might_contain, places, size_for
from strata.functions.codec import decode_record, encode_record
from strata.sources.native import Corrupt, NativeFiles, Run, _Reader, _Writer, frame, frames, log_files, run_files

VECTORS = [
    (b"k1", b"v1", 1, False, "8000001500000002000000020000000000000001006b3176318fd798ef"),
    (b"a", b"1", 1, False, "80000013000000010000000100000000000000010061317a412928"),
    (b"b", b"2", 2, False, "8000001300000001000000010000000000000002006232dad084bf"),
    (b"a", None, 3, True, "80000012000000010000000000000000000000030161ff08ca73"),
    (b"user:1", b"alice", 123456789, False, "8000001c000000060000000500000000075bcd1500757365723a31616c6963655f17ac30"),
    (b"user:2", None, 999, True, "80000017000000060000000000000000000003e701757365723a32b3029003"),
]


def test_encoding_of_known_records(spark):
    df = spark.createDataFrame([v[:4] for v in VECTORS], "key binary, value binary, ts long, is_deleted boolean")
    got = df.select(encode_record(*map(F.col, ("key", "value", "ts", "is_deleted"))).alias("e")).collect()
    assert [bytes(r.e).hex() for r in got] == [v[4] for v in VECTORS]
    assert [frame(*v[:4]).hex() for v in VECTORS] == [v[4] for v in VECTORS]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray.fromhex(v[4]),) for v in VECTORS] + [(None,)], "e binary")
    got = [r.r and tuple(bytes(x) if isinstance(x, bytearray) else x for x in r.r) for r in df.select(decode_record(F.col("e")).alias("r")).collect()]
    assert got == [v[:4] for v in VECTORS] + [None]
    edge = spark.createDataFrame([(b"", b"", -(2**63), False), (b"\x80\xff", b"", 2**63 - 1, False), (b"k", b"", -1, False)], "k binary, v binary, t long, d boolean")
    back = edge.select("*", decode_record(encode_record(*map(F.col, "kvtd"))).alias("r")).collect()
    assert all((b.k, b.v, b.t, b.d) == (b.r.key, b.r.value, b.r.ts, b.r.is_deleted) for b in back)


@pytest.mark.parametrize("at", [0, 3, 10, 20, 28])
def test_damaged_frames_raise(spark, at):
    e = bytearray.fromhex(VECTORS[0][4])
    e[at] ^= 1
    with pytest.raises(Exception):
        spark.createDataFrame([(e,)], "e binary").select(decode_record(F.col("e"))).collect()


def test_bloom_places_are_the_known_ones(spark):
    assert places([b"alpha"], 1024, 7)[0].tolist() == [43, 470, 897, 300, 727, 130, 557]
    assert places([b"beta"], 1024, 7)[0].tolist() == [167, 366, 565, 764, 963, 138, 337]
    got = spark.createDataFrame([(b"beta",), (None,), (b"",)], "k binary").select(bit_places(F.col("k"), 1024).alias("p")).collect()
    assert got[0].p == [167, 366, 565, 764, 963, 138, 337] and got[1].p is None and len(got[2].p) == 7


def test_bloom_has_no_false_negatives_and_few_positives(spark):
    df = spark.range(3000).select(F.col("id").cast("string").cast("binary").alias("k"))
    bloom = build(df, "k", *size_for(3000))
    alone = Bloom(*size_for(3000))
    alone.add(*[str(i).encode() for i in range(3000)])
    assert bloom.data == alone.data
    assert df.where(~might_contain(spark, F.col("k"), bloom)).count() == 0
    others = spark.range(3000, 23000).select(F.col("id").cast("string").cast("binary").alias("k"))
    assert others.where(might_contain(spark, F.col("k"), bloom)).count() < 0.005 * 20000
    again = Bloom.unpack(bloom.pack())
    assert again.might_contain(b"7") and again.data == bloom.data
    for bad in (b"", b"\0" * 8, bloom.pack()[:-1]):
        with pytest.raises(ValueError):
            Bloom.unpack(bad)


def test_native_log(spark, tmp_path):
    spark.dataSource.register(NativeFiles)
    records = [v[:4] for v in VECTORS]
    (tmp_path / "wal-000002.log").write_bytes(b"".join(frame(*r) for r in records[2:4]))
    (tmp_path / "wal-000001.log").write_bytes(b"".join(frame(*r) for r in records[:2]))
    (tmp_path / "wal.log").write_bytes(b"".join(frame(*r) for r in records[4:]) + frame(*records[0])[:-3])  # torn tail
    (tmp_path / "wal-x.log.tmp").write_bytes(b"?")
    assert log_files(p.name for p in tmp_path.iterdir()) == ["wal-000001.log", "wal-000002.log", "wal.log"]
    rows = spark.read.format("strata_native").load(str(tmp_path)).collect()
    got = [(bytes(r.key), r.value and bytes(r.value), r.ts, r.is_deleted) for r in sorted(rows, key=lambda r: (r.file == "wal.log", r.file, r.pos))]
    assert got == records


def test_native_damage_raises():
    e = bytearray(frame(b"k1", b"v1", 1, False))
    e[10] ^= 1
    with pytest.raises(Corrupt):
        list(frames(bytes(e), len(e), True))
    with pytest.raises(Corrupt):
        list(frames(frame(b"k", b"v", 1, False)[:-2], 20, False))
    with pytest.raises(Corrupt):
        Run.of(pa.BufferReader(b"x" * 50))


def test_native_write_and_read_back(spark, tmp_path):
    spark.dataSource.register(NativeFiles)
    df = spark.createDataFrame([v[:4] for v in VECTORS], "key binary, value binary, ts long, is_deleted boolean").repartition(2)
    for n in (1, 2):
        df.write.format("strata_native").mode("append").save(str(tmp_path / "log"))
        back = spark.read.format("strata_native").load(str(tmp_path / "log"))
        assert back.count() == n * len(VECTORS)
    assert not [p for p in (tmp_path / "log").iterdir() if p.suffix == ".tmp"]


@pytest.mark.parametrize("kind", ["log", "run"])
def test_native_writer_begins_another_file(tmp_path, monkeypatch, kind):
    monkeypatch.setattr("strata.sources.native.PIECE", 100)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("C", (), {"partitionId": lambda s: 0, "taskAttemptId": lambda s: 0})())
    rows = [(b"%03d" % i, b"v", i, False) for i in range(20)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "value", "ts", "is_deleted"), r)) for r in rows])
    writer = _Writer(str(tmp_path), batch.schema.names, kind, 0, 2)
    writer.commit([writer.write(iter([batch]))])
    reader = _Reader(str(tmp_path), kind, None)
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len({r["file"] for r in got}) > 4 and [tuple(r.values())[:4] for r in got] == rows
    one = _Reader(str(tmp_path), kind, b"007")
    assert [r["ts"] for p in one.partitions() for b in one.read(p) for r in b.to_pylist()] == [7]


def test_native_run(spark, tmp_path):
    import struct

    body = b"".join(frame(*v[:4]) for v in VECTORS[:2])
    footer = struct.pack(">QIIIQI8s", len(body), 0, 2, 1, 0, 0, b"BTSSTB2X")
    old = struct.pack(">IsQ", 1, VECTORS[0][0][:1], 0) + struct.pack(">QIII8s", len(body), 1, 2, 10, b"BTSSTB1")
    (tmp_path / "sst-5.sst").write_bytes(body + old)
    (tmp_path / "l1-sst-00000000000000000007.sst").write_bytes(body + footer)
    (tmp_path / "sst-3.sst").write_bytes(body + footer)
    assert run_files(p.name for p in tmp_path.iterdir()) == ["sst-3.sst", "sst-5.sst", "l1-sst-00000000000000000007.sst"]
    spark.dataSource.register(NativeFiles)
    assert spark.read.format("strata_native").option("kind", "run").load(str(tmp_path)).count() == 6


def test_native_run_written_and_sought(spark, tmp_path):
    spark.dataSource.register(NativeFiles)
    df = spark.range(500).selectExpr("cast(lpad(cast(id as string), 4, '0') as binary) as key", "cast(if(id % 9 = 0, null, id) as string) as v", "id as ts", "id % 9 = 0 as is_deleted")
    df = df.withColumn("value", F.col("v").cast("binary")).repartitionByRange(2, "key").sortWithinPartitions("key")
    folder = str(tmp_path / "run")
    df.write.format("strata_native").option("kind", "run").option("gap", "7").mode("append").save(folder)
    assert len(run_files(os.listdir(folder))) == 2
    read = lambda **o: spark.read.format("strata_native").option("kind", "run").options(**o).load(folder)
    got = {(bytes(r.key), r.value and bytes(r.value), r.ts, r.is_deleted) for r in read().collect()}
    assert got == {(b"%04d" % i, None if i % 9 == 0 else b"%d" % i, i, i % 9 == 0) for i in range(500)}
    for i in (0, 6, 7, 250, 499):
        assert [r.ts for r in read(key=(b"%04d" % i).hex()).collect()] == [i]
    assert read(key=b"nothing".hex()).count() == 0
    data = (tmp_path / "run" / run_files(os.listdir(folder))[0]).read_bytes()
    run = Run.of(pa.BufferReader(data))
    assert run.seek(b"0000")[0] == 0 and run.seek(run.keys[3])[0] == run.offsets[3]
    pieces = [p for k in range(-(-len(data) // 200)) if (p := run.piece(k, 200))]
    assert len(pieces) > 5 and pieces[0][0] == 0 and pieces[-1][1] == run.end and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    assert sum(len(list(frames(data, b, False, a))) for a, b in pieces) == len(list(frames(data, run.end, False)))
    unsorted = df.orderBy(F.desc("key")).coalesce(1)
    with pytest.raises(Exception):
        unsorted.write.format("strata_native").option("kind", "run").mode("append").save(folder)
    assert len(run_files(os.listdir(folder))) == 2 and not list((tmp_path / "run").glob(".*.tmp"))
