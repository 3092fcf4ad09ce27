"""Has this key been seen before? (problem 4): seen flags in a streaming state store.

History and incoming records are streams of files. Both are reduced to (key, order), the
order of history being below every record id, and one streaming aggregate keeps for each
key the least order and whether a record ever asked for it. The state lies partitioned by
key in RocksDB on the executors' disks, with a changelog in the checkpoint folder; there is
no watermark, so nothing expires. Rows combine in each map task before the shuffle, so a hot
key sends one row a task.

Each micro-batch of records emits one answer for each of its records: the state gives, for
the keys that the batch touched, the first record of each; the batch's other records are
repeats. History comes in micro-batches before those of the records. Records whose files
arrive in another order than their ids are answered as what was there says; where a later
batch finds an earlier record, or history, for a key, it emits that first one again, and
`answers` takes the least of a key's first ones, so answers are exact whatever the order.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Fs, own_session, work_dir

#: Order of everything in history, below all record ids.
BEFORE = -(2**63)
#: Bytes of files that one micro-batch takes from each stream.
BATCH_BYTES = 64 << 30
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    # A checkpoint's number of state partitions is fixed; batches must not be coalesced.
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
ANSWERS = "rec_id long, is_repeat boolean, key binary"


def _stream(spark: SparkSession, path: str, batch_bytes: int, only: str | None = None) -> DataFrame:
    """A table as a stream of its files, with `only` of those whose names match."""
    schema = spark.read.parquet(path).schema
    if Fs(spark, path).is_file():  # a stream takes folders or patterns; this one has a single match
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes)
    return (reader.option("pathGlobFilter", only) if only else reader).parquet(path)


def _arrived(fs: Fs, batch: int, source: int) -> list[str]:
    """Files that a micro-batch takes from a source, by the checkpoint's logs."""

    def offset(b: int) -> int:
        line = fs.read(f"checkpoint/offsets/{b}").splitlines()[2 + source] if b >= 0 else "-"
        return -1 if line == "-" else json.loads(line)["logOffset"]

    first, last = offset(batch - 1), offset(batch)
    found = {}
    for name in fs.names(f"checkpoint/sources/{source}"):
        number = name.split(".")[0]
        if number.isdecimal() and first < int(number) and (int(number) <= last or name.endswith(".compact")):
            for line in fs.read(f"checkpoint/sources/{source}/{name}").splitlines()[1:]:
                entry = json.loads(line)
                if first < entry["batchId"] <= last:
                    found[entry["path"]] = None
    return list(map(unquote, found))


def _run(
    spark: SparkSession, history: str, incoming: str, key: str, rec_id: str, at: str, batch_bytes: int, partitions: int | None, records: bool
) -> None:
    """Take what has arrived of history, or with records=True of the incoming records, into the state, and emit answers.

    Both are runs of one query on one checkpoint; in the first the filter of the records' stream matches no file.
    """
    session = own_session(spark, STATE_CONF | ({"spark.sql.shuffle.partitions": partitions} if partitions else {}))
    fs = Fs(spark, at)
    h = _stream(session, history, batch_bytes)
    h = h.select(F.col(key).alias("key"), F.lit(BEFORE).alias("ord"), F.lit(False).alias("asks"))
    i = _stream(session, incoming, batch_bytes, None if records else "no file has this name")
    i = i.select(F.col(key).alias("key"), F.col(rec_id).cast("bigint").alias("ord"), F.lit(True).alias("asks"))
    state = (
        h.unionByName(i).where(F.col("key").isNotNull())
        .groupBy("key").agg(F.min("ord").alias("first"), F.max("asks").alias("asks"))
    )

    def answer(batch: DataFrame, batch_id: int) -> None:
        files, late = _arrived(fs, batch_id, 1), _arrived(fs, batch_id, 0)
        if files and late:  # both parts below read the batch
            batch.persist()
        asked = batch.where("asks").select("key", F.col("first").alias("_first"))
        # Keys whose history came after a record that asked for them.
        out = asked.where(F.col("_first") == BEFORE).select(F.col("_first").alias("rec_id"), F.lit(False).alias("is_repeat"), "key") if late else None
        if files:
            rows = batch.sparkSession.read.parquet(*files).where(F.col(key).isNotNull() & F.col(rec_id).isNotNull())
            rows = rows.select(F.col(rec_id).cast("bigint").alias("rec_id"))
            told = rows.join(asked.where(F.col("_first") > BEFORE), F.col("rec_id") == F.col("_first"), "left")
            told = told.select("rec_id", F.col("_first").isNull().alias("is_repeat"), "key")
            out = told if out is None else told.unionByName(out)
        if out is not None:  # a repeated batch overwrites its own answers
            out.write.mode("overwrite").parquet(f"{at}/answers/batch={batch_id}")
        batch.unpersist()

    query = (
        state.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint")
        .trigger(availableNow=True).foreachBatch(answer).start()
    )
    query.awaitTermination()


def answers(spark: SparkSession, at: str) -> DataFrame:
    """rec_id, is_repeat: what the micro-batches have emitted; of several first records of a key the least one counts."""
    if not Fs(spark, at).exists("answers"):  # nothing has arrived
        return spark.createDataFrame([], "rec_id long, is_repeat boolean")
    emitted = spark.read.schema(ANSWERS).option("basePath", f"{at}/answers").parquet(f"{at}/answers/*")
    # A key has as many of these rows as micro-batches found a first record of it, so no key is hot.
    firsts = emitted.where("NOT is_repeat").withColumn("is_repeat", F.col("rec_id") > F.min("rec_id").over(Window.partitionBy("key")))
    out = emitted.where("is_repeat").unionByName(firsts.where(F.col("rec_id") > BEFORE))
    return out.select("rec_id", "is_repeat")


def classify(
    spark: SparkSession, history: str, incoming: str, key: str = "key", rec_id: str = "rec_id",
    at: str | None = None, batch_bytes: int = BATCH_BYTES, partitions: int | None = None,
) -> DataFrame:
    """rec_id, is_repeat for each incoming record with a key, as the stream emitted them.

    at is the folder of the stream's checkpoint and answers. Calling again with the same
    folder takes only files that have arrived since, history first, and earlier state stays;
    without it there is no state to keep when all is answered. partitions is the number of
    state partitions, fixed when a checkpoint is begun; None takes spark.sql.shuffle.partitions.

    Records with a null key or a null id get no answer; the empty key is a key; rows that
    share a record id share its answer. Deletes count as occurrences. Other columns are not
    read. Empty tables give no rows. A micro-batch's records meet their first ones by record
    id, so hot keys do not matter to it.
    """
    folder = at or work_dir(spark, "seen")
    for records in (False, True):
        _run(spark, history, incoming, key, rec_id, folder, batch_bytes, partitions, records)
    if at is None:
        Fs(spark, folder).delete("checkpoint")
    return answers(spark, folder)


def wrong_rate(answers: DataFrame, history: DataFrame, incoming: DataFrame) -> DataFrame:
    """n_records, n_repeats, n_wrong, wrong_rate of answers against a batch recount of all keys."""
    both = history.select("key", F.lit(BEFORE).alias("ord")).unionByName(incoming.select("key", F.col("rec_id").alias("ord")))
    first = both.where("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("ord")).where(F.col("ord") > BEFORE)
    truth = answers.join(first.select(F.col("ord").alias("rec_id"), F.lit(True).alias("new")), "rec_id", "left")
    wrong = F.col("is_repeat") == F.coalesce("new", F.lit(False))
    return truth.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count(F.when(F.col("is_repeat"), 1)).alias("n_repeats"),
        F.count(F.when(wrong, 1)).alias("n_wrong"),
    ).withColumn("wrong_rate", F.when(F.col("n_records") > 0, F.col("n_wrong") / F.col("n_records")).otherwise(F.lit(0.0)))
