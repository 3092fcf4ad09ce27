"""Runs: immutable Parquet folders, hash-bucketed by key and sorted by key.

All runs of a store have the same buckets, so a scan of several runs places the
files of one bucket in one task: the k-way merge on read needs no shuffle, and a
point lookup reads one bucket of each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifest import Run
from .shared import own_session, within


#: Name of the column that tells the runs of a scan apart; stores have no such column of their own.
PARTITION = "strata_run"


def prepare(spark: SparkSession) -> None:
    """Set a session up for runs, for good: both settings are needed whenever a result is computed.

    Parquet checks page checksums, so that damage raises instead of passing as data. The
    order within buckets of one file is known to the planner, so that it is not made again.
    """
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.page.write-checksum.enabled", "true")
    conf.set("parquet.page.verify-checksum.enabled", "true")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


def ddl(schema: T.StructType) -> str:
    """Column list of a schema, as SQL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def run_stats(n: str = "n", t: str = "t", lo: str = "lo", hi: str = "hi") -> list[Column]:
    """Rows, tombstones, least and greatest key of a run, under the given names (AG5)."""
    return [F.count(F.lit(1)).alias(n), F.count(F.when(F.col("is_deleted"), 1)).alias(t), F.min("key").alias(lo), F.max("key").alias(hi)]


def _source(spark: SparkSession, paths: Sequence[str], schema, partitions: Sequence[str], buckets: int, options: dict[str, str]):
    """Spark's file source with buckets. Its reader and writer have no way to state them without a catalog table."""
    jvm, utils = spark._jvm, spark._jvm.PythonUtils
    names, some = utils.toSeq(["key"]), jvm.scala.Option.apply
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, names, names)
    return jvm.org.apache.spark.sql.execution.datasources.DataSource(
        spark._jsparkSession, "parquet", utils.toSeq(list(paths)), some(schema), utils.toSeq(list(partitions)), some(spec), utils.toScalaMap(options), some(None)
    )


def write_run(df: DataFrame, path: str, level: int, run_seq: int, buckets: int, bloom: bool = True) -> Run | None:
    """Write one row per key as a run (SK5) and return its manifest entry, None if it has no rows.

    The last shuffle of df, as a fold leaves it, is made to have one partition for each bucket:
    then every task writes its own buckets, one file each, and nothing is shuffled again. The
    statistics are gathered while the rows are written. No catalog takes part.
    """
    spark = own_session(df.sparkSession, {"spark.sql.shuffle.partitions": buckets})
    seen = Observation()
    df = within(spark, df).observe(
        seen,
        *run_stats(),
        F.min("seq").alias("s0"),
        F.max("seq").alias("s1"),
    )
    options = {"path": path}
    if bloom:
        options |= {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    write = _source(spark, (), None, (), buckets, options).planForWriting(
        spark._jvm.org.apache.spark.sql.SaveMode.ErrorIfExists, df._jdf.queryExecution().analyzed()
    )
    spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, write)  # a command runs at once
    m = seen.get
    return Run(path, level, run_seq, m["n"], m["t"], m["lo"].hex().upper(), m["hi"].hex().upper(), m["s0"], m["s1"]) if m["n"] else None


def read_runs(spark: SparkSession, runs: Sequence[tuple[int, str]], columns: str, buckets: int) -> DataFrame:
    """The given (run_seq, path) runs as one bucketed DataFrame; strata_run has the run_seq of each row.

    The relation is built from the files alone; their folders have names strata_run=X.
    """
    schema = spark._jsparkSession.parseDataType(T._parse_datatype_string(f"{columns}, {PARTITION} string").json())
    source = _source(spark, [path for _, path in runs], schema, [PARTITION], buckets, {"basePath": runs[0][1].rsplit("/", 1)[0]})
    df = DataFrame(spark._jsparkSession.baseRelationToDataFrame(source.resolveRelation(True, True)), spark)
    numbers = F.create_map(*[F.lit(x) for n, path in runs for x in (path.rsplit("=", 1)[1], n)])
    return df.withColumn(PARTITION, numbers[F.col(PARTITION)].cast("bigint"))
