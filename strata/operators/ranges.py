"""Rows in numbered key ranges, for positions over a whole sort order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import work_dir


def ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with _part, the number of its range of keys, ranges in the order of the keys.

    The rows are written once to the shared folder: the bounds of ranges come from a sample,
    and a plan that computed them again could cut elsewhere. Equal keys share a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_dir(spark, 'ranges')}/rows"
    df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def carried(per_part: DataFrame, value, within: Sequence[str] = ()) -> DataFrame:
    """per_part, one row for each range, with _carry: value over the ranges before it (of the same group)."""
    w = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.withColumn("_carry", value.over(w))
