"""Lookups of many keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import carried, ranged


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """key, value, found for every row of keys (LK7).

    Repeated keys give as many rows; a null key is not found; other columns of keys are left out. state has one row per
    key, so the join cannot multiply rows; Spark picks broadcast or shuffle by size.
    """
    s = state.select(F.col("key").alias("_key"), "value", F.lit(True).alias("_found"))
    joined = keys.select("key").join(s, F.col("key") == F.col("_key"), "left")
    return joined.select("key", "value", F.coalesce("_found", F.lit(False)).alias("found"))


def index_seek(keys: DataFrame, index: DataFrame) -> DataFrame:
    """key, start_pos: for each distinct key the position of the greatest index key that is not above it (LK5).

    An as-of lookup without a range join: index entries and keys are put into ranges of the
    key together, and the last entry is carried forward, within a range and from the ranges
    before it. A task holds one range. Keys below the first entry, and the null key, have a
    null start; an empty index gives null starts.
    """
    wanted = keys.select("key").distinct()
    tagged = index.select("key", F.col("pos").cast("bigint").alias("pos"), F.lit(0).alias("side")).unionByName(
        wanted.select("key", F.lit(None).cast("bigint").alias("pos"), F.lit(1).alias("side"))
    )
    rows = ranged(tagged.where("key IS NOT NULL"), ["key"])
    before = carried(rows.groupBy("_part").agg(F.max("pos").alias("_top")), F.max("_top"))
    w = Window.partitionBy("_part").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_pos", F.max("pos").over(w)).join(before.select("_part", "_carry"), "_part").where("side = 1")
    out = placed.select("key", F.coalesce("_pos", "_carry").alias("start_pos"))
    return out.unionByName(wanted.where("key IS NULL").select("key", F.lit(None).cast("bigint").alias("start_pos")))


def sparse_index(df: DataFrame, gap: int, run: str = "run_id") -> DataFrame:
    """Rows of every gap-th key of each run with its position pos, from position 0 (SO7).

    Keys are unique within a run. A run of any size is ranked range by range: a task holds
    one range, and the rows of the ranges before it are added.
    """
    rows = ranged(df, [run, "key"])
    before = carried(rows.groupBy(run, "_part").agg(F.count(F.lit(1)).alias("_n")), F.sum("_n"), [run])
    w = Window.partitionBy(run, "_part").orderBy("key")
    placed = rows.withColumn("_rank", F.row_number().over(w)).join(before.select(run, "_part", "_carry"), [run, "_part"])
    pos = (F.col("_rank") - 1 + F.coalesce("_carry", F.lit(0))).cast("bigint")
    return placed.withColumn("pos", pos).where(F.col("pos") % gap == 0).select(*df.columns, "pos")
