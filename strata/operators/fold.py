"""Last-writer-wins folds over change rows.

The canonical order is (ts, seq): the greatest ts wins and, among equal ts, the
greatest seq. Tombstones take part in every fold and are filtered afterwards,
because filtering first would bring older values back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_put(flag: str = "is_deleted") -> Column:
    """True unless the row is a tombstone; a null flag counts as a put."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def fold(
    df: DataFrame,
    keys: Sequence[str] = ("key",),
    order: Sequence[str] = ("ts", "seq"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The row with the greatest order per key, whole (AG1, AG2, AG3).

    A partial fold runs before the shuffle, so a hot key costs each map task one
    row. max_by takes a struct, so all columns come from one row and a null value
    of the winner stays null. Null keys are one group; null order values come
    first. Rows that tie on every order column are interchangeable only if they
    are equal; callers make the order unique by including seq.
    """
    columns = list(columns if columns is not None else [c for c in df.columns if c not in keys])
    winner = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(*[F.col(f"`{c}`") for c in order]))
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(winner.alias("_winner"))
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_winner").getField(c).alias(c) for c in columns])


def live(df: DataFrame, **kwargs) -> DataFrame:
    """fold, then without tombstones (LK1, LK6)."""
    return fold(df, **kwargs).where(is_put())


def newest(a: DataFrame, b: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Of two DataFrames with one row for each key, the row with the greater order per key (AG3); a's where they are equal.

    Inputs that are stored in buckets by key and sorted, as runs are, are merged as they stream
    by, without a shuffle or sort. Keys are not null.
    """
    names = [c for c in a.columns if c != "key"]

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(F.col("key").alias(f"_key{n}"), F.struct(*[F.col(f"`{c}`") for c in names]).alias(f"_row{n}"), F.struct(*order).alias(f"_at{n}"))

    both = side(a, 0).join(side(b, 1), F.col("_key0") == F.col("_key1"), "full_outer")
    first = F.col("_key1").isNull() | F.coalesce(F.col("_at0") >= F.col("_at1"), F.lit(False))
    row = F.when(first, F.col("_row0")).otherwise(F.col("_row1"))
    return both.select(F.coalesce("_key0", "_key1").alias("key"), *[row.getField(c).alias(c) for c in names])


def merge(runs: Sequence[DataFrame], ties: str = "seq") -> DataFrame:
    """Merge runs to one row per key, tombstones kept (AG3).

    ties="seq" is the canonical rule. ties="first" lets the first given run win
    among equal ts. An empty list gives None, as there is nothing to merge.
    """
    if not runs:
        return None
    if ties == "seq":
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        return fold(union)
    union = None
    for position, run in enumerate(runs):
        run = run.withColumn("_run", F.lit(-position))
        union = run if union is None else union.unionByName(run)
    return fold(union, order=("ts", "_run"), columns=[c for c in runs[0].columns if c != "key"])
