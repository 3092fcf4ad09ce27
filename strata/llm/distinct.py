"""Distinct counts over huge identifier sets (problem 1): log-log registers.

A key is hashed to 60 bits. The first p choose one of m = 2**p registers; its rank is
one more than the leading zeros of the rest. A register keeps the maximum rank, so
adding a key twice changes nothing and two sketches merge by the maximum of each
register. The state of a group is at most m small rows, however many keys it has.

The estimate is Ertl's corrected raw estimate (alpha = 1 / (2 ln 2) and the sigma series
for empty registers), which needs no tables and no switch between ranges. Its relative
standard error is 1.04 / sqrt(m): 1.63 % at p = 12.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bit_width
from .names import apart

#: log2 of the registers of a group.
P = 12
BITS = 60
#: Terms of sigma; the 30th is below 1e-300 for every x <= 1 - 2**-16.
TERMS = 30


def hash60(key: Column, kind: str = "xxhash64") -> Column:
    """60 hash bits of a key. xxhash64 is the fast one; md5 gives the same bits in other engines."""
    if kind == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)
    if kind == "md5":
        return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("bigint")
    raise ValueError(kind)


def standard_error(p: int = P) -> float:
    return 1.04 / math.sqrt(1 << p)


def registers(df: DataFrame, key: str, groups: Sequence[str], p: int = P, hash: str = "xxhash64") -> DataFrame:
    """groups, bucket, rank: the registers of each group, the mergeable partial result.

    Null keys are not counted, but a group of null keys alone still has a row, with a null
    bucket and rank 0. Null group values form a group. The maximum is taken in each map
    task before the shuffle, so a key or group with a third of all rows costs no more than
    its registers.
    """
    if not 4 <= p <= 16:
        raise ValueError("p must lie between 4 and 16")
    apart(groups, ("bucket", "rank"))
    rest = BITS - p
    h = F.when(F.col(key).isNotNull(), hash60(F.col(key), hash))  # the hash of null is a number, too
    hashed = df.select(*groups, h.alias("_h"))
    rank = rest + 1 - bit_width(F.col("_h").bitwiseAND(F.lit((1 << rest) - 1)))
    rows = hashed.select(
        *groups,
        F.shiftrightunsigned("_h", rest).cast("int").alias("bucket"),
        F.coalesce(rank, F.lit(0)).cast("int").alias("rank"),
    )
    return merge(rows, groups)


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Registers of coarser groups, or of several sketches in one DataFrame, by maximum."""
    return sketches.groupBy(*groups, "bucket").agg(F.max("rank").alias("rank"))


def cube(sketches: DataFrame, groups: Sequence[str], never_null: Sequence[str] = ()) -> DataFrame:
    """Registers of every combination of groups, with by_<group> saying which take part.

    never_null names groups whose null is no group of its own: rows without it count only
    where it does not take part.
    """
    n = len(groups)
    sets = [[g for i, g in enumerate(groups) if mask >> i & 1] + ["bucket"] for mask in range(1 << n)]
    out = sketches.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*groups, "bucket")])
    out = out.agg(F.max("rank").alias("rank"), *[(F.grouping(g) == 0).alias(f"by_{g}") for g in groups])
    for g in never_null:
        out = out.where(~F.col(f"by_{g}") | F.col(g).isNotNull())
    return out


def estimate(sketches: DataFrame, groups: Sequence[str], p: int = P) -> DataFrame:
    """groups, n_distinct and bounds of two standard errors, from registers."""
    m = 1 << p
    state = sketches.groupBy(*groups).agg(
        F.sum(F.when(F.col("bucket").isNotNull(), F.pow(F.lit(2.0), -F.col("rank")))).alias("_s"),
        F.count("bucket").alias("_used"),
    )
    x = F.lit(1.0) - F.col("_used") / m
    terms = [F.pow(x, F.lit(float(1 << k))) * float(1 << (k - 1)) for k in range(1, TERMS)]
    sigma = x
    for t in terms:
        sigma = sigma + t
    raw = (m * m / (2 * math.log(2))) / (F.col("_s") + m * sigma)
    n = F.when(F.col("_used") == 0, 0).otherwise(F.round(raw)).cast("bigint")
    e = standard_error(p)
    return state.select(*groups, n.alias("n_distinct")).select(
        *groups,
        "n_distinct",
        F.lit(round(e, 6)).alias("rel_std_error"),
        F.floor(F.col("n_distinct") * (1 - 2 * e)).alias("low"),
        F.ceil(F.col("n_distinct") * (1 + 2 * e)).alias("high"),
    )
