"""Most frequent items among billions (problem 2): combinatorial group testing.

Every row of D hash functions sends an item to one of W buckets. A bucket keeps its total
and, for each of the 32 bits of the item's fingerprint, how often the bit was set. Where
one item outweighs the rest of its bucket, each bit's majority spells its fingerprint, so
it is decoded from the counters alone. Sketches add bucket by bucket.

Bounds. An item with at least the share phi of N rows is decoded in a row of the sketch
unless the other items of its bucket weigh as much as it does. With W buckets and all
heavier items elsewhere the expected rest is N / W, so by Markov's inequality a row misses
with probability at most 1 / (phi * W), which is 0.05 at the default values (2048, 0.01)
with collisions among the at most 1 / phi heavy items another 1 / (phi * W); all D rows
miss with at most 0.1 ** 4. The state is D * W * 33 counters for each table, whatever the
rows. Only buckets that weigh phi * N can hold such an item, so there are at most D / phi
candidates; a second scan counts the keys that have their fingerprints exactly, which leaves
no false ones. Keys that share a fingerprint are told apart there, so 32 bits are enough for
any number of keys: what shares a heavy key's fingerprint is a share of 2**-32 of the rest.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import apart

PHI = 0.01
DEPTH = 4
WIDTH = 2048
BITS = 32
#: Most candidates that are sent to every executor; a group has DEPTH / PHI, 400, at most. More are joined by a shuffle.
MAX_BROADCAST = 10_000


def fingerprint(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << BITS) - 1))


def _bucket(h: Column, row: int, width: int) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(row)), F.lit(width)).cast("int")


def _least(phi: float) -> Column:
    """The fewest rows that are the share phi of n_rows, without rounding of binary fractions."""
    return F.ceil(F.lit(Decimal(str(phi))) * F.col("n_rows"))


def sketch(df: DataFrame, key: str, group: str, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """group, row, bucket, total, b0..b31: the mergeable sketch of each group.

    Null keys are left out. The counters are summed in each map task before the shuffle,
    so the shuffle carries at most depth * width rows a task and group, and a hot key
    costs no more than any other.
    """
    apart([group], ("row", "bucket", "total", "_h"))
    h = df.where(F.col(key).isNotNull()).select(F.col(group).alias("_g"), fingerprint(F.col(key)).alias("_h"))
    spots = F.array(*[F.struct(F.lit(r).alias("row"), _bucket(F.col("_h"), r, width).alias("bucket")) for r in range(depth)])
    rows = h.select("_g", "_h", F.explode(spots).alias("s")).select(F.col("_g").alias(group), "s.row", "s.bucket", "_h")
    bits = [F.sum(F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    return rows.groupBy(group, "row", "bucket").agg(F.count(F.lit(1)).alias("total"), *bits)


def add(sketches: DataFrame, group: str) -> DataFrame:
    """The sum of several sketches in one DataFrame."""
    return sketches.groupBy(group, "row", "bucket").agg(F.sum("total").alias("total"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(BITS)])


def candidates(sketches: DataFrame, group: str, phi: float = PHI, width: int = WIDTH) -> DataFrame:
    """group, _h, n_rows, at_most: decoded fingerprints of buckets that weigh phi * n_rows.

    at_most is the least bucket total of the fingerprint, an upper bound of its count. A
    fingerprint that does not hash to its own bucket was no majority and is dropped.
    """
    n = F.sum("total").over(Window.partitionBy(group, "row"))
    heavy = sketches.withColumn("n_rows", n).where(F.col("total") >= _least(phi))
    h = F.lit(0).cast("bigint")
    for b in range(BITS):
        h = h.bitwiseOR(F.when(2 * F.col(f"b{b}") > F.col("total"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    decoded = heavy.select(group, "row", "bucket", "total", "n_rows", h.alias("_h"))
    own = decoded.where(F.col("bucket") == F.pmod(F.xxhash64("_h", "row"), F.lit(width)))
    return own.groupBy(group, "_h").agg(F.max("n_rows").alias("n_rows"), F.min("total").alias("at_most"))


def frequent(df: DataFrame, key: str, group: str, phi: float = PHI, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """group, key, n, approx, n_rows: the items with at least the share phi of a group's rows with a key.

    approx is the sketch's count, n the exact one from the second scan, which also tells
    apart items of one fingerprint. Every stored row counts; keys are compared byte by
    byte, the empty key is a key, null keys are left out. Items at the threshold are in.
    An empty table gives no rows, a null group is a group.
    """
    apart([group, key], ("n", "approx", "n_rows", "at_most", "_g", "_c", "_h"))
    found = candidates(sketch(df, key, group, depth, width), group, phi, width)
    c = found.select(F.col(group).alias("_g"), F.col("_h").alias("_c"), "n_rows", "at_most")
    # A group has depth / phi candidates at most, but there may be many groups: sent if all are few.
    few = c.limit(MAX_BROADCAST + 1).collect()
    if len(few) <= MAX_BROADCAST:
        c = F.broadcast(df.sparkSession.createDataFrame(few, c.schema))
    rows = df.where(F.col(key).isNotNull()).select(group, key, fingerprint(F.col(key)).alias("_h"))
    hits = rows.join(c, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_h") == F.col("_c")))
    counted = hits.groupBy(group, key).agg(F.count(F.lit(1)).alias("n"), F.max("at_most").alias("approx"), F.max("n_rows").alias("n_rows"))
    return counted.where(F.col("n") >= _least(phi))
