"""A Bloom filter with fixed bit places, for whole columns of keys.

Place i of a key is (h1 + i * h2) mod bits, modulo 2**64 before, with h1 the 64-bit and h2
the 32-bit FNV-1a hash of its bytes (a zero hash is replaced).
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
BITS_PER_KEY, LEAST_BITS, HASHES = 16, 1024, 7
ZERO_HASH = 0x9E3779B97F4A7C15
FNV64 = (0xCBF29CE484222325, 0x100000001B3)
FNV32 = (0x811C9DC5, 0x01000193)

#: Bits of a filter that may be built from a column and sent to the executors: 256 MB. Larger sets take one filter for each run.
MOST_BITS = 1 << 31


def size_for(n_keys: int) -> tuple[int, int]:
    """Bits and hashes of a filter for so many keys."""
    return max(LEAST_BITS, n_keys * BITS_PER_KEY), HASHES


def _fnv(keys: np.ndarray, lengths: np.ndarray, offset: int, prime: int, kind) -> np.ndarray:
    """FNV-1a of all rows of a padded byte matrix, one column at a time."""
    h = np.full(len(keys), offset, kind)
    with np.errstate(over="ignore"):
        for c in range(keys.shape[1]):
            h = np.where(c < lengths, (h ^ keys[:, c].astype(kind)) * kind(prime), h)
    return h


def places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Bit places, one row for each key. Keys are hashed together with keys of about their length, so a long one costs itself alone."""
    lengths = np.array([len(k) for k in keys], np.int64)
    out = np.empty((len(keys), hashes), np.int64)
    classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for c in np.unique(classes):
        at = np.flatnonzero(classes == c)
        n, width = lengths[at], int(lengths[at].max())
        padded = np.frombuffer(b"".join(bytes(keys[i]).ljust(width, b"\0") for i in at), np.uint8).reshape(len(at), width)
        h1 = _fnv(padded, n, *FNV64, np.uint64)
        h2 = _fnv(padded, n, *FNV32, np.uint32).astype(np.uint64)
        h1[h1 == 0] = ZERO_HASH
        h2[h2 == 0] = ZERO_HASH
        with np.errstate(over="ignore"):
            sums = h1[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * h2[:, None]
        out[at] = (sums % np.uint64(bits)).astype(np.int64)
    return out


def _spread(s: pd.Series, of) -> pd.Series:
    """of the keys that are not null, null for the others."""
    keys = s.tolist()
    found = iter(of([k for k in keys if k is not None]))
    return pd.Series([None if k is None else next(found) for k in keys], dtype=object)


def bit_places(key: Column, bits: int, hashes: int = HASHES) -> Column:
    """array<bigint> of the places of each key; null for a null key (FN3, FN5)."""

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return _spread(s, lambda keys: places(keys, bits, hashes).tolist())

    return run(key)


class Bloom:
    """A filter held by the driver; bits bound its size."""

    def __init__(self, bits: int, hashes: int = HASHES, data: bytes | None = None) -> None:
        self.bits, self.hashes = max(8, bits), max(1, hashes)
        self.data = bytearray(data if data is not None else (self.bits + 7) // 8)

    def add(self, *keys: bytes) -> None:
        for p in places(list(keys), self.bits, self.hashes).ravel().tolist():
            self.data[p // 8] |= 1 << p % 8

    def might_contain(self, key: bytes) -> bool:
        """False only if the key was never added."""
        return all(self.data[p // 8] >> p % 8 & 1 for p in places([key], self.bits, self.hashes)[0].tolist())

    def pack(self) -> bytes:
        return struct.pack(">II", self.bits, self.hashes) + bytes(self.data)

    @classmethod
    def unpack(cls, data: bytes) -> Bloom:
        """Read what pack wrote; sizes that do not fit raise (FN4)."""
        if len(data) < 8:
            raise ValueError("bloom block too short")
        bits, hashes = struct.unpack(">II", data[:8])
        if not bits or not hashes or len(data) != 8 + (bits + 7) // 8:
            raise ValueError("bloom block with impossible sizes")
        return cls(bits, hashes, data[8:])


def build(df: DataFrame, key: str, bits: int, hashes: int = HASHES) -> Bloom:
    """The filter of a column of keys, null keys left out; at most MOST_BITS.

    Places are combined to 64-bit words in each map task; at most bits / 64 rows reach the driver.
    """
    if bits > MOST_BITS:
        raise ValueError(f"{bits} bits are too many to be held by one process; the most are {MOST_BITS}")
    p = df.where(F.col(key).isNotNull()).select(F.explode(bit_places(F.col(key), bits, hashes)).alias("p"))
    word, bit = F.shiftright("p", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    words = p.groupBy(word).agg(F.bit_or(bit).alias("b"))
    out = Bloom(bits, hashes)
    whole = np.zeros(-(-len(out.data) // 8), np.uint64)
    for row in words.toLocalIterator():
        whole[row.w] = np.uint64(row.b & (1 << 64) - 1)
    out.data = bytearray(whole.astype("<u8").tobytes()[: len(out.data)])
    return out


def might_contain(spark: SparkSession, key: Column, bloom: Bloom) -> Column:
    """Whether each key may be in the filter; null for a null key. The packed filter, at most MOST_BITS, is broadcast."""
    if bloom.bits > MOST_BITS:
        raise ValueError(f"a filter of {bloom.bits} bits is too large to be sent; the most are {MOST_BITS}")
    sent, bits, hashes = spark.sparkContext.broadcast(bytes(bloom.data)), bloom.bits, bloom.hashes

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        data = np.frombuffer(sent.value, np.uint8)

        def found(keys: list[bytes]) -> list[bool]:
            p = places(keys, bits, hashes)
            return (data[p >> 3] >> (p & 7).astype(np.uint8) & 1).all(axis=1).tolist()

        return _spread(s, found)

    return run(key)
