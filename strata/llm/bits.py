"""Bit tricks on BIGINT columns, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(col: Column) -> Column:
    """Bits that a non-negative BIGINT needs: 0 for 0, else 1 + floor(log2)."""
    for step in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseOR(F.shiftrightunsigned(col, step))
    return F.bit_count(col)
