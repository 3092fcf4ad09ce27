"""The framed record encoding, as column expressions.

Frame, big-endian: payload length with bit 31 set (4 bytes), payload, CRC-32 of the
payload (4 bytes). Payload: key length (4), value length (4), ts (8), deleted flag
(1), key, value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 17
CRC_FLAG = 1 << 31


def _be(col: Column, size: int) -> Column:
    """A non-negative number, or for size 8 any BIGINT, as big-endian bytes."""
    return F.unhex(F.substring(F.lpad(F.hex(col.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size))


def _number(digits: Column, start: int, size: int) -> Column:
    """Bytes of a string of hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 2 * start - 1, 2 * size), 16, 10).cast("bigint")


def encode_payload(key: Column, value: Column, ts: Column, is_deleted: Column) -> Column:
    """FN7: the payload of a record. A null value is written as empty, a tombstone's value never."""
    body = F.when(is_deleted, F.unhex(F.lit(""))).otherwise(F.coalesce(value, F.unhex(F.lit(""))))
    flag = F.when(is_deleted, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(_be(F.length(key), 4), _be(F.length(body), 4), _be(ts, 8), flag, key, body)


def encode_record(key: Column, value: Column, ts: Column, is_deleted: Column) -> Column:
    """SK3: the whole frame of a record; null if the key or ts is null."""
    payload = encode_payload(key, value, ts, is_deleted)
    return F.concat(_be(F.length(payload) + F.lit(CRC_FLAG), 4), payload, _be(F.crc32(payload), 4))


def decode_record(frame: Column) -> Column:
    """FN7, FN6: struct<key, value, ts, is_deleted> of a frame.

    A frame whose lengths do not match exactly or whose checksum is wrong raises; bit 31
    clear means no checksum. A null frame gives null. The value of a tombstone is null.
    """
    head = F.hex(F.substring(frame, 1, 4 + HEADER))
    high, low = _number(head, 13, 4), _number(head, 17, 4)
    parsed = F.struct(
        _number(head, 1, 4).alias("marked"),
        _number(head, 5, 4).cast("int").alias("key_size"),
        _number(head, 9, 4).cast("int").alias("value_size"),
        # Eight bytes as a signed number: the first bit counts negative.
        F.shiftleft(F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high), 32).bitwiseOR(low).alias("ts"),
        (F.substring(head, 41, 2) == "01").alias("deleted"),
    )

    def check(p: Column) -> Column:
        has_crc = p["marked"] >= CRC_FLAG
        size = p["marked"].bitwiseAND(F.lit(CRC_FLAG - 1)).cast("int")
        payload = F.substring(frame, F.lit(5), size)
        whole = (F.length(frame) == size + F.when(has_crc, 8).otherwise(4)) & (size == p["key_size"] + p["value_size"] + HEADER)
        crc = F.crc32(payload) == _number(F.hex(F.substring(frame, size + 5, F.lit(4))), 1, 4)
        record = F.struct(
            F.substring(payload, F.lit(HEADER + 1), p["key_size"]).alias("key"),
            F.when(~p["deleted"], F.substring(payload, F.lit(HEADER + 1) + p["key_size"], p["value_size"])).alias("value"),
            p["ts"].alias("ts"),
            p["deleted"].alias("is_deleted"),
        )
        wrong = F.when(~whole, F.raise_error(F.lit("invalid record encoding"))).otherwise(F.raise_error(F.lit("record crc mismatch")))
        return F.when(F.coalesce(whole & (~has_crc | crc), F.lit(False)), record).otherwise(wrong)

    # An array of one, so that the header is parsed once for all that is made of it.
    return F.when(frame.isNotNull(), F.transform(F.array(parsed), check)[0])
