"""Encoded sizes in bytes, so that codecs can be compared without writing bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_SIZE_FIELD = 41


def varint(u: Column) -> Column:
    """Bytes of an unsigned number below 2**63."""
    return F.when(u < 251, 1).when(u < 1 << 16, 3).when(u < 1 << 32, 5).otherwise(9).cast("long")


def zigzag(n: Column) -> Column:
    return F.call_function("shiftleft", n, F.lit(1)).bitwiseXOR(F.shiftright(n, 63))


def signed(n: Column) -> Column:
    return varint(zigzag(n.cast("long")))


def value(x: Column, bitdepth: Column) -> Column:
    """Bytes of a value at a bitdepth (U8, I16, I32 or F64)."""
    return F.when(bitdepth == "U8", 1).when(bitdepth.isin("I16", "I32"), signed(F.when(bitdepth != "F64", x))).otherwise(8).cast("long")


def noop(count: Column, values: Column) -> Column:
    """From the count and the sum of signed() over a frame."""
    return F.lit(1) + varint(count) + values


def constant(x: Column, bitdepth: Column) -> Column:
    return F.lit(2) + value(x, bitdepth)


def rle(n_values: Column, parts: Column) -> Column:
    """parts: the sum over values of value() + varint(starts) + the sum of varint(start)."""
    return F.lit(2) + varint(n_values) + parts


def keyed(n_keys: Column, keys: Column) -> Column:
    """Polynomial and IDW, from the number of keys and the sum of value() over them."""
    return F.lit(2) + varint(n_keys) + keys + 17


def fft(n_points: Column, positions: Column) -> Column:
    """From the number of points and the sum of varint(position)."""
    return F.lit(9) + varint(n_points) + positions + 8 * n_points


def frame(sample_count: Column, payload: Column) -> Column:
    return F.lit(2) + varint(sample_count) + varint(payload) + payload


def stream(n_frames: Column, frames: Column) -> Column:
    return F.lit(9) + varint(n_frames) + frames
