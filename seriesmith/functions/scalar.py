"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMALS = 5
#: Frames have at most this many samples; padded sizes reach a little further.
MAX_FRAME = 131072


def smooth_sizes(limit: int = 4 * MAX_FRAME) -> list[int]:
    """All 2**a * 3**b up to limit, in order."""
    out, power = [], 1
    while power <= limit:
        n = power
        while n <= limit:
            out.append(n)
            n *= 2
        power *= 3
    return sorted(out)


def prev_power_of_two(n: Column) -> Column:
    """The largest power of two that is n at most; 0 for n below 1."""
    bits = F.length(F.bin(n))
    return F.when(n < 1, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1))


def next_size(n: Column) -> Column:
    """The smallest 2**a * 3**b above n."""
    return F.array_min(F.filter(F.lit(smooth_sizes()), lambda x: x > n))


def is_decomposable(n: Column) -> Column:
    return F.array_contains(F.lit(smooth_sizes()), n.cast("int"))


def to_fixed(x: Column, precision: int) -> Column:
    """x in units of 10**-precision, cut towards zero to a whole number; negative and missing numbers give 0, and those too
    large the largest long. precision is 6 at most."""
    if not 0 <= precision <= 6:
        raise ValueError("precision is from 0 to 6")
    scaled = x * F.lit(float(10**precision))
    most = (1 << 63) - 1
    return F.when(scaled >= float(most), most).when((scaled > 0) & ~F.isnan(scaled), F.floor(scaled).cast("long")).otherwise(0).cast("long")


def round_half_away(x: Column, decimals: int) -> Column:
    scale = F.lit(float(10**decimals))
    scaled = x * scale
    up = F.abs(scaled) + F.lit(0.5)
    whole = F.when(up < float(1 << 53), F.floor(up).cast("double")).otherwise(up)  # floor() gives a long; from 2**53 on all are whole
    return F.signum(scaled) * whole / scale


def round_clamped(x: Column, low: Column, high: Column, decimals: int = DECIMALS) -> Column:
    return F.least(F.greatest(round_half_away(x, decimals), low), high)


def seconds_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def start_of_day(ts: Column) -> Column:
    """Seconds since the epoch at which the day of ts starts."""
    return F.unix_timestamp(F.date_trunc("DAY", ts).cast("timestamp"))


def norm(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def whole_part(x: Column) -> Column:
    return F.floor(x).cast("long")


def fraction(x: Column) -> Column:
    return x - F.floor(x)


def error_bound(percent: float) -> Column:
    """A bound given in per cent, through single precision, as a double."""
    return F.lit(percent / 100).cast("float").cast("double")
