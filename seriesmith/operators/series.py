"""Series: cleaning, positions, frames and their statistics.

A series is a set of rows (series_id, pos, value). Positions come from an order that must be total. A frame is a stretch of
a series: 131072 samples while there are as many, then the largest power of two that is left, and the rest when that is 512
or less. Frame numbers are computed from positions and lengths alone, so framing needs no shuffle but that which counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.scalar import MAX_FRAME

MIN_FRAME_BITS = 9
#: Samples that choose the codec at each level of sampling; at level 0 all do.
SAMPLE_LEVELS = (None, 4096, 2048, 1024, 512, 256, 128)
BLOCK = 2048


def clean(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows with a finite value."""
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def with_positions(df: DataFrame, order: list[str], key: str = "series_id", bucket: Column | None = None) -> DataFrame:
    """df with pos: the rank from 0 of each row in its series by ``order``.

    With a bucket, an expression that never falls along the order (such as the hour of the time), a long series is ranked
    bucket by bucket in different tasks: only the buckets' counts meet in one.
    """
    if bucket is None:
        return df.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_key", "_at", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    ranked = df.withColumn("_local", local).join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    return ranked.withColumn("pos", (F.col("_before") + F.col("_local")).cast("long")).drop("_bucket", "_key", "_at", "_before", "_local")


def frame_columns(pos: Column, n: Column) -> tuple[Column, Column, Column]:
    """(frame_no, frame_start, frame_len) of the sample at pos in a series of n samples.

    Behind the full frames, a remainder r is cut by its bits, high to low, down to 2**9; the bits below form the last frame.
    The frame of offset o ends where r's bits above the highest bit in which o and r differ end.
    """
    full = F.floor(n / MAX_FRAME).cast("long")
    r, o = n - full * MAX_FRAME, pos - full * MAX_FRAME
    bit = F.greatest(F.length(F.bin(o.bitwiseXOR(r))) - 1, F.lit(MIN_FRAME_BITS - 1))
    high = F.call_function("shiftright", r, bit + 1)
    start = F.call_function("shiftleft", high, bit + 1)
    # 2**9 left over is a frame of its own, and so is what is below, unless both are the last 512 or fewer
    size = F.when(bit >= MIN_FRAME_BITS, F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(r - start)
    number = F.floor(pos / MAX_FRAME).cast("long")
    in_full = pos < full * MAX_FRAME
    return (
        F.when(in_full, number).otherwise(full + F.bit_count(high)),
        F.when(in_full, number * MAX_FRAME).otherwise(full * MAX_FRAME + start),
        F.when(in_full, F.lit(MAX_FRAME).cast("long")).otherwise(size),
    )


def with_frames(df: DataFrame, key: str = "series_id") -> DataFrame:
    """df (with pos) with frame_no, frame_start, frame_len and pos_in_frame."""
    lengths = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    number, start, size = frame_columns(F.col("pos"), F.col("_n"))
    framed = df.join(lengths, F.col(key).eqNullSafe(F.col("_key")))
    framed = framed.withColumns({"frame_no": number, "frame_start": start, "frame_len": size}).drop("_key", "_n")
    return framed.withColumn("pos_in_frame", F.col("pos") - F.col("frame_start"))


def blocks(df: DataFrame, key: str = "series_id") -> DataFrame:
    """(series_id, chunk_no, values): the samples in blocks of 2048 in order."""
    at = F.struct("pos", "value")
    grouped = df.groupBy(key, F.floor(F.col("pos") / BLOCK).cast("long").alias("chunk_no")).agg(F.sort_array(F.collect_list(at)).alias("v"))
    return grouped.select(key, "chunk_no", F.col("v.value").alias("values"))


def from_blocks(chunks: DataFrame, key: str = "series_id") -> DataFrame:
    flat = chunks.select(key, "chunk_no", F.posexplode("values").alias("i", "value"))
    return flat.select(key, (F.col("chunk_no") * BLOCK + F.col("i")).alias("pos"), "value")


def bitdepth(low: Column, high: Column, fractional: Column) -> Column:
    """The narrowest of U8, I16, I32 and F64 that holds all values from low to high."""
    holds = lambda a, b: (low >= a) & (high <= b)
    return (
        F.when(fractional, "F64")
        .when(holds(0, 255), "U8")
        .when(holds(-(2**15), 2**15 - 1), "I16")
        .when(holds(-(2**31), 2**31 - 1), "I32")
        .otherwise("F64")
    )


def frame_stats(framed: DataFrame, key: str = "series_id") -> DataFrame:
    """A row for each frame: sample_count, min, max, min_loc, max_loc (first occurrences), mean, fractional, bitdepth."""
    v, at = F.col("value"), F.col("pos_in_frame")
    stats = framed.groupBy(key, "frame_no").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(F.struct(v, at))["pos_in_frame"].alias("min_loc"),
        (-F.max(F.struct(v, (-at).alias("back")))["back"]).alias("max_loc"),
        F.avg("value").alias("mean"),
        F.bool_or(v != F.floor(v)).alias("fractional"),
    )
    return stats.withColumn("bitdepth", bitdepth(F.col("min"), F.col("max"), F.col("fractional")))
