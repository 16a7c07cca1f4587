"""Lossless codecs as relations: rounding, constants and indexed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions import sizes
from seriesmith.functions.scalar import round_half_away
from seriesmith.operators.series import frame_stats

FRAME = ["series_id", "frame_no"]


def noop_encode(framed: DataFrame) -> DataFrame:
    """Values rounded to whole numbers, half away from zero, as stored; those beyond the longs as the last of them."""
    whole, most = round_half_away(F.col("value"), 0), float(1 << 63)
    return framed.withColumn("stored", F.when(F.abs(whole) >= most, F.signum(whole) * most).otherwise(whole).cast("long"))


def noop_decode(stored: DataFrame) -> DataFrame:
    return stored.withColumn("decoded", F.col("stored").cast("double"))


def noop_sizes(framed: DataFrame) -> DataFrame:
    """FRAME and payload_bytes."""
    stored = noop_encode(framed).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), F.sum(sizes.signed(F.col("stored"))).alias("values"))
    return stored.select(*FRAME, sizes.noop(F.col("n"), F.col("values")).alias("payload_bytes"))


def constant_encode(framed: DataFrame) -> DataFrame:
    """The minimum and bitdepth of each frame; is_constant says whether that loses nothing."""
    stats = frame_stats(framed)
    size = sizes.constant(F.col("min"), F.col("bitdepth"))
    return stats.select(*FRAME, "sample_count", F.col("min").alias("constant"), "bitdepth", (F.col("min") == F.col("max")).alias("is_constant"), size.alias("payload_bytes"))


def constant_decode(encoded: DataFrame) -> DataFrame:
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sample_count") - 1))
    return encoded.select(*FRAME, each.alias("pos_in_frame"), F.col("constant").alias("decoded"))


def run_starts(framed: DataFrame) -> DataFrame:
    """The first sample of each run of equal values: FRAME, value, start. Zeros of both signs are equal."""
    last = F.lag("value").over(Window.partitionBy(*FRAME).orderBy("pos_in_frame"))
    runs = framed.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("_last") != F.col("value")))
    return runs.select(*FRAME, "value", F.col("pos_in_frame").alias("start"))


def rle_encode(framed: DataFrame) -> DataFrame:
    """FRAME, value, starts: the sorted starts of the runs of each value."""
    return run_starts(framed).groupBy(*FRAME, "value").agg(F.array_sort(F.collect_list("start")).alias("starts"))


def rle_decode(encoded: DataFrame, frames: DataFrame) -> DataFrame:
    """FRAME, pos_in_frame, decoded. frames: FRAME, sample_count."""
    runs = encoded.select(*FRAME, "value", F.explode("starts").alias("start")).join(frames.select(*FRAME, "sample_count"), FRAME)
    following = F.lead("start").over(Window.partitionBy(*FRAME).orderBy("start"))
    last = F.coalesce(following, F.col("sample_count")) - 1
    return runs.withColumn("_last", last).select(*FRAME, F.explode(F.sequence("start", "_last")).alias("pos_in_frame"), F.col("value").alias("decoded"))


def rle_sizes(framed: DataFrame) -> DataFrame:
    """FRAME, n_values, n_runs, payload_bytes."""
    depth = frame_stats(framed).select(*FRAME, "bitdepth")
    by_value = run_starts(framed).groupBy(*FRAME, "value").agg(F.count(F.lit(1)).alias("n"), F.sum(sizes.varint(F.col("start"))).alias("starts"))
    part: Column = sizes.value(F.col("value"), F.col("bitdepth")) + sizes.varint(F.col("n")) + F.col("starts")
    summed = by_value.join(depth, FRAME).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_runs"), F.sum(part).alias("parts"))
    return summed.select(*FRAME, "n_values", "n_runs", sizes.rle(F.col("n_values"), F.col("parts")).alias("payload_bytes"))
