"""The discrete Fourier transform of short frames as a relation, and padding; frame_codecs has the array form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions.scalar import next_size, norm, round_clamped

FRAME = ["series_id", "frame_no"]
PAD_FROM = 128


def padding(n: Column) -> tuple[Column, Column]:
    """(added before, added behind) a frame of n samples: up to the next 2**a * 3**b, half on each side."""
    added = F.when(n >= PAD_FROM, next_size(n) - n).otherwise(0)
    before = F.floor(added / 2).cast("long")
    return before, (added - before).cast("long")


def padded(framed: DataFrame) -> DataFrame:
    """FRAME, pos_in_padded, value: the frame with its first and last sample repeated at the ends."""
    before, behind = padding(F.col("frame_len"))
    x, n = F.col("pos_in_frame"), F.col("frame_len")
    low = F.when(x == 0, F.lit(0)).otherwise(x + before)
    high = F.when(x == n - 1, n - 1 + before + behind).otherwise(x + before)
    return framed.select(*FRAME, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("pos_in_padded"), "value")


def trimmed(padded_rows: DataFrame, frames: DataFrame) -> DataFrame:
    """The inverse of padded(). frames: FRAME, frame_len."""
    before, _ = padding(F.col("frame_len"))
    joined = padded_rows.join(frames.select(*FRAME, "frame_len").distinct(), FRAME).withColumn("pos_in_frame", F.col("pos_in_padded") - before)
    return joined.filter((F.col("pos_in_frame") >= 0) & (F.col("pos_in_frame") < F.col("frame_len"))).select(*FRAME, "frame_len", "pos_in_frame", "value")


def transform(framed: DataFrame) -> DataFrame:
    """FRAME, bin, re, im for the lower half of the spectrum: a row for each sample and bin, so for frames of a few samples."""
    n, x = F.col("frame_len"), F.col("pos_in_frame")
    bins = framed.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / 2).cast("long"))))
    angle = F.lit(-2 * math.pi) * ((x * F.col("bin")) % n) / n
    return bins.groupBy(*FRAME, "frame_len", "bin").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"))


def strongest(spectrum: DataFrame, k: int | Column) -> DataFrame:
    """The k bins of each frame with the largest norm, smaller bins first among equal ones; a single one is the mean's."""
    re, im = F.col("re"), F.col("im")
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.round(norm(re, im), 9).desc(), "bin"))
    k = F.lit(k) if isinstance(k, int) else k
    ranked = spectrum.filter((re != 0) | (im != 0)).withColumn("rank", rank)
    return ranked.filter(F.when(k == 1, F.col("bin") == 0).otherwise(F.col("rank") <= k))


def inverse(points: DataFrame, framed: DataFrame) -> DataFrame:
    """The samples with decoded, from the points kept; bins above zero count with their mirror."""
    ends = framed.groupBy(*FRAME).agg(F.min("value").cast("float").cast("double").alias("low"), F.max("value").cast("float").cast("double").alias("high"))
    n, x = F.col("frame_len"), F.col("pos_in_frame")
    angle = F.lit(2 * math.pi) * ((x * F.col("bin")) % n) / n
    twice = F.when((F.col("bin") == 0) | (2 * F.col("bin") == n), 1.0).otherwise(2.0)
    terms = framed.join(points.select(*FRAME, "bin", "re", "im"), FRAME)
    summed = terms.groupBy(*FRAME, "frame_len", "pos_in_frame", "value").agg(F.sum(twice * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))).alias("total"))
    value = round_clamped(F.col("total") / n, F.col("low"), F.col("high"))
    return summed.join(ends, FRAME).select(*FRAME, "pos_in_frame", "value", F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(value).alias("decoded"))
