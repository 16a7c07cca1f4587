"""compress() and decompress(): series to frames and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.functions import sizes
from seriesmith.operators import frame_codecs
from seriesmith.operators.series import SAMPLE_LEVELS, clean, with_frames, with_positions

DEFAULT_ERROR = 3.0
#: Positions that one task ranks.
RANKED = 1 << 20
FRAMES = "series_id string, frame_no long, frame_start long, sample_count long, codec string, error double, payload binary"
_ARROW = pa.schema(
    [
        ("series_id", pa.string()),
        ("frame_no", pa.int64()),
        ("frame_start", pa.int64()),
        ("sample_count", pa.int64()),
        ("codec", pa.string()),
        ("error", pa.float64()),
        ("payload", pa.binary()),
    ]
)
_SAMPLES = pa.schema([("series_id", pa.string()), ("pos", pa.int64()), ("value", pa.float64())])


def bound_of(error: float) -> float:
    """The bound of an error in per cent, through single precision."""
    return float(np.float32(np.float32(error) / np.float32(100)))


def compress(df: DataFrame, order: list[str] | None = None, codec: str = "auto", error: float = DEFAULT_ERROR, level: int = 0, bucket: Column | None = None) -> DataFrame:
    """FRAMES of the series in df (series_id, value, and pos or the columns of ``order``).

    Samples without a finite value are left out, and positions count the others; timeindex.build_index() with the value's
    column counts the same samples. Without an order, positions are ranked in stretches of RANKED.

    error: the bound in per cent, 0 to 50; level: 0, or 1 to 6 to choose codecs by ever fewer samples. One task has one
    frame of 131072 samples at most in memory.
    """
    if codec not in frame_codecs.CODECS:
        raise ValueError(f"codec is one of {frame_codecs.CODECS}")
    if not 0 <= error <= 50 or not 0 <= level < len(SAMPLE_LEVELS):
        raise ValueError("error is from 0 to 50, level from 0 to 6")
    bound, sample = bound_of(error), SAMPLE_LEVELS[level]
    finite = clean(df.withColumn("series_id", F.col("series_id").cast("string")).withColumn("value", F.col("value").cast("double")))
    if not order and bucket is None:
        bucket = F.floor(F.col("pos") / RANKED)
    placed = with_positions(finite, order or ["pos"], bucket=bucket)
    framed = with_frames(placed).select("series_id", "frame_no", "frame_start", "pos", "value")

    def encoded(group: pa.Table) -> pa.Table:
        at = np.argsort(group.column("pos").to_numpy())
        x = group.column("value").to_numpy()[at]
        used, payload, reached = frame_codecs.choose(x, bound, sample) if codec == "auto" else (codec, *frame_codecs.encode(x, codec, bound))
        row = (group.column("series_id")[0].as_py(), group.column("frame_no")[0].as_py(), group.column("frame_start")[0].as_py(), len(x), used, reached, payload)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    return framed.groupBy("series_id", "frame_no").applyInArrow(encoded, FRAMES)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            x = frame_codecs.decode(row["payload"], row["codec"], row["sample_count"])
            pos = np.arange(row["frame_start"], row["frame_start"] + len(x))
            columns = [pa.array([row["series_id"]] * len(x), pa.string()), pa.array(pos, pa.int64()), pa.array(x, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SAMPLES)


def decompress(frames: DataFrame) -> DataFrame:
    """(series_id, pos, value) of FRAMES, frame by frame without a shuffle; a filter on frame_start decodes just those."""
    used = frames.select("series_id", "frame_start", "sample_count", "codec", "payload")
    return used.mapInArrow(_decoded, "series_id string, pos long, value double")


def frame_sizes(frames: DataFrame) -> DataFrame:
    payload = F.length("payload").cast("long")
    return frames.withColumn("payload_bytes", payload).withColumn("frame_bytes", sizes.frame(F.col("sample_count"), payload))


def compression_ratio(frames: DataFrame) -> DataFrame:
    """series_id, n_frames, samples, stream_bytes, ratio (of 8 bytes a sample)."""
    summed = frame_sizes(frames).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("sample_count").alias("samples"), F.sum("frame_bytes").alias("frame_bytes")
    )
    total = sizes.stream(F.col("n_frames"), F.col("frame_bytes"))
    return summed.select("series_id", "n_frames", "samples", total.alias("stream_bytes"), (8 * F.col("samples") / total).alias("ratio"))
