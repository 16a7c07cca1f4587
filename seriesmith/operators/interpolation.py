"""Interpolating codecs as relations: keys, Catmull-Rom and inverse-distance decoding, and the ladder of key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.functions import sizes
from seriesmith.functions.metrics import ape
from seriesmith.functions.scalar import round_clamped, round_half_away
from seriesmith.operators.series import frame_stats

FRAME = ["series_id", "frame_no"]


def default_points(n: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(n / 100)).cast("long")


def step_of(n: Column, points: Column) -> Column:
    return F.greatest(F.floor(n / points), F.lit(1)).cast("long")


def with_step(framed: DataFrame, points: Column | None = None) -> DataFrame:
    return framed.withColumn("step", step_of(F.col("frame_len"), default_points(F.col("frame_len")) if points is None else points))


def keys(stepped: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """FRAME, extra, key_no, x, v: every step-th sample and the last. The samples have a step."""
    x = F.col("pos_in_frame")
    number = F.floor((x + F.col("step") - 1) / F.col("step")).cast("long")
    kept = stepped.filter((x % F.col("step") == 0) | (x == F.col("frame_len") - 1))
    return kept.select(*FRAME, *extra, "step", "frame_len", number.alias("key_no"), x.alias("x"), F.col("value").alias("v"))


def segments(keyed: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """keys with those around them: x0..x3 and v0..v3, of which 1 and 2 bound the segment, and whether it is cubic."""
    w = Window.partitionBy(*FRAME, *extra).orderBy("key_no")
    around = {f"{c}{k + 1}": F.lag(c, -k).over(w) for c in ("x", "v") for k in (-1, 0, 1, 2)}
    return keyed.withColumns(around).withColumn("cubic", F.col("x0").isNotNull() & F.col("x3").isNotNull())


def catmull_rom(t_at: Column) -> Column:
    """The value at t_at from the columns of a segment; the last key's value behind it."""
    x0, x1, x2, x3 = (F.col(f"x{k}").cast("double") for k in range(4))
    v0, v1, v2, v3 = (F.col(f"v{k}") for k in range(4))
    h = x2 - x1
    t = (t_at - x1) / h
    m1, m2 = (v2 - v0) / (x2 - x0) * h, (v3 - v1) / (x3 - x1) * h
    # values of a few decimals end in ties, which the order of the factors decides; this is that of the SQL
    c2, t2, t3 = 3 * t * t, t * t, t * t * t
    cubic = v1 * (2 * t3 - c2 + 1) + m1 * (t3 - 2 * t2 + t) + v2 * (c2 - 2 * t3) + m2 * (t3 - t2)
    return F.when(x2.isNull(), v1).when(F.col("cubic"), cubic).otherwise(v1 + (v2 - v1) * t)


def spline_decode(stepped: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The samples with decoded; of a frame with one value that value. Columns low and high, if there, are its ends."""
    columns = [c for c in stepped.columns if c not in ("low", "high")]
    if len(columns) == len(stepped.columns):
        ends = stepped.groupBy(*FRAME, *extra).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        stepped = stepped.join(ends, [*FRAME, *extra])
    parts = segments(keys(stepped, extra), extra).select(*FRAME, *extra, "key_no", "cubic", *(f"{c}{k}" for c in "xv" for k in range(4)))
    x = F.col("pos_in_frame")
    number = F.when(x == F.col("frame_len") - 1, F.floor((x + F.col("step") - 1) / F.col("step"))).otherwise(F.floor(x / F.col("step")))
    joined = stepped.withColumn("key_no", number.cast("long")).join(parts, [*FRAME, *extra, "key_no"])
    value = round_clamped(catmull_rom(x.cast("double")), F.col("low"), F.col("high"))
    return joined.select(*columns, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value).alias("decoded"))


def idw_decode(stepped: DataFrame) -> DataFrame:
    """Inverse-distance decoding (power 2) of samples by all keys of their frame, exact at keys; for frames of a few keys.

    The join within a frame makes a row for each sample and key; frame_codecs has the array form for large frames.
    """
    ends = stepped.groupBy(*FRAME).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    keyed = keys(stepped).groupBy(*FRAME).agg(F.collect_list(F.struct("x", "v")).alias("keys"))  # 102 keys for 512 samples
    x = F.col("pos_in_frame").cast("double")

    def add(acc: Column, key: Column) -> Column:
        d = x - key["x"]
        w = F.when(d == 0, 0.0).otherwise(F.try_divide(F.lit(1.0), d * d))
        return F.struct(
            (acc["sum"] + w * key["v"]).alias("sum"), (acc["weight"] + w).alias("weight"), F.coalesce(F.when(d == 0, key["v"]), acc["at"]).alias("at")
        )

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("at"))
    mixed = F.aggregate(F.array_sort("keys"), zero, add, lambda acc: F.coalesce(acc["at"], F.try_divide(acc["sum"], acc["weight"])))
    joined = stepped.join(keyed, FRAME).join(ends, FRAME)
    value = round_clamped(mixed, F.col("low"), F.col("high"))
    return joined.select(*stepped.columns, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(value).alias("decoded"))


def frame_errors(decoded: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """FRAME, extra, error: the mean absolute percentage error."""
    return decoded.groupBy(*FRAME, *extra).agg(F.avg(ape(F.col("value"), F.col("decoded"))).alias("error"))


def keyed_sizes(stepped: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """FRAME, extra, n_keys, payload_bytes of polynomial and IDW frames."""
    depth = frame_stats(stepped.dropDuplicates([*FRAME, "pos_in_frame"]) if extra else stepped).select(*FRAME, "bitdepth", "min", "max")
    counted = keys(stepped, extra).join(depth, FRAME).filter("min < max")
    summed = counted.groupBy(*FRAME, *extra).agg(F.count(F.lit(1)).alias("n_keys"), F.sum(sizes.value(F.col("v"), F.col("bitdepth"))).alias("keys"))
    return summed.select(*FRAME, *extra, "n_keys", sizes.keyed(F.col("n_keys"), F.col("keys")).alias("payload_bytes"))


def ladder(frames: DataFrame) -> DataFrame:
    """frames (FRAME, frame_len) with a row for each rung: rung from 1, points, step; the last rung stores all samples.

    Points grow by a tenth of the samples 17 times, then by a hundredth 5 times.
    """
    n = F.col("frame_len")
    tenth, hundredth = F.greatest(F.floor(n / 10), F.lit(1)), F.greatest(F.floor(n / 100), F.lit(1))
    rungs = frames.withColumn("rung", F.explode(F.sequence(F.lit(1), F.lit(24))))
    up = F.col("rung") - 1
    points = default_points(n) + F.least(up, F.lit(17)) * tenth + F.greatest(up - 17, F.lit(0)) * hundredth
    return rungs.withColumn("points", F.when(F.col("rung") == 24, n).otherwise(points).cast("long")).withColumn("step", step_of(n, F.col("points")))


def fit_ladder(framed: DataFrame, bound: Column) -> DataFrame:
    """The first step of each frame's ladder whose error is within the bound: FRAME, step, error.

    Rungs with equal steps give equal results, so steps are tried once each, largest first; step 1 stores everything and
    has no error.
    """
    frames = framed.groupBy(*FRAME).agg(F.min("frame_len").alias("frame_len"), F.min("value").alias("low"), F.max("value").alias("high"))
    steps = ladder(frames).select(*FRAME, "low", "high", "step").distinct()
    tried = framed.join(steps.filter("step > 1"), FRAME)
    errors = frame_errors(spline_decode(tried, ("step",)), ("step",))
    passed = round_half_away(F.col("error"), 4) <= round_half_away(bound, 3)
    fits = errors.filter(passed & ~F.isnan("error")).unionByName(steps.filter("step = 1").select(*FRAME, "step", F.lit(0.0).alias("error")))
    best = fits.groupBy(*FRAME).agg(F.max(F.struct("step", "error")).alias("best"))
    return best.select(*FRAME, F.col("best.step").alias("step"), F.col("best.error").alias("error"))
