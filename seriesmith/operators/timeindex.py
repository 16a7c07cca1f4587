"""The time index: segments (m, x0, y0, n) in which sample x0 + i was taken at second y0 + m * i.

A segment starts with one point; the next gives its step m; more points belong to it while the whole number of steps from
its start is the number of points so far, so that lateness below a step is snapped. Points that are earlier than one before
are rejected. Times are seconds since the epoch, so days don't end a series.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmith.operators.series import clean

SEGMENT = "array<struct<m:bigint,x0:bigint,y0:bigint,n:bigint>>"
SEGMENTS = "series_id string, seg_no long, m long, x0 long, y0 long, n long"


def resume(state: tuple[int, int, int, int] | None, times: Iterable[int]) -> Iterator[tuple[int, int, int, int]]:
    """(m, x0, y0, n) of ordered times that go on from an open segment, if there is one; the last it yields is open again. A
    repeated first time opens a segment of its own, so no sample is lost."""
    m, x0, y0, n = state or (0, 0, 0, 0)
    for y in times:
        if n == 0:
            m, y0, n = 0, y, 1
        elif n == 1 and y > y0:
            m, n = y - y0, 2
        elif n > 1 and (y - y0) // m == n:
            n += 1
        else:
            yield m, x0, y0, n
            m, x0, y0, n = 0, x0 + n, y, 1
    if n:
        yield m, x0, y0, n


def fold(times: Iterable[int]) -> Iterator[tuple[int, int, int, int]]:
    """(m, x0, y0, n) of ordered times."""
    return resume(None, times)


def build_index(points: DataFrame, key: str = "series_id", ts: str = "ts", value: str | None = None) -> DataFrame:
    """SEGMENTS of each series of points (key, ts: seconds), which are streamed in order; a task holds one batch. With the
    column of values, only points with a finite one count, as in compress(), so that its samples keep their times."""
    if value:
        points = clean(points, value)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: str | None = None
        held: list[int] = []
        state: tuple[int, int, int, int] | None = None
        number = 0

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            names = ["series_id", "seg_no", "m", "x0", "y0", "n"]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        def closed(final: bool) -> list[tuple]:
            """Segments of the points held, after the state; the last stays as the state unless it is final."""
            nonlocal state, number
            out = []
            for segment in resume(state, held):
                if state is not None and segment[1] != state[1]:
                    out.append((current, number, *state))
                    number += 1
                state = segment
            held.clear()
            if final and state is not None:
                out.append((current, number, *state))
                state, number = None, 0
            return out

        for batch in batches:
            rows = []
            for name, y in zip(batch.column("k").to_pylist(), batch.column("y").to_pylist(), strict=True):
                if name != current:
                    rows += closed(True)
                    current = name
                held.append(y)
            rows += closed(False)
            if rows:
                yield made(rows)
        if last := closed(True):
            yield made(last)

    typed = points.select(F.col(key).cast("string").alias("k"), F.col(ts).cast("long").alias("y")).filter("y IS NOT NULL")
    return typed.repartition("k").sortWithinPartitions("k", "y").mapInArrow(segments, SEGMENTS)


def build_index_native(points: DataFrame, key: str = "series_id", ts: str = "ts") -> DataFrame:
    """build_index() by a fold over each series' sorted array: for series of a few thousand points."""
    sorted_times = points.filter(F.col(ts).isNotNull()).groupBy(F.col(key).cast("string").alias("series_id")).agg(F.array_sort(F.collect_list(F.col(ts).cast("long"))).alias("y"))
    one = lambda m, x0, y0, n: F.struct(m.alias("m"), x0.alias("x0"), y0.alias("y0"), n.alias("n"))
    zero = F.lit(0).cast("long")

    def add(done: Column, y: Column) -> Column:
        last = F.element_at(done, -1)
        before = F.slice(done, 1, F.size(done) - 1)
        second = (last["n"] == 1) & (y > last["y0"])
        steps = F.floor(F.try_divide(y - last["y0"], last["m"]))
        fits = F.coalesce((last["n"] > 1) & (steps == last["n"]), F.lit(False))
        grown = one(F.when(second, y - last["y0"]).otherwise(last["m"]), last["x0"], last["y0"], last["n"] + 1)
        fresh = one(zero, last["x0"] + last["n"], y, zero + 1)
        return F.when(F.size(done) == 0, F.array(one(zero, zero, y, zero + 1))).when(second | fits, F.concat(before, F.array(grown))).otherwise(F.concat(done, F.array(fresh)))

    built = sorted_times.select("series_id", F.aggregate("y", F.array().cast(SEGMENT), add).alias("s"))
    return built.select("series_id", F.posexplode("s").alias("seg_no", "seg")).select("series_id", F.col("seg_no").cast("long").alias("seg_no"), "seg.*")


def reject_late(points: DataFrame, arrival: list[str], key: str = "series_id", ts: str = "ts") -> DataFrame:
    """points with rejected: whether an earlier arrival of the series had a later time."""
    before = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("rejected", F.coalesce(F.col(ts) < F.max(ts).over(before), F.lit(False)))


def end_of(m: str = "m", y0: str = "y0", n: str = "n") -> Column:
    """The time of a segment's last sample."""
    return F.col(y0) + F.col(m) * (F.col(n) - 1)


def bounds(segments: DataFrame) -> DataFrame:
    """series_id, min_ts, max_ts, samples."""
    return segments.groupBy("series_id").agg(F.min("y0").alias("min_ts"), F.max(end_of()).alias("max_ts"), F.sum("n").alias("samples"))


def _ranged(probes: DataFrame, segments: DataFrame, on: str, low: Column, high: Column, span: int | None) -> DataFrame:
    """Probes left-joined with the segment that holds them; of several the first. With a span, segments are dealt to the
    cells of that width that they touch, which turns the range join into an equi-join for large indexes."""
    s = segments.withColumns({"_low": low, "_high": high}).withColumnRenamed("series_id", "_series")
    p = probes.withColumn("_probe", F.col(on))
    match = (F.col("series_id") == F.col("_series")) & F.col("_probe").between(F.col("_low"), F.col("_high"))
    if span:
        cells = F.sequence(F.floor(F.col("_low") / span), F.floor(F.col("_high") / span))
        s = s.withColumn("_cell", F.explode(cells))
        p = p.withColumn("_at", F.floor(F.col("_probe") / span))
        match = match & (F.col("_at") == F.col("_cell"))
    return p.join(s, match, "left").drop("_series", "_low", "_high", "_cell", "_at", "_probe")


def sample_at(probes: DataFrame, segments: DataFrame, span: int | None = None) -> DataFrame:
    """probes (series_id, y) with x: the sample whose step holds second y, else null; of samples at one time the first."""
    ended = F.lag(end_of()).over(Window.partitionBy("series_id").orderBy("x0"))
    apart = segments.withColumn("_free", F.greatest(F.col("y0"), F.coalesce(ended + 1, F.col("y0")))).filter(F.col("_free") <= end_of())
    found = _ranged(probes, apart, "y", F.col("_free"), end_of(), span)
    step = F.greatest(F.col("m"), F.lit(1))
    return found.select(*probes.columns, (F.col("x0") + F.floor((F.col("y") - F.col("y0")) / step)).cast("long").alias("x"))


def time_at(probes: DataFrame, segments: DataFrame, span: int | None = None) -> DataFrame:
    """probes (series_id, x) with y: the time of sample x, else null."""
    found = _ranged(probes, segments, "x", F.col("x0"), F.col("x0") + F.col("n") - 1, span)
    return found.select(*probes.columns, (F.col("y0") + F.col("m") * (F.col("x") - F.col("x0"))).alias("y"))


def _as_of(probes: DataFrame, segments: DataFrame, forward: bool) -> DataFrame:
    """probes with next_x (the first sample of the next segment) or previous_x (the last one of the segment before).

    Probes and segments are merged in the order of time, so it takes one shuffle by series and no pairs.
    """
    p = probes.select("series_id", F.col("y").alias("_t"), F.lit(True).alias("_probe"), F.lit(None).cast("long").alias("_x"))
    at, x = (F.col("y0"), F.col("x0")) if forward else (end_of(), F.col("x0") + F.col("n") - 1)
    s = segments.select("series_id", at.alias("_t"), F.lit(False).alias("_probe"), x.alias("_x"))
    merged = p.unionByName(s)
    # frames that grow from the first row on are kept up, while those that reach to the last are computed anew for each row
    w = Window.partitionBy("series_id").orderBy(F.col("_t").desc() if forward else F.col("_t")).rangeBetween(Window.unboundedPreceding, 0)
    found = (F.min("_x") if forward else F.max("_x")).over(w)
    return merged.withColumn("found", found).filter("_probe").select("series_id", F.col("_t").alias("y"), "found")


def this_or_next(probes: DataFrame, segments: DataFrame, span: int | None = None) -> DataFrame:
    """probes (series_id, y), once each, with x: that of the second, else the first sample after it."""
    probes = probes.select("series_id", "y").distinct()
    after = _as_of(probes, segments, True)
    return sample_at(probes, segments, span).join(after, ["series_id", "y"]).select("series_id", "y", F.coalesce("x", "found").alias("x"))


def this_or_previous(probes: DataFrame, segments: DataFrame, span: int | None = None) -> DataFrame:
    """probes, once each, with x: that of the second, else the last sample before it; at or after the end the number of
    samples."""
    probes = probes.select("series_id", "y").distinct()
    before = _as_of(probes, segments, False)
    found = sample_at(probes, segments, span).join(before, ["series_id", "y"]).join(bounds(segments), "series_id", "left")
    inside = F.coalesce("x", "found")
    return found.select("series_id", "y", F.when((F.col("y") >= F.col("max_ts")) & F.col("x").isNull(), F.col("samples")).otherwise(inside).alias("x"))


def all_times(segments: DataFrame) -> DataFrame:
    """(series_id, x, y) of all samples."""
    each = segments.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("series_id", (F.col("x0") + F.col("i")).alias("x"), (F.col("y0") + F.col("m") * F.col("i")).alias("y"))


def gaps(segments: DataFrame) -> DataFrame:
    """(series_id, after, before): the open intervals between segments that hold no sample."""
    following = F.lead("y0").over(Window.partitionBy("series_id").orderBy("x0"))
    ended = segments.select("series_id", end_of().alias("after"), following.alias("before"))
    return ended.filter("before > after + 1")


def is_empty(ranges: DataFrame, segments: DataFrame, span: int = 86400) -> DataFrame:
    """ranges (series_id, a, b), once each, with is_empty: whether [a, b] touches no segment; ends of segments belong to them,
    and so do both ends of the range. Ranges and segments are dealt to the cells of span seconds that they touch, which makes
    it one equi-join."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / span), F.floor(high / span)))
    s = segments.select(F.col("series_id").alias("_series"), F.col("y0").alias("_low"), end_of().alias("_high"))
    s = s.withColumn("_cell", cells(F.col("_low"), F.col("_high")))
    r = ranges.select("series_id", "a", "b").distinct().withColumn("_at", cells(F.col("a"), F.col("b")))
    touch = (F.col("series_id") == F.col("_series")) & (F.col("_at") == F.col("_cell")) & (F.col("a") <= F.col("_high")) & (F.col("b") >= F.col("_low"))
    return r.join(s, touch, "left").groupBy("series_id", "a", "b").agg((F.count("_series") == 0).alias("is_empty"))


def with_times(samples: DataFrame, segments: DataFrame, span: int = 1 << 16) -> DataFrame:
    """samples (series_id, pos, value) with ts, from the index of the samples that were kept: build_index() with value."""
    timed = time_at(samples.withColumnRenamed("pos", "x"), segments, span)
    return timed.withColumnsRenamed({"x": "pos", "y": "ts"})
