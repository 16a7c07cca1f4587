"""Relations: framing, statistics, metrics, compression, sources, index and stream."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmith.functions import metrics, scalar
from seriesmith.operators import compress as engine
from seriesmith.operators import interpolation, runs, series, timeindex
from seriesmith.sources import binary, csv, files
from seriesmith.streaming import timeindex as stream


def samples(spark, values, name="a"):
    return spark.createDataFrame([(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, pos long, value double")


def greedy(n):
    out = []
    while n:
        size = 131072 if n >= 131072 else n if n <= 512 else 1 << (n.bit_length() - 1)
        out.append(size)
        n -= size
    return out


@pytest.mark.parametrize("n", [1, 31, 511, 512, 513, 600, 1024, 2048, 12032, 131071, 131072, 131073, 394981])
def test_frames(spark, n):
    number, start, size = series.frame_columns(F.col("id"), F.lit(n).cast("long"))
    rows = spark.range(n).select(number.alias("f"), start.alias("s"), size.alias("l")).groupBy("f", "s", "l").count().orderBy("f").collect()
    assert [r["count"] for r in rows] == [r["l"] for r in rows] == greedy(n)
    assert [r["f"] for r in rows] == list(range(len(rows)))
    assert [r["s"] for r in rows] == [sum(greedy(n)[:k]) for k in range(len(rows))]


def test_positions_by_bucket(spark):
    rows = spark.range(1000).select(F.lit("a").alias("series_id"), ((F.col("id") * 7919) % 1009).alias("t"))
    plain = series.with_positions(rows, ["t"])
    dealt = series.with_positions(rows, ["t"], bucket=F.floor(F.col("t") / 100))
    assert plain.exceptAll(dealt).isEmpty() and dealt.count() == 1000


def test_clean(spark):
    assert [r.value for r in series.clean(samples(spark, [1, float("nan"), None, float("inf"), -float("inf"), 2])).collect()] == [1, 2]


@pytest.mark.parametrize(("values", "depth", "mean"), [([1, 4, 7], "U8", 4), ([1.5, 4.5, 9], "F64", 5), ([-1, 300, 1], "I16", 100), ([2**31, 0, 0], "F64", 2**31 / 3), ([70000, 1], "I32", 35000.5)])
def test_stats(spark, values, depth, mean):
    r = series.frame_stats(series.with_frames(samples(spark, values))).first()
    assert r["bitdepth"] == depth and r["mean"] == pytest.approx(mean) and r["min"] == min(values) and r["max_loc"] == values.index(max(values))


def test_metrics(spark):
    rows = spark.createDataFrame([(float(i), b) for i, b in enumerate((2.5, 4.0, 6.0, 8.0, 10.0), 1)], "a double, b double")
    got = rows.agg(*(f(F.col("a"), F.col("b")).alias(k) for k, f in metrics.METRICS.items())).first()
    assert got["mse"] == pytest.approx(11.25) and got["nmse"] == pytest.approx(1.0227272727) and got["mae"] == pytest.approx(3.1) and got["mape"] == pytest.approx(1.1)
    zeros = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "a double, b double")
    assert zeros.agg(metrics.mape(F.col("a"), F.col("b"))).first()[0] == math.inf
    assert math.isnan(spark.createDataFrame([(0.0, 0.0)], "a double, b double").agg(metrics.mape(F.col("a"), F.col("b"))).first()[0])
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([(1.0, None)], "a double, b double").agg(metrics.error_of("mae", F.col("a"), F.col("b"))).collect()


def test_scalars(spark):
    rows = spark.createDataFrame([(128,), (512,), (2048,), (131072,)], "n long")
    got = rows.select(scalar.next_size(F.col("n")).alias("s"), scalar.prev_power_of_two(F.col("n") + 1).alias("p"), scalar.is_decomposable(F.col("n")).alias("d")).collect()
    assert [r["s"] for r in got] == [144, 576, 2187, 139968] and [r["p"] for r in got] == [128, 512, 2048, 131072] and all(r["d"] for r in got)


def test_rounding_of_large_numbers(spark):
    """Infinite and large numbers stay what they are; as whole numbers they are stored as the last long."""
    x = [0.0000149, -0.0000151, 2.0**52 + 1, 1e20, -1e20, math.inf, -math.inf]
    got = [r[0] for r in samples(spark, x).orderBy("pos").select(scalar.round_half_away(F.col("value"), 5)).collect()]
    assert got == pytest.approx([0.00001, -0.00002, *x[2:]], rel=1e-15)
    assert math.isnan(samples(spark, [math.nan]).select(scalar.round_half_away(F.col("value"), 5)).first()[0])
    assert [r["stored"] for r in runs.noop_encode(samples(spark, x[2:5])).orderBy("pos").collect()] == [2**52 + 2, 2**63 - 1, -(2**63)]


def test_runs_round_trip(spark):
    framed = series.with_frames(samples(spark, [1, 1, 2, 2, 1, 0.0, -0.0, 5]))
    counts = framed.groupBy("series_id", "frame_no").agg(F.count("*").alias("sample_count"))
    back = runs.rle_decode(runs.rle_encode(framed), counts).orderBy("pos_in_frame")
    assert [r["decoded"] for r in back.collect()] == [1, 1, 2, 2, 1, 0, 0, 5]


def test_spline_equals_array_form(spark):
    from seriesmith.operators import frame_codecs

    x = np.round(50 + 20 * np.sin(np.arange(700) / 9), 3)
    rows = interpolation.spline_decode(interpolation.with_step(series.with_frames(samples(spark, x)))).orderBy("pos").collect()
    expected = np.concatenate([frame_codecs.decode(frame_codecs.keyed_encode(part, "polynomial")[0], "polynomial", len(part)) for part in (x[:512], x[512:])])
    np.testing.assert_allclose([r["decoded"] for r in rows], expected, atol=1.1e-5)


@pytest.mark.parametrize("codec", ["auto", "noop", "constant", "rle", "fft", "polynomial", "idw"])
def test_compress_round_trip(spark, codec):
    x = np.round(100 + 30 * np.sin(np.arange(1500) / 50)) if codec in ("noop", "rle") else np.full(300, 2.5) if codec == "constant" else 100 + 30 * np.sin(np.arange(1500) / 50)
    frames = engine.compress(samples(spark, x), codec=codec, error=3)
    back = [r["value"] for r in engine.decompress(frames).orderBy("pos").collect()]
    assert len(back) == len(x)
    if codec in ("noop", "rle", "constant"):
        np.testing.assert_array_equal(back, x)
    else:
        assert np.mean(np.abs(back - x) / x) <= 0.031
    ratio = engine.compression_ratio(frames).first()
    assert ratio["samples"] == len(x) and ratio["ratio"] > 1


def test_compress_checks_and_levels(spark):
    rows = samples(spark, np.arange(1, 700))
    for bad in ({"codec": "zip"}, {"error": 51}, {"level": 7}):
        with pytest.raises(ValueError):
            engine.compress(rows, **bad)
    for level in range(7):
        assert engine.decompress(engine.compress(rows, level=level)).count() == 699
    assert engine.compress(rows.limit(0)).count() == 0


def test_stream_bytes_and_files(spark, tmp_path):
    golden = [66, 82, 82, 79, 1, 0, 0, 0, 1, 1, 41, 251, 0, 4, 3, 3, 30, 3, 1]
    frames = engine.compress(samples(spark, [1.0] * 1024), codec="constant")
    content = binary.stream_files(frames).first()["content"]
    assert list(content) == golden
    with pytest.raises(binary.FormatError):
        binary.stream_frames(content[:4] + b"\x02\0\0\0" + content[8:])
    (tmp_path / "other.bro").write_bytes(b"something")
    files.save(binary.stream_files(frames), str(tmp_path), "bro")
    assert engine.decompress(binary.read_stream(spark, str(tmp_path))).count() == 1024


def test_raw_samples(spark, tmp_path):
    assert list(binary.raw_bytes(np.ones(1)))[12:] == [0, 0, 0, 0, 0, 0, 240, 63, 248, 255, 255, 255, 1, 0, 0, 0, 248, 255, 255, 255, 1, 0, 0, 0, 1, 0, 0, 0, 5, 0, 0, 0]
    x = np.random.default_rng(1).normal(size=5000)
    np.testing.assert_array_equal(binary.raw_values(binary.raw_bytes(x)), x)
    rows = samples(spark, x, "w")
    files.save(binary.raw_files(rows), str(tmp_path), "wbro")
    assert binary.read_raw(spark, str(tmp_path)).exceptAll(rows).isEmpty()
    assert series.from_blocks(series.blocks(rows)).exceptAll(rows).isEmpty()
    with pytest.raises(binary.FormatError):
        binary.raw_values(b"nothing here")


def test_wav(spark, tmp_path):
    x = np.array([1.5, np.nan, np.inf, -2.0])
    (tmp_path / "m.wav").write_bytes(binary.wav_bytes(x))
    assert [r["value"] for r in binary.read_wav(spark, str(tmp_path)).orderBy("pos").collect()] == [1.5, np.inf, -2.0]


def test_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text("time,value\n1,1.5\n2,2.5\n")
    (tmp_path / "n.txt").write_text("1.5\n2.5\n")
    got = csv.read_with_header(spark, str(tmp_path / "h.csv")).orderBy("pos").collect()
    assert [(r["series_id"], r["value"]) for r in got] == [("h", 1.5), ("h", 2.5)]
    assert [r["value"] for r in csv.read_without_header(spark, str(tmp_path / "n.txt")).orderBy("pos").collect()] == [1.5, 2.5]
    with pytest.raises(csv.TimestampFieldNotFound):
        csv.read_with_header(spark, str(tmp_path / "h.csv"), "when")
    with pytest.raises(csv.ValueFieldNotFound):
        csv.read_with_header(spark, str(tmp_path / "h.csv"), "time", "what")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        csv.read_without_header(spark, str(tmp_path / "h.csv")).collect()
    typed = spark.createDataFrame([("s", 1, 1.01), ("s", 5, 1.22)], "series_id string, timestamp long, value double")
    csv.write_typed(typed, str(tmp_path / "out"))
    back = csv.read_typed(spark, str(tmp_path / "out/series_id=s")).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["value"]) for r in back] == [(1, 1.01), (5, 1.22)]


TIMES = [0, 10, 29, 30, 31, 100, 100, 160, 220, 281, 500]


def test_index(spark):
    rows = spark.createDataFrame([("a", t) for t in TIMES] + [("b", 7)], "series_id string, ts long")
    expected = [("a", k, *s) for k, s in enumerate(timeindex.fold(TIMES))] + [("b", 0, 0, 0, 7, 1)]
    for build in (timeindex.build_index, timeindex.build_index_native):
        got = sorted(tuple(r) for r in build(rows).select("series_id", "seg_no", "m", "x0", "y0", "n").collect())
        assert got == expected
    assert sum(s[-1] for s in expected) == len(TIMES) + 1
    assert expected[0] == ("a", 0, 10, 0, 0, 4)  # 29 and 30 are within a step of their places


def test_index_by_batches(spark):
    rows = spark.range(5000).select(F.lit("a").alias("series_id"), (F.col("id") * 5 + F.when(F.col("id") % 700 == 0, 3).otherwise(0)).alias("ts"))
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(r)[2:] for r in timeindex.build_index(rows).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    times = sorted(r["ts"] for r in rows.collect())
    assert got == sorted(timeindex.fold(times))


def test_lookups(spark):
    segs = timeindex.build_index(spark.createDataFrame([("a", t) for t in (0, 10, 20, 50, 60, 70, 200)], "series_id string, ts long"))
    probe = spark.createDataFrame([("a", y) for y in (-5, 0, 15, 30, 50, 70, 100, 200, 300)], "series_id string, y long")
    at = {r["y"]: r["x"] for r in timeindex.sample_at(probe, segs).collect()}
    assert at == {-5: None, 0: 0, 15: 1, 30: None, 50: 3, 70: 5, 100: None, 200: 6, 300: None}
    assert at == {r["y"]: r["x"] for r in timeindex.sample_at(probe, segs, span=30).collect()}
    assert {r["y"]: r["x"] for r in timeindex.this_or_next(probe, segs).collect()} == {-5: 0, 0: 0, 15: 1, 30: 3, 50: 3, 70: 5, 100: 6, 200: 6, 300: None}
    assert {r["y"]: r["x"] for r in timeindex.this_or_previous(probe, segs).collect()} == {-5: None, 0: 0, 15: 1, 30: 2, 50: 3, 70: 5, 100: 5, 200: 6, 300: 7}
    x = spark.createDataFrame([("a", k) for k in range(8)], "series_id string, x long")
    assert [r["y"] for r in timeindex.time_at(x, segs).orderBy("x").collect()] == [0, 10, 20, 50, 60, 70, 200, None]
    ranges = spark.createDataFrame([("a", 21, 49), ("a", 20, 30), ("a", -9, 999), ("a", 201, 900), ("a", 12, 14)], "series_id string, a long, b long")
    assert {(r["a"], r["b"]): r["is_empty"] for r in timeindex.is_empty(ranges, segs).collect()} == {(21, 49): True, (20, 30): False, (-9, 999): False, (201, 900): True, (12, 14): False}
    assert sorted((r["after"], r["before"]) for r in timeindex.gaps(segs).collect()) == [(20, 50), (70, 200)]


def test_index_text(spark, tmp_path):
    segs = spark.createDataFrame([("a", 0, 15, 0, 55745, 166), ("a", 1, 15, 166, 58505, 63)], "series_id string, seg_no long, m long, x0 long, y0 long, n long")
    files.save(timeindex_lines := binary.index_lines(segs), str(tmp_path), "vsri", "value")
    assert timeindex_lines.first()["value"] == "55745\n59435\n15,0,55745,166\n15,166,58505,63"
    assert binary.read_index(spark, str(tmp_path)).exceptAll(segs).isEmpty()


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    for k, part in enumerate([[0, 10, 20], [30, 100], [50, 110, 300]]):
        spark.createDataFrame([("a", t) for t in part], "series_id string, ts long").coalesce(1).write.mode("append").parquet(str(source / f"k={k}"))
    points = spark.readStream.schema("series_id string, ts long").option("maxFilesPerTrigger", 1).parquet(str(source) + "/k=*")
    q = stream.segment_stream(points).writeStream.format("memory").queryName("segments").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        deadline = time.time() + 120
        while time.time() < deadline and q.isActive and (not q.lastProgress or q.lastProgress["batchId"] < 2):
            time.sleep(0.3)
    finally:
        q.stop()
    rows = spark.table("segments").collect()
    late = [r["rejected_ts"] for r in rows if r["kind"] == "late"]
    closed = {(r["m"], r["x0"], r["y0"], r["n"]) for r in rows if r["kind"] == "segment"}
    accepted = [0, 10, 20, 30, 100, 110, 300]
    assert late == [50] and closed == set(list(timeindex.fold(accepted))[:-1])


def test_command_line(spark, tmp_path):
    from seriesmith.__main__ import main

    lines = "".join(f"{1700000000000 + 15000 * k},{100 + k % 7}\n" for k in range(600))
    (tmp_path / "m.csv").write_text("timestamp,value\n" + lines)
    out = tmp_path / "out"
    made = main([str(tmp_path / "m.csv"), "--typed-csv", "--output-index", "-e", "1", "-o", str(out)])
    assert {p.rpartition(".")[2] for p in made} == {"vsri", "bro"}
    main([str(out / "m.bro"), "-u", "--output-csv", "-o", str(out)])
    x = binary.raw_values((out / "m.wbro").read_bytes())
    assert np.abs(x / np.array([100 + k % 7 for k in range(600)]) - 1).mean() <= 0.011
    back = csv.read_typed(spark, str(out / "csv/series_id=m")).orderBy("timestamp").collect()
    assert len(back) == 600 and back[1]["timestamp"] == 1700000015000
    with pytest.raises(SystemExit):
        main([str(tmp_path / "m.csv"), "--csv", "--fields", "value"])
