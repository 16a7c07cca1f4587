"""Command line: compress or decompress files, and turn CSV or WAV files into other formats."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.operators import timeindex
from seriesmith.operators.compress import DEFAULT_ERROR, compress, decompress
from seriesmith.operators.frame_codecs import CODECS
from seriesmith.sources import binary, csv, files
from seriesmith.sources.binary import ENDINGS


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="seriesmith", description=__doc__)
    p.add_argument("input", help="a file or a folder of files")
    p.add_argument("-o", "--output", default=".", help="folder of the results")
    p.add_argument("--compressor", choices=CODECS, default="auto")
    p.add_argument("-e", "--error", type=float, default=DEFAULT_ERROR, help="bound in per cent, 0 to 50")
    p.add_argument("-u", "--uncompress", action="store_true")
    p.add_argument("-c", "--compression-selection-sample-level", type=int, default=0, choices=range(7), dest="level")
    p.add_argument("--verbose", action="store_true", help="show samples")
    p.add_argument("--csv", action="store_true", help="the input is CSV")
    p.add_argument("--typed-csv", action="store_true", help="the input is CSV with timestamp (ms) and value; an index is kept")
    p.add_argument("--wav", action="store_true", help="the input is legacy WAV, the output raw samples")
    p.add_argument("--validate", action="store_true", help="with --wav: read the result back and compare")
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--fields", default="time,value", help="with --csv: names of the fields of time and value")
    p.add_argument("--no-compression", action="store_true")
    p.add_argument("--output-index", action="store_true")
    p.add_argument("--output-raw", action="store_true")
    p.add_argument("--output-csv", action="store_true", help="with -u and an index beside the input: write samples with times")
    return p.parse_args(args)


def read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    if a.wav:
        return binary.read_wav(spark, a.input)
    if a.csv:
        if a.no_header:
            return csv.read_without_header(spark, a.input)
        time_field, comma, value_field = a.fields.partition(",")
        if not comma:
            raise SystemExit("--fields needs two names and a comma")
        return csv.read_with_header(spark, a.input, time_field, value_field)
    return binary.read_raw(spark, a.input)


def main(args: list[str] | None = None) -> list[str]:
    a = arguments(args)
    spark = SparkSession.builder.appName("seriesmith").getOrCreate()
    if a.uncompress:
        samples = decompress(binary.read_stream(spark, a.input))
        if a.verbose:
            samples.show()
        out = files.save(binary.raw_files(samples), a.output, ENDINGS["raw"])
        if a.output_csv:
            timed = timeindex.with_times(samples, binary.read_index(spark, f"{a.output}/*.{ENDINGS['index']}"))
            timed = timed.select("series_id", (F.col("ts") * 1000).alias("timestamp"), "value")
            csv.write_typed(timed, f"{a.output}/csv")
        return out
    order, out = None, []
    if a.typed_csv:
        samples = csv.read_typed(spark, a.input)
        order = ["timestamp", "value"]
        if a.output_index:
            points = samples.select("series_id", F.floor(F.col("timestamp") / 1000).alias("ts"))
            out += files.save(binary.index_lines(timeindex.build_index(points)), a.output, ENDINGS["index"], "value")
    else:
        samples = read(spark, a)
    if a.verbose:
        samples.show()
    if a.wav or a.output_raw:
        placed = samples.withColumn("pos", F.col("timestamp")) if a.typed_csv else samples
        written = files.save(binary.raw_files(placed), a.output, ENDINGS["raw"])
        out += written
        if a.wav and a.validate:
            back = binary.read_raw(spark, f"{a.output}/*.{ENDINGS['raw']}")
            if not samples.exceptAll(back).isEmpty():
                raise SystemExit("what was written differs")
    if not (a.wav or a.no_compression):
        out += files.save(binary.stream_files(compress(samples, order, a.compressor, a.error, a.level)), a.output, ENDINGS["stream"])
    return out


if __name__ == "__main__":
    print(*main(), sep="\n")
