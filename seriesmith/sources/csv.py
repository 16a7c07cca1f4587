"""CSV sources and sink of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FieldNotFound(ValueError):
    """The header lacks a field that was asked for."""


class TimestampFieldNotFound(FieldNotFound):
    pass


class ValueFieldNotFound(FieldNotFound):
    pass


def _value(name: str) -> Column:
    """The column as a number; a missing or empty value fails the query, as one that is no number does."""
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.raise_error(F.lit(f"a line has no {name}")).cast("double"))


def _with_series(df: DataFrame) -> DataFrame:
    """Each file is a series; its lines are ranked by their place in the file."""
    return df.withColumn("series_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))


def read_with_header(spark: SparkSession, path: str, time_field: str = "time", value_field: str = "value", keep_time: bool = False) -> DataFrame:
    """(series_id, pos, value, and time if kept) of files with a header that has both fields. A value that is missing or
    no number, or a line with too many or too few fields, fails the query. Positions follow the order of lines, which holds for files that are read as one split or whose splits are
    read in order."""
    lines = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if time_field not in lines.columns:
        raise TimestampFieldNotFound(time_field)
    if value_field not in lines.columns:
        raise ValueFieldNotFound(value_field)
    columns = [F.monotonically_increasing_id().alias("pos"), _value(value_field).alias("value"), *([F.col(f"`{time_field}`").alias("time")] if keep_time else [])]
    return _with_series(lines).select("series_id", *columns)


def read_without_header(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, pos, value): the first column of files without a header."""
    lines = spark.read.option("header", False).option("mode", "FAILFAST").csv(path)
    return _with_series(lines).select("series_id", F.monotonically_increasing_id().alias("pos"), _value("_c0").alias("value"))


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, timestamp in milliseconds, value) of files with the header timestamp,value."""
    lines = spark.read.schema("timestamp long, value double").option("header", True).option("mode", "FAILFAST").csv(path)
    return _with_series(lines).select("series_id", "timestamp", "value")


def write_typed(samples: DataFrame, path: str) -> None:
    """Files with the header timestamp,value, a folder for each series, its samples in the order of time."""
    parts = samples.select("series_id", "timestamp", "value").repartition("series_id").sortWithinPartitions("series_id", "timestamp")
    parts.write.partitionBy("series_id").option("header", True).csv(path)
