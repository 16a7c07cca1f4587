"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import string
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Size of a table's files up to which it may be broadcast.
BROADCAST_BYTES = 16 << 20

#: Settings of the writes in a pipeline's stage: Spark deletes a write's shuffle files when it ends, not when the driver
#: collects its garbage, and sends so many rows at once to Python.
STAGE_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

#: For writes that send texts to Python, outside stages too: so many rows at once, not Spark's 10,000.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

#: Scratch paths, those of a pipeline's stage apart.
_written: list[tuple[SparkSession, str]] = []
_last_stage: list[tuple[SparkSession, str]] = []
_stage: list[tuple[SparkSession, str]] | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def without(columns: list[str], made: Iterable[str]) -> list[str]:
    """The columns whose names, in any case, aren't among those made."""
    taken = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in taken]


def boxed(columns: list[str]) -> list[Column]:
    """The columns as one struct, whose names can't clash with those of work columns beside it; none if there are none."""
    return [F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_box")] if columns else []


def unboxed(columns: list[str]) -> list[Column]:
    return [F.col("_box")[c].alias(c) for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary
    one; on a cluster it is an error, as each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seriesmith-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; it is deleted when the stage's successor starts, or when Python ends."""
    path = f"{shared_dir(spark)}/seriesmith/{tag}-{uuid.uuid4().hex}"
    (_written if _stage is None else _stage).append((spark, path))
    return path


@contextlib.contextmanager
def stage_scratch() -> Iterator[None]:
    """Scratch tables made inside belong to a pipeline's stage. Those of the stage before are deleted on entry: its output has
    been written and is what this stage reads."""
    global _stage
    _delete(_last_stage)
    _stage = _last_stage
    try:
        yield
    finally:
        _stage = None


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialize(df: DataFrame, tag: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Writes df to the shared folder, under these settings, and reads it back.

    That cuts the lineage, survives the loss of any executor, and lets the planner see the table's true size, so that
    it broadcasts the table only below spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with _settings(spark, (settings or {}) | ({} if _stage is None else STAGE_SETTINGS)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from materialize(), or of unions of such, that nothing reads any more."""
    names = {f.split("/")[-2] for table in tables for f in table.inputFiles()}
    for kept in _written, _last_stage:
        gone = [x for x in kept if x[1].rsplit("/", 1)[1] in names]
        kept[:] = [x for x in kept if x not in gone]
        _delete(gone)


def in_slices(made: Callable[..., pa.Array], *columns: pa.Array, rows: int = 1000) -> pa.Array:
    """What made() gives for the columns, so many rows at a time, so that few are Python objects at once."""
    return pa.concat_arrays([made(*(c.slice(k, rows) for c in columns)) for k in range(0, max(len(columns[0]), 1), rows)])


def table_bytes(table: DataFrame) -> int:
    """The planner's estimate of a table's size: of one from materialize(), its files' size."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_small(large: DataFrame, small: DataFrame, on: Column, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins a table of texts with one from materialize(). Up to the limit of bytes the latter is broadcast, so that texts stay
    in place; beyond, both are dealt by key and sorted, with the same rows."""
    return large.join(F.broadcast(small) if table_bytes(small) <= limit else small.hint("merge"), on, how)


def _delete(paths: list[tuple[SparkSession, str]]) -> None:
    while paths:
        spark, path = paths.pop()
        with contextlib.suppress(Exception):  # the session may have ended; the folder is the cluster's to clean
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(lambda: (_delete(_last_stage), _delete(_written)))
