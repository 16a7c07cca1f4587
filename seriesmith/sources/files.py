"""Single files for tools that expect one: content columns written by the driver, one series at a time, so not for large ones;
and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir; a machine's own folder serves only a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="seriesmith-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/seriesmith/{tag}-{uuid.uuid4().hex}"


def save(files: DataFrame, folder: str, ending: str, column: str = "content") -> list[str]:
    """Writes each row's content to folder/series_id.ending on the driver's disk; rows come one by one."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for row in files.select("series_id", column).toLocalIterator():
        path = Path(folder, f"{row['series_id']}.{ending}")
        data = row[column]
        path.write_bytes(data.encode() if isinstance(data, str) else bytes(data))
        out.append(str(path))
    return sorted(out)
