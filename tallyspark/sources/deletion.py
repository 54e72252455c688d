"""Deletion of files as a repeatable job with a journal.

What is to go is written down first, then tasks delete it, then the outcome is written down. A file is named by path and time of change: one that has been
replaced since is another file and stays. Tasks can be lost and repeated at any point, since a file that is gone already counts as done; a run that
died after its plan is finished by the next one; what the journal says is done isn't planned again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import storage

_PLAN = "path string, modified timestamp"
_DONE = f"{_PLAN}, outcome string"
SLACK_US = 1000  # stores tell times of change to the millisecond at least


def _file(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(f"file:///{path.removeprefix('file:').lstrip('/')}" if path.startswith(("/", "file:")) else path)


def _remove(path: str, changed_us: int) -> str:
    """deleted, gone (it wasn't there) or kept (it has changed since)."""
    system, at = _file(path)
    info = system.get_file_info(at)
    if info.type != arrow_fs.FileType.File:
        return "gone"
    if abs(info.mtime_ns // 1000 - changed_us) > SLACK_US:
        return "kept"
    try:
        system.delete_file(at)
    except FileNotFoundError:  # another attempt at this task was faster
        return "gone"
    return "deleted"


def _outcomes(planned: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "us": b["us"], "outcome": [_remove(p, int(u)) for p, u in zip(b["path"], b["us"], strict=True)]})

    timed = planned.select("path", F.unix_micros("modified").alias("us"))
    return timed.mapInPandas(run, "path string, us long, outcome string").select("path", F.timestamp_micros("us").alias("modified"), "outcome")


def _journal(spark: SparkSession, journal: str, kind: str) -> DataFrame:
    path = f"{journal}/{kind}"
    schema = _DONE if kind == "done" else _PLAN
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], schema)


def delete(files: DataFrame, journal: str) -> DataFrame:
    """Delete ``files`` (path, modified), and what an earlier run had planned but not done; (path, modified, outcome) of this run.

    ``journal`` is a folder that all executors share.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    done = _journal(spark, journal, "done").select("path", "modified")
    wanted = files.select("path", F.col("modified").cast("timestamp").alias("modified")).unionByName(_journal(spark, journal, "planned")).distinct()
    planned = wanted.join(done, ["path", "modified"], "left_anti")
    planned.write.parquet(f"{journal}/planned/{run}")
    _outcomes(spark.read.schema(_PLAN).parquet(f"{journal}/planned/{run}")).write.parquet(f"{journal}/done/{run}")
    return spark.read.schema(_DONE).parquet(f"{journal}/done/{run}")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def prune_folders(deleted: DataFrame, root: str, levels: int = 3) -> int:
    """Remove folders below ``root``, which is mounted, that have become empty, from the inside out; the number removed. A folder with anything in it stays."""
    top = root.removeprefix("file:").rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = []
            for path in b["folder"]:
                try:
                    os.rmdir(path)  # fails if it isn't empty
                    gone.append(path)
                except OSError:
                    pass
            yield pd.DataFrame({"folder": gone}, dtype=object)

    folders = deleted.select(_parent(F.regexp_replace("path", "^file:/+", "/")).alias("folder")).distinct()
    n = 0
    for _ in range(levels):
        inside = folders.where(F.startswith("folder", F.lit(f"{top}/")))
        n += inside.repartition("folder").mapInPandas(run, "folder string").count()
        folders = inside.select(_parent(F.col("folder")).alias("folder")).distinct()
    return n
