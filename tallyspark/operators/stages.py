"""A run as stages: each is written once, under a name that its inputs decide, so that a run resumes where it stopped."""

from __future__ import annotations

import hashlib
import importlib.util
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallyspark
from tallyspark.sources import storage

_MAKERS = tuple(f"tallyspark.{x}" for x in ("functions", "operators", "sources"))

#: Called with a stage's name and its table once that is written; raising an error ends the run before the next stage.
Hook = Callable[[str, DataFrame], None]


@dataclass
class Stage:
    """A table and the digest of all that it comes from."""

    table: DataFrame
    digest: str


def fingerprint(table: DataFrame, columns: list[str]) -> str:
    """A digest of the rows of ``table``, whatever their order: counts and sums of two hashes of each row."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashes = F.sum(F.xxhash64(text).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), text).cast("decimal(38,0)"))
    return hashlib.sha256(str(tuple(table.agg(F.count(F.lit(1)), *hashes).first())).encode()).hexdigest()


@cache
def code() -> str:
    """A digest of the modules that make stages: other code makes other stages."""
    found = sorted(m.name for m in pkgutil.walk_packages(tallyspark.__path__, "tallyspark.", onerror=lambda _: None) if m.name.startswith(_MAKERS))
    sources = [importlib.util.find_spec(name).loader.get_source(name) or "" for name in found]
    return hashlib.sha256("\0".join(sources).encode()).hexdigest()


class Stages:
    """Tables below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, hook: Hook | None = None):
        self.spark, self.root, self.hook = spark, root.rstrip("/"), hook
        self.made: list[str] = []  # names of the stages that this run has computed

    def path(self, name: str, digest: str) -> str:
        return f"{self.root}/{name}-{digest[:32]}"

    def run(self, name: str, inputs: list[Stage], build: Callable[[], DataFrame], settings: str = "") -> Stage:
        """The stage ``name``: read if it was written for these inputs and settings by this code, else built and written.

        A stage that a failed job left half written has no success mark and is written anew.
        """
        digest = hashlib.sha256("|".join([name, settings, code(), *(i.digest for i in inputs)]).encode()).hexdigest()
        path = self.path(name, digest)
        if not storage.exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").option("compression", "zstd").parquet(path)
            self.made.append(name)
        table = self.spark.read.parquet(path)
        if self.hook:
            self.hook(name, table)
        return Stage(table, digest)
