"""Tables that are replaced by partition, safely: rows are written beside, and one rename publishes them.

Layout below ``root``: ``data/batch=<id>`` holds the rows of one write, ``manifests/<id>`` says for every key which batch counts, and ``log/<n>`` names the
manifest of generation n. A job that fails before the log entry leaves the last generation as it was; a reader sees one generation or the next, never
parts of both. Two writers can't make the same generation: the second one's rename fails, and it starts anew from what the first one published.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.sources import storage

ATTEMPTS = 10  # generations that other writers may publish while one of ours is made


class Conflict(Exception):
    """Another writer has published this generation."""


class Published:
    """A table with one set of rows for each value of ``keys``."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], fmt: str = "parquet"):
        self.spark, self.root, self.keys, self.fmt = spark, root.rstrip("/"), keys, fmt

    def generation(self) -> int:
        """Number of the last published generation, 0 if there is none."""
        return max((int(n) for n in storage.names(self.spark, f"{self.root}/log") if n.isdigit()), default=0)

    def _entry(self, n: int) -> dict:
        return json.loads(storage.read_text(self.spark, f"{self.root}/log/{n:012d}"))

    def _manifest(self, entry: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/manifests/{entry['manifest']}")

    def read(self, n: int | None = None) -> DataFrame | None:
        """The rows of a generation, the last one without ``n``; None before the first."""
        n = self.generation() if n is None else n
        if not n:
            return None
        entry = self._entry(n)
        schema = StructType.fromJson(entry["schema"])
        rows = self.spark.read.schema(StructType([*schema.fields]).add("batch", "string")).format(self.fmt).load(f"{self.root}/data")
        marks = self._manifest(entry).select(*(F.col(k).alias(f"__{k}") for k in self.keys), F.col("batch").alias("__batch"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return rows.join(marks, [*same, F.col("batch") == F.col("__batch")], "left_semi").drop("batch")

    def stage(self, rows: DataFrame) -> str:
        """Write ``rows`` beside what counts; nothing reads them until they are published."""
        batch = uuid.uuid4().hex
        rows.write.format(self.fmt).mode("error").save(f"{self.root}/data/batch={batch}")
        return batch

    def publish(self, schema: StructType, batch: str | None = None, removed: DataFrame | None = None) -> int:
        """Make ``batch`` count for the keys that it has, and no batch for those in ``removed``; the number of the new generation."""
        for _ in range(ATTEMPTS):
            n = self.generation()
            gone = removed.select(*self.keys).distinct() if removed is not None else None
            fresh = None
            if batch:
                stored = self.spark.read.schema(schema).format(self.fmt).load(f"{self.root}/data/batch={batch}")
                fresh = stored.select(*self.keys).distinct()
                gone = fresh if gone is None else gone.unionByName(fresh)
            manifest = self._manifest(self._entry(n)) if n else None
            if manifest is not None and gone is not None:
                other = gone.toDF(*(f"__{k}" for k in self.keys))
                manifest = manifest.join(other, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")
            marked = fresh.withColumn("batch", F.lit(batch)) if fresh is not None else None
            new = marked if manifest is None else manifest if marked is None else manifest.unionByName(marked)
            if new is None:
                return n
            try:
                return self._commit(n + 1, new, schema)
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} other writers were faster")

    def _commit(self, n: int, manifest: DataFrame, schema: StructType) -> int:
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        if not storage.create(self.spark, f"{self.root}/log/{n:012d}", json.dumps({"manifest": name, "schema": json.loads(schema.json())})):
            raise Conflict(n)
        return n

    def upsert(self, rows: DataFrame) -> int:
        """Replace the rows of the keys that ``rows`` has, leave all others."""
        return self.publish(rows.schema, self.stage(rows))

    def remove(self, keys: DataFrame) -> int:
        """Drop the rows of ``keys``."""
        n = self.generation()
        return self.publish(StructType.fromJson(self._entry(n)["schema"]), removed=keys) if n else 0

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what none of the last ``keep`` generations uses: batches that were replaced or never published, manifests and log entries.

        For times without writers: a batch that is being written isn't published yet.
        """
        n = self.generation()
        kept = [self._entry(i) for i in range(max(1, n - keep + 1), n + 1)]
        used = {f"batch={r['batch']}" for e in kept for r in self._manifest(e).select("batch").distinct().collect()}  # one row for each write that still counts
        manifests = {e["manifest"] for e in kept}
        gone = [f"data/{x}" for x in storage.names(self.spark, f"{self.root}/data") if x.startswith("batch=") and x not in used]
        gone += [f"manifests/{x}" for x in storage.names(self.spark, f"{self.root}/manifests") if x not in manifests]
        gone += [f"log/{x}" for x in storage.names(self.spark, f"{self.root}/log") if x.isdigit() and int(x) <= n - keep]
        for x in gone:
            storage.delete(self.spark, f"{self.root}/{x}")
        return gone
