"""Shared scratch tables.

Intermediate results that must be cut from their lineage are written as Parquet under the folder that the cluster
names in ``spark.checkpoint.dir``: every executor can read them, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.shared import shared_dir


class Workspace:
    """Named Parquet tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
        """Write ``df`` in buckets of ``key``: later joins and groupings by ``key`` read it without a shuffle.

        Without ``dealt`` (``df`` is dealt out by ``key`` already) rows are dealt out first, so that a bucket is one file.
        """
        table = f"t{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        writer = (df if dealt else df.repartition(n, key)).write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
        writer.bucketBy(n, key).sortBy(key).saveAsTable(table)
        read = self.spark.table(table)
        self.spark.sql(f"drop table {table}")  # the name only: the files are read by their path, and no scratch name is left behind
        return read

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
