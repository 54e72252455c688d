"""Incremental intake: files are read as a stream, each content once, and a re-run takes only what is new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.sources.shared import shared_dir


def ingest(spark: SparkSession, source: str, schema: StructType, keys: list[str], target: str, checkpoint: str) -> None:
    """Append to ``target`` the rows of new files under ``source`` whose keys have not been seen.

    State is one entry per distinct key. Give the stream a watermark before this if keys age out; statement digests don't.
    """
    folder, _, name = source.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(source)
    stream.dropDuplicates(keys).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_available(spark: SparkSession, source: str, schema: StructType, keys: list[str]) -> DataFrame:
    """All distinct rows of ``source`` by one run of :func:`ingest` from nothing."""
    root = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    ingest(spark, source, schema, keys, f"{root}/data", f"{root}/checkpoint")
    return spark.read.schema(schema).parquet(f"{root}/data")


def high_water_marks(rows: DataFrame, account: str, day: str) -> DataFrame:
    """(account, last_fetch, n, since): the last day seen, the rows and, for overlap, the day before the last."""
    return rows.groupBy(account).agg(F.max(day).alias("last_fetch"), F.count(F.lit(1)).alias("n")).withColumn("since", F.date_sub("last_fetch", 1))


def daily_totals(stream: DataFrame, day: str, keys: list[str], amount: str, delay: str = "2 days") -> DataFrame:
    """Totals per key and day of an event-time stream; late rows count until the watermark passes the day."""
    stamped = stream.withColumn("__ts", F.col(day).cast("timestamp")).withWatermark("__ts", delay)
    sums = stamped.groupBy(*keys, F.window("__ts", "1 day").alias("w")).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, F.to_date("w.start").alias("day"), "total", "n")
