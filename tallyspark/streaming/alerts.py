"""Delivery of alerts from a stream: each goes out once, also over restarts.

An alert is known by the digest of what it says. A micro-batch is delivered by tasks, which leave a receipt for every alert, and is then noted as delivered.
A batch that is repeated, or a task that is, skips alerts with a receipt; alerts of earlier batches don't go out again. Only an alert that was sent by a task which
died before its receipt was written is sent twice, under the same id, by which a receiver can tell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from email.message import EmailMessage

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.sources import storage

SAYS = ("kind", "account", "source_file", "message")
#: Gets an alert (alert_id and ``SAYS``) and sends it; an error fails the task, which is then repeated.
Send = Callable[[dict], None]


def with_id(alerts: DataFrame) -> DataFrame:
    """``alerts`` (kind, account, source_file, message) with alert_id."""
    return alerts.withColumn("alert_id", F.sha2(F.to_json(F.struct(*SAYS), {"ignoreNullFields": "false"}), 256))


def mail(alert: dict, sender: str, to: str) -> EmailMessage:
    """An alert as a mail, whose Message-ID is the alert's."""
    m = EmailMessage()
    m["Message-ID"], m["From"], m["To"] = f"<{alert['alert_id']}@{sender.partition('@')[2]}>", sender, to
    m["Subject"] = f"{alert['kind']}: {alert['account']}"
    m.set_content("\n".join(str(alert[c]) for c in ("message", "source_file") if alert[c]))
    return m


def _receipts(root: str) -> tuple[arrow_fs.FileSystem, str]:
    system, path = arrow_fs.FileSystem.from_uri(f"file://{root.removeprefix('file:').replace('//', '/')}" if root.startswith(("/", "file:")) else root)
    system.create_dir(f"{path}/receipts")
    return system, f"{path}/receipts"


def _sent(batch: DataFrame, root: str, send: Send) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = _receipts(root)
        for b in batches:
            for row in b.astype(object).where(b.notna(), None).to_dict("records"):
                receipt = f"{folder}/{row['alert_id']}"
                if system.get_file_info(receipt).type == arrow_fs.FileType.NotFound:
                    send(row)
                    with system.open_output_stream(receipt) as f:
                        f.write(b"sent\n")
            yield b[["alert_id"]]

    return batch.select("alert_id", *SAYS).mapInPandas(run, "alert_id string")


def deliver_batch(alerts: DataFrame, number: int, root: str, send: Send) -> None:
    """Deliver the alerts of micro-batch ``number`` that no earlier batch has delivered."""
    spark, mine = alerts.sparkSession, f"{root}/delivered/batch={number}"
    if storage.exists(spark, f"{mine}/_SUCCESS"):
        return
    new = with_id(alerts).dropDuplicates(["alert_id"])
    if storage.exists(spark, f"{root}/delivered"):
        new = new.join(spark.read.schema("alert_id string, batch int").parquet(f"{root}/delivered").where(F.col("batch") != number), "alert_id", "left_anti")
    _sent(new.repartition("alert_id"), root, send).write.mode("overwrite").parquet(mine)


def deliver(stream: DataFrame, root: str, checkpoint: str, send: Send) -> StreamingQuery:
    """Deliver all alerts of ``stream`` that are there; ``root`` and ``checkpoint`` are folders that all executors share."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: deliver_batch(batch, number, root, send))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
