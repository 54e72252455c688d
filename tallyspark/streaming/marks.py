"""High-water marks as the state of a stream: what was fetched last of each account, and from where the next fetch goes on."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OVERLAP = datetime.timedelta(days=1)  # mail of the last day may come late
_STATE = "last date, rows long"
_OUT = "account string, last_fetch date, since date, n long, behind long"


class _Marks(StatefulProcessor):
    """One row of state for each account."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, n = self.mark.get() if self.mark.exists() else (None, 0)
        behind, latest = 0, last
        for part in rows:
            days = part["day"].dropna()
            n += len(part)
            if last is not None:
                behind += int((days < last - OVERLAP).sum())
            if len(days):
                latest = max(days) if latest is None else max(latest, max(days))
        self.mark.update((latest, n))
        yield pd.DataFrame({"account": [key[0]], "last_fetch": [latest], "since": [latest and latest - OVERLAP], "n": [n], "behind": [behind]})

    def close(self) -> None:
        pass


def marks(stream: DataFrame, account: str, day: str) -> DataFrame:
    """(account, last_fetch, since, n, behind) of each account that a micro-batch touches: the last day seen so far, the day before it, rows so far, and rows of
    this batch that lie before what was ``since`` until now, which a fetch from there wouldn't have brought. A null day counts as a row and moves no mark.

    State is a date and a count for each account; it survives a restart in the checkpoint. Sets the session's state store to RocksDB, which this needs.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select(F.col(account).cast("string").alias("account"), F.to_date(day).alias("day"))
    return rows.groupBy("account").transformWithStateInPandas(_Marks(), _OUT, "Update", "None")
