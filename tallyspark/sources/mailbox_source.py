"""Local mail stores: every message of the mbox files that have an index file beside them.

Two ways in. :func:`messages` reads whole messages through Spark's text source, so from any store that Spark reads. :class:`MailHeaders` is a
data source for folders that the executors have mounted: it reads headers only, of the stores and days that are asked for, and says where
each message lies; :func:`bodies` then opens just the messages that are wanted (:func:`scan`).
"""

from __future__ import annotations

import datetime
import email
import email.policy
import json
import mmap
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from email.message import EmailMessage
from email.utils import getaddresses, parsedate_tz
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.functions.dates import mail_date
from tallyspark.operators import messages as rules

INDEX = ".msf"
# Files and folders of a mail profile that hold no messages.
OTHER_SUFFIXES = (".msf", ".dat", ".json", ".html", ".txt", ".backup")
# Names of charsets in mails that Python knows by others.
CHARSETS = {"x-unknown": "utf-8", "unknown-8bit": "utf-8", "cp-850": "cp850", "x-sjis": "shift_jis", "ansi_x3.110-1983": "latin-1", "iso-8859-8-i": "iso-8859-8"}
_BODY = "body string, attachments array<struct<name:string,content_type:string,content:binary>>"
_SCHEMA = f"path string, subject string, address string, addresses array<string>, date_header string, {_BODY}"
SPLIT = 64 << 20  # bytes of a store that a task reads


def _text(content: bytes, charset: str | None) -> str:
    name = (charset or "utf-8").lower()
    try:
        return content.decode(CHARSETS.get(name, name), "replace")
    except LookupError:  # a charset that nobody knows
        return content.decode("utf-8", "replace")


def _head(m: EmailMessage) -> tuple[str, list[str], str]:
    addresses = [a.lower() for _, a in getaddresses([str(x) for x in m.get_all("from", [])]) if a]
    return str(m["subject"] or ""), addresses, str(m["date"] or "")


def _content(m: EmailMessage) -> tuple[str, list[dict]]:
    """Body and attachments; this is what decodes a message."""
    body, attached = [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        content = part.get_payload(decode=True) or b""
        if part.get_content_disposition() == "attachment" or part.get_filename():
            attached.append({"name": part.get_filename(), "content_type": part.get_content_type(), "content": content})
        elif part.get_content_maintype() == "text":
            body.append(_text(content, part.get_content_charset()))
    return "\n".join(body), attached


def _parsed(raw: bytes) -> EmailMessage:
    return email.message_from_bytes(raw, policy=email.policy.default)  # type: ignore[return-value]


def _row(raw: bytes) -> tuple:
    m = _parsed(raw)
    subject, addresses, day = _head(m)
    return (subject, addresses[0] if addresses else None, addresses, day, *_content(m))


def stores(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files below ``root`` that have an index beside them; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    index = files.where(F.endswith("path", F.lit(INDEX))).select(F.regexp_replace("path", r"\.msf$", "").alias("path"))
    return files.where(~F.endswith("path", F.lit(INDEX))).join(index, "path", "left_semi")


def messages(spark: SparkSession, root: str) -> DataFrame:
    """(path, subject, address, addresses, date_header, day, body, attachments) of all messages below ``root``; address is the first sender.

    Stores are read by Spark's text source with the line that begins a message as separator: a store of any size is split over tasks, and
    no task holds more than its messages.
    """
    raw = spark.read.text(root, lineSep="\nFrom ", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    wanted = stores(spark, root).select(F.regexp_replace("path", "^file:/+", "file:/").alias("__p"))
    each = raw.join(wanted, F.regexp_replace("path", "^file:/+", "file:/") == F.col("__p"), "left_semi").where(F.trim("raw") != "")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *_row(bytes(r).partition(b"\n")[2])) for p, r in zip(b["path"], b["raw"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "subject", "address", "addresses", "date_header", "body", "attachments"])

    return each.select("path", F.col("raw").cast("binary")).mapInPandas(parse, _SCHEMA).withColumn("day", mail_date("date_header"))


@dataclass
class _Range(InputPartition):
    """Messages of a store whose first byte lies from ``start`` to before ``end``."""

    path: str
    start: int
    end: int


def _day(header: str) -> datetime.date | None:
    """The day as the sender wrote it, whatever the offset."""
    found = parsedate_tz(header)
    try:
        return datetime.date(*found[:3]) if found else None
    except ValueError:
        return None


def _places(data: mmap.mmap, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of each message that begins in the range: behind its ``From`` line, up to the next one."""
    mark = b"From "
    if start == 0 and data[: len(mark)] == mark:
        at = 0
    else:
        before = data.find(b"\n" + mark, max(start - 1, 0))
        at = before + 1 if before >= 0 else end
    while at < end:
        following = data.find(b"\n" + mark, at)
        stop = following + 1 if following >= 0 else len(data)
        line = data.find(b"\n", at, stop)
        yield (line + 1 if line >= 0 else stop), stop
        if following < 0:
            return
        at = stop


class _HeaderReader(DataSourceReader):
    def __init__(self, root: str, split: int, paths: list[str] | None, since: str | None, until: str | None):
        self.root, self.split = Path(root.removeprefix("file:")), split
        self.paths = None if paths is None else set(paths)
        self.since, self.until = (datetime.date.fromisoformat(d) if d else None for d in (since, until))

    def _wanted(self, day: datetime.date | None) -> bool:
        if day is None:
            return self.since is None and self.until is None
        return (self.since is None or day >= self.since) and (self.until is None or day <= self.until)

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for folder, _, names in os.walk(self.root):
            there = set(names)
            for name in sorted(there):
                path = os.path.join(folder, name)
                if name + INDEX in there and not name.endswith(OTHER_SUFFIXES) and (self.paths is None or path in self.paths):
                    size = os.path.getsize(path)
                    out += [_Range(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.start == partition.end:
            return
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            for begin, end in _places(data, partition.start, partition.end):
                blank = [x for x in (data.find(b"\n\n", begin, end), data.find(b"\n\r\n", begin, end)) if x >= 0]
                subject, addresses, header = _head(_parsed(data[begin : min(blank, default=end)]))
                day = _day(header)
                if self._wanted(day):
                    yield partition.path, begin, end - begin, subject, addresses[0] if addresses else None, addresses, header, day


class MailHeaders(DataSource):
    """Headers of mail stores below the option ``path``, which driver and executors have mounted: ``stores`` (a JSON list of paths) chooses stores before
    any is opened, ``since`` and ``until`` (days, included) are met while headers are read, and no body is decoded."""

    @classmethod
    def name(cls) -> str:
        return "mail_headers"

    def schema(self) -> str:
        return "path string, offset long, size long, subject string, address string, addresses array<string>, date_header string, day date"

    def reader(self, schema: object) -> DataSourceReader:
        paths = json.loads(self.options.get("stores", "null"))
        return _HeaderReader(self.options["path"], int(self.options.get("split", SPLIT)), paths, self.options.get("since"), self.options.get("until"))


def headers(spark: SparkSession, root: str, split: int = SPLIT, paths: list[str] | None = None, since: datetime.date | None = None, until: datetime.date | None = None) -> DataFrame:
    """(path, offset, size, subject, address, addresses, date_header, day): where each message lies, and its head.

    With ``paths`` no other store is opened, with ``since`` or ``until`` messages of other days and without a day don't leave the source.
    """
    spark.dataSource.register(MailHeaders)
    given = {"split": str(split), "stores": json.dumps(paths)} | {k: v.isoformat() for k, v in (("since", since), ("until", until)) if v}
    return spark.read.format("mail_headers").options(**given).load(root)


def bodies(wanted: DataFrame) -> DataFrame:
    """(path, offset, body, attachments) of the messages ``wanted`` (path, offset, size): each store is opened once in a task and read at these places only."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, part in b.groupby("path", sort=False):
                rows = []
                with open(path, "rb") as f:
                    for offset, size in zip(part["offset"], part["size"], strict=True):
                        f.seek(offset)
                        rows.append((path, offset, *_content(_parsed(f.read(size)))))
                yield pd.DataFrame(rows, columns=["path", "offset", "body", "attachments"])

    near = wanted.select("path", "offset", "size", F.floor(F.col("offset") / SPLIT).alias("part"))
    dealt = near.repartition("path", "part").sortWithinPartitions("path", "offset")
    return dealt.select("path", "offset", "size").mapInPandas(read, f"path string, offset long, {_BODY}")


def scan(spark: SparkSession, root: str, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, counts): messages for accounts (account, subjects, senders, body_contains, start, end) with their attachments of a kind
    that statements have, and the number of messages by account.

    Headers are read and matched first, also against the earliest start and the last end of all accounts inside the source; only
    messages that an account may want are then read and decoded, each once however many accounts want it.
    """
    bounds = accounts.agg(F.trunc(F.min("start"), "MM").alias("since"), F.last_day(F.max("end")).alias("until"), F.bool_or(F.col("start").isNull()).alias("open"), F.bool_or(F.col("end").isNull()).alias("ongoing")).first()
    heads = headers(spark, root, since=None if bounds["open"] else bounds["since"], until=None if bounds["ongoing"] else bounds["until"])
    met = rules.for_accounts(heads, accounts)
    return _found(met.join(bodies(met.select("path", "offset", "size").distinct()), ["path", "offset"]).drop("offset", "size"))


def scan_messages(messages_: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`scan` for messages that were read whole."""
    return _found(rules.for_accounts(messages_, accounts))


def _found(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = F.transform("attachments", lambda a: a["name"])
    found = met.where(rules.body_matches(F.col("body"), names, F.col("body_contains")))
    found = found.withColumn("annual", rules.is_annual(F.col("subject"), F.col("body")))

    def kind(a: Column) -> Column:
        return rules.attachment_kind(a["name"], a["content_type"], a["content"], F.col("annual"))

    kinds = F.filter(F.transform("attachments", lambda a: F.struct(a["name"].alias("name"), kind(a).alias("kind"), a["content"].alias("content"))), lambda a: a["kind"].isNotNull())
    return found.withColumn("attachments", kinds), found.groupBy("account").agg(F.count(F.lit(1)).alias("messages"))
