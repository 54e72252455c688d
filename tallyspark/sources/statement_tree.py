"""Statement trees: folders of year, account type and account number, listed by a data source that opens only the folders that are asked for.

For trees that driver and executors have mounted. Where only Spark reads the store, :func:`under` lists by a path pattern instead, which leaves other years
unopened too.

What is asked for is an option of the source and isn't pushed into it by the optimiser: in Spark 4.1 all scans of one loaded Python source in
a query share the filters that were pushed last, so that a union of two years would read one of them twice.
"""

from __future__ import annotations

import datetime
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyspark.sources import files

LEVELS = ("folder", "account_type", "account_number")
YEAR_FOLDER = re.compile(r"FY\d{2}-\d{4}|\d{4}")


@dataclass
class _Folder(InputPartition):
    folder: str
    account_type: str | None = None


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, wanted: dict[str, list[str]]):
        self.root, self.wanted = root.removeprefix("file:"), wanted

    def _below(self, path: str, level: str) -> list[str]:
        """Folders in ``path``; where the level's names are given it isn't listed, they are looked up."""
        if level in self.wanted:
            return sorted(n for n in set(self.wanted[level]) if n and os.path.isdir(os.path.join(path, n)))
        with os.scandir(path) as found:
            return sorted(e.name for e in found if e.is_dir())

    def partitions(self) -> Sequence[InputPartition]:
        years = [n for n in self._below(self.root, "folder") if YEAR_FOLDER.fullmatch(n)]
        return [_Folder(y, t) for y in years for t in self._below(os.path.join(self.root, y), "account_type")] or [_Folder("")]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not partition.folder:
            return
        top = os.path.join(self.root, partition.folder, partition.account_type)
        for number in self._below(top, "account_number"):
            with os.scandir(os.path.join(top, number)) as found:
                for e in sorted(found, key=lambda e: e.name):
                    if e.is_file():
                        at = e.stat()
                        modified = datetime.datetime.fromtimestamp(at.st_mtime, datetime.UTC)
                        yield e.path, e.name, os.path.splitext(e.name)[1].lower(), modified, at.st_size, partition.folder, partition.account_type, number


class StatementTree(DataSource):
    """(path, name, suffix, modified, size, folder, account_type, account_number) of the files of a statement tree at the option ``path``.

    A partition is a year folder and account type. The option ``wanted`` (JSON: level to names) says which folders are opened at a level.
    """

    @classmethod
    def name(cls) -> str:
        return "statement_tree"

    def schema(self) -> str:
        return "path string, name string, suffix string, modified timestamp, size long, folder string, account_type string, account_number string"

    def reader(self, schema: object) -> DataSourceReader:
        return _TreeReader(self.options["path"], json.loads(self.options.get("wanted", "{}")))


def tree(spark: SparkSession, root: str, **wanted: list[str]) -> DataFrame:
    """The files of the tree; ``folder``, ``account_type`` and ``account_number`` name the folders that are opened, all without them."""
    if unknown := set(wanted) - set(LEVELS):
        raise ValueError(f"no level of the tree: {', '.join(sorted(unknown))}")
    spark.dataSource.register(StatementTree)
    return spark.read.format("statement_tree").option("wanted", json.dumps(wanted)).load(root)


def canonical(spark: SparkSession, root: str, year: str | None = None, accounts: list[str] | None = None) -> DataFrame:
    """The canonical statements of the tree as :func:`tallyspark.sources.files.canonical` describes them, of one year folder or some accounts."""
    wanted = ({"folder": [year]} if year else {}) | ({"account_number": accounts} if accounts is not None else {})
    return files.canonical(tree(spark, root, **wanted))


def under(spark: SparkSession, root: str, year: str | None = None, account: str | None = None) -> DataFrame:
    """As :func:`canonical` for any store that Spark reads: the path pattern names the year folder and the account, no other is listed."""
    pattern = "/".join((root.rstrip("/"), year or "{FY[0-9][0-9]-[0-9][0-9][0-9][0-9],[0-9][0-9][0-9][0-9]}", "*", account or "*"))
    return files.canonical(files.listing(spark, pattern, (".pdf", ".txt", ".csv"), recursive=False))
