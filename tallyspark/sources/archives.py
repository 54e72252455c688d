"""CSV members of ZIP attachments."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def safe_member(name: str) -> bool:
    """Relative, without parent or hidden folders or system leftovers."""
    parts = PurePosixPath(name.replace("\\", "/")).parts
    return bool(parts) and not name.startswith(("/", "\\")) and not any(p == "__MACOSX" or p.startswith(".") for p in parts)


def _members(content: bytes, passwords: list[str]) -> list[tuple[str | None, bytes | None, str | None]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if safe_member(n) and n.lower().endswith(".csv")]
            for p in ["", *passwords]:
                try:
                    return [(PurePosixPath(n.replace("\\", "/")).name, z.read(n, pwd=p.encode() or None), None) for n in names]
                except RuntimeError:  # wrong password
                    continue
            return [(None, None, "no password fits")]
    except (zipfile.BadZipFile, NotImplementedError):
        return [(None, None, "not a zip archive")]


def csv_members(archives: DataFrame, key: str, content: str, passwords: list[str] | None = None) -> DataFrame:
    """(key, name, content, error): the safe CSV members of every archive, or why there are none.

    Passwords are tried in order after none; they go with the function, never into a column. Null archives have no rows.
    """
    known = list(passwords or [])
    kind = dict(archives.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *m) for k, c in zip(b["k"], b["c"], strict=True) for m in _members(bytes(c), known)]
            yield pd.DataFrame(rows, columns=["k", "name", "content", "error"])

    given = archives.where(F.col(content).isNotNull()).select(F.col(key).alias("k"), F.col(content).alias("c"))
    return given.mapInPandas(run, f"k {kind}, name string, content binary, error string").withColumnRenamed("k", key)
