"""Files of statements: listings by suffix, the keys that a path says, and texts read whole. Contents aren't read for a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.periods import file_stem, folder_of, key_of_path
from tallyspark.functions.text import _col

STAGED = (".pdf", ".csv", "metadata.json")


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".pdf", ".csv"), recursive: bool = True) -> DataFrame:
    """(path, name, suffix, modified, size) of the files whose name ends in one of the suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    named = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return named.where(has_suffix("name", suffixes)).withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))


def has_suffix(name: Column | str, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(_col(name)), F.lit(s))
    return out


def unsupported(files: DataFrame) -> DataFrame:
    """Staged files that are neither statements nor metadata."""
    return files.where(~has_suffix("name", STAGED))


def is_transactions(name: Column | str) -> Column:
    """Whether a CSV is a result of parsing and no statement."""
    return F.startswith(_col(name), F.lit("transactions-")) & has_suffix(name, (".csv",))


def canonical(files: DataFrame, year: str | None = None) -> DataFrame:
    """The canonical statements among ``files``, with folder, account_type, account_number, key and kind (pdf, txt or csv).

    They lie in folders of year, account type and number. A CSV is one if its stem is a month or a year. With ``year`` only that folder is kept:
    a filter on the path, so that nothing else is opened.
    """
    at = lambda i: F.try_element_at(F.split("path", "/"), F.lit(i))
    keyed = files.withColumns({"folder": at(-4), "account_type": at(-3), "account_number": at(-2), "key": key_of_path("path"), "kind": F.substring("suffix", 2, 10)})
    keyed = keyed.where(F.col("folder").rlike(r"^(FY\d{2}-\d{4}|\d{4})$") & F.col("kind").isin("pdf", "txt", "csv"))
    keyed = keyed.where((F.col("kind") != "csv") | (F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).rlike(r"^\d{4}(-\d{2})?$") & ~is_transactions("name")))
    return keyed.where(F.col("folder") == year) if year else keyed


def pairs(statements: DataFrame) -> DataFrame:
    """(folder, account_type, account_number, key, pdf, txt): the PDF of every statement and its text, null if there is none."""
    keys = ["folder", "account_type", "account_number", "key"]
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path"))).alias(kind)
    return statements.groupBy(*keys).agg(one("pdf"), one("txt")).where("pdf is not null")


def has_transactions(files: DataFrame) -> bool:
    """Whether there is any transactions CSV; the scan ends at the first."""
    return not files.where(is_transactions("name")).isEmpty()


def texts(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(path, text): every text file below ``root``, read whole."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def canonical_path(root: str, key: Column, account_type: Column, number: Column, suffix: str) -> Column:
    """Where a statement of a period belongs."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), folder_of(key), account_type, number, F.concat(file_stem(key), F.lit(suffix)))
