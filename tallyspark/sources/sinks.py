"""Where results go: transactions as CSV per period, metadata as JSON, statements by upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.amounts import two_decimals


def csv_rows(transactions: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the CSV files, as text: keys, date, description, ref, credited, debited, file."""
    return transactions.select(
        *keys, F.date_format("date", "yyyy-MM-dd").alias("date"), "description", F.coalesce("ref_no", F.lit("")).alias("ref"),
        two_decimals(F.col("credited")).alias("credited"), two_decimals(F.col("debited")).alias("debited"), F.col("source_file").alias("file"),
    )


def write_transactions(transactions: DataFrame, path: str, keys: list[str]) -> None:
    """CSV files with a header, a folder per key, rows in order of date, file, ref and description."""
    rows = csv_rows(transactions, keys)
    rows.repartition(*keys).sortWithinPartitions(*keys, "date", "file", "ref", "description").write.mode("overwrite").partitionBy(*keys).option("header", True).csv(path)


def keep_fields(metadata: DataFrame, current: DataFrame, key: str, kept: tuple[str, ...] = ("last_fetch_date",)) -> DataFrame:
    """``metadata`` with the fields of ``current`` that a refresh must not lose."""
    old = current.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in kept))
    joined = metadata.join(old, F.col(key) == F.col("__k"), "left")
    own = {c: F.coalesce(c, f"__{c}") if c in metadata.columns else F.col(f"__{c}") for c in kept}
    return joined.withColumns(own).drop("__k", *(f"__{c}" for c in kept))


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def upsert_statements(statements: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that ``statements`` touches, leave all others."""
    statements.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def changed(statements: DataFrame, current: DataFrame, keys: list[str], digest: str = "sha256") -> DataFrame:
    """``statements`` whose content isn't what ``current`` has already."""
    return statements.join(current.select(*keys, digest).distinct(), [*keys, digest], "left_anti")
