"""The accounts dimension: defaults and overrides, checks, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlay(defaults: DataFrame, overrides: DataFrame, key: str, replaced: list[str], united: list[str]) -> DataFrame:
    """Per field the override if there is one; the lists in ``united`` are joined, the default's items first."""
    o = overrides.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in [*replaced, *united]))
    joined = defaults.join(o, F.col(key) == F.col("__k"), "left")
    none = F.array().cast("array<string>")
    out = {c: F.coalesce(f"__{c}", c) for c in replaced} | {c: F.array_union(F.coalesce(c, none), F.coalesce(f"__{c}", none)) for c in united}
    return joined.withColumns(out).drop("__k", *(f"__{c}" for c in [*replaced, *united]))


def shared_numbers(accounts: DataFrame, number: str = "account_number", bank: str = "bank") -> DataFrame:
    """(number, banks) of numbers that more than one bank has; variants of one bank may share."""
    return accounts.groupBy(number).agg(F.count_distinct(bank).alias("banks")).where("banks > 1")


def checked(accounts: DataFrame, number: str = "account_number", bank: str = "bank") -> DataFrame:
    """``accounts``; reading them fails if a number is shared across banks."""
    bad = shared_numbers(accounts, number, bank).select(F.col(number).alias("__n"))
    text = F.concat(F.lit("account number of several banks: "), F.col(number))
    joined = accounts.join(bad, F.col(number) == F.col("__n"), "left")
    return joined.withColumn(number, F.when(F.col("__n").isNotNull(), F.raise_error(text).cast("string")).otherwise(F.col(number))).drop("__n")


def to_run(accounts: DataFrame, number: str | None, column: str = "account_number") -> DataFrame:
    """All accounts, or the one asked for; an error if it isn't there."""
    if number is None:
        return accounts
    found = accounts.where(F.col(column) == number)
    if found.isEmpty():
        raise ValueError(f"no account {number}")
    return found


def counts(rows: DataFrame, account: str, year: str) -> DataFrame:
    """Rows per account and fiscal year, per account, and in all."""
    return rows.rollup(account, year).agg(F.count(F.lit(1)).alias("n"))
