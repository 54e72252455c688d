"""Which statement sources are parsed, and how formats of one period come together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_wins(texts: DataFrame, csvs: DataFrame, account: str = "account", stem: str = "stem") -> DataFrame:
    """``texts`` without those whose account and stem have a CSV."""
    return texts.join(csvs.select(account, stem), [account, stem], "left_anti")


def outside_annual(monthly: DataFrame, annual: DataFrame, account: str = "account") -> DataFrame:
    """``monthly`` without those that lie inside an annual period of the account; a missing bound keeps the row."""
    a = annual.select(F.col(account).alias("__a"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = (F.col(account) == F.col("__a")) & (F.col("start") >= F.col("__s")) & (F.col("end") <= F.col("__e"))
    return monthly.join(a, inside, "left_anti")


def merge_formats(pdfs: DataFrame, csvs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, formats): which of pdf, txt and csv a period has. ``pdfs`` carries has_txt."""
    left = pdfs.groupBy(*keys).agg(F.lit(True).alias("pdf"), F.bool_or("has_txt").alias("txt"))
    right = csvs.select(*keys).distinct().withColumn("csv", F.lit(True))
    both = left.join(right, keys, "full_outer")
    present = F.array_compact(F.array(*(F.when(F.col(f), f) for f in ("pdf", "txt", "csv"))))
    return both.select(*keys, present.alias("formats"))


def orphans(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """(keys, lacks): rows of either side without a partner on the other."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_left = a.join(b, keys, "left_anti").withColumn("lacks", F.lit(names[1]))
    return only_left.unionByName(b.join(a, keys, "left_anti").withColumn("lacks", F.lit(names[0])))


def with_fallback(accounts: DataFrame, rules: DataFrame, bank: str = "bank", variant: str = "variant") -> DataFrame:
    """``accounts`` with the rule of their bank and variant, else the bank's default, else null.

    ``rules`` (bank, variant, rule) is a registry of a few dozen rows in code. Spark doesn't know the size of such a frame, and to deal statements out by
    their bank is to send all of one bank to one task, so it is broadcast by name.
    """
    exact = rules.select(F.col("bank").alias("__b"), F.col("variant").alias("__v"), F.col("rule").alias("__exact"))
    default = rules.where("variant = 'default'").select(F.col("bank").alias("__d"), F.col("rule").alias("__default"))
    joined = accounts.join(F.broadcast(exact), (F.col(bank) == F.col("__b")) & (F.col(variant) == F.col("__v")), "left").join(F.broadcast(default), F.col(bank) == F.col("__d"), "left")
    return joined.withColumn("rule", F.coalesce("__exact", "__default")).drop("__b", "__v", "__exact", "__d", "__default")


def all_sources(annual: DataFrame, monthly: DataFrame) -> DataFrame:
    """Annual sources (account, start, end, ..) and the monthly ones that none of them covers, as one table."""
    return annual.unionByName(outside_annual(monthly, annual), allowMissingColumns=True)
