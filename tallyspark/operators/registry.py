"""Which rules read the statements of a bank and card variant. The registry is data; new layouts are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.parsing import RULES, apply_rules, distinct_transactions
from tallyspark.operators.selection import with_fallback
from tallyspark.sources import sectioned

# Bank, variant, line rule. A variant that isn't listed reads by its bank's default, if there is one.
READERS = (
    ("bob", "default", "ref_marked"),
    ("csb", "default", "rupee_marked"),
    ("federal", "default", "rupee_marked"),
    ("federal", "signet", "dashed_marked"),
    ("hdfc", "default", "hdfc"),
    ("icici", "default", "serial_points"),
    ("idfc", "wow", "slashed_or_month"),
    ("indusind", "default", "points_marked"),
    ("pnb", "default", "two_dates"),
    ("yes", "default", "marked"),
)


def readers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(READERS), "bank string, variant string, rule string")


#: Rules that are several line rules, in order; what one statement says twice counts once.
SEVERAL = {"hdfc": ("hdfc_annual", "hdfc_monthly")}


def read_statements(statements: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(transactions, unread) of ``statements`` (bank, variant, .., text): each by its registered rule; unread has those without.

    An ICICI statement that is an export with sections is read as such.
    """
    ruled = with_fallback(statements, readers(statements.sparkSession))
    export = F.coalesce((F.col("rule") == "serial_points") & F.contains(text, F.lit(sectioned.BEGIN)), F.lit(False))
    found = apply_rules(ruled.where(F.col("rule").isNotNull() & ~export & ~F.col("rule").isin(list(SEVERAL))), text=text)
    for name, rules in SEVERAL.items():
        found = found.unionByName(distinct_transactions(ruled.where(F.col("rule") == name), [RULES[r] for r in rules], text))
    return found.unionByName(sectioned.rows(ruled.where(export), text)), ruled.where("rule is null").drop("rule")
