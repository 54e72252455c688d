"""The chain of monthly statements: does each opening balance continue the closing one before?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.amounts import TOLERANCE, balances_match
from tallyspark.functions.periods import month_key, months_between


def balance_gaps(monthly: DataFrame, annual_months: DataFrame | None = None, account: str = "account", tolerance: str | Column = TOLERANCE) -> DataFrame:
    """(account, month, status) from ``monthly`` (account, month: date, opening, closing).

    Between neighbours a month apart, balances that differ give two rows, discontinuity, for both months. Months
    missing in between are matched or mismatched by the balances around them; an annual statement that covers one
    removes it. A missing balance says nothing. ``tolerance`` is an amount, or a column of ``monthly`` if accounts differ in it.
    """
    w = Window.partitionBy(account).orderBy("month")
    each = monthly.withColumns({"next_month": F.lead("month").over(w), "next_opening": F.lead("opening").over(w)})
    known = each.where("next_month is not null and closing is not null and next_opening is not null")
    same = balances_match(F.col("closing"), F.col("next_opening"), tolerance)
    adjacent = F.add_months("month", 1) == F.col("next_month")
    said = lambda m, status: F.struct(m.alias("m"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"))
    broken = F.array(said(F.col("month"), "discontinuity"), said(F.col("next_month"), "discontinuity"))
    between = months_between(F.add_months("month", 1), F.add_months("next_month", -1))
    missing = F.transform(between, lambda m: said(m, F.when(same, "matched").otherwise("mismatched")))
    # one row of the window says all that it knows, so the chain is sorted once
    rows = known.select(account, F.explode(F.when(adjacent & ~same, broken).when(~adjacent, missing)).alias("x")).select(account, "x.m", "x.status")
    if annual_months is not None:
        covered = annual_months.select(F.col(account).alias("__a"), F.col("month").alias("__m"))
        rows = rows.join(covered, (F.col(account) == F.col("__a")) & (F.col("m") == F.col("__m")) & (F.col("status") != "discontinuity"), "left_anti")
    return rows.select(account, month_key(F.col("m")).alias("month"), "status")
