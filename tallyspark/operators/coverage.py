"""Coverage of an account by statements: islands of touching periods, the gaps between them, and what closes a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.amounts import TOLERANCE, balances_match
from tallyspark.functions.periods import month_key, months_between


def segments(periods: DataFrame, account: str = "account") -> DataFrame:
    """(account, start, end, approximate, periods): periods that overlap or touch become one; approximate if any is.

    One window sort per account; the running end of all periods before decides where an island begins.
    """
    w = Window.partitionBy(account).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = periods.withColumn("__new", F.when(before.isNull() | (F.col("start") > F.date_add(before, 1)), 1).otherwise(0))
    numbered = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(account, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("approximate").alias("approximate"), F.count(F.lit(1)).alias("periods")).drop("__island")


def gaps(covered: DataFrame, account: str = "account") -> DataFrame:
    """(account, start, end) between neighbouring segments."""
    w = Window.partitionBy(account).orderBy("start")
    following = covered.withColumn("__next", F.lead("start").over(w)).where("__next is not null")
    return following.select(account, F.date_add("end", 1).alias("start"), F.date_sub("__next", 1).alias("end"))


def gap_balances(missing: DataFrame, monthly: DataFrame, account: str = "account", tolerance: str = TOLERANCE) -> DataFrame:
    """``missing`` (account, start, end) with before, after and balances_match.

    before is the closing balance of the monthly that ends the day before the gap, after the opening one of the first monthly that
    starts behind it: a forward as-of match. Statements and gaps are sorted together, once per account, from the last day back, and each gap takes what
    was seen last.
    """
    ends = monthly.groupBy(F.col(account).alias("__a"), F.date_add("end", 1).alias("__day")).agg(F.min_by(F.struct("closing"), F.struct("start", "end", "closing")).alias("__b"))
    found = missing.join(ends, (F.col(account) == F.col("__a")) & (F.col("start") == F.col("__day")), "left").drop("__a", "__day")
    none = F.lit(None)
    statements = monthly.select(F.col(account).alias("a"), F.col("start").alias("d"), F.lit(False).alias("gap"), F.col("end").alias("e"), F.struct(F.col("opening").alias("o")).alias("open"), none.alias("g"))
    gaps_ = found.select(F.col(account).alias("a"), F.col("end").alias("d"), F.lit(True).alias("gap"), none.cast("date").alias("e"), none.cast(statements.schema["open"].dataType).alias("open"), F.struct("start", "end", F.col("__b.closing").alias("before")).alias("g"))
    both = statements.withColumn("g", none.cast(gaps_.schema["g"].dataType)).unionByName(gaps_)
    # of statements that start on one day the one with the smallest end, then opening, is seen last; a gap that ends on that day comes before them
    back = Window.partitionBy("a").orderBy(F.desc("d"), F.desc("gap"), F.desc_nulls_last("e"), F.desc_nulls_last("open.o")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("after", F.last("open", ignorenulls=True).over(back)).where("gap")
    out = seen.select(F.col("a").alias(account), "g.start", "g.end", "g.before", F.col("after.o").alias("after"))
    return out.withColumn("balances_match", balances_match(F.col("before"), F.col("after"), tolerance))


def roll_up(periods: DataFrame, account: str = "account") -> DataFrame:
    """One row per account: bounds, segments and gaps in order, the months that are covered, and how many periods, and approximate ones, there are."""
    s = segments(periods, account)
    inner = s.groupBy(account).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "end", "approximate"))).alias("segments"), F.sum("periods").alias("count"))
    months = periods.select(account, "approximate", months_between(F.col("start"), F.col("end")).alias("m")).groupBy(F.col(account).alias("__m"))
    months = months.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("m", month_key))))).alias("months"), F.count_if("approximate").alias("n_approximate"))
    g = gaps(s, account).groupBy(F.col(account).alias("__a")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gaps"))
    return inner.join(months, F.col(account) == F.col("__m"), "left").join(g, F.col(account) == F.col("__a"), "left").drop("__a", "__m")
