"""Statement text to transactions: line rules as data, applied as column expressions.

A rule is a pattern with numbered groups for date, description, amount, direction and reference. Lines are exploded, matched
and projected in one scan; whole-text rules match over line ends instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.amounts import parse_amount, split_direction
from tallyspark.functions.dates import parse_date


@dataclass(frozen=True)
class LineRule:
    """How one layout writes a transaction; group numbers are 0 where the layout lacks the part."""

    name: str
    pattern: str
    date: int
    description: int
    amount: int
    mark: int = 0
    ref: int = 0
    stop: str | None = None  # nothing is read from the first line with this marker on
    skip: str | None = None  # lines that match are no transactions
    default_mark: str = "DR"


_DATE = r"(\d{2}/\d{2}/\d{4})"
_AMOUNT = r"([\d,]+\.\d{2})"

# The layouts that are read.
RULES = {
    r.name: r
    for r in (
        LineRule("ref_marked", rf"(?i)^\s*{_DATE}\s+(\S+)\s+(.+?)\s+{_AMOUNT}\s+(DR|CR)\s*$", 1, 3, 4, 5, 2),
        LineRule("rupee_marked", rf"(?i)^\s*(\d{{1,2}} [A-Z]{{3}} \d{{2,4}})\s+(.+?)\s+Rs\.?\s*{_AMOUNT}\s*(Dr|Cr)\s*$", 1, 2, 3, 4, stop="End of Transactions"),
        LineRule("dashed_marked", rf"(?i)^\s*(\d{{2}}-\d{{2}}-\d{{4}})\s+(.+?)\s+{_AMOUNT}\s*(Dr|Cr)\s*$", 1, 2, 3, 4),
        LineRule("serial_points", rf"(?i)^\s*{_DATE}\s+(\d{{6,}})\s+(.+?)(?:\s+-?\d+)?\s+{_AMOUNT}(?:\s+(CR))?\s*$", 1, 3, 4, 5, 2),
        LineRule("slashed_or_month", rf"(?i)^\s*(\d{{2}}/\d{{2}}/\d{{4}}|\d{{1,2}} [A-Z]{{3}} \d{{2}})\s+(.+?)\s+{_AMOUNT}(?:\s+(DR|CR))?\s*$", 1, 2, 3, 4),
        LineRule("points_marked", rf"(?i)^\s*{_DATE}\s+(.+?)\s+\d+\s+{_AMOUNT}\s+(DR|CR)\b.*$", 1, 2, 3, 4, skip=r"(?i)^\s*TOTAL|\sTo\s\d|nil transaction"),
        LineRule("two_dates", rf"(?i)^\s*(\d{{2}}-[A-Z]{{3}}-\d{{4}})\s+\d{{2}}-[A-Z]{{3}}-\d{{4}}\s+(.+?)\s+{_AMOUNT}(?:\s+(Cr))?\s*$", 1, 2, 3, 4, skip=r"(?i)nil transaction"),
        LineRule("hdfc_annual", rf"(?i)^(\d{{1,2}}-[A-Z]{{3}}-\d{{4}})\s+(.+?)\s+{_AMOUNT}\s+(DR|CR)\b.*$", 1, 2, 3, 4),
        LineRule("hdfc_monthly", rf"^\s*(\d{{1,2}}/\d{{1,2}}/\d{{4}})(?:\s+\d{{1,2}}:\d{{2}}:\d{{2}})?\s+(.+?)\s+{_AMOUNT}\s*(Cr|CR|Dr|DR)?\s*$", 1, 2, 3, 4),
        LineRule("marked", rf"(?i)^\s*{_DATE}\s+(.+?)\s+{_AMOUNT}\s+(Cr|Dr)\s*$", 1, 2, 3, 4, skip=r"(?i)nil transaction"),
    )
}


def _before(rows: Column, stop: str) -> Column:
    ends = F.filter(F.transform(rows, lambda x, i: F.when(F.contains(x, F.lit(stop)), i)), lambda i: i.isNotNull())
    return F.slice(rows, 1, F.coalesce(F.get(ends, F.lit(0)), F.size(rows)))


def read_lines(statements: DataFrame, text: str = "text", stop: str | None = None) -> DataFrame:
    """``statements`` with a row per line: (pos from 0, line); with ``stop``, only the lines before the first that holds it."""
    rows = F.split(F.regexp_replace(F.col(text), r"\r\n?|\f", "\n"), "\n")
    if stop:
        rows = _before(rows, stop)
    return statements.select("*", F.posexplode(rows).alias("pos", "line"))


def parsed(line: Column, rule: LineRule) -> Column:
    """(date, description, ref_no, credited, debited) of a line by a rule; null if it is no transaction."""

    def group(n: int) -> Column:
        return F.nullif(F.regexp_extract(line, rule.pattern, n), F.lit("")) if n else F.lit(None).cast("string")

    mark = F.coalesce(F.upper(group(rule.mark)), F.lit(rule.default_mark))
    credited, debited = split_direction(parse_amount(group(rule.amount)), mark)
    parts = (parse_date(group(rule.date)).alias("date"), F.trim(group(rule.description)).alias("description"), group(rule.ref).alias("ref_no"))
    fits = line.rlike(rule.pattern) & ~line.rlike(rule.skip) if rule.skip else line.rlike(rule.pattern)
    return F.when(fits, F.struct(*parts, credited.alias("credited"), debited.alias("debited")))


def transactions(statements: DataFrame, rule: LineRule, text: str = "text") -> DataFrame:
    """``statements`` with date, description, ref_no, credited and debited per line that the rule matches; text goes."""
    found = read_lines(statements, text, rule.stop).drop(text).where(F.col("line").rlike(rule.pattern))
    return found.withColumn("t", parsed(F.col("line"), rule)).where("t.date is not null").select("*", "t.*").drop("line", "t")


def transactions_of_text(statements: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """As :func:`transactions` for a pattern over whole texts: groups date, description, amount, mark; may cross lines."""
    parts = F.arrays_zip(*(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("d", "t", "a", "m"), 1)))
    each = statements.select("*", F.posexplode(parts).alias("pos", "x")).drop(text)
    credited, debited = split_direction(parse_amount(F.col("x.a")), F.when(F.upper(F.col("x.m")) == "CR", "CR").otherwise("DR"))
    return each.select("*", parse_date(F.col("x.d")).alias("date"), F.trim(F.regexp_replace(F.col("x.t"), r"\s+", " ")).alias("description"), credited.alias("credited"), debited.alias("debited")).drop("x")


def distinct_transactions(statements: DataFrame, rules: list[LineRule], text: str = "text") -> DataFrame:
    """As :func:`transactions` by several rules, the first rule's matches first; what a statement says twice counts once."""
    rows = F.split(F.regexp_replace(F.col(text), r"\r\n?|\f", "\n"), "\n")
    found = F.concat(*(F.filter(F.transform(rows, lambda x: parsed(x, r)), lambda t: t["date"].isNotNull() & (t["description"] != "")) for r in rules))  # noqa: B023
    return statements.select("*", F.posexplode(F.array_distinct(found)).alias("pos", "t")).select("*", "t.*").drop(text, "t")


def first_of_each(rows: DataFrame, within: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Inside each statement one row of every (date, description, amount, direction), the first in order."""
    w = Window.partitionBy(*within, *by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


@cache
def _by_rule(application: str, rule: str) -> Column:
    """The CASE over all rules for the columns ``rule`` and line: built once in a session, as it holds no data."""
    return F.coalesce(*(F.when(F.col(rule) == r.name, parsed(F.col("line"), r)) for r in RULES.values()))


def apply_rules(statements: DataFrame, rule: str = "rule", text: str = "text") -> DataFrame:
    """Every statement by the rule that its ``rule`` column names, all in one scan: the rules are branches of a CASE."""
    rows = F.split(F.regexp_replace(F.col(text), r"\r\n?|\f", "\n"), "\n")
    kept = rows
    for r in RULES.values():
        if r.stop:
            kept = F.when(F.col(rule) == r.name, _before(rows, r.stop)).otherwise(kept)
    each = statements.select("*", F.posexplode(kept).alias("pos", "line")).drop(text)
    return each.withColumn("t", _by_rule(statements.sparkSession.sparkContext.applicationId, rule)).where("t.date is not null").select("*", "t.*").drop("line", "t")
