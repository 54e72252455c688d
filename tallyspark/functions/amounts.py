"""Amount expressions: decimals from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import _col, let

MONEY = "decimal(18,2)"
TOLERANCE = "0.21"

# An amount with its currency prefix and optional marks.
# A minus may be followed by a stray comma. The look ahead leaves the places early where no amount can begin.
TOKEN = r"(?i)(?=[RI₹(\-\d])(?:(?:Rs\.?|INR|₹)\s*)?\(?(?:-,?)?\d[\d,]*(?:\.\d+)?\)?(?:\s*\b(?:Cr|Dr)\b)?"
DECIMAL_TOKEN = r"(?i)(?=[RI₹(\-\d])(?:(?:Rs\.?|INR|₹)\s*)?\(?(?:-,?)?\d[\d,]*\.\d{1,2}\)?(?:\s*\b(?:Cr|Dr)\b)?"


def parse_amount(text: Column | str) -> Column:
    """Signed decimal: parentheses or minus and a separate Cr make it negative, Dr positive; null if it isn't one.

    The mark must stand apart: ``100.00CR`` is positive, ``100.00 CR`` negative.
    """

    def read(t: Column) -> Column:
        credit, debit = t.rlike(r"(?i)\bCr\b"), t.rlike(r"(?i)\bDr\b")
        minus = t.rlike(r"^\(.*\)$") | F.contains(t, F.lit("-"))
        plain = F.regexp_replace(t, r"(?i)Rs\.?|INR|₹|\b(?:Cr|Dr)\b|(?<=\d)(?:CR|DR)$|^[rC](?=\s*\d)|[,()\s-]", "")
        value = let(plain, lambda p: F.when(p.rlike(r"^\d+(\.\d+)?$"), p)).try_cast("decimal(38,6)").try_cast(MONEY)  # a longer number is no amount
        return let(value, lambda v: F.when(credit, -F.abs(v)).when(debit, F.abs(v)).when(minus, -v).otherwise(v).cast(MONEY))

    return let(F.trim(_col(text)), read)


def tokens(text: Column | str, decimals: bool = False) -> Column:
    """(pos, raw, amount) of every amount of a line, with its character position from 0; ``(cid:n)`` counts as blank."""
    pattern = DECIMAL_TOKEN if decimals else TOKEN
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,raw:string>>").alias("out"))

    def placed(t: Column) -> Column:
        found, upto = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(f"(?s).*?{pattern}"), F.lit(0))
        step = F.zip_with(found, upto, lambda m, x: F.struct((F.length(x) - F.length(m)).alias("gap"), F.length(m).alias("size"), m.alias("raw")))
        return F.aggregate(
            step,
            empty,
            lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("pos"), x["raw"].alias("raw")))).alias("out")),
        )["out"]

    return F.transform(let(_plain(text), placed), lambda x: F.struct(x["pos"].alias("pos"), x["raw"].alias("raw"), parse_amount(x["raw"]).alias("amount")))


def _plain(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"\(cid:\d+\)", "")


def count_tokens(text: Column | str, decimals: bool = False) -> Column:
    """How many :func:`tokens` a line has."""
    return F.regexp_count(_plain(text), F.lit(DECIMAL_TOKEN if decimals else TOKEN))


def first_token(text: Column | str, decimals: bool = False) -> Column:
    """What the first of :func:`tokens` is written like, null without one."""
    return F.nullif(F.regexp_extract(_plain(text), DECIMAL_TOKEN if decimals else TOKEN, 0), F.lit(""))


def first_amount(text: Column | str, decimals: bool = False) -> Column:
    """The amount of the first of :func:`tokens`; the others aren't parsed."""
    return parse_amount(first_token(text, decimals))


def last_amount(text: Column | str, decimals: bool = False) -> Column:
    """The amount of the last of :func:`tokens`."""
    return parse_amount(F.try_element_at(F.regexp_extract_all(_plain(text), F.lit(DECIMAL_TOKEN if decimals else TOKEN), F.lit(0)), F.lit(-1)))


def nearest(items: Column, position: Column) -> Column:
    """Of (pos, .., amount) the amount that stands nearest to a position, the first on a tie."""
    apart = F.transform(items, lambda x, i: F.struct(F.abs(x["pos"] - position).alias("d"), i.alias("i"), x["amount"].alias("amount")))
    return F.array_min(apart)["amount"]


def split_direction(amount: Column, mark: Column) -> tuple[Column, Column]:
    """(credited, debited): an amount goes to one side, the other is 0."""
    zero = F.lit(0).cast(MONEY)
    return F.when(mark == "CR", amount).otherwise(zero).cast(MONEY), F.when(mark == "CR", zero).otherwise(amount).cast(MONEY)


def split_signed(amount: Column) -> tuple[Column, Column]:
    """(credited, debited) of a signed amount: below 0 is credit."""
    return split_direction(F.abs(amount), F.when(amount < 0, "CR").otherwise("DR"))


def balances_match(left: Column, right: Column, tolerance: str | Column = TOLERANCE) -> Column:
    """Equal within the tolerance, which is included."""
    return F.abs(left - right) <= F.lit(tolerance).cast(MONEY)


def two_decimals(amount: Column) -> Column:
    """Text with two decimals, rounded half to even."""
    return F.bround(amount, 2).cast(MONEY).cast("string")
