"""Date expressions over text. All return null where nothing parses; ANSI mode never sees a failing cast."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import _col, after_label, let, lines

# Accepted formats, with the shape that a text must have for each; true marks two-digit years.
FORMATS = (
    ("d/M/yyyy", False),
    ("d-M-yyyy", False),
    ("d/MMM/yyyy", False),
    ("d/MMM/yy", True),
    ("d MMM, yyyy", False),
    ("d MMM yyyy", False),
    ("d MMM yy", True),
    ("d MMMM, yyyy", False),
    ("d MMMM yyyy", False),
    ("MMMM d, yyyy", False),
    ("d-MMM-yyyy", False),
    ("d-MMM-yy", True),
)
PIVOT = 69  # two-digit years from here on are of the 1900s

# A date inside running text; two-digit years aren't searched for.
IN_TEXT = (
    r"(?i)\b(\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{1,2}[/-][A-Z]{3}[/-]\d{4}|\d{1,2}\s+[A-Z]{3,9},?\s+\d{4}|[A-Z]{3,9}\s+\d{1,2},\s+\d{4})\b"
)


def _shape(pattern: str) -> str:
    """What a text looks like that a format can read."""
    parts = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{3,}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "^" + re.sub("y+|M+|d", lambda m: parts[m.group()], pattern) + "$"


def parse_date(text: Column | str) -> Column:
    """The date that a whole string says, in any of ``FORMATS``: the one whose shape it has."""

    def one(plain: Column, pattern: str, short: bool) -> Column:
        d = F.to_date(F.try_to_timestamp(plain, F.lit(pattern)))
        return F.when(F.year(d) >= 2000 + PIVOT, F.add_months(d, -1200)).otherwise(d) if short else d

    def read(plain: Column) -> Column:
        named = plain.rlike("[A-Za-z]")
        out = F.lit(None).cast("date")
        for pattern, short in reversed(FORMATS):
            fits = plain.rlike(_shape(pattern)) & (named if "MMM" in pattern else ~named)
            out = F.when(fits, one(plain, pattern, short)).otherwise(out)
        return out

    return let(F.regexp_replace(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), ",+$", ""), read)


def account_date(text: Column | str, today: Column | None = None) -> Column:
    """dd-MM-yyyy or ISO, from 1970 to the end of the year of ``today`` (by default the current one)."""
    t = F.trim(_col(text))
    d = F.to_date(F.coalesce(F.try_to_timestamp(t, F.lit("dd-MM-yyyy")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))
    return F.when((d >= F.make_date(F.lit(1970), F.lit(1), F.lit(1))) & (F.year(d) <= F.year(F.current_date() if today is None else today)), d)


def join_split_day(text: Column | str) -> Column:
    """``1 6-MAR-2024`` as ``16-MAR-2024``."""
    return F.regexp_replace(_col(text), r"(?i)(?<!\d)([0-3])\s+(\d-[A-Za-z]{3}-\d{4})", "$1$2")


def dates_in(text: Column | str) -> Column:
    """All parseable dates of a text, in order."""
    found = F.regexp_extract_all(_col(text), F.lit(IN_TEXT), F.lit(1))
    return F.filter(F.transform(found, parse_date), lambda d: d.isNotNull())


def first_date(text: Column | str) -> Column:
    return F.get(dates_in(text), F.lit(0))


def last_date(text: Column | str) -> Column:
    return F.try_element_at(dates_in(text), F.lit(-1))


def date_range(text: Column | str, joiner: str = r"\s+(?:to|-|–)\s+") -> Column:
    """(start, end) around the joiner: the last date before it and the first after it; a lone date is the end."""
    sides = let(F.split(_col(text), f"(?i){joiner}", 2), lambda p: F.struct(last_date(F.get(p, F.lit(0))).alias("a"), first_date(F.get(p, F.lit(1))).alias("b")))
    whole = lambda x: F.struct(F.when(x["b"].isNotNull(), x["a"]).alias("start"), F.coalesce(x["b"], x["a"]).alias("end"))
    return let(sides, whole)


def date_after_label(text: Column | str, label: str, width: int = 400) -> Column:
    return first_date(after_label(text, label, width))


def range_after_label(text: Column | str, label: str, width: int = 300) -> Column:
    return date_range(after_label(text, label, width))


def both(found: Column) -> Column:
    """A range that has a start and an end, else null."""
    return let(found, lambda r: F.when(r["start"].isNotNull() & r["end"].isNotNull(), r))


def date_beside_label(text: Column | str, label: str) -> Column:
    """The end of the range, or the date, on the rest of the label's line."""
    return date_range(F.substring_index(after_label(text, label, 4000), "\n", 1))["end"]


def date_at_label(text: Column | str, label: str) -> Column:
    """The same, else the first date on the lines below."""
    below = lambda t: F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)", 1)
    return let(after_label(text, label, 4000), lambda t: F.coalesce(date_range(F.substring_index(t, "\n", 1))["end"], first_date(below(t))))


def first_range(text: Column | str, joiner: str, near: int = 80) -> Column:
    """(start, end) at the first joiner with a date in the ``near`` characters on either side."""
    def found(parts: Column) -> Column:
        left = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        each = F.transform(left, lambda x, i: F.struct(last_date(F.right(x, F.lit(near))).alias("start"), first_date(F.left(F.get(parts, i + 1), F.lit(near))).alias("end")))
        return F.get(F.filter(each, lambda r: r["start"].isNotNull() & r["end"].isNotNull()), F.lit(0))

    return let(F.split(_col(text), f"(?i){joiner}"), found)


def range_near(text: Column | str, context: str, joiner: str) -> Column:
    """The first range in the 250 characters before a mention of the context or the 500 after it."""
    def found(parts: Column) -> Column:
        left = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        around = F.transform(left, lambda x, i: first_range(F.concat_ws(" ", F.right(x, F.lit(250)), F.left(F.get(parts, i + 1), F.lit(500))), joiner))
        return F.get(F.filter(around, lambda r: r.isNotNull()), F.lit(0))

    return let(F.split(_col(text), f"(?i){context}"), found)


def month_token(text: Column | str) -> Column:
    """The first day of a month written like ``APRIL-24`` or ``March-2025``."""
    t = F.trim(_col(text))
    name, year = F.regexp_extract(t, r"^([A-Za-z]+)-", 1), F.regexp_extract(t, r"-(\d{4}|\d{2})$", 1)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.to_date(F.try_to_timestamp(F.concat(F.initcap(F.lower(name)), F.lit(" "), full), F.lit("MMMM yyyy")))


def year_end_range(text: Column | str) -> Column:
    """(start, end) of ``period from APRIL-24 to MARCH-25``."""
    pattern = r"(?i)period from\s+([A-Z]+-\d{2,4})\s+to\s+([A-Z]+-\d{2,4})"
    start, end = (month_token(F.regexp_extract(_col(text), pattern, i)) for i in (1, 2))
    return both(F.struct(start.alias("start"), F.last_day(end).alias("end")))


def two_date_line(text: Column | str) -> Column:
    """(start, end) of the first line that holds two dates like ``05-MAR-2024 04-APR-2024``."""
    pattern = r"(?i)(\d{1,2}-[A-Z]{3}-\d{4})[ \t]+(\d{1,2}-[A-Z]{3}-\d{4})"
    return both(F.struct(*(parse_date(F.regexp_extract(_col(text), pattern, i)).alias(n) for i, n in ((1, "start"), (2, "end")))))


def mail_date(header: Column | str) -> Column:
    """The sender's own calendar day in a Date header; no offset is applied."""
    day = F.regexp_extract(_col(header), r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return F.to_date(F.try_to_timestamp(day, F.lit("d MMM yyyy")))


def between_months(day: Column, start: Column, end: Column) -> Column:
    """Whether a day's month is within the months of start and end, both included; false for null."""
    month = F.trunc(day, "MM")
    low = start.isNull() | (month >= F.trunc(start, "MM"))
    high = end.isNull() | (month <= F.trunc(end, "MM"))
    return F.coalesce(day.isNotNull() & low & high, F.lit(False))
