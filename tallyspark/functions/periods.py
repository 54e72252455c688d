"""Period expressions: keys of months, fiscal and calendar years, billing cycles, month series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import _col, let

UNKNOWN = "unknown-month"


def _month_of(year: Column, month: int, day: int = 1) -> Column:
    return F.make_date(year.cast("int"), F.lit(month), F.lit(day))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def fiscal_key(day: Column) -> Column:
    """``FYyy-YYYY`` of the year from April to March that holds the day."""
    y = F.year(F.add_months(day, -3))
    return F.format_string("FY%02d-%d", y % 100, y + 1)


def key_kind(key: Column | str) -> Column:
    k = _col(key)
    return F.when(k.rlike(r"^\d{4}-\d{2}$"), "month").when(k.rlike(r"^FY\d{2}-\d{4}$"), "fiscal").when(k.rlike(r"^\d{4}$"), "calendar").otherwise("unknown")


def key_bounds(key: Column | str) -> Column:
    """(start, end) of a key's days; null for keys that name no period."""

    def read(k: Column) -> Column:
        end_year = F.regexp_extract(k, r"^FY\d{2}-(\d{4})$", 1).try_cast("int")
        short = F.regexp_extract(k, r"^FY(\d{2})-\d{4}$", 1).try_cast("int")
        same = F.floor(end_year / 100) * 100 + short
        start_year = F.when(same >= end_year, same - 100).otherwise(same)
        year = F.regexp_extract(k, r"^(\d{4})$", 1).try_cast("int")
        # a month that there isn't is told by its digits: to parse it would be an exception for each row
        is_month = k.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])\z")
        month = F.when(is_month, F.make_date(F.substring(k, 1, 4).try_cast("int"), F.substring(k, 6, 2).try_cast("int"), F.lit(1)))
        return (
            F.when(is_month, F.struct(month.alias("start"), F.last_day(month).alias("end")))
            .when(end_year.isNotNull(), F.struct(_month_of(start_year, 4).alias("start"), _month_of(end_year, 3, 31).alias("end")))
            .when(year.isNotNull(), F.struct(_month_of(year, 1).alias("start"), _month_of(year, 12, 31).alias("end")))
        )

    return let(_col(key), read)


def key_label(key: Column | str) -> Column:
    """``FY 2024-25``, ``2024`` or ``Mar 2024``."""
    b = key_bounds(key)
    return (
        F.when(key_kind(key) == "fiscal", F.format_string("FY %d-%02d", F.year(b["start"]), F.year(b["end"]) % 100))
        .when(key_kind(key) == "month", F.date_format(b["start"], "MMM yyyy"))
        .otherwise(_col(key))
    )


def billing_cycle(day: Column, anchor: Column) -> Column:
    """(start, end) of the cycle that holds a day; cycles start on the anchor day, on a month's last day if it is shorter."""
    month = F.trunc(day, "MM")

    def clamped(m: Column, d: Column) -> Column:
        return F.date_add(m, F.least(d, F.dayofmonth(F.last_day(m))) - 1)

    first = F.when(F.dayofmonth(day) >= F.least(anchor, F.dayofmonth(F.last_day(day))), month).otherwise(F.add_months(month, -1))
    following = F.add_months(first, 1)
    end = F.when(anchor == 1, F.last_day(first)).otherwise(clamped(following, F.greatest(anchor - 1, F.lit(1))))
    return F.struct(clamped(first, anchor).alias("start"), end.alias("end"))


def approximate_start(end: Column) -> Column:
    """The day after the same day of the month before."""
    return F.date_add(F.add_months(end, -1), 1)


def bounds(start: Column, end: Column) -> Column:
    """(start, end, approximate): a missing start is estimated, reversed ones are swapped."""
    low = F.coalesce(start, approximate_start(end))
    return F.struct(F.least(low, end).alias("start"), F.greatest(low, end).alias("end"), start.isNull().alias("approximate"))


def months_between(start: Column, end: Column) -> Column:
    """First days of the months of both bounds and between; empty if reversed or null."""
    a, b = F.trunc(start, "MM"), F.trunc(end, "MM")
    none = F.array().cast("array<date>")
    return F.when(a <= b, F.sequence(a, b, F.expr("interval 1 month"))).otherwise(none)


def year_sections(start: Column, end: Column, fiscal: bool = True) -> Column:
    """The months from start's to end's by year, fiscal or calendar: an array of (year_key, months), the newest year and in it the newest month first."""
    months = F.reverse(months_between(F.trunc(start, "MM"), end))
    year = lambda m: fiscal_key(m) if fiscal else F.date_format(m, "yyyy")

    def sections(ms: Column) -> Column:
        within = lambda k: F.transform(F.filter(ms, lambda m: year(m) == k), month_key)
        return F.transform(F.array_distinct(F.transform(ms, year)), lambda k: F.struct(k.alias("year_key"), within(k).alias("months")))

    return let(months, sections)


def covered_month(key: Column | str) -> Column:
    """The month that a statement keyed by month covers: the one before."""
    return month_key(F.add_months(key_bounds(key)["start"], -1))


def period_key(annual: Column, content: Column, filename: Column) -> Column:
    """(key, source) by the first that is known."""

    def known(k: Column, source: str) -> Column:
        return F.when(k.isNotNull(), F.struct(k.alias("key"), F.lit(source).alias("source")))

    return F.coalesce(known(annual, "annual"), known(content, "content"), known(filename, "filename"), F.struct(F.lit(UNKNOWN).alias("key"), F.lit("unknown").alias("source")))


def filename_month(name: Column | str) -> Column:
    """The month in ``{label}__yyyy-MM-dd[__annual][ (n)].ext``."""
    return F.nullif(F.regexp_extract(_col(name), r"__(\d{4}-\d{2})-\d{2}(?:__annual)?(?: \(\d+\))?\.[A-Za-z]+$", 1), F.lit(""))


def filename_mail_date(name: Column | str) -> Column:
    return F.to_date(F.try_to_timestamp(F.regexp_extract(_col(name), r"__(\d{4}-\d{2}-\d{2})(?:__annual)?(?: \(\d+\))?\.[A-Za-z]+$", 1), F.lit("yyyy-MM-dd")))


def filename_annual(name: Column | str) -> Column:
    return _col(name).rlike(r"__annual[. ]")


def folder_of(key: Column) -> Column:
    """The year folder of a key: its own for years, the fiscal year for months, ``unknown-month`` for others."""
    return F.when(key_kind(key) == "month", fiscal_key(key_bounds(key)["start"])).when(key_kind(key) == "unknown", F.lit(UNKNOWN)).otherwise(key)


def file_stem(key: Column) -> Column:
    """A statement's file name without suffix: the month, or the year in which a fiscal year ends."""
    return F.when(key_kind(key) == "fiscal", F.regexp_extract(key, r"-(\d{4})$", 1)).otherwise(key)


def key_of_path(path: Column | str) -> Column:
    """The key that a canonical path says: its month, or the year of its folder where the stem is a year; null for others."""
    stem = F.regexp_extract(_col(path), r"([^/]*)\.[^./]*$", 1)
    folder = F.try_element_at(F.split(_col(path), "/"), F.lit(-4))
    month = F.when(stem.rlike(r"^\d{4}-\d{2}$"), stem)
    return F.coalesce(month, F.when(stem.rlike(r"^\d{4}$") & folder.rlike(r"^(FY\d{2}-\d{4}|\d{4})$"), folder))


def upload_period(name: Column | str) -> Column:
    """The key in ``manual__{key}.pdf`` or ``.csv``: a month, a fiscal or a calendar year. A month may be followed by a day."""
    key = r"(\d{4}-\d{2}(?=[.-])|FY\d{2}-\d{4}(?=\.)|\d{4}(?=\.))"
    return F.nullif(F.upper(F.regexp_extract(_col(name), rf"(?i)^manual__{key}(?:-\d{{2}}(?: \(\d+\))?)?\.(?:pdf|csv)$", 1)), F.lit(""))
