"""Column expressions against values worked out by hand."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import amounts, dates, periods, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("shown", "expected"),
    [
        ("1,234.50", "1234.50"), ("(12.00)", "-12.00"), ("-7", "-7.00"), ("100.00 CR", "-100.00"), ("100.00CR", "100.00"), ("100.00 Dr", "100.00"),
        ("Rs. 5.10", "5.10"), ("₹ 9", "9.00"), ("r 3.25", "3.25"), ("", None), ("abc", None), ("1.2.3", None),
    ],
)
def test_amounts(spark, shown, expected):
    assert value(spark, amounts.parse_amount(F.lit(shown))) == (Decimal(expected) if expected else None)


@pytest.mark.parametrize(
    ("shown", "expected"),
    [
        ("5/4/2021", date(2021, 4, 5)), ("05-04-2021", date(2021, 4, 5)), ("20  Aug,  2025", date(2025, 8, 20)), ("17 Oct 75", date(1975, 10, 17)), ("17 Oct 25", date(2025, 10, 17)),
        ("March 3, 2020", date(2020, 3, 3)), ("29-FEB-2024", date(2024, 2, 29)), ("29-Feb-2023", None), ("5/4/21", None), ("", None), ("3 Mar 2024,", date(2024, 3, 3)),
    ],
)
def test_dates(spark, shown, expected):
    assert value(spark, dates.parse_date(F.lit(shown))) == expected


def test_date_ranges(spark):
    found = value(spark, dates.date_range(F.lit("from 01/02/2024 and 03 Mar 2024 to 04/04/2024")))
    assert (found["start"], found["end"]) == (date(2024, 3, 3), date(2024, 4, 4))
    lone = value(spark, dates.date_range(F.lit("as of 04/04/2024")))
    assert (lone["start"], lone["end"]) == (None, date(2024, 4, 4))
    assert value(spark, dates.date_after_label(F.lit("xx DDuuee  DDaattee: 04/04/2024"), "Due Date")) == date(2024, 4, 4)
    assert value(spark, dates.join_split_day(F.lit("1 6-MAR-2024"))) == "16-MAR-2024"
    assert value(spark, dates.mail_date(F.lit("Tue, 31 Dec 2024 23:50:00 -0800"))) == date(2024, 12, 31)


@pytest.mark.parametrize(
    ("day", "anchor", "start", "end"),
    [
        (date(2024, 2, 10), 1, date(2024, 2, 1), date(2024, 2, 29)), (date(2024, 2, 8), 9, date(2024, 1, 9), date(2024, 2, 8)), (date(2024, 2, 9), 9, date(2024, 2, 9), date(2024, 3, 8)),
        (date(2024, 2, 28), 31, date(2024, 1, 31), date(2024, 2, 29)), (date(2023, 3, 1), 31, date(2023, 2, 28), date(2023, 3, 30)), (date(2024, 3, 31), 31, date(2024, 3, 31), date(2024, 4, 30)),
    ],
)
def test_billing_cycle(spark, day, anchor, start, end):
    found = value(spark, periods.billing_cycle(F.lit(day), F.lit(anchor)))
    assert (found["start"], found["end"]) == (start, end)


def test_period_keys(spark):
    assert value(spark, periods.fiscal_key(F.lit(date(2024, 3, 31)))) == "FY23-2024"
    assert value(spark, periods.fiscal_key(F.lit(date(2024, 4, 1)))) == "FY24-2025"
    b = value(spark, periods.key_bounds(F.lit("FY99-2000")))
    assert (b["start"], b["end"]) == (date(1999, 4, 1), date(2000, 3, 31))
    assert value(spark, periods.key_bounds(F.lit("2099-99"))) is None
    assert value(spark, periods.key_bounds(F.lit("unknown-month"))) is None
    assert value(spark, periods.covered_month(F.lit("2024-01"))) == "2023-12"
    assert value(spark, periods.months_between(F.lit(date(2024, 3, 1)), F.lit(date(2024, 1, 1)))) == []
    assert value(spark, periods.filename_month(F.lit("card__2024-05-09__annual (2).pdf"))) == "2024-05"
    assert value(spark, periods.filename_annual(F.lit("card__2024-05-09__annual (2).pdf")))
    key = value(spark, periods.period_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("2024-05")))
    assert (key["key"], key["source"]) == ("2024-05", "filename")


def test_text(spark):
    assert value(spark, text.sanitize(F.lit("a\tb€  \nc"))) == "a b\nc"
    t = F.lit("x\nBEGIN\ny\nEND\nz\nEND\nw")
    assert value(spark, text.trim_by_markers(t, ["BEGIN"], ["END"])) == "BEGIN\ny\nEND\nz\nEND"
    assert value(spark, text.trim_by_markers(F.lit("END\nBEGIN"), ["BEGIN"], ["END"])) == ""
    assert value(spark, text.trim_by_markers(F.lit("a\nb"), ["BEGIN"], ["END"])) == "a\nb"
    assert value(spark, text.contains_any(F.lit("a  b"), ["a b", ""])) is False
    assert value(spark, text.contains_any_squeezed(F.lit("a \n b"), ["a  b"])) is True
    assert value(spark, text.direction(F.lit("Cr 5 DR 6"))) == "DR"
    assert value(spark, text.direction(F.lit("none"))) == "DR"
    assert value(spark, text.file_leaf(F.lit("../a/b:c.pdf"))) == "b_c.pdf"
    assert value(spark, text.file_leaf(F.lit(None).cast("string"))) == "attachment"
    assert value(spark, text.distinct_words(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("b")))) == ["A", "b"]


def test_token_positions(spark):
    found = value(spark, amounts.tokens(F.lit("a (cid:3) 12.50 b 7 Cr")))
    assert [(x["pos"], x["amount"]) for x in found] == [(3, Decimal("12.50")), (11, Decimal("-7.00"))]


def test_balance_tolerance(spark):
    for other, same in (("10.21", True), ("10.22", False)):
        assert value(spark, amounts.balances_match(F.lit(Decimal("10.00")), F.lit(Decimal(other)))) is same
    assert value(spark, amounts.two_decimals(F.lit("12.345").cast("decimal(18,3)"))) == "12.34"
