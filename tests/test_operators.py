"""Operators over small tables, with nulls, ties, repeated rows and empty input."""

import io
import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import accounts, balances, coverage, keeper, messages, parsing, selection
from tallyspark.sources import archives, mailbox_source, sectioned, sinks

M = "account string, month date, opening decimal(18,2), closing decimal(18,2)"


def month(m, opening, closing, account="a"):
    return (account, date(2024, m, 1), None if opening is None else Decimal(opening), None if closing is None else Decimal(closing))


def gaps(spark, rows, annual=None):
    found = balances.balance_gaps(spark.createDataFrame(rows, M), annual)
    return sorted((r["month"], r["status"]) for r in found.collect())


def test_balance_gaps(spark):
    assert gaps(spark, [month(1, "0", "5"), month(2, "5.21", "7")]) == []
    assert gaps(spark, [month(1, "0", "5"), month(2, "5.22", "7")]) == [("2024-01", "discontinuity"), ("2024-02", "discontinuity")]
    assert gaps(spark, [month(1, "0", "5"), month(4, "5", "7")]) == [("2024-02", "matched"), ("2024-03", "matched")]
    assert gaps(spark, [month(1, "0", "5"), month(4, "6", "7")]) == [("2024-02", "mismatched"), ("2024-03", "mismatched")]
    assert gaps(spark, [month(1, "0", None), month(4, "6", "7")]) == []
    assert gaps(spark, []) == []
    annual = spark.createDataFrame([("a", date(2024, 2, 1))], "account string, month date")
    assert gaps(spark, [month(1, "0", "5"), month(4, "5", "7")], annual) == [("2024-03", "matched")]


def test_coverage(spark):
    d = lambda m, x: date(2024, m, x)
    rows = [("a", d(1, 1), d(1, 31), False, "0", "1"), ("a", d(2, 1), d(2, 10), True, "1", "2"), ("a", d(3, 1), d(3, 31), False, "2.2", "3"), ("b", d(1, 1), d(1, 2), False, None, None)]
    p = spark.createDataFrame([(*r[:4], *(None if x is None else Decimal(x) for x in r[4:])) for r in rows], "account string, start date, end date, approximate boolean, opening decimal(18,2), closing decimal(18,2)")
    s = coverage.segments(p)
    assert sorted((r["account"], r["start"], r["end"], r["approximate"]) for r in s.collect()) == [("a", d(1, 1), d(2, 10), True), ("a", d(3, 1), d(3, 31), False), ("b", d(1, 1), d(1, 2), False)]
    g = coverage.gap_balances(coverage.gaps(s), p).collect()
    assert [(r["start"], r["end"], r["balances_match"]) for r in g] == [(d(2, 11), d(2, 29), True)]
    assert {r["account"]: r["count"] for r in coverage.roll_up(p).collect()} == {"a": 3, "b": 1}
    assert coverage.segments(p.where("false")).count() == 0


FILE = (
    "account string, path string, sha256 string, source string, manual boolean, excluded boolean, has_markers boolean, included boolean, statement_date date, period_start date, period_end date,"
    " opening decimal(18,2), closing decimal(18,2), reference string, mail_date date"
)


def staged(path, sha=None, source="content", manual=False, excluded=False, has_markers=True, included=True, sd=None, ref=None, mail=None, opening=None):
    return ("a", path, sha or path, source, manual, excluded, has_markers, included, sd, None, None, opening, None, ref, mail)


D1, D2 = date(2024, 1, 5), date(2024, 2, 5)


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([staged("1", excluded=True)], ("rejected", None)),
        ([staged("1", manual=True, excluded=True), staged("2")], ("prepared", "1")),
        ([staged("1", has_markers=False), staged("2", has_markers=False)], ("prepared", "2")),
        ([staged("1", included=False)], ("rejected", None)),
        ([staged("1", source="filename"), staged("2", source="content")], ("prepared", "2")),
        ([staged("1", sd=D1, ref="x"), staged("2", sd=D2, ref="x")], ("ambiguous", None)),
        ([staged("1"), staged("2")], ("ambiguous", None)),
        ([staged("1", sha="s"), staged("2", sha="s")], ("prepared", "1")),
        ([staged("1", sd=D1, ref="x", opening=Decimal(1)), staged("2", sd=D1, ref="x")], ("prepared", "1")),
        ([staged("1", sd=D1, ref="x", mail=D1), staged("2", sd=D1, ref="x", mail=D2)], ("prepared", "2")),
        ([staged("1", sd=D1, ref="x", mail=D2), staged("2", sd=D1, ref="x", mail=D2)], ("ambiguous", None)),
        ([staged("1", sd=D1, ref="x"), staged("2", sd=D1, ref="x")], ("ambiguous", None)),
    ],
)
def test_keeper(spark, rows, expected):
    r = keeper.keep_pdf(spark.createDataFrame(rows, FILE), ["account"]).first()
    assert (r["outcome"], r["keeper_path"]) == expected


def test_keeper_csv_and_alerts(spark):
    f = spark.createDataFrame([staged("1", mail=D2), staged("2", mail=D1), staged("3")], FILE)
    assert keeper.keep_csv(f, ["account"]).first()["keeper_path"] == "1"
    assert keeper.alerts(f, keeper.keep_pdf(f, ["account"]), ["account"]).first()["files"] == "1,2,3"
    assert keeper.keep_pdf(f.where("false"), ["account"]).count() == 0


def test_line_rules(spark):
    text = "head\n05/01/2024 R1 TEA 1,000.00 CR\n06/01/2024 R2 A B 2.50 dr\n31/02/2024 R3 X 1.00 DR\n"
    s = spark.createDataFrame([("s", text), ("n", None)], "id string, text string")
    found = parsing.transactions(s, parsing.RULES["ref_marked"]).collect()
    assert [(r["date"], r["description"], r["ref_no"], r["credited"], r["debited"]) for r in found] == [(date(2024, 1, 5), "TEA", "R1", Decimal("1000.00"), Decimal("0.00")), (date(2024, 1, 6), "A B", "R2", Decimal("0.00"), Decimal("2.50"))]
    across = parsing.transactions_of_text(spark.createDataFrame([("05/01/2024 TEA AND\nCAKE 4.00Cr\n06/01/2024 BUN 1.00",)], "text string"), r"(?m)^(\d{2}/\d{2}/\d{4})\s+([A-Z\s]+?)\s+([\d,]+\.\d{2})(Cr)?")
    assert [(r["description"], r["credited"], r["debited"]) for r in across.collect()] == [("TEA AND CAKE", Decimal("4.00"), Decimal("0.00")), ("BUN", Decimal("0.00"), Decimal("1.00"))]
    both = parsing.apply_rules(spark.createDataFrame([("ref_marked", text), ("marked", "05/01/2024 X 1.00 Cr")], "rule string, text string"))
    assert both.groupBy("rule").count().count() == 2


def test_selection(spark):
    m = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 1, 31)), ("a", date(2024, 1, 1), None), ("b", date(2024, 1, 1), date(2024, 1, 31))], "account string, start date, end date")
    annual = spark.createDataFrame([("a", date(2023, 4, 1), date(2024, 3, 31))], "account string, start date, end date")
    assert sorted((r["account"], r["end"] is None) for r in selection.outside_annual(m, annual).collect()) == [("a", True), ("b", False)]


def test_messages(spark):
    rows = [("x@bank.example", True), ("x@sub.bank.example", False), (None, False), ("me@other.example", True)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "address string")
    wanted = F.array(F.lit("BANK.example"), F.lit("me@other.example"))
    assert [r[0] for r in df.select(messages.sender_matches(F.col("address"), wanted)).collect()] == [w for _, w in rows]
    assert messages.imap_criteria(['a"b', "c"], "1-Jan-2024", None) == 'SINCE 1-Jan-2024 OR SUBJECT "a\\"b" SUBJECT "c"'
    assert messages.imap_criteria([], None, None) == "ALL"


def test_accounts(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "x"), ("2", "x")], "account_number string, bank string")
    assert [r["account_number"] for r in accounts.shared_numbers(a).collect()] == ["1"]
    with pytest.raises(Exception, match="several banks"):
        accounts.checked(a).collect()
    assert accounts.to_run(a, "2").count() == 2
    with pytest.raises(ValueError):
        accounts.to_run(a, "3")


def test_sectioned(spark):
    text = 'A,b\nTransaction Details:\nDate,Sr\nXXXX\n05/01/2024,12,TEA,0,0,"1,000.00",-5.00\n06-Jan-24,R77777,BUN,0,0,3.00,\n\nMESSAGE Details:\n07/01/2024,1,Z,0,0,1.00,'
    found = sectioned.rows(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()
    assert [(r["date"], r["ref_no"], r["credited"], r["debited"]) for r in found] == [(date(2024, 1, 5), None, Decimal("5.00"), Decimal("0.00")), (date(2024, 1, 6), "R77777", Decimal("0.00"), Decimal("3.00"))]


def test_zip_members(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in ("a/one.csv", "../bad.csv", "/abs.csv", "__MACOSX/x.csv", "note.txt", "two.CSV", ".h/y.csv"):
            z.writestr(n, n)
    df = spark.createDataFrame([("k", bytearray(raw.getvalue())), ("broken", bytearray(b"nope")), ("none", None)], "id string, content binary")
    found = archives.csv_members(df, "id", "content").collect()
    assert sorted((r["id"], r["name"], r["error"]) for r in found) == [("broken", None, "not a zip archive"), ("k", "one.csv", None), ("k", "two.CSV", None)]


def test_mail_source(spark, tmp_path):
    (tmp_path / "Inbox.msf").write_text("index")
    (tmp_path / "Inbox").write_bytes(
        b"From x\nFrom: A <Al@Bank.example>\nSubject: =?utf-8?q?Caf=C3=A9?=\nDate: Tue, 02 Jan 2024 23:00:00 +0500\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain\n\nhello\n--q\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=s.pdf\n\n%PDF\n--q--\n\n"
    )
    (tmp_path / "Stray").write_bytes(b"From x\nSubject: no\n\n")
    found = mailbox_source.messages(spark, str(tmp_path)).collect()
    assert [(r["subject"], r["address"], r["day"], r["body"].strip(), r["attachments"][0]["name"]) for r in found] == [("Café", "al@bank.example", date(2024, 1, 2), "hello", "s.pdf")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01", date(2024, 1, 5), "TEA", None, Decimal("1.00"), Decimal("0.00"), "f")], "account string, period string, date date, description string, ref_no string, credited decimal(18,2), debited decimal(18,2), source_file string")
    sinks.write_transactions(rows, str(tmp_path / "csv"), ["account", "period"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["credited"] == "1.00"
    for part, v in (("a", "1"), ("b", "2"), ("a", "3")):
        sinks.upsert_statements(spark.createDataFrame([(part, v)], "account string, sha256 string"), str(tmp_path / "up"), ["account"])
    assert sorted((r["account"], r["sha256"]) for r in spark.read.parquet(str(tmp_path / "up")).collect()) == [("a", "3"), ("b", "2")]


def test_registry(spark):
    from tallyspark.operators import registry

    rows = [
        ("bob", "easy", "05/01/2024 R1 TEA 1.00 CR"), ("federal", "signet", "05-01-2024 TEA 2.00 Dr"), ("idfc", "wow", "5 Jan 24 TEA 3.00"), ("idfc", "other", "5 Jan 24 TEA 3.00"),
        ("csb", "edge", "05 Jan 24 TEA Rs. 4.00 Cr\n** End of Transactions **\n06 Jan 24 TEA Rs. 4.00 Cr"), ("indusind", "x", "TOTAL\n05/01/2024 TEA 12 5.00 DR"), ("icici", None, "05/01/2024 123456789 TEA 7 6.00 CR"),
    ]
    found, unread = registry.read_statements(spark.createDataFrame(rows, "bank string, variant string, text string"))
    assert sorted((r["bank"], r["credited"] - r["debited"]) for r in found.collect()) == [
        ("bob", Decimal(1)), ("csb", Decimal(4)), ("federal", Decimal(-2)), ("icici", Decimal(6)), ("idfc", Decimal(-3)), ("indusind", Decimal(-5)),
    ]
    assert [(r["bank"], r["variant"]) for r in unread.collect()] == [("idfc", "other")]


def test_extractors(spark):
    from tallyspark.operators import extract

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    t = F.lit("Total Due\n05/01/2024\n1,200.50 Cr\nSummary\n1 2\n10.00 20.00 30.00\n11.00 21.00 31.00\n05 Jan 2024 Rs. 7.00 Dr\nAmount 5.00")
    assert value(extract.amount_beside_label(t, "Total Due")) == Decimal("-1200.50")
    assert value(extract.nth_row_after(t, "Summary", 2, 3)) == Decimal("31.00")
    assert value(extract.nth_row_after(t, "Summary", 2, 3, last=False)) == Decimal("11.00")
    assert value(extract.nth_row_after(t, "Absent")) is None
    assert value(extract.lone_amount_after(t, "Total Due")) == Decimal("-1200.50")
    assert value(extract.unlabelled_opening(t)) == Decimal("7.00")
    assert value(extract.reference(F.lit("AAN : X1 ABC1234"), "AAN")) == "ABC1234"
    assert value(extract.amount_below_label(F.lit(None).cast("string"), "x")) is None
