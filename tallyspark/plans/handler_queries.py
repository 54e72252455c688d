"""Queries over rendered statement heads: an order is a statement, written in a bank's layout and read by its handler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import handlers
from tallyspark.plans.catalogue import ORDERS_SQL, orders, query

_WIDE = 22


def _money(plus: int = 0) -> Column:
    return F.format_number(F.col("amount") + plus, 2)


def _day(pattern: str, back: int = 0) -> Column:
    return F.date_format(F.date_sub("day", back), pattern)


def _row(*cells: Column | str) -> Column:
    return F.concat(*(F.rpad(c if isinstance(c, Column) else F.lit(c), _WIDE, " ") for c in cells))


def _text(*lines: Column | str) -> Column:
    return F.concat_ws("\n", *(x if isinstance(x, Column) else F.lit(x) for x in lines))


def _range(label: str, pattern: str, joiner: str) -> Column:
    return F.concat(F.lit(label), _day(pattern, 29), F.lit(joiner), _day(pattern))


def _read(spark: SparkSession, sf_dir: str, bank: str, variants: dict[str, Column]) -> DataFrame:
    """Orders dealt over the variants by number, each rendered in its layout, and read.

    Reading takes far longer than an order's few bytes suggest, so they are dealt over the cores first, however few row groups hold them.
    """
    o = orders(spark, sf_dir).select("ref", "day", "amount").repartition(4 * spark.sparkContext.defaultParallelism, "ref")
    names = list(variants)
    kind = F.col("ref") % len(names)
    pick = lambda values: F.coalesce(*(F.when(kind == i, v) for i, v in enumerate(values)))
    statements = o.select("ref", F.lit(bank).alias("bank"), pick([F.lit(n.split(":")[0]) for n in names]).alias("variant"), pick([variants[n] for n in names]).alias("text"))
    found, _ = handlers.metadata(statements, (bank,))
    return found.select("ref", "variant", "statement_date", "period_start", "period_end", "opening", "closing", "reference", "estimated", "annual")


def _sql(variants: tuple[str, ...], start: str = "(day - 29)::date", reference: str = "null", closing: str = "1", estimated: str = "false", annual: str = "false", end: str = "day") -> str:
    names = ", ".join(f"'{v.split(':')[0]}'" for v in variants)
    return f"""with {ORDERS_SQL}, k as (select *, ref % {len(variants)} as kind from orders_t)
select ref, [{names}][kind + 1] as variant, ({end})::date as statement_date, ({start})::date as period_start, ({end})::date as period_end, amount as opening, (amount + {closing})::decimal(18,2) as closing,
       ({reference})::varchar as reference, {estimated} as estimated, {annual} as annual from k"""


def _bob() -> dict[str, Column]:
    table = (_row("Opening Balance", "Purchases", "Closing Balance"), _row(_money(), "12.00", _money(1)))
    glance = ("This Month's Statement At A Glance", *table)
    gst = ("GST No: 27AAA", _row("9.00", "8.00", "7.00"), _row(_money(), "12.00", _money(1)))
    return {
        "default": _text("BOBCARD", _range("Statement Period : ", "dd/MM/yyyy", " to "), "Account Summary", *table, "Page 1 of 2", "after 01/01/2001 to 02/02/2002"),
        "easy": _text("BOBCARD EASY", _range("", "dd MMM, yyyy", " To "), "Loan Summary", *glance),
        "default:gst": _text("BOBCARD", F.concat(F.lit("Statement Date : "), _day("dd/MM/yyyy")), _range("Statement Period : ", "dd-MM-yyyy", " to "), *gst),
    }


@query(_sql(("default", "easy", "default:gst")))
def handler_bob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, a range at the top, tables by header, rows behind an anchor."""
    return _read(spark, sf_dir, "bob", _bob())


def _edge() -> Column:
    amounts = [F.concat(F.lit("     Rs. "), F.lit(f"{i}.00")) for i in range(1, 7)]
    first = F.concat(F.lit("  "), _day("dd MMM yyyy"), F.lit("   Rs. "), _money())
    return _text(_range("Statement ", "dd MMM yyyy", " - "), first, *amounts, F.concat(F.lit("     Rs. "), _money(1)), "04 Jan 2021 SHOP Rs. 180.00", "-" * 48 + " End of Transactions " + "-" * 48, "Rs. 1.00")


_EDGE_SQL = _sql(("default", "edge"), closing="0")


@query(_EDGE_SQL)
def handler_csb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unlabelled column of amounts below the dated one; closing is the first amount in rupees."""
    return _read(spark, sf_dir, "csb", {"default": _edge(), "edge": _edge()})


@query(f"""with {ORDERS_SQL}, k as (select *, ref % 3 as kind from orders_t)
select ref, ['default', 'edge', 'signet'][kind + 1] as variant, day as statement_date, (day - 29)::date as period_start, day as period_end, amount as opening,
       (amount + case when kind = 2 then 1 else 0 end)::decimal(18,2) as closing, null::varchar as reference, false as estimated, false as annual from k""")
def handler_federal(spark: SparkSession, sf_dir: str) -> DataFrame:
    signet = _text(
        F.concat(F.lit("Statement Date "), _day("dd/MM/yyyy")), _range("Statement Period ", "dd/MM/yyyy", " to "), "Payment Due Date", _row(_money(), "5.00", "6.00"),
        "Total Amount Due (in Rs.) Minimum", F.concat(F.lit("Rs. "), _money(1)), "GSTN of Federal Bank",
    )
    return _read(spark, sf_dir, "federal", {"default": _edge(), "edge": _edge(), "signet": signet})


def _hdfc() -> dict[str, Column]:
    v1 = ("Account Summary", _row("Opening Balance", "Payments", "Purchases", "Total Dues"), _row(_money(), "5.00", "6.00", _money(1)))
    v2 = ("Account Summary", "Opening", "Balance", _row(_money(), "5.00", "6.00", _money(1)))
    due = F.concat(_day("dd/MM/yyyy"), F.lit("   "), _money(1), F.lit("   100.00"))
    aan = F.concat(F.lit("AAN : "), F.col("ref") + 10_000_000_000)
    modern = (_range("Billing Period ", "dd MMM, yyyy", " - "), "PREVIOUS STATEMENT DUES", _row(_money(), "5.00", "6.00"), "TOTAL AMOUNT DUE", F.concat(F.lit("C"), _money(1)))
    neu = (_range("Billing Period ", "dd MMM, yyyy", " - "), "PREVIOUS STATEMENT DUES", F.concat(_money(), F.lit(" + 1.00 = 9.00")), "TOTAL AMOUNT DUE", _money(1))
    guideline = ("DUPLICATE STATEMENT", "Statement", F.concat(F.lit("Date: "), _day("dd/MM/yyyy")))
    return {
        "default": _text(aan, _range("Billing Period ", "dd MMM, yyyy", " - "), *v1, "Reward Points Summary", "9.00"),
        "regalia": _text(aan, *guideline, F.concat(F.lit("Statement Date "), _day("dd/MM/yyyy")), *v2),
        "swiggy": _text(aan, *modern),
        "swiggy:guideline": _text(aan, *guideline, F.concat(F.lit("Statement Date "), _day("dd/MM/yyyy")), *v2),
        "tata-neu-infinity": _text(aan, *neu),
        "diners-privilege": _text(aan, *guideline, F.concat(F.lit("Statement Date "), _day("dd/MM/yyyy")), *v2, "Payment Due Date", due),
        "regalia-gold": _text(
            "Year End Statement Summary", aan, F.concat(F.lit("Account Summary for the period from "), F.upper(_day("MMMM-yyyy")), F.lit(" to "), F.upper(F.date_format(F.add_months("day", 11), "MMMM-yyyy"))),
            _row("Opening Balance", "Payments", "Purchases", "Total Dues"), _row(_money(), "5.00", "6.00", _money(1)),
        ),
    }


_HDFC_NAMES = ("default", "regalia", "swiggy", "swiggy:guideline", "tata-neu-infinity", "diners-privilege", "regalia-gold")
_YEAR = "kind = 6"


@query(
    _sql(
        _HDFC_NAMES,
        start=f"case when {_YEAR} then date_trunc('month', day) when kind in (1, 3, 5) then day - interval 1 month + interval 1 day else day - 29 end",
        end=f"case when {_YEAR} then last_day(day + interval 11 month) else day end",
        reference="(ref + 10000000000)",
        estimated="kind in (1, 3, 5)",
        annual=_YEAR,
    )
)
def handler_hdfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older and the bank-wide layout, those of two cards, and a year-end statement."""
    return _read(spark, sf_dir, "hdfc", _hdfc())


def _icici() -> dict[str, Column]:
    body = (F.concat(F.lit("Invoice No: "), F.col("ref") + 1_000_000_000), _row("Previous Balance", "Purchases", "Payments"), _row(_money(), "5.00", "6.00"), "Total Amount due", F.concat(F.lit("`"), _money(1)))
    plain = _text("STATEMENT DATE", _day("MMMM d, yyyy"), _range("Statement period : ", "MMMM d, yyyy", " to "), *body)
    return {
        "coral": plain,
        "amazon": _text(plain, "SPENDS OVERVIEW", "Earnings transfered to", "Total Amount due", "3.00"),
        "amazon:early": _text(plain, "Earnings transfered to", "SPENDS   OVERVIEW", "MOST IMPORTANT TERMS AND CONDITIONS (MITC)", "9.00"),
    }


@query(_sql(("coral", "amazon", "amazon:early"), reference="(ref + 1000000000)"))
def handler_icici(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "icici", _icici())


def _idfc() -> dict[str, Column]:
    top = _range("", "dd/MMM/yyyy", " - ")
    classic = _text(top, "STATEMENT SUMMARY", "Total Balance  Opening Charges", F.concat(F.lit("r9.00   r"), _money(), F.lit("   r5.00   r"), _money(1)), "YOUR TRANSACTIONS")
    inline = _text(top, _row("Total Amount Due", "Minimum Amount Due", "Credit Limit"), F.concat(F.lit("r"), _money()), "Opening Balance", F.concat(F.lit("Equation = "), F.lit("1.00")), "YOUR TRANSACTIONS")
    stacked = _text(top, F.concat(F.lit("r"), _money(), F.lit(" ")), "+", "YOUR TRANSACTIONS", "Statement Summary", "Opening Balance", _money(), "Total Amount Due", _money(1))
    return {"wow": classic, "wow:inline": inline, "wow:stacked": stacked}


@query(f"""with {ORDERS_SQL}, k as (select *, ref % 3 as kind from orders_t)
select ref, 'wow' as variant, day as statement_date, (day - 29)::date as period_start, day as period_end, amount as opening,
       (case kind when 0 then amount + 1 when 1 then 1 else amount end)::decimal(18,2) as closing, null::varchar as reference, false as estimated, false as annual from k""")
def handler_idfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classic summary row, the inline equation and the stack above the transactions."""
    return _read(spark, sf_dir, "idfc", _idfc())


def _indusind() -> dict[str, Column]:
    head = (_range("Statement Period ", "dd/MM/yyyy", " To "), "Previous Balance", _money())
    return {
        "auraedge": _text(*head, "Total Outstanding", "12.00", _money(1), "Payment Due Date", "3.00"),
        "amex-epay": _text(*head, "Total Amount Due", F.concat(F.lit("Rs. "), _money(1)), "Rewards Opening Balance", "7.00"),
        "default": _text(*head, "Total Outstanding", F.concat(F.lit("Total 9.00 "), _money(1)), "Invoice 1"),
    }


@query(_sql(("auraedge", "amex-epay", "default")))
def handler_indusind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "indusind", _indusind())


def _pnb() -> dict[str, Column]:
    number = F.concat(F.lit("2024CC"), F.col("ref"))
    table = ("Account Summary", _row("Previous Balance", "Purchases", "Total Amount Due for Month"), _row(_money(), "5.00", _money(1)))
    early = _text(F.concat(F.lit("Invoice No : "), number), F.concat(F.lit("Invoice Date : "), _day("dd-MMM-yyyy")), _range("From ", "dd-MMM-yyyy", " to "), *table)
    late = _text(
        "Scan below QR to pay 01-JAN-2001", "Invoice No :", "Invoice Date :", "Total Amount Due for Month :", number, _day("dd-MMM-yyyy"), _money(1),
        F.concat(_day("dd-MMM-yyyy", 29), F.lit("  "), _day("dd-MMM-yyyy")), "Account Summary", _row("Previous Balance", "Purchases", "Payments"), _row(_money(), "5.00", "6.00"),
    )
    return {"platinum": early, "default": late}


@query(_sql(("platinum", "default"), reference="'2024CC' || ref"))
def handler_pnb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block at the top, and behind advertising with labels and values in stacks."""
    return _read(spark, sf_dir, "pnb", _pnb())


@query(_sql(("default", "ace")))
def handler_yes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _text(_range("Statement Period : ", "dd/MM/yyyy", " To "), "Previous Balance :", F.concat(F.lit("Rs. "), _money()), "Total Amount Due:", F.concat(F.lit("Rs. "), _money(1)), "Dear Cardmember,")
    dated = _text(F.concat(F.lit("Statement Date : "), _day("dd/MM/yyyy")), plain)
    return _read(spark, sf_dir, "yes", {"default": plain, "ace": dated})


@query(f"""with {ORDERS_SQL}
select distinct ref, day as date, note as description, (case when mark = 'CR' then amount else 0 end)::decimal(18,2) as credited, (case when mark = 'CR' then 0 else amount end)::decimal(18,2) as debited
from orders_t""")
def parse_hdfc_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order said twice in one statement, as a year-end line and as a monthly one."""
    from tallyspark.operators import registry

    o = orders(spark, sf_dir)
    annual = F.concat_ws("  ", _day("d-MMM-yyyy"), F.col("note"), _money(), F.col("mark"), F.lit("1234XX"))
    monthly = F.concat(F.lit(" "), _day("dd/MM/yyyy"), F.lit(" 10:11:12 "), F.col("note"), F.lit("  "), _money(), F.when(F.col("mark") == "CR", "Cr").otherwise(""))
    statements = o.select("ref", F.lit("hdfc").alias("bank"), F.lit("regalia").alias("variant"), _text("Statement", monthly, annual, monthly).alias("text"))
    return registry.read_statements(statements)[0].select("ref", "date", "description", "credited", "debited")

