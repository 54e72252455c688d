"""Statement heads to metadata: which text rules read the date, period, balances and reference of each bank's layouts.

The rules are data: a field of a layout is a list of steps, each the name of an expression and its arguments, and the first step that
finds something wins. A step may depend on a condition on the text. :func:`metadata` applies the layouts of all banks in one scan; a
statement is only read by its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import dates, periods, text
from tallyspark.operators import extract, idfc
from tallyspark.operators.selection import with_fallback

Step = tuple
_TO, _DASH = r"\s+to\s+", r"\s+-\s+"


@dataclass(frozen=True)
class Layout:
    """How one family of statements is cleaned and read."""

    date: tuple[Step, ...] = ()
    period: tuple[Step, ...] = ()
    opening: tuple[Step, ...] = ()
    closing: tuple[Step, ...] = ()
    reference: tuple[Step, ...] = ()
    trim_start: tuple[str, ...] = ()
    trim_end: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()  # that go without what stands below them
    labels: tuple[str, ...] = ()  # of a column of amounts that lacks them
    annual: bool = False  # year-end statements say their own period
    estimate: str = "never"  # whether a missing start is estimated: never, always, or a condition
    tolerance: str = "0.21"
    fiscal: bool = False
    prepare: str | None = None  # an expression that the balances' text goes through first


# Conditions on the text.


def is_guideline(t: Column) -> Column:
    """The bank-wide layout that stacks its summary."""
    return F.contains(F.upper(t), F.lit("DUPLICATE STATEMENT")) | t.rlike(r"(?i)Statement\s*\n\s*Date\s*:") | t.rlike(r"(?is)Account Summary.{0,240}?Opening\s*\n\s*Balance\b")


def _is_guideline_or_plain_summary(t: Column) -> Column:
    older = [text.has_label(t, x) for x in ("Billing Period", "PREVIOUS STATEMENT DUES", "TOTAL AMOUNT DUE")]
    return is_guideline(t) | ~(older[0] | older[1] | older[2]) & F.contains(F.upper(t), F.lit("ACCOUNT SUMMARY"))


def invoice_is_late(t: Column) -> Column:
    """The invoice block stands behind pages of advertising."""
    at = F.instr(t, "Invoice No :")
    return (at > 0) & ((at > 4000) | text.contains_any(F.substring_index(t, "Invoice No :", 1), ["Presenting Rupay Platinum", "Scan below QR", "PNB GENIE"]))


CONDITIONS: dict[str, Callable[[Column], Column]] = {
    "guideline": is_guideline,
    "guideline_or_summary": _is_guideline_or_plain_summary,
    "late_invoice": invoice_is_late,
    "inline": idfc.is_inline,
    "classic": idfc.is_classic,
    "not_less_than": lambda t: ~t.rlike(r"(?is)(?:than|the|less)\s+[\"']?\s{0,40}TOTAL\s+AMOUNT\s+DUE") & text.has_label(t, "TOTAL AMOUNT DUE"),
}


#: Conditions on what cleaning takes away.
_BEFORE_CLEANING = frozenset(["late_invoice"])


def _number(label: str, pattern: str) -> Callable[[Column], Column]:
    return lambda t: F.nullif(F.upper(F.regexp_extract(text.after_label(t, label, 500), pattern, 0)), F.lit(""))


STEPS: dict[str, Callable[..., Column]] = {
    "beside": dates.date_beside_label,
    "at": dates.date_at_label,
    "label_range": lambda t, label, joiner: dates.both(dates.date_range(text.after_label(t, label, 300), joiner)),
    "near": dates.range_near,
    "near_split": lambda t, context, joiner: dates.range_near(dates.join_split_day(t), context, joiner),
    "top": lambda t, joiner, n: dates.first_range(F.left(t, F.lit(n)), joiner),
    "two_dates": dates.two_date_line,
    "column": extract.table_column,
    "row": extract.row_after,
    "next": extract.next_line_amount,
    "beside_amount": extract.amount_beside_label,
    "single": extract.single_amount_after,
    "equation": extract.equation_after,
    "inline_amount": extract.inline_amount,
    "edge_opening": extract.edge_opening,
    "edge_closing": extract.edge_closing,
    "outstanding": extract.outstanding,
    "due_line": extract.due_line,
    "stacked": extract.stacked_amount,
    "classic": idfc.classic,
    "header_block": idfc.header_block,
    "sidecar": idfc.sidecar_opening,
    "leading_stack": idfc.leading_stack,
    "stack_after": idfc.stack_after,
    "stack": idfc.stack,
    "aan": lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)\bAAN\s*:?\s*(\d{10,})\b", 1), F.lit("")), _number("Alternate Account Number", r"\d{13,}")(t)),
    "number": lambda t, label, pattern: _number(label, pattern)(t),
}

_SUMMARY = {"opening": ("row", "Account Summary", 1, False, 3, 1200, False), "closing": ("row", "Account Summary", 1, True, 3, 1200, False)}


def _if(condition: str, *steps: Step) -> tuple[Step, ...]:
    return tuple(("if", condition, s) for s in steps)


def _unless(condition: str, *steps: Step) -> tuple[Step, ...]:
    return tuple(("unless", condition, s) for s in steps)


def _rows(anchor: str, *which: int) -> dict[str, tuple[Step, ...]]:
    return {"opening": tuple(("row", anchor, n, False) for n in which), "closing": tuple(("row", anchor, n, True) for n in which)}


# Labels, markers and phrases as the statements print them.

_GLANCE = ("Account Summary", "This Month's Statement At A Glance", "This Month s Statement At A Glance")  # cleaning makes a blank of the apostrophe
_BOB = Layout(
    date=(("beside", "Statement Date :"), ("label_range", "Statement Period :", _TO), ("top", _TO, 500)),
    period=(("label_range", "Statement Period :", _TO), ("top", _TO, 500)),
    opening=(*(("column", c, "Opening Balance") for c in _GLANCE), *_rows("GST No:", 2, 1)["opening"]),
    closing=(*(("column", c, "Closing Balance") for c in _GLANCE), *_rows("GST No:", 2, 1)["closing"]),
    trim_end=("Reward Summary at Card Level", "Page 1 of"),
)
_EDGE = Layout(date=(("top", _DASH, 2000),), period=(("top", _DASH, 2000),), opening=(("edge_opening",),), closing=(("edge_closing",),))
_EDGE_LABELS = ("Opening Balance", "Spends", "Cash Advances", "Fees & Charges", "Interest Charges", "Repayments & Refunds", "Paid via points", "Total Amount Due")
_EDGE_END = ("-" * 48 + " End of Transactions " + "-" * 48,)
_HDFC = Layout(
    date=(("at", "Statement Date"), ("at", "Address"), ("near", "Billing Period", _DASH)),
    period=(("near", "Billing Period", _DASH),),
    opening=(*_if("guideline", _SUMMARY["opening"]), *_unless("guideline", ("column", "Account Summary", "Opening Balance"), ("row", "Account Summary", 1, False))),
    closing=(*_if("guideline", _SUMMARY["closing"], ("due_line",)), *_unless("guideline", ("column", "Account Summary", "Total Dues"), ("row", "Account Summary", 1, True))),
    reference=(("aan",),),
    trim_end=("Reward Points Summary",),
    drop=(
        "Benefits on your card", "IMPORTANT INFORMATION", "Your Card Control Setting", "Purchase Indicator / Insights", "Offers on your card", "Important Information", "Useful Links",
        "To update your personal details, please write a letter to", "In case you wish to update the personal details", "Note : The  Available Credit Limit",
        "If the  Minimum Amount Due", "To Hotlist your Credit Card", "To Hotlist your credit card", "Credit Information Companies",
        "Making only the minimum payment every month", "Statement and Payment MITC", "with Credit Information Companies",
    ),
    annual=True, estimate="guideline", tolerance="0.99", fiscal=True,
)
_SPENDS_HEADING = "SPENDS OVERVIEW"
_ICICI_PERIOD = tuple(("label_range", x, _TO) for x in ("Statement period :", "Statement Period:", "Statement Period"))
_ICICI = Layout(
    date=(("at", "STATEMENT DATE"), *_ICICI_PERIOD),
    period=_ICICI_PERIOD,
    opening=(("column", "Previous Balance", "Previous Balance", 300),),
    closing=(("next", "Total Amount due"),),
    reference=(("number", "Invoice No:", r"\d{10,}"), ("number", "Invoice No :", r"\d{10,}")),
    trim_end=("MOST IMPORTANT TERMS AND CONDITIONS (MITC)",),
    drop=(
        "For exclusive", "offers, visit", "IMPORTANT MESSAGES", "Download the iMobile Pay app", "CREDIT CARD STATEMENT", "GREAT    OFFERS    ON   YOUR   CARD",
        "IMPORTANT     INFORMATION      ON  YOUR   CREDIT   CARD", "ICICl Bank Rewards", _SPENDS_HEADING, "# International Spends", "Others-100%",
        "www.icicibank.com/offers", "For any query, you may write to us on customer.care", "T&C apply",
    ),
    fiscal=True,
)
_IDFC = Layout(opening=(("column", "STATEMENT SUMMARY", "Opening Balance"),), closing=(("beside_amount", "Total Amount Due"),))
_DUE = "Total Amount Due"
_WOW = Layout(
    date=(("beside", "Statement Date"), ("top", _DASH, 500)),
    period=(("label_range", "Statement Date", _TO), ("top", _DASH, 500), ("label_range", "Statement Period", _DASH)),
    opening=(
        *_if("inline", ("sidecar",), ("inline_amount", "Opening Balance")),
        *_if("classic", ("classic", False), ("header_block", "Opening Balance")),
        *_unless("inline", ("leading_stack", False), ("stack_after", "Opening Balance"), ("stack", False), ("header_block", "Opening Balance")),
    ),
    closing=(
        *_if("inline", ("equation", _DUE), ("beside_amount", _DUE), ("inline_amount", _DUE)),
        *_if("classic", ("header_block", _DUE), ("classic", True), ("beside_amount", _DUE), ("equation", _DUE), ("inline_amount", _DUE)),
        *_unless("inline", ("leading_stack", True), ("stack_after", _DUE), ("stack", True), ("header_block", _DUE), ("beside_amount", _DUE), ("equation", _DUE), ("inline_amount", _DUE)),
    ),
    trim_end=("IMPORTANT INFORMATION",),
    drop=(
        "Payment Modes", "PAYMENT MODES", "Pay via our new Mobile App", "Need help Check out our FAQs", "Pay Now        Pay in EMI", "3X rewards on UPI", "Refer this Credit Card", "CHECK OUT WHY",
        "Covert your IDFC FIRST Bank Credit Card", "Late payment fee would be levied if Minimum", "SPECIAL BENEFITS ON YOUR CARD", "OFFER OF THE MONTH", "YOU MADE A GREAT CHOICE",
        "Enjoy the Convenience", "Your Card Information",
    ),
    prepare="marks",
)
_INDUSIND = Layout(
    date=(("near", "Statement Period", _TO), ("at", "Statement Date")),
    period=(("near", "Statement Period", _TO),),
    opening=(("next", "Previous Balance"),),
    closing=(("outstanding",), ("next", "Total Amount Due")),
    trim_end=("Rewards Opening Balance", "Rewards OpeningBalance"),
    drop=(
        "IMPORTANT MESSAGES:", "IMPORTANTMESSAGES:", "PROMOTIONAL MESSAGES:", "PROMOTIONALMESSAGES:", "MARKETING MESSAGE", "MARKETINGMESSAGE", "NOTE: *Total of points redeemed", "With IndusAlerts",
        "Secure your IndusInd Bank Credit Card on-the-go", "HOW TO MAKE PAYMENTS", "FEES & CHARGES", "CREDIT AND CASH WITHDRAWAL LIMITS", "Pleasedrawyourcheque",
        "Closest IndusInd Bank ATM Drop Box", "Manage your Card with instant Card blocking",
    ),
)
_MONTH_DUE = "Total Amount Due for Month"
_PNB = Layout(
    date=(("at", "Invoice Date :"), *_unless("late_invoice", ("near_split", "From", _TO))),
    period=(("near_split", "From", _TO), *_if("late_invoice", ("two_dates",))),
    opening=(("column", "Account Summary", "Previous Balance"),),
    closing=(("column", "Account Summary", _MONTH_DUE), *_if("late_invoice", ("stacked", _MONTH_DUE), ("stacked", "Total Amount Due")), ("beside_amount", _MONTH_DUE), ("beside_amount", "Total Amount Due :")),
    reference=(("number", "Invoice No :", r"(?i)\d{4}CC\d+"),),
    trim_end=("********** End of Statement **********",),
    drop=("Presenting Rupay Platinum", "PNB GENIE", "Scan and download", "Always get MORE", "Reward points details", "Why pay in Rupees", "CAUTION :", "Please make all Cheque"),
)
_SIGNET = Layout(
    date=(("beside", "Statement Date"), ("label_range", "Statement Period", _TO), ("top", _DASH, 2000)),
    period=(("label_range", "Statement Period", _TO),),
    opening=(("row", "Payment Due Date", 1, False),),
    closing=(("next", "Total Amount Due (in Rs.)"), ("row", "Payment Due Date", 1, True)),
    trim_end=("GSTN of Federal Bank",),
    drop=("The following illustration will indicate", "Organic Credit Cards", "Transaction dispute needs to be reported"),
)
_YES = Layout(
    date=(("beside", "Statement Date :"), ("near", "Statement Period", _TO)),
    period=(("near", "Statement Period", _TO),),
    opening=(("next", "Previous Balance :"),),
    closing=(("next", "Total Amount Due:"),),
    trim_end=("------------------End of the Statement------------------",),
    drop=(
        "Your Reward Points Summary", "To redeem your Reward Points", "Important information :", "Important Information:", "Presenting EMI facility through e-Statements", "SMS  Help  space",
        "Important Safety Instructions", "Dear Cardmember,", "Making only the minimum payment every month", "from a wide range of options, please visit", "Simply click on the highlighted transactions",
        "YES TOUCH PhoneBanking Number", "At YES BANK, maintaining confidentiality", "Please click here for the Most Important Terms and Conditions", "YES BANK Credit Cards GSTIN", "Basis RBI circular on",
    ),
)
_PREVIOUS = "PREVIOUS STATEMENT DUES"

LAYOUTS: dict[str, Layout] = {
    "bob": _BOB,
    "bob_easy": replace(
        _BOB,
        drop=(
            "Please register your Mobile No. & E-Mail ID", "Please register your Mobile No. and Email ID", "Please register your Mobile Number & Email ID", "Loan Summary", "GO DIGITAL to SELF-SERVICE",
            "YOUR CONVENIENCE IS OUR PRIORITY", "Did You Know", "SCHEDULE OF CHARGES", "IMPORTANT", "CIBIL Information", "Billing Dispute Resolution", "For T&C & details on Fee/charges",
            "Important Security Update for Your BOBCARD", "via the BOBCARD mobile app or portal", "Clickheretoknowmore",
        ),
    ),
    "edge_plain": _EDGE,
    "csb_edge": replace(_EDGE, trim_end=_EDGE_END, labels=_EDGE_LABELS),
    "federal_edge": replace(_EDGE, trim_end=_EDGE_END, labels=_EDGE_LABELS, drop=("IMPORTANT INFORMATION", "Issued by")),
    "signet": _SIGNET,
    "hdfc": _HDFC,
    "swiggy": replace(
        _HDFC,
        estimate="always",
        opening=(*_if("guideline_or_summary", _SUMMARY["opening"]), *_unless("guideline_or_summary", ("row", _PREVIOUS, 1, False, 3, 600, False))),
        closing=(*_if("guideline_or_summary", _SUMMARY["closing"], ("due_line",)), *_unless("guideline_or_summary", *_if("not_less_than", ("row", "TOTAL AMOUNT DUE", 1, False, 1, 400, False)))),
    ),
    "tata_neu": replace(
        _HDFC,
        opening=(*_if("guideline", _SUMMARY["opening"]), *_unless("guideline", ("equation", _PREVIOUS))),
        closing=(*_if("guideline", _SUMMARY["closing"], ("due_line",)), *_unless("guideline", ("single", "TOTAL AMOUNT DUE"))),
        trim_end=("Bonus NeuCoins Summary",),
        drop=(*_HDFC.drop, "NeuCoins with Bank Opening NeuCoins", "Eligible for EMI", "CONVERT TO EMI"),
    ),
    "icici": _ICICI,
    "amazon": replace(_ICICI, trim_end=("Earnings transfered to", "Amazon Pay balance*"), drop=(*(d for d in _ICICI.drop if d != _SPENDS_HEADING), "EARNINGS"), phrases=(_SPENDS_HEADING,)),
    "idfc": _IDFC,
    "wow": _WOW,
    "indusind": _INDUSIND,
    "pnb": _PNB,
    "yes": _YES,
}


@dataclass(frozen=True)
class Handler:
    """A bank and card variant: its layout, and the mails and texts that are its own."""

    bank: str
    variant: str
    layout: str
    subjects: tuple[str, ...]
    annual_subjects: tuple[str, ...] = ()
    body: tuple[str, ...] = ()
    exclude: tuple[str, ...] = field(default=())


_ICICI_SUBJECT = "ICICI Bank Credit Card Statement for the period"
_SPENDS = ("ANNUAL SPEND SUMMARY", "CARD WISE SUMMARY FOR ACCOUNT OF", "MONTH WISE SPENDS ON YOUR ACCOUNT", "GLIMPSE OF HOW YOU SPENT")
_YEAR_END = ("Year End Statement Summary",)

# The banks and variants with a handler.
HANDLERS = (
    Handler("bob", "default", "bob", ("E-statement for your BOB", "E-statement for your BOBCARD", "Duplicate Statement from BOB Card")),
    Handler("bob", "easy", "bob_easy", ("E-statement for your BOB EASY credit card ending in", "E-statement for your BOBCARD EASY credit card ending in", "E-statement for your BOBCARD RUPAY EASY credit card ending", "Duplicate Statement from BOB Card")),
    Handler("csb", "default", "edge_plain", ("Credit Card Statement",)),
    Handler("csb", "edge", "csb_edge", ("Edge CSB Bank RuPay Credit Card Statement",)),
    Handler("federal", "default", "edge_plain", ("Federal Bank Credit Card Statement",)),
    Handler("federal", "edge", "federal_edge", ("Edge Federal Bank Credit Card Statement",)),
    Handler("federal", "signet", "signet", ("Credit Card Statement",), body=("<title>Signet</title>",)),
    Handler("hdfc", "default", "hdfc", ("HDFC Bank Credit Card Statement",), _YEAR_END),
    Handler("hdfc", "diners-privilege", "hdfc", ("Your HDFC Bank - Diners Club International Credit Card Statement",), _YEAR_END),
    Handler("hdfc", "regalia", "hdfc", ("Your HDFC Bank - Regalia MasterCard Credit Card Statement",), _YEAR_END),
    Handler("hdfc", "regalia-gold", "hdfc", ("Your HDFC Bank - HDFC Bank Regalia Gold Credit Card Statement",), _YEAR_END),
    Handler("hdfc", "swiggy", "swiggy", ("Swiggy HDFC Bank Credit Card Statement",), _YEAR_END),
    Handler("hdfc", "tata-neu-infinity", "tata_neu", ("Your HDFC Bank - Tata Neu Infinity HDFC Bank Credit Card Statement",), _YEAR_END),
    Handler("icici", "default", "icici", (_ICICI_SUBJECT,)),
    Handler("icici", "coral", "icici", (_ICICI_SUBJECT,)),
    Handler("icici", "platinum", "icici", (_ICICI_SUBJECT,)),
    Handler("icici", "amazon", "amazon", (f"Amazon Pay {_ICICI_SUBJECT}", _ICICI_SUBJECT)),
    Handler("idfc", "default", "idfc", ("Credit Card Statement",)),
    Handler("idfc", "wow", "wow", ("FIRST WOW! Credit Card Statement", "FIRST WOW Credit Card Statement", "Your Credit Card Statement")),
    Handler("indusind", "default", "indusind", ("IndusInd Bank Credit Card",), exclude=_SPENDS),
    Handler("indusind", "auraedge", "indusind", ("IndusInd Bank Credit Card",), exclude=_SPENDS),
    Handler("indusind", "amex-epay", "indusind", ("IndusInd Bank Credit Card",), exclude=_SPENDS),
    Handler("pnb", "default", "pnb", ("Your PNB Credit Card Statement for the month",)),
    Handler("pnb", "platinum", "pnb", ("Your PNB Credit Card Statement for the month",)),
    Handler("yes", "default", "yes", ("Your YES_BANK",)),
    Handler("yes", "ace", "yes", ("Your YES_BANK_ACE Rupay Credit Card E-Statement",)),
)


def registry(spark: SparkSession) -> DataFrame:
    """The handlers as rows: bank, variant, layout, tolerance, fiscal, subjects, annual_subjects, body, exclude."""
    rows = [(h.bank, h.variant, h.layout, LAYOUTS[h.layout].tolerance, LAYOUTS[h.layout].fiscal, list(h.subjects), list(h.annual_subjects), list(h.body), list(h.exclude)) for h in HANDLERS]
    kinds = "bank string, variant string, layout string, tolerance string, fiscal boolean, subjects array<string>, annual_subjects array<string>, body array<string>, exclude array<string>"
    return spark.createDataFrame(rows, kinds).withColumn("tolerance", F.col("tolerance").cast("decimal(18,2)"))


def clean(t: Column, name: str) -> Column:
    """A statement's text as a layout wants it: cut to its markers, without odd characters and sections that aren't data."""
    rule = LAYOUTS[name]
    if name == "amazon":  # the earnings end the statement unless the spends come after them
        earnings, spends = [F.instr(t, m) for m in rule.trim_end], F.instr(t, _SPENDS_HEADING)
        before = (spends > 0) & ((earnings[0] > 0) & (earnings[0] < spends) | (earnings[1] > 0) & (earnings[1] < spends))
        short = text.trim_by_markers(t, [], list(rule.trim_end))
        cut = F.when(before | ((earnings[0] == 0) & (earnings[1] == 0)), text.trim_by_markers(t, [], list(_ICICI.trim_end))).otherwise(short)
    elif name == "pnb":
        cut = F.when(invoice_is_late(t), text.trim_by_markers(t, ["Invoice No :"], list(rule.trim_end))).otherwise(text.trim_by_markers(t, [], list(rule.trim_end)))
    else:
        cut = text.trim_by_markers(t, list(rule.trim_start), list(rule.trim_end))
    out = text.drop_sections(text.sanitize(cut), list(rule.drop))
    if rule.phrases:
        out = text.drop_phrases(out, list(rule.phrases))
    return text.label_column(out, rule.labels) if rule.labels else out


def _chain(t: Column, steps: tuple[Step, ...], said: Column | None = None) -> list[Column]:
    """The columns of ``steps``; ``said`` has what :func:`_said` found in ``t``."""

    def one(step: Step) -> Column:
        kind, *args = step
        if kind in ("if", "unless"):
            return F.when(said[args[0]] if kind == "if" else ~said[args[0]], one(args[1]))
        return STEPS[kind](said["parts"] if kind in idfc.OF_PARTS else t, *args)

    return [one(s) for s in steps]


def _asked(steps: tuple[Step, ...]) -> set[str]:
    """The conditions that ``steps`` depend on, and "parts" where one reads these."""
    found = set()
    for step in steps:
        while step[0] in ("if", "unless"):
            found.add(step[1])
            step = step[2]
        if step[0] in idfc.OF_PARTS:
            found.add("parts")
    return found


def _said(t: Column, steps: tuple[Step, ...], raw: Column, body: Callable[[Column | None], Column]) -> Column:
    """``body`` of what several of ``steps`` ask of the text, each found once."""
    asked = _asked(steps)
    if not asked:
        return body(None)

    def conditions(parts: Column | None) -> Column:
        args = lambda n: (t, parts) if n == "classic" else (raw if n in _BEFORE_CLEANING else t,)
        found = [F.coalesce(CONDITIONS[n](*args(n)), F.lit(False)).alias(n) for n in sorted(asked - {"parts"})]
        return text.let(F.struct(*found, *([parts.alias("parts")] if parts is not None else [])), body)

    return text.let(idfc.parts(t), conditions) if asked & {"parts", "classic"} else conditions(None)


def read(t: Column, name: str, raw: Column | None = None, balances: bool = True) -> Column:
    """(date, start, end, estimated, annual, opening, closing, reference) of a cleaned text by a layout; ``raw`` is the text before that.

    Without ``balances`` the last three aren't looked for and aren't there.
    """
    rule = LAYOUTS[name]
    raw = t if raw is None else raw
    ranges = {"label_range", "near", "near_split", "top", "two_dates"}

    def kind(step: Step) -> str:
        return kind(step[2]) if step[0] in ("if", "unless") else step[0]

    def amount(x: Column, steps: tuple[Step, ...], asked: Column | None) -> Column:
        return F.coalesce(*_chain(x, steps, asked), F.lit(None).cast("decimal(18,2)"))

    def days(asked: Column | None) -> Column:
        """The day and the period; steps of the day that are those of the period aren't taken again."""
        n, steps = len(rule.period), rule.date
        at = next((i for i in range(len(steps) - n + 1) if n and steps[i : i + n] == rule.period), None)

        def day(p: Column) -> Column:
            each = lambda own: [c["end"] if kind(s) in ranges else c for s, c in zip(own, _chain(t, own, asked), strict=True)]
            found = each(steps) if at is None else [*each(steps[:at]), p["end"], *each(steps[at + n :])]
            return F.struct(F.coalesce(*found, F.lit(None).cast("date")).alias("day"), p.alias("period"), F.when(said, year).alias("year"))

        return text.let(F.coalesce(*_chain(t, rule.period, asked), F.lit(None).cast("struct<start:date,end:date>")), day)

    year = dates.year_end_range(t) if rule.annual else F.lit(None).cast("struct<start:date,end:date>")
    said = F.contains(F.lower(t), F.lit("year end statement")) | F.contains(F.lower(t), F.lit("account summary"))
    may = {"never": F.lit(False), "always": F.lit(True)}.get(rule.estimate)
    may = CONDITIONS[rule.estimate](t) if may is None else may

    def head(x: Column) -> Column:
        annual = x["year"].isNotNull()
        return F.struct(
            F.when(annual, x["year"]["end"]).otherwise(x["day"]).alias("date"), F.when(annual, x["year"]["start"]).otherwise(x["period"]["start"]).alias("start"),
            F.coalesce(x["year"]["end"], x["period"]["end"], x["day"]).alias("end"), annual.alias("annual"),
        )

    def money(x: Column) -> Column:
        return _said(x, (*rule.opening, *rule.closing), raw, lambda asked: F.struct(amount(x, rule.opening, asked).alias("opening"), amount(x, rule.closing, asked).alias("closing")))

    found = text.let(text.let(_said(t, (*rule.date, *rule.period), raw, days), head), lambda h: F.struct(h.alias("h"), (h["start"].isNull() & h["end"].isNotNull() & may).alias("estimated")))
    ready = text.merge_marks(text.join_detached_marks(t)) if rule.prepare == "marks" else t

    def dated(h: Column) -> list[Column]:
        start = F.when(h["estimated"], periods.approximate_start(h["h"]["end"])).otherwise(h["h"]["start"])
        return [h["h"]["date"].alias("date"), start.alias("start"), h["h"]["end"].alias("end"), h["estimated"].alias("estimated"), h["h"]["annual"].alias("annual")]

    if not balances:
        return text.let(found, lambda h: F.struct(*dated(h)))

    def both(h: Column, m: Column) -> Column:
        return F.struct(
            *dated(h), m["opening"].alias("opening"), m["closing"].alias("closing"), F.coalesce(*_chain(t, rule.reference), F.lit(None).cast("string")).alias("reference"),
        )

    return text.let(found, lambda h: text.let(text.let(ready, money), lambda m: both(h, m)))


@cache
def _cleaning(application: str, name: str, into: str) -> Column:
    """What a layout makes of the column ``into``. Such an expression takes seconds to build and holds no data, so a session builds it once."""
    return clean(F.col(into), name)


@cache
def _reading(application: str, name: str, into: str, raw: str, balances: bool) -> Column:
    return read(F.col(into), name, F.col(raw), balances)


def reading(spark: SparkSession, name: str, into: str, raw: str, balances: bool = True) -> Column:
    """:func:`read` of the columns ``into`` and ``raw``."""
    return _reading(spark.sparkContext.applicationId, name, into, raw, balances)


def layout_names(banks: tuple[str, ...] | None) -> list[str]:
    """The layouts of ``banks``, of all without them."""
    return sorted({h.layout for h in HANDLERS if banks is None or h.bank in banks})


def with_layout(statements: DataFrame) -> DataFrame:
    """``statements`` (bank, variant, ..) with the layout that reads each; a variant without a handler is read by its bank's default, and null is none."""
    known = registry(statements.sparkSession).select("bank", "variant", F.col("layout").alias("rule"))
    return with_fallback(statements, known).withColumnRenamed("rule", "layout")


def metadata(statements: DataFrame, banks: tuple[str, ...] | None = None, into: str = "text") -> tuple[DataFrame, DataFrame]:
    """(read, unread) of ``statements`` (bank, variant, .., text).

    read has the cleaned text, tolerance and fiscal of the handler, and statement_date, period_start, period_end, estimated, annual,
    opening, closing and reference. A variant without a handler is read by its bank's default. ``banks`` names those that can occur,
    which keeps the plan small.
    """
    ruled, names = with_layout(statements), layout_names(banks)
    pick = lambda f: F.coalesce(*(F.when(F.col("layout") == n, f(n)) for n in names))
    mine = F.coalesce(F.col("layout").isin(names), F.lit(False))
    application = statements.sparkSession.sparkContext.applicationId
    cleaned = ruled.where(mine).withColumn("__raw", F.col(into)).withColumn(into, pick(lambda n: _cleaning(application, n, into)))
    found = cleaned.withColumn("__m", pick(lambda n: reading(statements.sparkSession, n, into, "__raw")))
    found = found.withColumns({"tolerance": pick(lambda n: F.lit(LAYOUTS[n].tolerance)).cast("decimal(18,2)"), "fiscal": pick(lambda n: F.lit(LAYOUTS[n].fiscal))})
    columns = {"statement_date": "date", "period_start": "start", "period_end": "end", **{c: c for c in ("estimated", "annual", "opening", "closing", "reference")}}
    return found.withColumns({k: F.col(f"__m.{v}") for k, v in columns.items()}).drop("__m", "__raw"), ruled.where(~mine).drop("layout")
