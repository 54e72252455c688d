"""Balances from statement text: where an amount stands relative to labels, headers and anchors. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.amounts import count_tokens, first_amount, first_token, last_amount, nearest, parse_amount, tokens
from tallyspark.functions.dates import first_date
from tallyspark.functions.text import _col, after_label, first_where, from_label, label_pattern, let, lines


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def _after_line(text: Column | str, pattern: str) -> Column:
    """The lines behind the first one that matches; none if no line does."""
    none = F.array().cast("array<string>")

    def behind(rows: Column) -> Column:
        return let(first_where(rows, lambda x: x.rlike(pattern)), lambda at: F.when(at.isNull(), none).otherwise(F.slice(rows, at + 2, F.size(rows))))

    return let(lines(text), behind)


def amount_beside_label(text: Column | str, label: str, width: int = 400) -> Column:
    """The first amount with decimals behind the label, lines that only say a date left out."""
    rest = F.filter(lines(after_label(text, label, width)), lambda x: ~x.rlike(r"^\s*\d{1,2}[/-][\dA-Za-z]{2,3}[/-]\d{2,4}\s*$"))
    return first_amount(F.array_join(rest, "\n"), decimals=True)


def amount_below_label(text: Column | str, label: str, within: int = 5) -> Column:
    """The first amount on one of the lines below the label's line; one with a currency sign is preferred."""
    below = F.array_join(F.slice(_after_line(text, label_pattern(label)), 1, within), "\n")
    signed = F.regexp_extract(below, r"(?i)(?:Rs\.?|INR|₹)\s*-?[\d,]+(?:\.\d+)?(?:\s*\b(?:Cr|Dr)\b)?", 0)
    return F.coalesce(parse_amount(F.nullif(signed, F.lit(""))), first_amount(below, decimals=True))


def nth_row_after(text: Column | str, anchor: str, n: int = 1, least: int = 1, last: bool = True) -> Column:
    """The last (or first) amount of the n-th line below the anchor that has at least ``least`` amounts."""
    rows = F.filter(_after_line(text, label_pattern(anchor)), lambda x: count_tokens(x, decimals=True) >= least)
    return (last_amount if last else first_amount)(F.get(rows, F.lit(n - 1)), decimals=True)


def lone_amount_after(text: Column | str, anchor: str) -> Column:
    """The amount of the first line below the anchor that is nothing but an amount."""
    only = F.filter(_after_line(text, label_pattern(anchor)), lambda x: x.rlike(r"(?i)^\s*(?:(?:Rs\.?|INR|₹)\s*)?-?[\d,]+\.\d{1,2}(?:\s*(?:Cr|Dr))?\s*$"))
    return parse_amount(_first(only))


def section_total(text: Column | str, anchor: str, total: str = "Total") -> Column:
    """In the section below the anchor the last line that is one amount, else the last amount of the total's line."""
    rest = _after_line(text, label_pattern(anchor))
    single = F.filter(rest, lambda x: count_tokens(x, decimals=True) == 1)
    line = _first(F.filter(rest, lambda x: x.rlike(rf"(?i)^\s*{total}\b")))
    return F.coalesce(last_amount(line, decimals=True), first_amount(_last(single), decimals=True))


def column_below_header(text: Column | str, header: str, column: str, least: int = 3) -> Column:
    """In the first line with ``least`` amounts below the header line, the amount nearest to the column's name in it."""
    rows = lines(text)
    pattern = label_pattern(header)
    head = _first(F.filter(rows, lambda x: x.rlike(pattern)))
    position = F.regexp_instr(head, F.lit(label_pattern(column))) - 1
    found = tokens(_first(F.filter(_after_line(text, pattern), lambda x: count_tokens(x, decimals=True) >= least)), decimals=True)
    return let(position, lambda p: F.when(p >= 0, nearest(found, p)))


def unlabelled_opening(text: Column | str) -> Column:
    """The amount of the first line that starts with a date and goes on with a currency sign."""
    return parse_amount(F.nullif(F.regexp_extract(_col(text), r"(?im)^\s*\d{1,2}[ /-][\dA-Za-z]{2,3}[ /-]\d{2,4}\s+(Rs\.?\s*[\d,]+\.\d{2}(?:\s*(?:Cr|Dr))?)", 1), F.lit("")))


def reference(text: Column | str, label: str, width: int = 400) -> Column:
    """The first word of at least six capital letters or digits behind the label."""
    return F.nullif(F.regexp_extract(after_label(text, label, width), r"\b([A-Z0-9]{6,})\b", 1), F.lit(""))


_BOUNDARY = r"(?i)Bonus/Reward|Transaction Date|Transaction Details|Reward Summary"
_HEADER = r"(?i)Opening|Balance|Total\s+Dues|Credits|Debits|Charges|Payment|Purchase|Finance"
_DATE_ONLY = r"(?i)^\s*\d{1,2}/(?:\d{1,2}|[A-Z]{3})/\d{2,4}(?:\s+-\s+\d{1,2}/(?:\d{1,2}|[A-Z]{3})/\d{2,4})?\s*$"
_RS = r"(?i)Rs\.?\s*-?[\d,]*\d(?:\.\d+)?"


def _all(x: Column) -> Column:
    return tokens(x)


def _shown(window: Column) -> Column:
    """The lines that aren't blank and don't only say a date."""
    return F.filter(lines(window), lambda x: (F.trim(x) != "") & ~x.rlike(_DATE_ONLY))


def table_rows(window: Column) -> Column:
    """(head, data) of a summary table: lines up to a boundary; data starts at the first row of three amounts behind a header."""
    def before(rows: Column) -> Column:
        return let(first_where(rows, lambda x: x.rlike(_BOUNDARY)), lambda end: F.when(end.isNull(), rows).otherwise(F.slice(rows, 1, end)))

    def parted(rows: Column) -> Column:
        head = first_where(rows, lambda x: x.rlike(_HEADER))
        at = let(head, lambda h: h + 1 + first_where(F.slice(rows, h + 2, F.size(rows)), lambda x: count_tokens(x) >= 3))
        return let(at, lambda n: F.when(n.isNotNull(), F.struct(F.slice(rows, 1, n).alias("head"), F.slice(rows, n + 1, F.size(rows)).alias("data"))))

    return let(let(_shown(window), before), parted)


def table_column(text: Column | str, context: str, column: str, width: int = 2000) -> Column:
    """In the table that begins at the context, the amount of the first row that stands nearest to the column's name in the header.

    A name that the header breaks over lines is found by its last word, else by its first.
    """
    words = column.split()

    def read(found: Column) -> Column:
        def place(name: str, last: bool = False) -> Column:
            at = F.filter(F.transform(found["head"], lambda x: F.regexp_instr(x, F.lit(label_pattern(name))) - 1), lambda p: p >= 0)
            return _last(at) if last else _first(at)

        position = F.coalesce(place(column), place(words[-1], last=True), place(words[0])) if len(words) > 1 else place(column)
        return let(position, lambda p: F.when(p.isNotNull(), nearest(_all(_first(found["data"])), p)))

    return let(table_rows(from_label(text, context, width)), read)


def row_after(text: Column | str, anchor: str, n: int = 1, last: bool = True, least: int = 3, width: int = 1200, decimals: bool = True) -> Column:
    """The last (or first) amount of the n-th line behind the anchor, the rest of its own included, that has ``least`` amounts."""
    rows = F.filter(lines(after_label(text, anchor, width)), lambda x: count_tokens(x, decimals) >= least)
    return (last_amount if last else first_amount)(F.get(rows, F.lit(n - 1)), decimals)


def next_line_amount(text: Column | str, label: str, width: int = 400) -> Column:
    """The first amount on the lines below the label's line; on a line one with decimals is preferred."""
    below = let(lines(after_label(text, label, width)), lambda rows: F.slice(rows, 2, F.size(rows)))
    each = F.transform(below, lambda x: parse_amount(F.coalesce(first_token(x, decimals=True), first_token(x))))
    return _first(F.filter(each, lambda a: a.isNotNull()))


def single_amount_after(text: Column | str, anchor: str, width: int = 500) -> Column:
    """The amount of the first line behind the anchor that has just one."""
    return first_amount(_first(F.filter(lines(after_label(text, anchor, width)), lambda x: count_tokens(x) == 1)))


def equation_after(text: Column | str, anchor: str, width: int = 600) -> Column:
    """The first amount of the first line behind the anchor that has an equals sign."""
    rows = F.filter(lines(after_label(text, anchor, width)), lambda x: F.contains(x, F.lit("=")) & (count_tokens(x) > 0))
    return first_amount(_first(rows))


def inline_amount(text: Column | str, label: str) -> Column:
    """The first amount on the label's line."""
    row = _first(F.filter(lines(text), lambda x: x.rlike(label_pattern(label))))
    return first_amount(row)


def edge_opening(text: Column | str) -> Column:
    """The amount in rupees on the first line that has a date before it."""
    dated = rf"(?i)(?:\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}\s+[A-Z]{{3}}\s+\d{{4}}).*?({_RS[4:]})"
    row = _first(F.filter(lines(text), lambda x: x.rlike(dated)))
    return parse_amount(F.regexp_extract(row, dated, 1))


def edge_closing(text: Column | str) -> Column:
    """The first amount in rupees."""
    return parse_amount(F.nullif(F.regexp_extract(_col(text), f"({_RS})", 1), F.lit("")))


def outstanding(text: Column | str, anchor: str = "Total Outstanding") -> Column:
    """In the 500 characters below the anchor's line, up to rewards, invoice or due date: the last line of one amount, else the total's last."""
    def upto(rows: Column) -> Column:
        end = first_where(rows, lambda x: x.rlike(r"(?i)^\s*(?:Rewards\b|Invoice\b|Payment\s*Due\s*Date\b)"))
        return let(end, lambda n: F.when(n.isNull(), rows).otherwise(F.slice(rows, 1, n)))

    def read(rows: Column) -> Column:
        single = F.filter(rows, lambda x: count_tokens(x, decimals=True) == 1)
        total = F.filter(rows, lambda x: x.rlike(r"(?i)^\s*Total\b") & (count_tokens(x, decimals=True) > 1))
        return F.coalesce(first_amount(_last(single), decimals=True), last_amount(_last(total), decimals=True))

    below = let(lines(after_label(text, anchor, 600)), lambda rows: F.filter(F.slice(rows, 2, F.size(rows)), lambda x: F.trim(x) != ""))
    return let(let(below, upto), read)


def due_line(text: Column | str, label: str = "Payment Due Date", width: int = 400) -> Column:
    """The first amount of the first line behind the label that has a date and, the date's digits apart, two amounts."""
    rows = F.filter(lines(after_label(text, label, width)), lambda x: (count_tokens(x, decimals=True) >= 2) & first_date(x).isNotNull())
    return first_amount(_first(rows), decimals=True)


def stacked_amount(text: Column | str, label: str, begin: str = "Invoice No :") -> Column:
    """Labels stand one below the other from the line that begins them, their values likewise further down: the value at the label's place."""
    value = r"(?i)^\s*(?:.*\d{4}CC\d+.*|.*\d+X+\d+.*|\d{1,2}[/-](?:\d{1,2}|[A-Z]{3})[/-]\d{2,4}|-?\d[\d,]*(?:\.\d+)?)\s*$"

    def read(rest: Column, n: Column) -> Column:
        at = first_where(F.slice(rest, 1, n), lambda x: x.rlike(label_pattern(label)))
        values = F.slice(rest, n + 1, F.size(rest))
        return let(values, lambda v: first_amount(F.get(v, first_where(v, lambda x: x.rlike(value)) + at)))

    def behind(rows: Column) -> Column:
        return let(first_where(rows, lambda x: F.contains(x, F.lit(begin))), lambda start: F.slice(rows, start + 1, F.size(rows)))

    count = lambda rest: F.coalesce(first_where(rest, lambda x: ~F.trim(x).endswith(":")), F.size(rest))
    return let(let(lines(text), behind), lambda rest: let(count(rest), lambda n: read(rest, n)))
