"""Summaries that the text layer takes apart: amounts above their labels, labels and amounts in stacks, equations in one line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.amounts import count_tokens, first_amount, nearest, tokens
from tallyspark.functions.text import after_label, first_where, from_label, label_pattern, let, lines
from tallyspark.operators.extract import _DATE_ONLY, table_rows

_INLINE = r"(?i)Total Amount Due.*Minimum Amount Due.*Credit Limit"
_RUPEE = r"(?i)(?:^|\s)r\s*-?\d[\d,]*(?:\.\d+)?"


def _unsigned(x: Column) -> Column:
    """A line without an r for the rupee sign."""
    return F.regexp_replace(x, r"(?i)(^|\s)r\s*(?=-?\d)", "$1")


def _amounts(x: Column) -> Column:
    """Amounts of a line, those written with an r for the rupee sign included."""
    return tokens(_unsigned(x))


def _get(items: Column, i: int) -> Column:
    return F.get(items, F.lit(i))["amount"]


def is_inline(t: Column) -> Column:
    return t.rlike(_INLINE)


def _summary(t: Column) -> Column:
    """The amounts of the classic summary row: the first with four rupee signs below the heading."""
    rows = F.filter(lines(from_label(t, "STATEMENT SUMMARY", 2000)), lambda x: F.regexp_count(x, F.lit(_RUPEE)) >= 4)
    return _amounts(F.get(rows, F.lit(0)))


def _block(t: Column) -> Column:
    """(head, data) of the table before the transactions and before the summary's heading."""
    before = let(F.split(t, label_pattern("YOUR TRANSACTIONS"), 2), lambda p: F.when(F.size(p) > 1, F.get(p, F.lit(0))).otherwise(F.left(t, F.lit(3000))))
    upper = lambda b: F.get(F.split(b, label_pattern("STATEMENT SUMMARY"), 2), F.lit(0))
    return let(before, lambda b: table_rows(upper(b)))


#: Steps that read the parts of a text instead of the text.
OF_PARTS = frozenset(["classic", "header_block", "leading_stack", "stack", "stack_after"])


def parts(t: Column) -> Column:
    """What several steps read: the summary row, the table, and the lines and amounts of both stacks."""
    before = F.get(F.split(t, label_pattern("YOUR TRANSACTIONS"), 2), F.lit(0))
    stacks = lambda rows: F.struct(_money(rows["leading"]).alias("leading"), _money(rows["below"]).alias("stack"), rows["below"].alias("below"))
    found = F.struct(_until(lines(before)).alias("leading"), _until(lines(from_label(t, "Statement Summary", 2500))).alias("below"))
    return let(let(found, stacks), lambda s: F.struct(_summary(t).alias("summary"), _block(t).alias("block"), s.alias("stacks")))


def is_classic(t: Column, found: Column) -> Column:
    return ~is_inline(t) & (F.coalesce(F.size(found["summary"]) >= 4, F.lit(False)) | found["block"].isNotNull())


def classic(found: Column, last: bool) -> Column:
    """Opening is the second amount of the summary row, unless it is zero; closing the last."""
    if last:
        return F.try_element_at(found["summary"], F.lit(-1))["amount"]
    return let(_get(found["summary"], 1), lambda a: F.when(a != 0, a))


def header_block(found: Column, column: str) -> Column:
    """In a table whose data is broken over lines the third amount of the last (opening) or first line; else by column."""
    opening = column == "Opening Balance"

    def read(found: Column, data: Column) -> Column:
        row = F.try_element_at(data, F.lit(-1)) if opening else F.get(data, F.lit(0))
        enough = F.size(data) >= 2 if opening else F.lit(True)
        split = let(_amounts(row), lambda r: F.when((F.size(r) >= 3) & enough, _get(r, 2)))
        at = F.get(F.filter(F.transform(found["head"], lambda x: F.regexp_instr(x, F.lit(label_pattern(column))) - 1), lambda p: p >= 0), F.lit(0))
        return F.coalesce(split, let(at, lambda p: F.when(p.isNotNull(), nearest(_amounts(F.array_join(data, " ")), p))))

    def rows(found: Column) -> Column:
        n = F.coalesce(first_where(found["data"], lambda x: count_tokens(_unsigned(x)) < 2), F.size(found["data"]))
        return let(F.slice(found["data"], 1, n), lambda data: read(found, data))

    return rows(found["block"])


def sidecar_opening(t: Column) -> Column:
    """The amount on the line above a line that only says Opening Balance, if that is of the summary."""

    def above(rows: Column) -> Column:
        return let(first_where(rows, lambda x: x.rlike(label_pattern("Opening Balance")) & (count_tokens(x) == 0)), lambda at: F.when(at > 0, F.get(rows, at - 1)))

    line = let(F.filter(lines(t), lambda x: F.trim(x) != ""), above)
    return let(line, lambda x: F.when(x.rlike(r"(?i)^\s*r|Rewards\s+Summary"), first_amount(_unsigned(x))))


def _until(rows: Column) -> Column:
    """Lines before a sign of the equation or the minimum due; the header row of the inline layout is none."""
    def upto(r: Column) -> Column:
        end = first_where(r, lambda x: x.rlike(r"(?i)Minimum Amount Due|^\s*[+=-]\s*$") & ~x.rlike(_INLINE))
        return let(end, lambda n: F.when(n.isNull(), r).otherwise(F.slice(r, 1, n)))

    return let(rows, upto)


def _money(rows: Column) -> Column:
    """The amounts of lines that are a rupee amount or have decimals."""
    kept = F.filter(rows, lambda x: ~x.rlike(_DATE_ONLY) & (x.rlike(r"(?i)^\s*r\s*-?\d") | x.rlike(r"[\d,]+\.\d{2}")))
    return F.filter(F.transform(kept, lambda x: first_amount(_unsigned(x))), lambda a: a.isNotNull())


def _pick(found: Column, last: bool) -> Column:
    """The last amount, or the first that isn't zero."""
    if last:
        return F.try_element_at(found, F.lit(-1))
    return let(found, lambda f: F.coalesce(F.get(F.filter(f, lambda a: a != 0), F.lit(0)), F.get(f, F.lit(0))))


def leading_stack(found: Column, last: bool) -> Column:
    """In the lines from the top to the first sign, before the transactions."""
    return _pick(found["stacks"]["leading"], last)


def stack(found: Column, last: bool) -> Column:
    """The same from the heading Statement Summary on."""
    return _pick(found["stacks"]["stack"], last)


def stack_after(found: Column, label: str) -> Column:
    """The same behind the label in that stack."""
    rest = after_label(F.array_join(found["stacks"]["below"], "\n"), label, 2500)
    amounts = F.filter(F.transform(F.filter(lines(rest), lambda x: ~x.rlike(_DATE_ONLY)), lambda x: first_amount(_unsigned(x))), lambda a: a.isNotNull())
    return _pick(amounts, label == "Total Amount Due")
