"""CSV exports with sections: transactions stand between two headings, under a header whose first cell is the date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.amounts import parse_amount, split_signed
from tallyspark.functions.dates import parse_date

# Fixed values of the export.
BEGIN, END, FIRST_CELL = "Transaction Details:", "MESSAGE Details:", "date"
_FIELDS = "c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string"


def rows(exports: DataFrame, text: str = "text") -> DataFrame:
    """``exports`` with date, ref_no, description, credited, debited per transaction; rows without date or amount go.

    Cells: 0 date, 1 reference (up to three digits are a serial number), 2 description, 6 or else 5 the amount; a negative one is credit.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    position = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))

    def first(test):
        return F.get(F.transform(F.filter(position, test), lambda p: p["i"]), F.lit(0))

    begin = F.coalesce(first(lambda p: F.startswith(p["x"], F.lit(BEGIN))), F.lit(-1))
    end = F.coalesce(first(lambda p: F.startswith(p["x"], F.lit(END))), F.size(lines))
    inside = F.slice(lines, begin + 2, F.greatest(end - begin - 1, F.lit(0)))
    each = exports.select("*", F.posexplode(inside).alias("pos", "line")).drop(text)
    cells = each.withColumn("c", F.from_csv("line", _FIELDS)).drop("line")
    amount = F.coalesce(parse_amount(F.col("c.c6")), parse_amount(F.col("c.c5")))
    credited, debited = split_signed(F.col("amount"))
    ref = F.trim(F.col("c.c1"))
    out = cells.where(F.lower(F.trim(F.coalesce("c.c0", F.lit("")))) != FIRST_CELL).withColumns({"date": parse_date(F.col("c.c0")), "amount": amount})
    out = out.withColumns({"ref_no": F.when(~ref.rlike(r"^\d{0,3}$"), ref), "description": F.trim(F.col("c.c2"))}).where("date is not null and amount is not null")
    return out.withColumns({"credited": credited, "debited": debited}).drop("c", "amount")
