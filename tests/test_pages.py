"""Sections and glyphs against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import amounts, text
from tallyspark.operators import glyphs, handlers


def plain_drop(shown, markers):
    def no_blanks(rows):
        return "\n".join(x for x in rows if x.strip())

    for m in markers:
        words, rows = m.split(), shown.split("\n")
        anchor, out = " ".join(words), shown
        letters = [c for c in anchor if c.isalpha()]
        if len(words) <= 6 and sum(c.isupper() for c in letters) >= 0.8 * len(letters) and any(x.strip().upper() == anchor.upper() for x in rows):
            first = next((i for i, x in enumerate(rows) if anchor in x), None)
            if first is not None:
                ends = [anchor, *text.BOUNDARIES, *(o for o in markers if o != m)]
                end = next((i for i in range(first + 1, len(rows)) if any(e in rows[i] for e in ends)), len(rows))
                out = no_blanks(rows[:first] + rows[end:])
        if out == shown:
            out = re.sub(r"\s+".join(map(re.escape, words)), "", shown)
        if out == shown and len(words) > 6:
            first = next((i for i, x in enumerate(rows) if " ".join([words[0].lstrip("*"), *words[1:5]]) in x), None)
            last = [i for i, x in enumerate(rows) if first is not None and i >= first and " ".join(words[-4:]) in x]
            if last:
                out = no_blanks(rows[:first] + rows[last[-1] + 1 :])
        shown = out
    return no_blanks(shown.split("\n"))


LONG = "*Offer terms apply to all cards and end on the last day"
MARKERS = ["IMPORTANT", "Issued by", "GO DIGITAL", LONG, "SMS  Help  space", "Don't (pay)"]


def test_sections_agree_with_plain_python(spark):
    rng = random.Random(3)
    pieces = ["IMPORTANT", " IMPORTANT ", "Important", "x IMPORTANT y", "Issued by", "Issued\nby us", "GO DIGITAL", "Past Dues 3", "a 1", "b 2", "", "  ", "SMS Help", "space SMS Help space", "Statement Date 1"]
    pieces += ["Offer terms apply to all", "of it on the last day", "and end on the last day now", LONG.lstrip("*"), LONG, "Don't (pay) now"]
    shown = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    table = spark.createDataFrame([(i, x) for i, x in enumerate([*shown, None])], "id long, t string")
    got = {r["id"]: r["out"] for r in table.select("id", text.drop_sections("t", MARKERS).alias("out")).collect()}
    assert got.pop(len(shown)) is None
    assert got == {i: plain_drop(x, MARKERS) for i, x in enumerate(shown)}
    assert spark.range(1).select(text.drop_sections(F.lit("a\n\nb"), [" ", ""])).first()[0] == "a\nb"


def test_a_layout_drops_whole_sections(spark):
    shown = "Opening Balance\nIMPORTANT INFORMATION\nread this 9.00\nand that\nStatement Date 1\nIssued by Bank\n04 Jan 2021 A Rs. 1.00"
    row = spark.createDataFrame([(shown,)], "t string").select(handlers.clean(F.col("t"), "federal_edge")).first()[0]
    assert row == "Opening Balance\nStatement Date 1\n Bank\n04 Jan 2021 A Rs. 1.00"


@pytest.mark.parametrize("digits", range(1, 61))
def test_amounts_of_any_length_are_amounts_or_null(spark, digits):
    shown = ["9" * digits, "9" * digits + ".99", "1." + "5" * digits, "-" + "7" * digits, "(" + "8" * digits + ")", "Rs. " + "6" * digits + " Cr"]
    if digits > 1 and digits % 7:
        shown = shown[:2]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in shown], "t string").select(amounts.parse_amount("t")).collect()]
    assert all((v is not None) == (digits <= 16) for i, v in enumerate(got) if i != 2)


def plain_pages(rows):
    rows = sorted((r for r in rows if r[0].strip()), key=lambda r: (round(r[2], 1), r[1]))
    lines = []
    for r in rows:
        if lines and abs(r[2] - lines[-1][0][2]) < 2.0:
            lines[-1].append(r)
        else:
            lines.append([r])
    shown, flags = [], []
    for line in lines:
        line.sort(key=lambda r: r[1])
        shown.append("".join(r[0] for r in line))
        owner = [r for r in line for _ in r[0]]
        for m in re.finditer(r"Rs\.?\s*(?:-?\d[\d,]*(?:\.\d+)?|\.\d+)", shown[-1], re.IGNORECASE):
            flags.append(any(r[3] == [0.1, 0.6, 0.1] for r in owner[m.start() : m.end()]))
    return shown, flags


def test_glyphs_agree_with_plain_python(spark):
    rng = random.Random(4)
    pages = {}
    for page in range(30):
        rows = []
        for line in range(rng.randint(0, 8)):
            at, green = rng.random(), rng.random() < 0.5
            for c in rng.choice(["Rs.12.50", "ab Rs 7", "Rs.1,000Rs..5", "total"]):
                at += 1 + rng.random()
                rows.append((c, at, 5.25 * line + rng.choice([0.0, 0.5, 1.0, 1.75]), [0.1, 0.6, 0.1] if green and c in "5701" else rng.choice([[0.0], [0.1, 0.2, 0.9], None, [0.0, 0.9, 0.9, 0.2]])))
        rng.shuffle(rows)
        pages[page] = rows
    table = spark.createDataFrame([(p, *r) for p, rows in pages.items() for r in [*rows, (" ", 0.0, 0.0, None), ("x", None, 1.0, None)]], "page long, text string, x0 double, top double, color array<double>")
    got = {r["page"]: (r["lines"], r["credits"]) for r in glyphs.pages(table, ["page"]).collect()}
    assert got == {p: plain_pages(rows) for p, rows in pages.items() if rows}


def test_drifting_baselines_are_measured_from_the_first_glyph(spark):
    rows = [(1, c, float(i), 1.5 * i, None) for i, c in enumerate("abcd")]
    table = spark.createDataFrame(rows, "page long, text string, x0 double, top double, color array<double>")
    assert glyphs.pages(table, ["page"]).first()["lines"] == ["ab", "cd"]


def test_pages_without_glyphs_stay(spark):
    texts = spark.createDataFrame([(1, "04 Jan 2021 A Rs. 1.00"), (None, "04 Jan 2021 B Rs. 1.00"), (3, None)], "page long, text string")
    none = spark.createDataFrame([], "page long, text string, x0 double, top double, color array<double>")
    assert glyphs.mark_pages(texts, none, ["page"]).collect() == texts.collect()
    some = spark.createDataFrame([(None, "Rs.1.00", 1.0, 1.0, [0.1, 0.6, 0.1])], none.schema)
    assert {r["page"]: r["text"] for r in glyphs.mark_pages(texts, some, ["page"]).collect()} == {1: "04 Jan 2021 A Rs. 1.00", None: "04 Jan 2021 B Rs. 1.00 Cr", 3: None}


def test_shapes_that_statements_have(spark):
    """A comma behind the minus, a day whose digits are apart, a heading above transactions that only some cards drop with them."""
    row = spark.range(1).select(amounts.tokens(F.lit("C-,137.30 C45.80 C460.00"), decimals=True)["amount"].alias("t"), amounts.tokens(F.lit("Total ,12 5"))["pos"].alias("p")).first()
    assert [str(x) for x in row["t"]] == ["-137.30", "45.80", "460.00"] and row["p"] == [7, 10]
    pnb = "Invoice Date : 16-MAR-2024\nFrom 17-FEB-2024 To 1 6-MAR-2024\nAccount Summary\n"
    head = spark.createDataFrame([(pnb,)], "t string").select(handlers.read(F.col("t"), "pnb").alias("h")).first()["h"]
    assert (str(head["start"]), str(head["end"])) == ("2024-02-17", "2024-03-16")
    shown = "Total Amount due\n420.00\nSPENDS OVERVIEW\n10/04/2024 1000000001 SHOP 50 420.00\nEarnings transfered to\n"
    table = spark.createDataFrame([(shown,)], "t string")
    assert table.select(handlers.clean(F.col("t"), "amazon")).first()[0] == "Total Amount due\n420.00\n10/04/2024 1000000001 SHOP 50 420.00\nEarnings transfered to"
    assert "SHOP" not in table.select(handlers.clean(F.col("t"), "icici")).first()[0]
