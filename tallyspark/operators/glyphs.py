"""Glyphs of pages to lines, and from their colours to the direction of amounts.

Some cards print credits in green and write no mark behind them. A page's glyphs are clustered to lines by their baselines, put in order, and the colour of
each amount's glyphs says whether it is a credit. A page is one row of the grouping: its glyphs are bounded by what fits on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text as t

REACH = 2.0  # how far a glyph's top may be from that of a line's first glyph
AMOUNT = r"(?i)Rs\.?\s*(?:-?\d[\d,]*(?:\.\d+)?|\.\d+)"


def _starts(glyphs: Column) -> Column:
    """Positions from 0 at which lines begin: a fold over the glyphs from the top, whose state is the top of the open line's first glyph."""
    begin = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, g: Column) -> Column:
        new = s["top"].isNull() | (F.abs(g["top"] - s["top"]) >= REACH)
        return F.struct(F.when(new, g["top"]).otherwise(s["top"]).alias("top"), (s["at"] + 1).alias("at"), F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))

    return F.aggregate(glyphs, begin, step)["starts"]


def _lines(glyphs: Column) -> Column:
    """The glyphs of each line, from left to right."""

    def cut(starts: Column) -> Column:
        end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(glyphs))
        ordered = lambda part: F.array_sort(F.transform(part, lambda g: F.struct(g["x0"].alias("x0"), g["top"].alias("top"), g["text"].alias("text"), g["green"].alias("green"))))
        return F.transform(starts, lambda s, i: ordered(F.slice(glyphs, s + 1, end(i) - s)))

    return t.let(_starts(glyphs), cut)


def _shown(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda g: g["text"]), "")


def _credits(line: Column) -> Column:
    """For each amount of a line whether one of its glyphs is green."""
    colours = F.array_join(F.transform(line, lambda g: F.repeat(F.when(g["green"], "g").otherwise("-"), F.length(g["text"]))), "")
    return t.let(F.struct(_shown(line).alias("text"), colours.alias("colours")), lambda x: F.transform(t.spans(x["text"], AMOUNT), lambda m: F.contains(F.substring(x["colours"], m["at"] + 1, m["size"]), F.lit("g"))))


def pages(glyphs: DataFrame, within: list[str]) -> DataFrame:
    """(within, lines, credits) of ``glyphs`` (within, text, x0, top, color): the lines' texts from the top, and for each amount in reading order whether
    it is printed as a credit. Blank glyphs and those without a place don't count; a colour is an array of gray, RGB or CMYK parts, null is none."""
    shown = glyphs.where((F.trim("text") != "") & F.col("x0").isNotNull() & F.col("top").isNotNull())
    one = F.struct(F.round("top", 1).alias("row"), "x0", "top", "text", t.is_green(F.col("color")).alias("green"))
    grouped = shown.groupBy(*within).agg(F.array_sort(F.collect_list(one)).alias("__glyphs")).withColumn("__lines", _lines(F.col("__glyphs")))
    return grouped.select(*within, F.transform("__lines", _shown).alias("lines"), F.flatten(F.transform("__lines", _credits)).alias("credits"))


def mark_pages(texts: DataFrame, glyphs: DataFrame, within: list[str], text: str = "text") -> DataFrame:
    """``texts`` (within, text) with Cr or Dr behind the amounts of transaction lines, as the glyphs' colours say; a page without glyphs stays as it is."""
    known = pages(glyphs, within).select(*(F.col(c).alias(f"__{c}") for c in within), F.col("credits").alias("__credits"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in within]
    joined = texts.join(known, same, "left")
    none = F.col("__credits").isNull() | (F.size("__credits") == 0)
    return joined.withColumn(text, F.when(none, F.col(text)).otherwise(t.mark_amounts(text, F.col("__credits")))).drop("__credits", *(f"__{c}" for c in within))
