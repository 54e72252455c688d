"""Text expressions: cleaning, trimming, markers, labels."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that survive cleaning.
ALLOWED = r"A-Za-z0-9 \n\r.,/\-:()%&@#*+=<>|_$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column | str) -> Column:
    return F.split(_col(text), "\n")


def unlines(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def sanitize(text: Column | str) -> Column:
    """Characters outside the allow-list become blanks; line ends are trimmed on the right."""

    def trimmed(t: Column) -> Column:
        loose = F.contains(t, F.lit(" \n")) | F.endswith(t, F.lit(" "))
        return F.when(loose, unlines(F.transform(lines(t), lambda x: F.rtrim(x)))).otherwise(t)

    # one loop over the characters says of most texts that there is nothing to replace
    plain = lambda t: F.when(t.rlike(rf"\A[{ALLOWED}]*+\z"), t).otherwise(F.regexp_replace(t, f"[^{ALLOWED}]", " "))
    return let(_col(text), lambda t: let(plain(t), trimmed))


def squeeze(text: Column | str) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def drop_blank_lines(text: Column | str) -> Column:
    return unlines(F.filter(lines(text), lambda x: F.trim(x) != ""))


def trim_by_markers(text: Column | str, start: list[str], end: list[str]) -> Column:
    """Lines from the first one with a start marker to the last one with an end marker, both included.

    A marker that isn't there trims nothing; an end that only stands before the start leaves nothing.
    """
    def at(rows: Column, markers: list[str]) -> Column:
        hit = F.transform(rows, lambda x, i: F.when(_any(x, markers), i + 1))
        return F.filter(hit, lambda i: i.isNotNull())

    def cut(rows: Column) -> Column:
        first = F.coalesce(F.get(at(rows, start), F.lit(0)), F.lit(1)) if start else F.lit(1)
        last = F.coalesce(F.try_element_at(at(rows, end), F.lit(-1)), F.size(rows)) if end else F.size(rows)
        return let(F.struct(first.alias("a"), last.alias("b")), lambda p: unlines(F.slice(rows, p["a"], F.greatest(p["b"] - p["a"] + 1, F.lit(0)))))

    t = _col(text)
    return F.when(_any(t, [*start, *end]), let(lines(t), cut)).otherwise(t)


def _any(text: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        if m:
            found = found | F.contains(text, F.lit(m))
    return found


def contains_any(text: Column | str, markers: list[str]) -> Column:
    """Any marker as it stands; empty markers don't count."""
    return F.coalesce(_any(_col(text), markers), F.lit(False))


def contains_any_squeezed(text: Column | str, markers: list[str]) -> Column:
    """Any marker, white space made alike on both sides."""
    return F.coalesce(_any(squeeze(text), [" ".join(m.split()) for m in markers]), F.lit(False))


def eligible(text: Column | str, include: list[str], exclude: list[str], manual: Column | None = None) -> Column:
    """Not excluded, unless uploaded by hand, and included where there is a list to be on."""
    barred = contains_any_squeezed(text, exclude)
    if manual is not None:
        barred = barred & ~manual
    return ~barred & (contains_any(text, include) if include else F.lit(True))


def drop_phrases(text: Column | str, phrases: list[str]) -> Column:
    """Every phrase goes, in any case and with any white space between its words; blank lines go last."""
    out = _col(text)
    for p in phrases:
        words = p.split()
        if words:
            out = F.regexp_replace(out, "(?i)" + r"\s+".join(re.escape(w) for w in words), "")
    return drop_blank_lines(out)


# Lines that begin another section of a statement.
BOUNDARIES = (
    "IMPORTANT INFORMATION", "YOUR TRANSACTIONS", "STATEMENT SUMMARY", "Statement Summary", "MOST IMPORTANT TERMS AND CONDITIONS", "Domestic Transactions", "PREVIOUS STATEMENT DUES",
    "Past Dues", "Account Summary", "TOTAL AMOUNT DUE", "Statement Date", "Billing Period",
)
SHORT_MARKER = 6  # words up to which a marker can be a heading
CAPITALS = 0.8  # share of a heading's letters


def _marker(marker: str, markers: list[str]) -> Column:
    """A marker as data: the pattern of its words, whether it can be a heading, what ends its section, and the lines between which a long one lies."""
    words = marker.split()
    anchor, letters = " ".join(words), [c for c in marker if c.isalpha()]
    heading = len(words) <= SHORT_MARKER and bool(letters) and sum(c.isupper() for c in letters) >= CAPITALS * len(letters)
    ends = [anchor, *BOUNDARIES, *(m for m in markers if m != marker and m.strip())]
    long = len(words) > SHORT_MARKER
    parts = {
        "key": max(words[1:5] if long else words, key=len),
        "pattern": r"\s+".join(re.escape(w) for w in words),
        "anchor": anchor,
        "ends": "|".join(re.escape(e) for e in ends),
        "first": " ".join([words[0].lstrip("*"), *words[1:5]]) if long else anchor,
        "last": " ".join(words[-4:]) if long else anchor,
        "heading": heading,
        "long": long,
    }
    return F.struct(*(F.lit(v).alias(k) for k, v in parts.items()))


def _between(rows: Column, begins: Callable[[Column], Column], ends: Callable[[Column], Column], inclusive: bool) -> Column:
    """``rows`` without a section, as text; null if it doesn't occur.

    A fold over the lines, whose state is the section's first line and its end: inclusive, the last line from the first one on that ends it; else
    the next line that begins another section, or the end of the text.
    """
    begin = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("first"), F.lit(-1).alias("end"))

    def step(s: Column, x: Column) -> Column:
        opened = F.when((s["first"] < 0) & begins(x), s["at"]).otherwise(s["first"])
        closed = (opened >= 0) & ends(x) if inclusive else (s["first"] >= 0) & (s["end"] < 0) & ends(x)
        return F.struct((s["at"] + 1).alias("at"), opened.alias("first"), F.when(closed, s["at"]).otherwise(s["end"]).alias("end"))

    def cut(s: Column) -> Column:
        after = s["end"] + 1 if inclusive else F.when(s["end"] < 0, s["at"]).otherwise(s["end"])
        kept = F.concat(F.slice(rows, 1, s["first"]), F.slice(rows, after + 1, F.greatest(s["at"] - after, F.lit(0))))
        there = (s["first"] >= 0) & (s["end"] >= 0) if inclusive else s["first"] >= 0
        return F.when(there, unlines(F.filter(kept, lambda x: F.trim(x) != "")))

    return let(F.aggregate(rows, begin, step), cut)


def drop_sections(text: Column | str, markers: list[str]) -> Column:
    """``text`` without what the markers name, one marker after the other; blank lines go last.

    A short marker in capitals that stands on a line of its own is a heading: it goes with the lines below it, up to a line that holds it again, another
    marker or one of ``BOUNDARIES``. If that changes nothing, every occurrence of the marker's words goes, whatever white space is between them. If
    that neither, a long marker is a block of lines, from the first line with its first words to the last with its last words.

    The markers are data of one fold, so the expression doesn't grow with them. A marker is only looked for where its longest word is: most texts hold few markers,
    and a pattern that is data is compiled anew for each row.
    """
    known = [m for m in markers if m.split()]
    if not known:
        return drop_blank_lines(text)

    def step(t: Column, m: Column) -> Column:
        def of(rows: Column) -> Column:
            shown = F.exists(rows, lambda x: F.upper(F.trim(x)) == F.upper(m["anchor"]))
            section = F.when(m["heading"] & shown, _between(rows, lambda x: F.contains(x, m["anchor"]), lambda x: F.rlike(x, m["ends"]), False))
            words = F.regexp_replace(t, m["pattern"], F.lit(""))
            block = F.when(m["long"], _between(rows, lambda x: F.contains(x, m["first"]), lambda x: F.contains(x, m["last"]), True))
            changed = lambda c: let(c, lambda v: F.when(v != t, v))
            return F.coalesce(changed(section), changed(words), changed(block), t)

        return F.when(F.contains(t, m["key"]), let(lines(t), of)).otherwise(t)

    return drop_blank_lines(F.aggregate(F.array(*(_marker(m, known) for m in known)), _col(text), step))


def label_pattern(label: str) -> str:
    """A pattern for a label whose letters may be doubled by the text layer, blanks between them."""
    words = ["".join(rf"{re.escape(c)}+\s*" for c in w) for w in label.split()]
    return "(?i)" + r"\s+".join(w.removesuffix(r"\s*") for w in words)


def after_label(text: Column | str, label: str, width: int = 400) -> Column:
    """What stands behind the label's first occurrence, at most ``width`` characters; null without the label."""
    return _once(text, label_pattern(label) + rf"(?s)(.{{0,{width}}})")


def from_label(text: Column | str, label: str, width: int = 400) -> Column:
    """The same with the label itself."""
    return _once(text, rf"(?={label_pattern(label)})(?s)(.{{0,{width}}})")


def _once(text: Column | str, pattern: str) -> Column:
    """The first group of the first match, null without one. Spark keeps the compiled pattern from row to row, which ``split`` doesn't."""
    return F.get(F.regexp_extract_all(_col(text), F.lit(f"{pattern}.*"), F.lit(1)), F.lit(0))


def has_label(text: Column | str, label: str) -> Column:
    return _col(text).rlike(label_pattern(label))


def first_where(items: Column, test) -> Column:
    """Index from 0 of the first item that passes; null if none does."""
    return F.get(F.filter(F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0))


def direction(text: Column | str) -> Column:
    """CR or DR by the last such word of the line, DR without one."""
    found = F.upper(F.regexp_extract(_col(text), r"(?i)^(?:.*)\b(DR|CR)\b", 1))
    return F.when(found == "", "DR").otherwise(found)


def file_leaf(name: Column | str, default: str = "attachment") -> Column:
    """A safe leaf name: no folders, unsafe characters as underscores."""
    leaf = F.regexp_extract(F.regexp_replace(F.coalesce(_col(name), F.lit("")), r"\\", "/"), r"([^/]*)$", 1)
    safe = F.regexp_replace(F.trim(leaf), r"[^A-Za-z0-9._() \-]", "_")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(default))


def account_label(bank: Column | str, variant: Column | str, number: Column | str) -> Column:
    return F.concat(_col(bank), F.coalesce(F.concat(F.lit("/"), _col(variant)), F.lit("")), F.lit(" ("), _col(number), F.lit(")"))


def distinct_words(items: Column) -> Column:
    """Trimmed, non-empty, first seen order, case ignored."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    lower = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def senders(items: Column) -> Column:
    """Addresses or domains, trimmed, in lower case, each once; one with white space inside or a broken address fails the read."""
    clean = distinct_words(F.transform(items, lambda x: F.lower(x)))
    broken = lambda x: x.rlike(r"\s") | F.contains(x, F.lit("@")) & ~x.rlike(r"^[^@]+@[^@]+$")
    bad = F.filter(clean, broken)
    return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("no sender: "), F.get(bad, F.lit(0)))).cast("array<string>")).otherwise(clean)


def join_detached_marks(text: Column | str) -> Column:
    """A line that only says CR or DR goes to the end of the line before it."""
    rows = lines(text)
    alone = r"(?i)^\s*(CR|DR)\s*$"
    glued = F.transform(rows, lambda x, i: F.when(F.coalesce(F.get(rows, i + 1).rlike(alone), F.lit(False)) & ~x.rlike(alone), F.concat_ws(" ", F.rtrim(x), F.trim(F.get(rows, i + 1)))).otherwise(x))
    return unlines(F.filter(glued, lambda x, i: ~x.rlike(alone) | (i == 0)))


def merge_marks(text: Column | str, reach: int = 80) -> Column:
    """A line of CR and DR marks without amounts goes into the line above: each mark to the amount nearest to it, ``reach`` characters at most."""
    amount = r"-?\d[\d,]*\.\d{1,2}"
    marks = r"(?i)^[^\d]*\b(?:CR|DR)\b[^\d]*$"

    def places(x: Column, pattern: str) -> Column:
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        gaps = F.split(x, pattern)
        at = lambda i: F.length(F.array_join(F.slice(gaps, 1, i + 1), "")) + F.length(F.array_join(F.slice(found, 1, i), ""))
        return F.transform(found, lambda w, i: F.struct(at(i).alias("at"), w.alias("word"), F.get(gaps, i).alias("gap")))

    def glued(x: Column, below: Column) -> Column:
        apart = lambda m, a: F.abs(m["at"] - a["at"])

        def built(own: Column, near: Column) -> Column:
            nearest = lambda m: F.array_min(F.transform(own, lambda a: F.struct(apart(m, a).alias("d"), a["at"].alias("at"))))
            each = F.transform(near, lambda m: F.struct(nearest(m).alias("to"), F.upper(m["word"]).alias("mark")))

            def rebuilt(chosen: Column) -> Column:
                mark = lambda a: F.get(F.filter(chosen, lambda c: (c["to"]["at"] == a["at"]) & (c["to"]["d"] <= reach)), F.lit(0))["mark"]
                return F.array_join(F.transform(own, lambda a: F.concat(a["gap"], a["word"], F.coalesce(F.concat(F.lit(" "), mark(a)), F.lit("")))), "")

            return let(each, rebuilt)

        out = let(F.struct(places(x, amount).alias("own"), places(below, r"(?i)\b(?:CR|DR)\b").alias("near")), lambda p: built(p["own"], p["near"]))
        return F.concat(out, F.element_at(F.split(x, amount), -1))

    def merged(rows: Column) -> Column:
        joins = F.transform(rows, lambda x, i: F.coalesce(F.get(rows, i + 1).rlike(marks) & (F.regexp_count(x, F.lit(amount)) >= 2), F.lit(False)))

        def kept(at: Column) -> Column:
            out = F.transform(rows, lambda x, i: F.when(F.get(at, i), glued(x, F.get(rows, i + 1))).otherwise(x))
            return unlines(F.filter(out, lambda x, i: (i == 0) | ~F.get(at, i - 1)))

        return let(joins, kept)

    return F.when(_col(text).rlike(r"(?im)" + marks.removeprefix("(?i)")), let(lines(text), merged)).otherwise(_col(text))


def label_column(text: Column | str, labels: tuple[str, ...]) -> Column:
    """The unlabelled column of amounts that starts at a dated one gets its labels, if it has one line for each; blank lines don't count."""
    dated = r"(?i)^\s*(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+[A-Z]{3}\s+\d{4})\s+Rs\.?\s*-?[\d,]+(?:\.\d+)?\s*$"
    either = r"(?i)^\s*(?:(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\s+[A-Z]{3}\s+\d{4})\s+)?Rs\.?\s*-?[\d,]+(?:\.\d+)?\s*$"
    shown = lambda x: F.trim(x) != ""
    named = F.array(*(F.lit(x) for x in labels))

    def labelled(rows: Column, start: Column) -> Column:
        below = F.slice(F.filter(F.slice(rows, start + 1, F.size(rows)), shown), 1, len(labels))
        fits = F.size(F.filter(below, lambda x: x.rlike(either))) == len(labels)
        place = lambda i: F.size(F.filter(F.slice(rows, start + 1, i - start + 1), shown))
        out = F.transform(rows, lambda x, i: F.when((i >= start) & shown(x), F.concat_ws("  ", F.get(named, place(i) - 1), F.trim(x))).otherwise(x))
        return F.when(fits, unlines(out))

    found = let(lines(text), lambda rows: let(first_where(rows, lambda x: x.rlike(dated)), lambda start: labelled(rows, start)))
    there = F.contains(_col(text), F.lit(labels[0])) & F.contains(_col(text), F.lit(labels[-1]))
    return F.when(there, _col(text)).otherwise(F.coalesce(found, _col(text)))


def drop_block(text: Column | str, header: str, until: str) -> Column:
    """From the line that is the header to the one before the first that matches ``until``, or to the end."""
    rows = lines(text)
    begin = F.array_position(F.transform(rows, lambda x: F.trim(x)), F.lit(header)).cast("int")
    rest = F.slice(rows, begin + 1, F.size(rows))
    stop = F.get(F.filter(F.transform(rest, lambda x, i: F.when(x.rlike(until), i)), lambda i: i.isNotNull()), F.lit(0))
    tail = F.when(stop.isNull(), F.array().cast("array<string>")).otherwise(F.slice(rest, stop + 1, F.size(rest)))
    return F.when(begin == 0, _col(text)).otherwise(unlines(F.concat(F.slice(rows, 1, F.greatest(begin - 1, F.lit(0))), tail)))


def spans(text: Column | str, pattern: str) -> Column:
    """(at, size) of every match, ``at`` from 0."""
    t = _col(text)
    found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + x["gap"]
        return F.struct((at + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("at"), x["size"].alias("size")))).alias("out"))

    each = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    return F.aggregate(each, begin, step)["out"]


def is_green(color: Column) -> Column:
    """Whether a glyph's colour (gray, RGB or CMYK parts from 0 to 1) is green, as credits are printed."""
    part = lambda i: F.get(color, F.lit(i))
    cmyk = F.array(*(1 - F.least(F.lit(1.0), part(i) + part(3)) for i in range(3)))
    rgb = F.when(F.size(color) == 4, cmyk).when(F.size(color) == 3, color).otherwise(F.array(part(0), part(0), part(0)))
    r, g, b = (F.get(rgb, F.lit(i)) for i in range(3))
    return F.coalesce((g >= 0.25) & (g > r + 0.08) & (g > b + 0.08), F.lit(False))


def mark_amounts(text: Column | str, credits: Column) -> Column:
    """Amounts in rupees on transaction lines with Cr or Dr behind them, as ``credits`` says of all amounts of the text in reading order.

    Amounts on other lines use up their flag; an amount beyond the flags is a debit, and one that is marked already stays.
    """
    amount = r"(?i)Rs\.?\s*-?[\d,]*\d(?:\.\d+)?"
    begin = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def rebuilt(x: Column, n: Column) -> Column:
        gaps = F.split(x, amount)

        def mark(word: Column, i: Column) -> Column:
            marked = F.get(gaps, i + 1).rlike(r"(?i)^\s*(?:Cr|Dr)\b")
            return F.concat(F.get(gaps, i), word, F.when(marked, "").otherwise(F.when(F.coalesce(F.get(credits, n + i), F.lit(False)), " Cr").otherwise(" Dr")))

        return F.concat(F.array_join(F.transform(F.regexp_extract_all(x, F.lit(amount), F.lit(0)), mark), ""), F.element_at(gaps, -1))

    def step(acc: Column, x: Column) -> Column:
        line = F.when(x.rlike(r"^\s*\d{1,2}\s+[A-Za-z]{3}\s+\d{2,4}\b") & x.rlike(amount), rebuilt(x, acc["n"])).otherwise(x)
        return F.struct((acc["n"] + F.regexp_count(x, F.lit(amount))).alias("n"), F.concat(acc["out"], F.array(line)).alias("out"))

    return unlines(F.aggregate(lines(text), begin, step)["out"])
