"""From staged statements to transactions, metadata, coverage and alerts, for all accounts at once: an account is a column, not a loop."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import amounts, periods
from tallyspark.functions.text import eligible, let
from tallyspark.operators import balances, coverage, handlers, keeper, registry, selection
from tallyspark.operators.stages import Hook, Stage, Stages, fingerprint
from tallyspark.sources import sectioned
from tallyspark.sources.shared import shared_dir

WITHIN = ["account", "key"]
_HEAD = ["statement_date", "period_start", "period_end", "estimated", "annual", "opening", "closing", "reference", "tolerance"]


@dataclass
class Result:
    """Tables of a run, each of them written; those that a run wasn't asked for are None."""

    decisions: DataFrame  # account, key, kind, outcome, keeper_path
    metadata: DataFrame  # one row per period with a kept statement: its head, formats, granularity, year_key, covered_months
    selected: DataFrame  # the sources that are parsed: account, key, kind, path
    transactions: DataFrame
    gaps: DataFrame  # account, month, status
    coverage: DataFrame  # account, start, end, segments, count, gaps
    alerts: DataFrame  # account, key, kind, files
    unread: DataFrame  # selected statements of banks without a reader
    made: list[str]  # stages that were computed and not found


def statement_keys(heads: DataFrame, name: str = "name") -> DataFrame:
    """``heads`` with key and source: the year of an annual statement, the month of its date, of an upload, or of its name."""
    annual = F.when(F.col("annual"), periods.fiscal_key(F.col("period_end")))
    content = periods.month_key(F.coalesce("statement_date", "period_end"))
    manual = periods.upload_period(name)
    found = periods.period_key(annual, content, periods.filename_month(name))
    return heads.withColumn("__k", F.when(manual.isNotNull(), F.struct(manual.alias("key"), F.lit("manual").alias("source"))).otherwise(found)).withColumns({"key": F.col("__k.key"), "source": F.col("__k.source")}).drop("__k")


def export_keys(exports: DataFrame, id_: str = "path", text: str = "text", name: str = "name") -> DataFrame:
    """(id, key, source, start, end) of exports with sections (id, text, name, anchor: the day its billing cycles start on).

    By the content's statement period if it says one; else by the transactions: one billing cycle is a month, several are a fiscal year; else by the name.
    """
    head = handlers.reading(exports.sparkSession, "icici", text, text, balances=False)
    said = exports.select(F.col(id_).alias("id"), F.col(name).alias("n"), head.alias("h"))
    rows = sectioned.rows(exports.select(id_, "anchor", text), text)
    cycle = periods.billing_cycle(F.col("date"), F.col("anchor"))
    per = rows.withColumn("c", cycle).groupBy(F.col(id_).alias("i")).agg(F.count_distinct("c").alias("cycles"), F.min("c.start").alias("first"), F.max("c.end").alias("last"))
    joined = said.join(per, F.col("id") == F.col("i"), "left")
    key = lambda k, s, a, e: F.struct(k.alias("key"), F.lit(s).alias("source"), a.alias("start"), e.alias("end"))
    start, end = F.col("h.start"), F.col("h.end")
    same = F.trunc(start, "MM") == F.trunc(end, "MM")
    months, years = periods.month_key(end), periods.fiscal_key(end)
    none = F.lit(None).cast("date")
    file_month, annual_name = periods.filename_month("n"), periods.filename_annual("n")
    found = (
        F.when(start.isNotNull() & end.isNotNull(), F.when(same, key(months, "content", start, end)).otherwise(key(years, "annual", start, end)))
        .when(F.col("h.date").isNotNull(), key(periods.month_key(F.col("h.date")), "content", none, F.col("h.date")))
        .when((F.col("cycles") == 1) & ~annual_name, key(periods.month_key(F.col("last")), "content", F.col("first"), F.col("last")))
        .when(F.col("cycles") >= 1, key(periods.fiscal_key(F.col("last")), "annual", F.col("first"), F.col("last")))
        .when(file_month.isNotNull(), key(file_month, "filename", none, none))
        .otherwise(key(F.lit(periods.UNKNOWN), "unknown", none, none))
    )
    return joined.select("id", found.alias("k")).select("id", "k.*")


def year_summaries(metadata: DataFrame, account: str = "account") -> DataFrame:
    """Annual statements with their year_key, and replaces: the date of the statement before it that has the same year, which it stands for."""
    w = Window.partitionBy(account, "year_key").orderBy("statement_date")
    annual = metadata.where(F.col("annual") & F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
    return annual.withColumn("year_key", periods.fiscal_key(F.col("period_end"))).withColumn("replaces", F.lag("statement_date").over(w))


def annual_reconciliation(on_disk: DataFrame, summaries: DataFrame, account: str = "account") -> DataFrame:
    """(account, on_disk, visible, agrees): annual CSV files (account, key) against summaries that show one (account, formats)."""
    disk = on_disk.groupBy(account).agg(F.count_if(periods.key_kind(F.col("key")).isin("fiscal", "calendar")).alias("on_disk"))
    shown = summaries.groupBy(F.col(account).alias("__a")).agg(F.count_if(F.array_contains("formats", "csv")).alias("visible"))
    joined = disk.join(shown, F.col(account) == F.col("__a"), "full")
    counts = {"on_disk": F.coalesce("on_disk", F.lit(0)), "visible": F.coalesce("visible", F.lit(0))}
    return joined.select(F.coalesce(account, "__a").alias(account), *(c.alias(n) for n, c in counts.items())).withColumn("agrees", F.col("on_disk") == F.col("visible"))


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _barred(x: Column, markers: Column) -> Column:
    """Whether a text holds any of the markers, white space made alike on both sides."""
    said = let(_squeeze(x), lambda s: F.exists(markers, lambda m: (F.trim(m) != "") & F.contains(s, _squeeze(m))))
    return F.coalesce(said, F.lit(False))


def _judged(files: DataFrame) -> DataFrame:
    """``files`` with barred, and markers: those that the text as it stands doesn't hold, so that the cleaned text decides; null if there are none, or it holds one."""
    some = F.exists("text_not_contains", lambda m: F.trim(m) != "")
    found = files.withColumn("barred", _barred(F.col("text"), F.col("text_not_contains")))
    return found.withColumn("markers", F.when(some & ~F.col("barred"), F.col("text_not_contains")))


#: What a content is known by; the digest comes first, since a sort goes by the first column's prefix.
_CONTENT = ["sha256", "bank", "variant"]


def _of_content(right: DataFrame) -> tuple[DataFrame, Column, list[str]]:
    """``right`` with its content columns under other names, the condition that a row is of such a content, and those names."""
    names = {"sha256": "__d", "bank": "__b", "variant": "__v"}
    same = (F.col("sha256") == F.col("__d")) & (F.col("bank") == F.col("__b")) & F.col("variant").eqNullSafe(F.col("__v"))
    return right.withColumnsRenamed(names), same, list(names.values())


def _heads(files: DataFrame, banks: tuple[str, ...] | None) -> DataFrame:
    """(bank, variant, sha256, cleaned, head fields, barred_by): every content is cleaned and read once for each layout that it is read by.

    barred_by has the lists of markers of which the cleaned text holds one, so no file needs the text again to be judged.
    """
    pdfs = _judged(files.where("kind = 'pdf'")).select(*_CONTENT, "text", "markers")
    distinct = pdfs.groupBy(*_CONTENT).agg(F.any_value("text").alias("text"), F.collect_set("markers").alias("markers"))
    found, _ = handlers.metadata(distinct, banks, into="text")
    barred_by = F.filter("markers", lambda ms: _barred(F.col("text"), ms))
    return found.select(*_CONTENT, F.col("text").alias("cleaned"), *_HEAD, barred_by.alias("barred_by"))


def _keyed(files: DataFrame, heads: DataFrame, anchor: Column) -> DataFrame:
    """Files without their texts, with key, source, head fields, and what the markers of their account say.

    What the text says of a file is asked where the file is read; no text goes into the join with the heads.
    """
    h, same, names = _of_content(heads.select(*_CONTENT, *_HEAD, "barred_by"))
    asked = _judged(files).withColumns(
        {
            "has_markers": F.size(F.filter("text_contains", lambda m: m != "")) > 0,
            "included": F.exists("text_contains", lambda m: (m != "") & F.contains(F.col("text"), m)),
        }
    ).drop("text", "text_contains", "text_not_contains")
    marked = asked.join(h, same, "left").drop(*names).withColumns(
        {
            "excluded": F.col("barred") | F.coalesce(F.array_contains("barred_by", F.col("markers")), F.lit(False)),
            "annual": F.coalesce("annual", F.lit(False)),
            "estimated": F.coalesce("estimated", F.lit(False)),
        }
    ).drop("barred", "markers", "barred_by")
    pdfs = statement_keys(marked.where("kind = 'pdf'"))
    csvs = marked.where("kind = 'csv'")
    said = export_keys(files.where("kind = 'csv'").select("path", "text", "name", anchor.alias("anchor"))).toDF("__id", "__key", "__source", "__start", "__end")
    manual = periods.upload_period("name")
    exports = csvs.join(said, F.col("path") == F.col("__id")).withColumns(
        {"key": F.coalesce(manual, "__key"), "source": F.when(manual.isNotNull(), "manual").otherwise(F.col("__source")), "period_start": F.col("__start"), "period_end": F.col("__end"), "statement_date": F.col("__end"), "annual": F.col("__source") == "annual"}
    )
    both = pdfs.unionByName(exports.select(*pdfs.columns))
    start, end = F.col("period_start"), F.col("period_end")
    known = F.when(end.isNotNull(), periods.bounds(start, end))
    sound = {
        "manual": F.col("source") == "manual",
        "annual": F.coalesce("annual", F.lit(False)) | periods.key_kind("key").isin("fiscal", "calendar"),  # an upload is annual by its name
        "estimated": F.col("estimated") | (start.isNull() & end.isNotNull()),
        "period_start": known["start"],
        "period_end": known["end"],
    }
    return both.withColumns(sound)


#: What the rules of keepers ask of a file.
_JUDGED = [*WITHIN, "path", "sha256", "source", "manual", "excluded", "has_markers", "included", "statement_date", "period_start", "period_end", "opening", "closing", "reference", "mail_date"]


def _decided(keyed: DataFrame) -> DataFrame:
    """(account, key, kind, outcome, keeper_path): PDFs by the rule chain that can be ambiguous, exports by the one that can't."""
    pdfs = keeper.keep_pdf(keyed.where("kind = 'pdf'").select(*_JUDGED), WITHIN).select(*WITHIN, F.lit("pdf").alias("kind"), "outcome", "keeper_path")
    csvs = keeper.keep_csv(keyed.where("kind = 'csv'").select(*_JUDGED), WITHIN).select(*WITHIN, F.lit("csv").alias("kind"), F.lit("prepared").alias("outcome"), "keeper_path")
    return pdfs.unionByName(csvs)


def _periods(kept: DataFrame) -> DataFrame:
    """One row per account and period: the head of the PDF where there is one, else of the export, and the formats of both.

    A year's bounds are those that its key says, and it has year_key and the months that it covers.
    """
    formats = selection.merge_formats(kept.where("kind = 'pdf'").withColumn("has_txt", F.lit(True)), kept.where("kind = 'csv'"), WITHIN)
    row = F.max_by(F.struct("path", "source", *_HEAD), F.col("kind")).alias("row")  # "pdf" comes after "csv"
    found = kept.groupBy(*WITHIN).agg(row).join(formats, WITHIN).select(*WITHIN, "row.*", "formats")
    year = F.when(periods.key_kind("key").isin("fiscal", "calendar"), periods.key_bounds("key"))
    annual = F.coalesce(year["start"].isNotNull(), F.lit(False))
    months = F.transform(periods.months_between(year["start"], year["end"]), periods.month_key)
    return found.withColumns(
        {
            "annual": annual,
            "estimated": F.col("estimated") & ~annual,
            "period_start": F.coalesce(year["start"], "period_start"),
            "period_end": F.coalesce(year["end"], "period_end"),
            "granularity": F.when(annual, "annual").otherwise("monthly"),
            "year_key": F.when(annual, F.col("key")),
            "covered_months": F.coalesce(months, F.array().cast("array<string>")),
        }
    )


def _selected(kept: DataFrame) -> DataFrame:
    """What is parsed: no text beside an export of its period, no monthly source inside an annual one of its account."""
    sources = kept.withColumns({"start": F.col("period_start"), "end": F.col("period_end")})
    csvs, texts = sources.where("kind = 'csv'"), sources.where("kind = 'pdf'")
    each = selection.csv_wins(texts, csvs, "account", "key").unionByName(csvs)
    return selection.all_sources(each.where("annual"), each.where("not annual")).select(*WITHIN, "kind", "path", "bank", "variant", "sha256", "annual")


#: The stages that each stage reads.
NEEDS = {
    "heads": (), "keyed": ("heads",), "decided": ("keyed",), "kept": ("keyed", "decided"), "metadata": ("kept",), "selected": ("kept",), "transactions": ("selected", "heads"),
    "unread": ("selected",), "gaps": ("metadata",), "coverage": ("metadata",), "alerts": ("keyed", "decided"),
}


def _todo(parts: tuple[str, ...] | None) -> set[str]:
    """``parts`` and all stages that they come from; every stage without ``parts``."""
    found = set(NEEDS if parts is None else parts)
    for name in reversed(NEEDS):
        if name in found:
            found.update(NEEDS[name])
    return found


def run(
    files: DataFrame, banks: tuple[str, ...] | None = None, only: DataFrame | None = None, hook: Hook | None = None, root: str | None = None, anchor: str | None = None,
    parts: tuple[str, ...] | None = None,
) -> Result:
    """All steps over staged statements.

    ``files``: account, bank, variant, path, name, sha256, text, mail_date, text_contains and text_not_contains (arrays); a name that ends in .csv is an
    export, whose billing cycles start on the day that the column ``anchor`` says, on the first without one. With ``only`` (path), as after an upload, nothing
    but the periods of those files is decided anew.

    Every stage is written below ``root``, once for the same files: a run that was stopped, by a failure or by ``hook``, goes on from its last stage. Without
    ``root`` a run keeps its tables in a folder of its own. With ``parts``, names of stages, a run makes these and what they come from; another run finds them.

    ``files`` is read several times, so what is costly to make is better written first.
    """
    spark = files.sparkSession
    st = Stages(spark, root or f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", hook)
    known = files.withColumn("kind", F.when(F.endswith(F.lower("name"), F.lit(".csv")), "csv").otherwise("pdf"))
    day = F.coalesce(F.col(anchor), F.lit(1)) if anchor else F.lit(1)
    named = [c for c in ("account", "bank", "variant", "path", "name", "sha256", "mail_date", "text_contains", "text_not_contains", anchor) if c]
    source = Stage(known, fingerprint(known, named))
    part = fingerprint(only, ["path"]) if only is not None else ""
    todo = _todo(parts)

    def stage(name: str, inputs: list[Stage], build: Callable[[], DataFrame], settings: str = "") -> Stage | None:
        return st.run(name, inputs, build, settings) if name in todo else None

    heads = stage("heads", [source], lambda: _heads(known, banks), str(banks))
    keyed = stage("keyed", [source, heads], lambda: _keyed(known, heads.table, day), str(anchor))

    def wanted() -> DataFrame:
        if only is None:
            return keyed.table
        touched = keyed.table.join(only.select("path"), "path", "left_semi").select(*WITHIN).distinct()
        return keyed.table.join(touched, WITHIN, "left_semi")

    decided = stage("decided", [keyed], lambda: _decided(wanted()), part)

    def kept_rows() -> DataFrame:
        chosen = decided.table.where("outcome = 'prepared'").select(*WITHIN, "kind", F.col("keeper_path").alias("path"))
        return keyed.table.join(chosen, [*WITHIN, "kind", "path"], "left_semi")

    kept = stage("kept", [keyed, decided], kept_rows)
    metadata = stage("metadata", [kept], lambda: _periods(kept.table))
    selected = stage("selected", [kept], lambda: _selected(kept.table))

    def texts() -> DataFrame:
        """Cleaned texts by their content; of files that no layout reads, which have no head, the text as it stands by account and path."""
        cleaned, same, _ = _of_content(heads.table.select(*_CONTENT, "cleaned"))
        read = (F.col("kind") == "pdf") & F.col("sha256").isNotNull() & F.coalesce(F.col("layout").isin(handlers.layout_names(banks)), F.lit(False))
        chosen, raw = handlers.with_layout(selected.table), handlers.with_layout(known).where(~read).select("account", "path", "text")
        shown = lambda rows, text: rows.select(*WITHIN, "bank", "variant", F.col("path").alias("source_file"), F.col(text).alias("text"))
        return shown(chosen.where(read).join(cleaned, same), "cleaned").unionByName(shown(chosen.where(~read).join(raw, ["account", "path"]), "text"))

    transactions = stage("transactions", [selected, heads], lambda: registry.read_statements(texts())[0])
    unread = stage("unread", [selected], lambda: selection.with_fallback(selected.table, registry.readers(spark)).where("rule is null").drop("rule"))

    def broken() -> DataFrame:
        m = metadata.table
        monthly = m.where("not annual").select("account", F.trunc("period_end", "MM").alias("month"), "opening", "closing", F.coalesce("tolerance", F.lit(amounts.TOLERANCE).cast(amounts.MONEY)).alias("tolerance"))
        years = m.where("annual").select("account", F.explode(periods.months_between(F.col("period_start"), F.col("period_end"))).alias("month"))
        return balances.balance_gaps(monthly.where("month is not null"), years, tolerance=F.col("tolerance"))

    def covered() -> DataFrame:
        b = periods.bounds(F.col("period_start"), F.col("period_end"))
        bounded = metadata.table.where("period_end is not null").select("account", b.alias("b"), "estimated")
        return coverage.roll_up(bounded.select("account", "b.start", "b.end", (F.col("b.approximate") | F.col("estimated")).alias("approximate")))

    gaps = stage("gaps", [metadata], broken)
    cover = stage("coverage", [metadata], covered)
    alerts = stage("alerts", [keyed, decided], lambda: keeper.alerts(wanted().where("kind = 'pdf'").drop("kind"), decided.table.where("kind = 'pdf'").drop("kind"), WITHIN), part)
    return Result(*(s and s.table for s in (decided, metadata, selected, transactions, gaps, cover, alerts, unread)), st.made)


def with_field(document: Column, schema: str, name: str, value: Column) -> Column:
    """A JSON document with one field set and all others as they were; a document that doesn't parse becomes one with that field alone."""
    parsed = F.from_json(document, F.lit(schema))
    return F.to_json(F.coalesce(parsed, F.from_json(F.lit("{}"), F.lit(schema))).withField(name, value))


def typed(document: Column, schema: str) -> Column:
    """A JSON document's fields by their types; a value of another type fails the read."""
    return F.from_json(document, F.lit(schema), {"mode": "FAILFAST"})


def same_balance(left: Column, right: Column, tolerance: str = amounts.TOLERANCE) -> Column:
    """Whether two balances as printed agree: as amounts within the tolerance, as text if one of them is none."""
    a, b = amounts.parse_amount(left), amounts.parse_amount(right)
    return F.when(a.isNull() | b.isNull(), left == right).otherwise(amounts.balances_match(a, b, tolerance))


def may_stay(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """``files`` with eligible, by today's markers."""
    return files.withColumn("eligible", F.coalesce(eligible("text", include, exclude), F.lit(False)))
