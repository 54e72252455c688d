"""Metadata documents of accounts: JSON, checked field by field, and computed anew where there is none.

Documents are read as variants, so a field may have any type until it is looked at: one account's broken document is a row with a problem and doesn't
end the read of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STATEMENT = (
    "statement_date: string, formats: array<string>, opening_balance: string, closing_balance: string, period_start: string, period_end: string,"
    " period_approximate: boolean, granularity: string, covered_months: array<string>, year_key: string"
)
_COVERED = (
    "start: string, end: string, segments: array<struct<start: string, end: string, approximate: boolean>>,"
    " gaps: array<struct<start: string, end: string, balances_match: boolean>>, months: array<string>, approximate_statement_count: bigint"
)
#: What :func:`checked` returns as ``metadata``.
METADATA = (
    "account_number: string, bank: string, variant: string, account_type: string, opening_date: string, closing_date: string, formats: array<string>,"
    f" statements: array<struct<{_STATEMENT}>>, statement_dates: array<string>, starting: string, ending: string, statement_count: bigint,"
    f" period_covered: struct<{_COVERED}>, last_fetch_date: string"
)


def documents(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """(path, document): every metadata document below ``root``, one row each."""
    read = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def _kind(v: Column, path: str) -> Column:
    """The JSON type at a path: LIST, OBJECT, BOOLEAN, BIGINT, STRING, ..; null where nothing or JSON's null is."""
    at = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(at.startswith("ARRAY"), "LIST").when(at.startswith("OBJECT"), "OBJECT").when(at != "VOID", at)


def _is_not(v: Column, path: str, kind: str) -> Column:
    """Whether something of another type is at the path."""
    return F.coalesce(_kind(v, path) != kind, F.lit(False))


def _lacks(v: Column, path: str, kind: str) -> Column:
    """Whether nothing of the type is at the path."""
    return ~F.coalesce(_kind(v, path) == kind, F.lit(False))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _items(v: Column, path: str) -> Column:
    """The objects of a list, as variants; what else is in it doesn't count."""
    all_ = F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(all_, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _problem_of_statement(s: Column) -> Column:
    return (
        F.when(_kind(s, "$.statement_date").isNull(), "a statement has no date")
        .when(_lacks(s, "$.formats", "LIST"), "formats must be a list")
        .when(_is_not(s, "$.period_approximate", "BOOLEAN"), "period_approximate must be true or false")
        .when(~F.coalesce(_get(s, "$.granularity", "string").isin("monthly", "annual"), F.lit(False)), "granularity must be monthly or annual")
        .when(_lacks(s, "$.covered_months", "LIST"), "covered_months must be a list")
    )


def problem(v: Column) -> Column:
    """The first thing wrong with a document (a variant); null if it is sound."""
    statements = F.filter(F.transform(_items(v, "$.statements"), _problem_of_statement), lambda p: p.isNotNull())
    segments = F.exists(_items(v, "$.period_covered.segments"), lambda s: _is_not(s, "$.approximate", "BOOLEAN"))
    return (
        F.when(v.isNull(), "not JSON")
        .when(_lacks(v, "$", "OBJECT"), "metadata must be an object")
        .when(_lacks(v, "$.statements", "LIST"), "statements must be a list")
        .when(F.size(statements) > 0, F.get(statements, F.lit(0)))
        .when(_lacks(v, "$.period_covered", "OBJECT"), "period_covered must be an object")
        .when(segments, "approximate must be true or false")
        .when(_is_not(v, "$.period_covered.approximate_statement_count", "BIGINT"), "approximate_statement_count must be a number")
        .when(_is_not(v, "$.statement_count", "BIGINT"), "statement_count must be a number")
        .when(F.greatest(*(_kind(v, f"$.{n}").isNull() for n in ("account_number", "bank", "account_type"))), "account_number, bank and account_type must be there")
    )


def _strings(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _metadata(v: Column) -> Column:
    text = lambda s, *names: [_get(s, f"$.{n}", "string").alias(n) for n in names]
    flag = lambda s, name: F.coalesce(_get(s, f"$.{name}", "boolean"), F.lit(False)).alias(name)
    statement = lambda s: F.struct(
        *text(s, "statement_date"), _strings(s, "$.formats").alias("formats"), *text(s, "opening_balance", "closing_balance", "period_start", "period_end"), flag(s, "period_approximate"),
        *text(s, "granularity"), _strings(s, "$.covered_months").alias("covered_months"), *text(s, "year_key"),
    )
    match = lambda g: F.when(_kind(g, "$.balances_match") == "BOOLEAN", _get(g, "$.balances_match", "boolean")).alias("balances_match")
    covered = F.struct(
        _get(v, "$.period_covered.start", "string").alias("start"), _get(v, "$.period_covered.end", "string").alias("end"),
        F.transform(_items(v, "$.period_covered.segments"), lambda s: F.struct(*text(s, "start", "end"), flag(s, "approximate"))).alias("segments"),
        F.transform(_items(v, "$.period_covered.gaps"), lambda g: F.struct(*text(g, "start", "end"), match(g))).alias("gaps"),
        _strings(v, "$.period_covered.months").alias("months"), F.coalesce(_get(v, "$.period_covered.approximate_statement_count", "bigint"), F.lit(0)).alias("approximate_statement_count"),
    )
    dates = _strings(v, "$.statement_dates")
    return F.struct(
        *text(v, "account_number", "bank", "variant", "account_type", "opening_date", "closing_date"), _strings(v, "$.formats").alias("formats"),
        F.transform(_items(v, "$.statements"), statement).alias("statements"), dates.alias("statement_dates"), *text(v, "starting", "ending"),
        F.coalesce(_get(v, "$.statement_count", "bigint"), F.size(dates).cast("bigint")).alias("statement_count"), covered.alias("period_covered"), *text(v, "last_fetch_date"),
    ).cast(f"struct<{METADATA}>")


def checked(docs: DataFrame, document: str = "document", strict: bool = False) -> DataFrame:
    """``docs`` with metadata and problem in place of the document.

    An object without ``statements``, as the mark of a fetch leaves it, has neither: it counts as no document. Missing lists are empty, missing flags false, a
    missing statement_count is the number of statement_dates; numbers stand for texts, but not for flags, nor texts for either. With ``strict`` a problem fails the read.
    """
    read = docs.withColumn("__v", F.try_parse_json(document)).drop(document)
    bare = (_kind(F.col("__v"), "$") == "OBJECT") & _get(F.col("__v"), "$.statements", "variant").isNull()  # JSON's null would be a variant
    marked = read.withColumn("problem", F.when(~F.coalesce(bare, F.lit(False)), problem(F.col("__v"))))
    if strict:
        marked = marked.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")))
    return marked.withColumn("metadata", F.when(F.col("problem").isNull() & ~bare, _metadata(F.col("__v")))).drop("__v")


def load(accounts: DataFrame, docs: DataFrame, computed: DataFrame, key: str = "account") -> DataFrame:
    """``accounts`` with metadata, stored (whether it is that of a document) and problem.

    ``docs`` and ``computed`` have the ``key``; ``docs`` come from :func:`checked`, ``computed`` has metadata as made anew, which stands in where no document is
    stored and none is broken. A broken one is no reason to pass over what somebody has written: metadata is null then.
    """
    stored = docs.select(F.col(key).alias("__k"), F.col("metadata").alias("__stored"), "problem")
    made = computed.select(F.col(key).alias("__m"), F.col("metadata").alias("__made"))
    joined = accounts.join(stored, F.col(key) == F.col("__k"), "left").join(made, F.col(key) == F.col("__m"), "left")
    found = F.when(F.col("problem").isNull(), F.coalesce("__stored", "__made"))
    return joined.select(*accounts.columns, found.alias("metadata"), F.col("__stored").isNotNull().alias("stored"), "problem")
