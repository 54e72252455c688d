"""Statements that users upload: where each goes, under which name, and which are refused.

A PDF goes to staging as ``manual__{key}.pdf``, where cleanup decides on it; an export of one period goes straight to its canonical place; the exports
in an archive go to staging, named by the period that they say. A period that has a canonical file of the kind is never replaced by an upload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import periods
from tallyspark.operators import run
from tallyspark.sources import archives, files
from tallyspark.sources.published import Published

PREFIX = "manual__"
PERIOD = ["account", "kind", "key"]


def is_period(key: Column | str) -> Column:
    """Whether a key names a month, a fiscal or a calendar year that there is."""
    return F.coalesce(periods.key_bounds(key)["start"].isNotNull(), F.lit(False))


def plan(uploads: DataFrame, canonical: DataFrame, root: str, staging: str, order: str = "at") -> DataFrame:
    """``uploads`` (account, account_type, kind: pdf or csv, key, and ``order``, which no two uploads of a period share) with outcome and target.

    ``canonical`` has the (account, kind, key) of what there is. Outcomes: ``invalid`` for a key that names no period or another kind of file, ``exists`` where a
    canonical file is, or where an earlier upload has put an export; ``replaced`` for a PDF that a later one of its period overwrites in staging; else
    ``staged`` or ``saved``, with the path as target. Nulls in account, kind or key are invalid.
    """
    valid = is_period("key") & F.col("kind").isin("pdf", "csv") & F.col("account").isNotNull()
    there = canonical.select(*PERIOD).distinct().withColumn("__there", F.lit(True))
    # invalid ones have bounds too, which nothing reads: to leave them out would be to look at every key twice
    bounds = uploads.groupBy(*PERIOD).agg(F.min(order).alias("__first"), F.max(order).alias("__last"))
    joined = uploads.join(there, PERIOD, "left").join(bounds, PERIOD, "left")
    outcome = (
        F.when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.col("__there"), "exists")
        .when(F.col("kind") == "pdf", F.when(F.col(order) == F.col("__last"), "staged").otherwise("replaced"))
        .otherwise(F.when(F.col(order) == F.col("__first"), "saved").otherwise("exists"))
    )
    waiting = F.concat_ws("/", F.lit(staging.rstrip("/")), "account_type", "account", F.concat(F.lit(PREFIX), "key", F.lit(".pdf")))
    place = files.canonical_path(root, F.col("key"), F.col("account_type"), F.col("account"), ".csv")
    marked = joined.withColumn("outcome", outcome)
    target = F.when(F.col("outcome") == "staged", waiting).when(F.col("outcome") == "saved", place)
    return marked.withColumn("target", target).select(*uploads.columns, "outcome", "target")


def leaf(name: Column | str) -> Column:
    """The file name of an archive member, ``attachment.csv`` where its path has none."""
    last = F.regexp_extract(F.rtrim(F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/")), F.lit("/")), r"([^/]*)$", 1)
    return F.when(last.isin("", ".", "..") | last.isNull(), "attachment.csv").otherwise(last)


def staged_names(members: DataFrame, taken: DataFrame) -> DataFrame:
    """``members`` (account, path, name, key) with key (null if it names no period) and target: the name in staging, which is nobody else's.

    ``taken`` (account, name) are the names in staging. A repeat gets `` (1)``, `` (2)`` before the suffix, the least number that is free, in order of
    path; a number that a member's own name has counts as a repeat's.
    """
    number, suffix = r" \((\d+)\)(?=\.[^.]*$|$)", r"(\.[^.]*)$"

    def parts(name: Column) -> Column:
        plain = F.regexp_replace(name, number, "")
        return F.struct(F.regexp_replace(plain, suffix, "").alias("stem"), F.regexp_extract(plain, suffix, 1).alias("suffix"), F.coalesce(F.regexp_extract(name, number, 1).try_cast("long"), F.lit(0)).alias("n"))

    known = is_period("key")
    new = members.withColumn("key", F.when(known, F.col("key"))).withColumn("__p", parts(F.concat(F.lit(PREFIX), F.when(known, F.concat("key", F.lit(".csv"))).otherwise(leaf("name")))))
    within = ["account", "__p.stem", "__p.suffix"]
    k = F.row_number().over(Window.partitionBy(*within).orderBy("path")) - 1
    own = taken.select(F.col("account").alias("__a"), parts(F.col("name")).alias("t")).groupBy("__a", F.col("t.stem").alias("__s"), F.col("t.suffix").alias("__x")).agg(F.array_sort(F.collect_set("t.n")).alias("__taken"))
    joined = new.withColumn("__k", k).join(own, F.col("account").eqNullSafe(F.col("__a")) & (F.col("__p.stem") == F.col("__s")) & (F.col("__p.suffix") == F.col("__x")), "left")
    # before the i-th taken number t lie t - i free ones
    below = F.size(F.filter(F.coalesce("__taken", F.array().cast("array<bigint>")), lambda t, i: t - i <= F.col("__k")))
    n = F.col("__k") + below
    name = F.concat("__p.stem", F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(""), F.col("__p.suffix"))
    return joined.withColumn("target", name).select(*members.columns, "target")


def from_archives(zips: DataFrame, taken: DataFrame, passwords: list[str] | None = None, anchor: int = 1) -> tuple[DataFrame, DataFrame]:
    """(account, path, name, text, key, source, target) of the exports in ``zips`` (account, path, content), and (account, path, error) of archives that can't be read.

    The key is that of the export's content, or of its name; bytes that aren't UTF-8 become replacement characters. Every archive is opened once for the
    keys and once for the texts, unless the caller writes the members first.
    """
    owner = zips.select("account", F.col("path").alias("__archive"))
    found = archives.csv_members(zips.select("path", "content"), "path", "content", passwords).join(owner, F.col("path") == F.col("__archive"))
    read = found.where("error is null").select("account", F.concat_ws("!/", "path", "name").alias("path"), "name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    said = run.export_keys(read.select("path", "text", "name", F.lit(anchor).alias("anchor"))).select(F.col("id").alias("__id"), "key", "source")
    keyed = read.join(said, F.col("path") == F.col("__id")).drop("__id")
    return staged_names(keyed, taken), found.where("error is not null").select("account", "path", "error")


def save(planned: DataFrame, staging: Published, canonical: Published) -> tuple[int, int]:
    """Publish what :func:`plan` admits, PDFs to ``staging`` and exports to ``canonical``; the generations of both.

    A table whose rows don't change stays as it is. Saving again is harmless: what was saved then exists.
    """
    made = []
    for table, outcome in ((staging, "staged"), (canonical, "saved")):
        rows = planned.where(F.col("outcome") == outcome).drop("outcome")
        made.append(table.generation() if rows.isEmpty() else table.upsert(rows))
    return made[0], made[1]
