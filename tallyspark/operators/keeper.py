"""Which staged file stands for an account and period.

Every step of the decision is a column; the outcome is one CASE. Nothing is collected but the names in alerts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How well a file's period is known; smaller is better.
SOURCE_RANK = {"manual": -1, "annual": 0, "content": 1, "filename": 2, "unknown": 3}


def source_rank(source: Column) -> Column:
    out = F.lit(3)
    for name, rank in SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def first_of_digest(files: DataFrame, within: list[str], digest: str = "sha256", path: str = "path") -> DataFrame:
    """Of the files of one content the one with the smallest path; copies are combined in each task before they meet."""
    row = F.min_by(F.struct(*files.columns), F.col(path)).alias("row")
    return files.groupBy(*(F.col(c).alias(f"__{c}") for c in (*within, digest))).agg(row).select("row.*")


def collapse_key(files: DataFrame) -> Column:
    """Equal for files that are one statement: by reference and date if both are known, else by dates and balances."""
    own = F.struct(F.lit("identity").alias("kind"), F.col("statement_date").cast("string").alias("a"), F.col("period_start").cast("string").alias("b"), F.col("period_end").cast("string").alias("c"), F.col("opening").cast("string").alias("d"), F.col("closing").cast("string").alias("e"))
    none = F.lit(None).cast("string")
    ref = F.struct(F.lit("invoice").alias("kind"), F.col("reference").alias("a"), F.col("statement_date").cast("string").alias("b"), none.alias("c"), none.alias("d"), none.alias("e"))
    return F.when(F.col("reference").isNotNull() & F.col("statement_date").isNotNull(), ref).otherwise(own)


def richness(files: DataFrame) -> Column:
    """How many of the five parsed fields a file has."""
    fields = ("statement_date", "period_start", "period_end", "opening", "closing")
    return sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))


def keep_pdf(files: DataFrame, within: list[str]) -> DataFrame:
    """(within, outcome, keeper_path): outcome is prepared, rejected or ambiguous; keeper_path is null unless prepared.

    ``files``: path, sha256, source, manual, excluded, has_markers (an include list exists), included, statement_date,
    period_start, period_end, opening, closing, reference, mail_date. In order: one file per digest; files excluded and not manual go; a manual
    file wins, the last by path; without an include list the last file wins; files off the list go; the best source; one file, or one
    digest, wins; several or weak collapse keys are ambiguous; the richest, then the latest mail, and a tie is ambiguous.
    """
    unique = first_of_digest(files, within)
    # files that can't be used stay as rows, so that a period of which every file is excluded is rejected in the same grouping
    usable = unique.withColumns({"usable": F.col("manual") | ~F.col("excluded"), "rank": source_rank(F.col("source")), "rich": richness(unique), "ck": collapse_key(unique)})
    usable = usable.withColumn("weak", (F.col("ck.kind") == "identity") & F.coalesce("ck.a", "ck.b", "ck.c", "ck.d", "ck.e").isNull())
    w = Window.partitionBy(*within)
    listed = F.col("usable") & (F.col("included") | ~F.col("has_markers"))
    stepped = usable.withColumn("best", F.min(F.when(listed, F.col("rank"))).over(w))
    finalist = listed & (F.col("rank") == F.col("best"))
    marked = stepped.withColumn("final", finalist)
    per = marked.withColumn("top_rich", F.max(F.when(F.col("final"), F.col("rich"))).over(w))
    rich = F.col("final") & (F.col("rich") == F.col("top_rich"))
    per = per.withColumn("top", rich).withColumn("last_mail", F.max(F.when(rich, F.col("mail_date"))).over(w))
    at_top = F.col("top")
    latest = at_top & (F.col("mail_date") == F.col("last_mail"))
    sums = per.groupBy(*within).agg(
        F.max(F.when(F.col("manual"), F.col("path"))).alias("manual_path"),
        F.max(F.when(F.col("usable"), F.col("path"))).alias("last_path"),
        F.bool_or(F.when(F.col("usable"), F.col("has_markers"))).alias("has_markers"),
        F.count_if(F.col("final")).alias("n_final"),
        F.max(F.when(F.col("final"), F.col("path"))).alias("final_path"),
        F.count_distinct(F.when(F.col("final"), F.to_json("ck"))).alias("n_keys"),
        F.bool_or(F.col("final") & F.col("weak")).alias("weak"),
        F.count_if(at_top).alias("n_top"),
        F.max(F.when(at_top, F.col("path"))).alias("top_path"),
        F.count_if(latest).alias("n_latest"),
        F.max(F.when(latest, F.col("path"))).alias("latest_path"),
    )
    ambiguous = F.struct(F.lit("ambiguous").alias("outcome"), F.lit(None).cast("string").alias("keeper_path"))

    def prepared(path: str) -> Column:
        return F.struct(F.lit("prepared").alias("outcome"), F.col(path).alias("keeper_path"))

    decided = (
        F.when(F.col("manual_path").isNotNull(), prepared("manual_path"))
        .when(~F.col("has_markers"), prepared("last_path"))
        .when(F.col("n_final") == 0, F.struct(F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("keeper_path")))
        .when(F.col("n_final") == 1, prepared("final_path"))
        .when((F.col("n_keys") > 1) | F.col("weak"), ambiguous)
        .when(F.col("n_top") == 1, prepared("top_path"))
        .when(F.col("n_latest") == 1, prepared("latest_path"))
        .otherwise(ambiguous)
    )
    return sums.select(*within, decided.alias("d")).select(*within, "d.outcome", "d.keeper_path")


def keep_csv(files: DataFrame, within: list[str]) -> DataFrame:
    """(within, keeper_path) of CSV files, never ambiguous: best source, latest mail, last path."""
    usable = first_of_digest(files, within).where("manual or not excluded").where("manual or included or not has_markers")
    order = Window.partitionBy(*within).orderBy(F.col("manual").desc(), source_rank(F.when(F.col("manual"), "manual").otherwise(F.col("source"))), F.col("mail_date").desc_nulls_last(), F.col("path").desc())
    return usable.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*within, F.col("path").alias("keeper_path"))


def alerts(files: DataFrame, decisions: DataFrame, within: list[str]) -> DataFrame:
    """(within, kind, files) of periods without a keeper: the paths in order, joined by commas."""
    bad = decisions.where("outcome <> 'prepared'").select(*within, F.col("outcome").alias("kind"))
    return files.join(bad, within).groupBy(*within, "kind").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"))


def unique_names(files: DataFrame, within: list[str], name: str = "name", order: str = "path") -> DataFrame:
    """``files`` with unique_name: repeats of a name get `` (1)``, `` (2)`` before the suffix."""
    n = F.row_number().over(Window.partitionBy(*within, name).orderBy(order)) - 1
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return files.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), suffix)))
