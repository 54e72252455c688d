"""Housekeeping of staged and canonical files: what to exclude, refresh, rewrite or delete. Results are rows of actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import eligible
from tallyspark.sources import deletion, sinks
from tallyspark.sources.published import Published


def check_markers(files: DataFrame, include: list[str], exclude: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, alerts): files that may stay by their text, and one alert per file that is missing the include markers."""
    marked = files.withColumn("__ok", F.coalesce(eligible("text", include, exclude, F.coalesce("manual", F.lit(False))), F.lit(False)))
    kept = marked.where("__ok").drop("__ok")
    alerts = marked.where("not __ok").select("account", "path", F.lit("missing_markers").alias("kind"), F.array(*(F.lit(m) for m in include)).cast("array<string>").alias("text_contains"))
    return kept, alerts


def stale_texts(pdfs: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """PDFs whose text is missing or older than they are."""
    t = texts.select(*keys, F.col("modified").alias("__text_modified"))
    joined = pdfs.join(t, keys, "left")
    return joined.where(F.col("__text_modified").isNull() | (F.col("__text_modified") < F.col("modified"))).drop("__text_modified")


def collapsed(files: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, action): of a prepared period every file is deleted from staging, the keeper after its promotion."""
    chosen = decisions.where("outcome = 'prepared'").select(*keys, "keeper_path")
    action = F.when(F.col("path") == F.col("keeper_path"), "promote").otherwise("delete")
    return files.join(chosen, keys).select(*keys, "path", action.alias("action"))


def outputs_of(account: str, *tables: DataFrame) -> DataFrame:
    """(path) of everything that belongs to an account, each once, in order."""
    paths = [t.where(F.col("account") == account).select("path") for t in tables]
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out.distinct().orderBy("path")


def no_longer_eligible(canonical: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """(account, path): canonical files that today's markers would refuse."""
    ok = F.coalesce(eligible("text", include, exclude, F.coalesce("manual", F.lit(False))), F.lit(False))
    return canonical.where(~ok).select("account", "path")


def first_new(uploads: DataFrame, canonical: DataFrame, keys: list[str]) -> DataFrame:
    """Uploads of periods that have no canonical file."""
    return uploads.join(canonical.select(*keys), keys, "left_anti")


def promote(files: DataFrame, decisions: DataFrame, table: Published, keys: list[str]) -> DataFrame:
    """Publish each period's keeper, its text with it, in ``table``; then (keys, path, modified) of the staged files that may go.

    ``files``: keys, path, modified, sha256, text and whatever else is to be kept. Keepers whose content ``table`` has already aren't written again. If
    the job fails before the publication, ``table`` is as it was and no staged file may go; if it fails after it, the next run finds the keepers published.
    """
    known = collapsed(files, decisions, keys)
    keepers = files.join(known.where("action = 'promote'").select(*keys, "path"), [*keys, "path"], "left_semi")
    current = table.read()
    fresh = keepers if current is None else sinks.changed(keepers, current, keys)
    if not fresh.isEmpty():
        table.upsert(fresh)
    return known.join(files.select(*keys, "path", "modified"), [*keys, "path"]).select(*keys, "path", "modified")


def publish_metadata(metadata: DataFrame, table: Published, key: str, kept: tuple[str, ...] = ("last_fetch_date",)) -> int:
    """Replace the metadata of the accounts in ``metadata``, but for the fields that a refresh must not lose."""
    current = table.read()
    rows = metadata.withColumns({c: F.lit(None).cast("string") for c in kept if c not in metadata.columns})
    return table.upsert(rows if current is None else sinks.keep_fields(rows, current, key, kept))


def delete_account(account: str, table: Published, files: DataFrame, journal: str, root: str) -> DataFrame:
    """Unpublish an account and delete its ``files`` (account, path, modified) below ``root``, with folders that this leaves empty; the outcomes."""
    current = table.read()
    if current is not None:
        table.remove(current.where(F.col("account") == account))
    done = deletion.delete(files.where(F.col("account") == account), journal)
    deletion.prune_folders(done.where("outcome <> 'kept'"), root)
    return done
