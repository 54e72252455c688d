"""Settings: accounts from JSON, defaults by handler, values from environment files and overrides of a run."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import account_date
from tallyspark.functions.text import distinct_words, senders
from tallyspark.operators import accounts as dimension
from tallyspark.operators import handlers

_LISTS = "text_contains array<string>, text_not_contains array<string>"
ACCOUNTS = (
    "bank string, variant string, account_number string, type string, opening_date string, closing_date string, passwords array<string>,"
    f" mail struct<subjects: array<string>, body_contains: array<string>, `from`: array<string>>, statement struct<{_LISTS.replace(' array', ': array')}>"
)
HOPS = 10


def env_chain(start: str, hop: str = "ENV_PATH") -> dict[str, str]:
    """The values of an environment file and of those it leads to; a later file's win. A file that isn't there says nothing."""
    found: dict[str, str] = {}
    path = Path(start)
    for _ in range(HOPS):
        if not path.is_file():
            return found
        rows = [x.strip() for x in path.read_text(encoding="utf-8").splitlines()]
        own = dict(x.removeprefix("export ").split("=", 1) for x in rows if "=" in x and not x.startswith("#"))
        own = {k.strip(): v.strip().strip("\"'") for k, v in own.items()}
        found |= {k: v for k, v in own.items() if k != hop}
        if not own.get(hop):
            return found
        path = path.parent / own[hop]
    raise ValueError(f"more than {HOPS} environment files in a row")


class Env:
    """Typed values of a mapping, by default of the process's environment."""

    def __init__(self, values: Mapping[str, str] | None = None):
        self.values = os.environ if values is None else values

    def text(self, name: str, default: str | None = None) -> str:
        value = (self.values.get(name) or "").strip()
        if not value and default is None:
            raise ValueError(f"{name} is required")
        return value or str(default)

    def number(self, name: str, default: int) -> int:
        return int(self.text(name, str(default)))

    def flag(self, name: str, default: bool) -> bool:
        value = self.text(name, "true" if default else "false").lower()
        if value not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"{name} must be true or false")
        return value in ("1", "true", "yes", "on")


def load_accounts(spark: SparkSession, path: str) -> DataFrame:
    """The accounts of a JSON file, which must be an array of objects; a value of another type is an error."""
    first = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^\s*(.)", 1).alias("c")).first()
    if first is None or first["c"] != "[":
        raise ValueError(f"accounts must be a JSON array: {path}")
    return spark.read.schema(ACCOUNTS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _words(items: Column) -> Column:
    return distinct_words(F.coalesce(items, F.array().cast("array<string>")))


def account_type(name: Column | str) -> Column:
    """``credit_card``, also for none, or ``bank_account``, in any case and with blanks; another type fails the read."""
    plain = F.replace(F.lower(F.trim(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(plain == "", "credit_card").when(plain.isin("credit_card", "bank_account"), plain).otherwise(F.raise_error(F.concat(F.lit("no type of account: "), plain)).cast("string"))


def resolve(raw: DataFrame, today: Column | None = None) -> DataFrame:
    """``raw`` accounts with their handler's defaults: bank, variant, account_number, type, opening, closing, passwords, subjects,
    body_contains, senders, text_contains, text_not_contains, fiscal, tolerance.

    An account's own subjects, body markers and senders replace the handler's, its text markers join them. A number that several
    banks have, or an empty one, fails the read, and so do a type or a sender that can't be.
    """
    own = raw.select(
        F.lower(F.trim("bank")).alias("bank"), F.coalesce(F.lower(F.trim("variant")), F.lit("default")).alias("variant"), F.trim("account_number").alias("account_number"),
        account_type("type").alias("type"), account_date("opening_date", today).alias("opening"), account_date("closing_date", today).alias("closing"),
        F.coalesce("passwords", F.array().cast("array<string>")).alias("passwords"), _words(F.col("mail.subjects")).alias("own_subjects"), _words(F.col("mail.body_contains")).alias("own_body"),
        senders(F.coalesce(F.col("mail.from"), F.array().cast("array<string>"))).alias("senders"), _words(F.col("statement.text_contains")).alias("text_contains"), _words(F.col("statement.text_not_contains")).alias("own_exclude"),
    )
    known = handlers.registry(raw.sparkSession)
    from tallyspark.operators.selection import with_fallback

    keyed = with_fallback(own, known.select("bank", "variant", F.concat_ws("/", "bank", "variant").alias("rule")))
    rules = known.select(F.concat_ws("/", "bank", "variant").alias("r"), "subjects", "annual_subjects", "body", "exclude", "fiscal", "tolerance")
    joined = keyed.join(rules, F.col("rule") == F.col("r"), "left")
    either = lambda mine, theirs: F.when(F.size(mine) > 0, F.col(mine)).otherwise(theirs)
    out = joined.select(
        "bank", "variant", F.when(F.col("account_number") != "", F.col("account_number")).otherwise(F.raise_error(F.lit("an account has no number")).cast("string")).alias("account_number"),
        "type", "opening", "closing", "passwords", either("own_subjects", F.concat("subjects", "annual_subjects")).alias("subjects"), either("own_body", F.col("body")).alias("body_contains"), "senders",
        "text_contains", F.array_union(F.coalesce("exclude", F.array().cast("array<string>")), "own_exclude").alias("text_not_contains"), "fiscal", "tolerance",
    )
    return dimension.checked(out)


def for_run(accounts: DataFrame, overrides: Mapping[str, object] | None = None) -> DataFrame:
    """The accounts of a run: ``identifier`` picks one, which must be there; values that are None don't count."""
    patch = {k: v for k, v in (overrides or {}).items() if v is not None}
    unknown = set(patch) - {"identifier"}
    if unknown:
        raise ValueError(f"no such override: {', '.join(sorted(unknown))}")
    return dimension.to_run(accounts, patch.get("identifier"))  # type: ignore[arg-type]
