"""Messages against account rules."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import between_months

BLOCK = 5000  # account rules that are broadcast at once


def subject_matches(subject: Column, wanted: Column) -> Column:
    """Any wanted string in the subject, case ignored."""
    return F.coalesce(F.exists(wanted, lambda s: F.contains(F.lower(subject), F.lower(s))), F.lit(False))


def sender_matches(address: Column, wanted: Column) -> Column:
    """A full address or its exact domain is wanted; an empty list wants all; no address never matches a list."""
    a = F.lower(address)
    hit = F.exists(wanted, lambda w: (F.lower(w) == a) | (F.lower(F.ltrim(w, F.lit("@"))) == F.substring_index(a, "@", -1)))
    return F.when(F.size(wanted) == 0, True).otherwise(F.coalesce(hit, F.lit(False)))


def body_matches(body: Column, attachment_names: Column, wanted: Column) -> Column:
    """Any marker in the body or an attachment's name; an empty list wants all."""
    text = F.concat_ws("\n", body, F.array_join(attachment_names, "\n"))
    return (F.size(wanted) == 0) | F.exists(wanted, lambda w: F.contains(text, w))


def is_annual(subject: Column, body: Column) -> Column:
    """Year-end mail by its subject, or by its body if the subject doesn't say."""
    pattern = r"(?i)annual|year end"
    return F.coalesce(subject.rlike(pattern), F.lit(False)) | F.coalesce(body.rlike(pattern), F.lit(False))


def attachment_kind(name: Column, content_type: Column, content: Column | None = None, annual: Column | None = None) -> Column:
    """pdf, csv or zip: by suffix, then by type, then for year-end mail by the first bytes; null for others."""
    n, t = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    kind = F.when(F.endswith(n, F.lit(".pdf")), "pdf").when(F.endswith(n, F.lit(".csv")), "csv").when(F.endswith(n, F.lit(".zip")), "zip")
    kind = kind.when(t == "application/pdf", "pdf").when(t.isin("text/csv", "application/csv"), "csv").when(t.isin("application/zip", "application/x-zip-compressed"), "zip")
    if content is not None and annual is not None:
        kind = kind.when(annual & (t == "application/octet-stream") & (F.substring(content, 1, 4) == F.lit(b"%PDF")), "pdf")
    return kind


def for_accounts(messages: DataFrame, accounts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of a message (subject, address, day) and an account (subjects, senders, start, end) whose rules it meets.

    The condition has no equal keys. The rules are a stated set, counted first: up to ``block`` of them go to every task at once, and
    more are met block by block, so that what is broadcast stays bounded.
    """
    sender = sender_matches(F.col("address"), F.col("senders"))
    if "addresses" in messages.columns:  # any of several senders
        sender = sender | F.exists("addresses", lambda a: sender_matches(a, F.col("senders")))
    met = subject_matches(F.col("subject"), F.col("subjects")) & sender & between_months(F.col("day"), F.col("start"), F.col("end"))
    n = max(1, ceil(accounts.count() / block))
    key = F.pmod(F.xxhash64(F.to_json(F.struct(*accounts.columns))), F.lit(n))
    out = messages.join(F.broadcast(accounts.where(key == 0) if n > 1 else accounts), met)
    for i in range(1, n):
        out = out.unionByName(messages.join(F.broadcast(accounts.where(key == i)), met))
    return out


def search_window(opening: Column, last_fetch: Column, closing: Column) -> Column:
    """(since, before): from the opening or the day before the last fetch on, to the closing day, its next day excluded."""
    return F.struct(F.greatest(opening, F.date_sub(last_fetch, 1)).alias("since"), F.date_add(closing, 1).alias("before"))


def imap_criteria(subjects: list[str], since: str | None, before: str | None) -> str:
    """The filter as IMAP search keys, so that the server sends only headers that can match."""
    quoted = [f'SUBJECT "{s.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' for s in subjects]
    tree = ""
    for q in reversed(quoted):
        tree = f"OR {q} {tree}" if tree else q
    parts = [f"SINCE {since}" if since else "", f"BEFORE {before}" if before else "", tree]
    return " ".join(p for p in parts if p) or "ALL"


def gmail_query(subjects: list[str], since: str | None, before: str | None) -> str:
    """The same for a server that searches like Gmail: any subject, days as yyyy/MM/dd."""
    terms = [f'subject:"{s.replace(chr(34), "")}"' for s in subjects]
    any_of = f"({' OR '.join(terms)})" if len(terms) > 1 else "".join(terms)
    return " ".join(x for x in (any_of, f"after:{since}" if since else "", f"before:{before}" if before else "") if x)
