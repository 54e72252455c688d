"""Filter interaction audit by an incidence matrix product.

Each document fails some of n filters: its mask. A part (source) has three histograms over the 2 ** n masks: all documents, the good and
the toxic ones. Stacked as rows they are multiplied by integer matrices with a column for every step of every order of the filters (32 by 600 for
five), which say of each mask whether it is kept after the step, removed in it, removed earlier though it fails the step's filter, or fails that filter
alone. So any number of documents costs one count by part and mask, and all orders are read off the histograms.

Defined results: a null text counts as empty; a null part is the empty string; a document without labels is neither good nor toxic, one
with several rows of labels is what any of them says; a row fails the repeat filter if a smaller key has the same text, so rows that repeat with the
same key don't fail by each other and a null key neither fails nor makes others fail; texts of any length are looked at whole; an empty
table gives an empty table. Only key, part and text are read, so no other column's name clashes. Texts are identified by MD5.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.store import Workspace

WORD = r"[^\x20\x09-\x0D]+"
REPEAT = "E"  # the filter that compares texts with each other
_SLICE = 64  # parts multiplied at once


def text_filters(text: Column) -> dict[str, Column]:
    """By letter, whether ``text`` (not null) fails: A few words, B repeated words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, work: Workspace, filters: dict[str, Column], key: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """(key, part, mask): bit i is set where the row fails the i-th of ``filters``, the bit after them where it repeats a smaller key's text.

    The key of the join is text and row key together, so a text with very many copies is no hot key; its smallest key is found by an aggregation
    that combines in each task first.
    """
    bits = sum((F.when(failing, 1 << i).otherwise(0) for i, failing in enumerate(filters.values())), F.lit(0))
    rows = work.save(docs.select(F.col(key).alias("key"), F.coalesce(F.col(part), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("digest")), "rows")
    firsts = work.save(rows.where("key is not null").groupBy("digest").agg(F.min("key").alias("first")), "firsts").withColumnRenamed("digest", "d")
    met = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("key") == F.col("first")), "left")
    later = F.col("key").isNotNull() & F.col("first").isNull()
    return met.select("key", "part", F.when(later, F.col("mask").bitwiseOR(1 << len(filters))).otherwise(F.col("mask")).alias("mask"))


def histograms(masked: DataFrame, labels: DataFrame, work: Workspace, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic) of ``masked`` (key, part, mask)."""
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    known = work.save(labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(says("quality"), says("toxic")), "labels")
    met = masked.join(known, F.col("key") == F.col("k"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return met.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def incidence(n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The matrices (masks by steps of all orders) and the filter of each column."""
    orders = np.array(list(permutations(range(n))), np.int64)
    before = np.zeros_like(orders)  # bits of the filters that come earlier
    before[:, 1:] = np.cumsum(1 << orders, axis=1)[:, :-1]
    own, before = (1 << orders).ravel(), before.ravel()
    mask = np.arange(1 << n)[:, None]
    early, fails = (mask & before) != 0, (mask & own) != 0
    found = {"kept": ~early & ~fails, "removed": ~early & fails, "redundant": early & fails, "unique_fails": mask == own}
    return {k: m.astype(np.int64) for k, m in found.items()}, orders.ravel()


def outcomes(counts: DataFrame, names: str) -> DataFrame:
    """All steps of all orders of the filters ``names``, for every part of ``counts`` (part, mask, n, good, toxic)."""
    n = len(names)
    columns = n * factorial(n)
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** n cells at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, filters = incidence(n)
        orders = ["".join(p) for p in permutations(names)]
        of_filter = (filters[:, None] == np.arange(n)).astype(np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                b = whole.slice(start, _SLICE)
                stacked = np.zeros((3, b.num_rows, 1 << n), np.int64)
                for i, cells in enumerate(b.column(1)):
                    for c in cells.as_py():
                        stacked[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
                docs, good, toxic = stacked
                removed = docs @ by["removed"]
                found = {
                    "kept": docs @ by["kept"],
                    "removed": removed,
                    "redundant": docs @ by["redundant"],
                    "unique_fails": docs @ by["unique_fails"],
                    "good_lost": good @ by["removed"],
                    "toxic_lost": toxic @ by["removed"],
                    "shapley": (removed @ of_filter)[:, filters],
                }
                part = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), columns)))
                order = pa.array(orders).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), n), b.num_rows)))
                step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders) * b.num_rows))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(m.ravel()) for m in found.values())], names=["part", "filter_order", "step", *found])

    counted = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return rows.mapInArrow(run, f"part string, filter_order string, step int, {counted}")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "source", text: str = "text", filters: dict[str, Column] | None = None) -> DataFrame:
    """The outcomes of every order of ``filters`` (letter: whether a row of ``docs`` fails) and of the repeat filter, for every part."""
    work = Workspace(docs.sparkSession, "audit")
    chosen = text_filters(F.coalesce(F.col(text), F.lit(""))) if filters is None else filters
    masked = masks(docs, work, chosen, key, part, text)
    counts = work.save(histograms(masked, labels, work, key), "counts")
    work.drop("rows", "firsts", "labels")
    return outcomes(counts, "".join(chosen) + REPEAT)
