"""Substring dedup by hashing of lines, and of the sentences inside them.

Texts are split into lines, and lines of several sentences into these. Units are normalised (lower case, white space runs as one blank,
trimmed) and hashed; of each digest the earliest occurrence, by rank of the document and place in it, is kept and every other
one is a later one. Later lines go. Later sentences go where they follow each other for ``RUN`` words or more: passages are often
pasted into the middle of a line, where no line is equal, while a short sentence alone repeats by chance. What is removed keeps
the byte offsets that it has in the original text.

Units of fewer than ``min_words`` words stay; with 1 every unit that isn't blank is looked at. Defined results: a null text has no units
and stays null; an empty one stays empty; texts of any length are read whole, a line at a time; documents rank by key, then by text digest, a null key
last; the key is of any type that can be ordered; rows that are equal in key and text are one document to this operator and get the
same result; a unit that repeats inside a document goes as well; columns of ``docs`` named removed, passages or kept are
replaced, others stay; empty tables give empty tables. 64-bit digests decide equality.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.store import Workspace

MIN_WORDS = 5
RUN = 20  # words of sentences that follow each other
LINE, PARAGRAPH = b"\n", b"\n\n"
_STOP = re.compile(rb"[.!?]+[ \t]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[ \t]*")
_FLUSH = 100_000  # rows of an output batch
_SPANS = "array<struct<start:bigint,n_bytes:bigint>>"


def units(raw: bytes, separator: bytes = LINE, sentences: bool = True) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, sentences as (start, end)) of every line; ends include what separates. A line of one sentence lists none."""
    start = 0
    for line in raw.split(separator):
        end = min(start + len(line) + len(separator), len(raw))
        cuts = [start + m.end() for m in _STOP.finditer(line) if m.end() < len(line)] if sentences else []
        yield start, end, list(zip([start, *cuts], [*cuts, end], strict=True)) if cuts else []
        start = end


def unit_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: bytes = LINE, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """(k, md5, at, digest): the units of at least ``min_words`` words, at counts all units of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            own = pa.array(np.repeat(np.arange(len(found)), [len(a) for _, a, _ in found]))
            md5 = pa.array([m for m, _, _ in found], pa.binary()).take(own)
            at = np.concatenate([np.asarray(a, np.int32) for _, a, _ in found])
            digest = np.frombuffer(b"".join(d for _, _, d in found), np.int64)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(own), md5, pa.array(at), pa.array(digest)], names=["k", "md5", "at", "digest"])

        found: list[tuple[bytes, list[int], bytes]] = []
        keys, size = [], 0
        for b in batches:
            for i, value in enumerate(b.column(1)):
                raw = value.as_py()
                at, digests = [], []
                spans = (x for start, end, inner in units(raw, separator, sentences) for x in ((start, end), *inner))
                for n, (start, end) in enumerate(spans):
                    parts = raw[start:end].decode("utf-8", "replace").lower().split()
                    if len(parts) >= min_words:
                        at.append(n)
                        digests.append(hashlib.blake2b(" ".join(parts).encode(), digest_size=8).digest())
                if at:
                    found.append((hashlib.md5(raw).digest(), at, b"".join(digests)))
                    keys.append(b.column(0).slice(i, 1))
                    size += len(at)
                if size >= _FLUSH:
                    yield out()
                    found, keys, size = [], [], 0
        if found:
            yield out()

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, md5 binary, at int, digest long")


def repeated_units(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: bytes = LINE, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """(__d_k, __d_md5, __units): per document the units that occur more than once, as (at, whether an earlier one exists), in order."""
    work = Workspace(docs.sparkSession, "units")
    # rows that are equal in key and text would otherwise count as repeats of each other
    rows = work.save(unit_rows(docs, key, text, separator, min_words, sentences), "units")
    rank = F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("md5"), F.col("at"))
    # as a table of its own the join to it can be split where one unit has most rows, and is a broadcast where Spark finds it small
    firsts = work.save(rows.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last").select(F.col("digest").alias("f"), "first"), "firsts")
    met = rows.join(firsts, F.col("digest") == F.col("f")).select("k", "md5", F.struct("at", (rank > F.col("first")).alias("later")).alias("unit"))
    found = met.groupBy(F.col("k").alias("__d_k"), F.col("md5").alias("__d_md5")).agg(F.array_sort(F.collect_set("unit")).alias("__units"))
    out = work.save(found, "found")
    work.drop("units", "firsts")
    return out


def decide(raw: bytes, flagged: dict[int, bool], separator: bytes = LINE, run: int = RUN, sentences: bool = True) -> tuple[list, list]:
    """(removed, passages) as (start, n_bytes) spans, from the repeated units of ``raw``: at -> later."""
    pieces, n = [], 0  # later lines whole, others by sentence
    for start, end, inner in units(raw, separator, sentences):
        each = [(start, end, True, flagged.get(n))] if flagged.get(n) or not inner else [(a, e, False, flagged.get(i)) for i, (a, e) in enumerate(inner, n + 1)]
        n += 1 + len(inner)
        pieces += [(a, e, words, line, later) for a, e, line, later in each if (words := len(raw[a:e].split()))]

    def runs(wanted: Callable[[bool | None], bool], lines: bool) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for inside, group in groupby(pieces, lambda p: wanted(p[4])):
            held = list(group)
            long = sum(p[2] for p in held) >= run
            for start, end, _, line, _ in held if inside else ():
                if not long and not (lines and line):
                    continue
                if out and not raw[out[-1][1] : start].strip() and (long or out[-1][1] == start):
                    out[-1][1] = end
                else:
                    out.append([start, end])
        return [(start, end - start) for start, end in out]

    return runs(lambda later: later is True, True), runs(lambda later: later is not None, False)


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the (start, length) spans, which are in order and apart."""
    kept, at = [], 0
    for start, n in spans:
        kept.append(raw[at:start])
        at = start + n
    kept.append(raw[at:])
    return b"".join(kept)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: bytes = LINE, min_words: int = MIN_WORDS, run: int = RUN, sentences: bool = True) -> DataFrame:
    """``docs`` with removed (array of start, n_bytes in the original text), passages (runs of repeated units of at least ``run``
    words, the earliest occurrence included, in the same form) and kept (what remains, as binary)."""
    found = repeated_units(docs, key, text, separator, min_words, sentences)
    plain = docs.drop("removed", "passages", "kept")
    keyed = plain.withColumn("__k", F.col(key)).withColumn("__md5", F.unhex(F.md5(F.col(text))))
    same = F.col("__k").eqNullSafe(F.col("__d_k")) & (F.col("__md5") == F.col("__d_md5"))
    joined = keyed.join(found, same, "left").drop("__k", "__md5", "__d_k", "__d_md5")
    rest = plain.columns
    rows = joined.select(*(F.col(f"`{c}`") for c in rest), F.col(text).cast("binary").alias("__raw"), "__units")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("n_bytes", pa.int64())]))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, passages, kept = [], [], []
            for value, own in zip(b.column(len(rest)), b.column(len(rest) + 1), strict=True):
                raw = value.as_py()
                gone, long = ([], []) if not own.is_valid else decide(raw, {u["at"]: u["later"] for u in own.as_py()}, separator, run, sentences)
                removed.append([{"start": a, "n_bytes": n} for a, n in gone])
                passages.append([{"start": a, "n_bytes": n} for a, n in long])
                kept.append(cut(raw, gone) if gone else raw)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(removed, kind), pa.array(passages, kind), pa.array(kept, pa.binary())], names=[*rest, "removed", "passages", "kept"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields]
    return rows.mapInArrow(shorten, ", ".join([*fields, f"removed {_SPANS}", f"passages {_SPANS}", "kept binary"]))
