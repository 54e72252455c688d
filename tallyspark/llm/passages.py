"""Repeated passages, counted in words.

Every run of ``WORDS`` words that occurs more than once in the corpus is to be found. Words are what white space sets apart and are compared
byte by byte; the white space between them doesn't count. Of each window of ``WORDS`` words the gram of ``GRAM`` words with the
smallest hash is the anchor, and equal windows have it at the same place. An anchor's context is all that its windows cover. Anchors whose gram
occurs elsewhere, as the logarithmic family of suffix indexes of ``suffix_dedup`` finds them, are looked at: equal contexts repeat as a whole, and of the others all windows are hashed and counted. So the
result is exact while an entry is kept for about every 18th word and a row for a window only where a passage begins or ends.

Defined results: a null text stays null; texts of fewer than ``WORDS`` words lose nothing; equal texts of ``WORDS`` words or more lose
everything; a passage goes at every occurrence, from its first word to its last; a repeat inside one document is a repeat; empty tables give
empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import rolling
from tallyspark.llm.store import Workspace
from tallyspark.llm.suffix_dedup import SuffixIndex, distinct_texts, merged

WORDS = 51
GRAM = 16
_CHUNK = 1 << 19  # bytes of text that are hashed at once
_LOW = np.uint64(0xFFFFFFFF)
_BLANK = b" \t\n\x0b\x0c\r"
_WORD_BYTE = np.array([i not in _BLANK for i in range(256)])
_WORD = r"[^\x20\x09-\x0D]+"


def _words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(hash, start, end, text number) of every word, with start and end in its text, and where each text's words begin."""
    data, bounds = rolling.joined([t + b" " for t in texts])
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]  # every text ends outside a word
    begin = np.searchsorted(start, bounds)
    number = np.repeat(np.arange(len(texts)), np.diff(begin))
    return rolling.Spans(data, 5).hash(start, end), start - bounds[number], end - bounds[number], number, begin


def anchors(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(fp, ctx, text number, start, end, n) of every anchor: its n windows cover the bytes start .. end of the text."""
    h, start, end, number, begin = _words(texts)
    n = len(h) - words + 1
    starts = np.flatnonzero(number[words - 1 :] == number[:n]) if n > 0 else np.empty(0, np.int64)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    size = min(GRAM, words)
    at = np.arange(len(h) - size + 1)
    spans = rolling.Spans.of(h)
    grams = spans.hash(at, at + size)
    key = (grams & ~_LOW) | at.astype(np.uint64)  # of equal hashes the first
    at = (rolling.sliding_min(key, words - size + 1) & _LOW).astype(np.int64)[starts]
    new = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate(([0], new))
    low, last = starts[first], starts[np.concatenate((new - 1, [len(starts) - 1]))] + words - 1
    ctx = spans.hash(low, last + 1)
    return grams[at[first]].view(np.int64), ctx.view(np.int64), number[low], start[low], end[last], last - low - words + 2


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` (digest, text, ..) of about ``_CHUNK`` bytes of text."""
    sizes = np.cumsum([0 if t is None else len(t.as_buffer()) for t in batch.column(1)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _CHUNK, "right")))
        yield batch.slice(at, to - at)
        at = to


def entries(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(fp, ctx, digest, start, end, n) of every anchor in ``texts`` (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(b):
                fp, ctx, number, start, end, n = anchors(part.column(1).to_pylist(), words)
                columns = [pa.array(fp, pa.int64()), pa.array(ctx, pa.int64()), part.column(0).take(pa.array(number, pa.int64())), *(pa.array(x.astype(np.int32)) for x in (start, end, n))]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "ctx", "digest", "start", "end", "n"])

    return texts.select("digest", F.col("text").cast("binary")).mapInArrow(run, "fp long, ctx long, digest binary, start int, end int, n int")


def windows(texts: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(window, id, start, end): hash and bytes of all windows of the anchors ``wanted`` (digest, start, n), id of ``texts``."""
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("start", "n")).alias("w"))
    rows = texts.join(lists, "digest").select("id", F.col("text").cast("binary").alias("raw"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _chunks(b):
                h, start, end, number, begin = _words(part.column(1).to_pylist())
                lists = part.column(2)
                own = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                at, n = (np.asarray(lists.flatten().field(i)).astype(np.int64) for i in (0, 1))
                far = 1 << 32  # the words of all texts in one order
                low = np.searchsorted(number * far + start, own * far + at)
                each = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                ids = part.column(0).take(pa.array(np.repeat(own, n)))
                yield pa.RecordBatch.from_arrays([pa.array(rolling.Spans.of(h).hash(each, each + words).view(np.int64)), ids, pa.array(start[each].astype(np.int32)), pa.array(end[each + words - 1].astype(np.int32))], names=["window", "id", "start", "end"])

    return rows.mapInArrow(run, "window long, id long, start int, end int")


def _joint(lists: DataFrame) -> DataFrame:
    """``lists`` (id, spans) with the spans in order, those that overlap or touch made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            joint = [[{"start": a, "end": e} for a, e in merged(np.stack([np.asarray(s.values.field(i)) for i in (0, 1)], 1).astype(np.int64))] for s in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(joint, kind)], names=["id", "spans"])

    return lists.mapInArrow(run, "id long, spans array<struct<start:bigint,end:bigint>>")


def repeated(docs: DataFrame, text: str = "text", words: int = WORDS, batches: int = 3) -> DataFrame:
    """(digest, spans): for each different text that holds repeated passages, the (start, end) bytes of these, in order and apart.

    The suffix index has the texts' suffixes that begin at an anchor, added in ``batches``.
    """
    work = Workspace(docs.sparkSession, "passages")
    # the table is read by digest; inside, texts have short numbers, which keep the rows of windows narrow
    numbered = distinct_texts(docs, text, 2 * words - 1).withColumn("id", F.monotonically_increasing_id())
    texts = work.save_bucketed(numbered, "texts", "digest", dealt=True)
    index = SuffixIndex(work, words, entries)
    batch = F.pmod(F.xxhash64("digest"), F.lit(batches))
    for i in range(batches):
        index.add(texts.where(batch == i))
    rows = work.save(index.repeated(), "repeated")
    index.drop()
    contexts = work.save(rows.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("alike"), F.min(F.struct("digest", "start", "n")).alias("one")), "contexts")
    twice = contexts.where("alike > 1").select("fp", "ctx")
    whole = rows.join(twice, ["fp", "ctx"], "left_semi").select("digest", "start", "end")
    # one of equal contexts goes on, so that others can still meet it
    groups = contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("contexts"), F.min("alike").alias("least")).where("contexts > 1 and least = 1")
    found = work.save(windows(texts, contexts.join(groups, "fp", "left_semi").select("one.*"), words), "windows")
    again = work.save(found.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "again")
    numbers = texts.select("digest", "id")
    hits = found.join(again, "window", "left_semi").select("id", "start", "end")
    hits = hits.unionByName(whole.join(numbers, "digest").select("id", "start", "end"))
    copied = texts.where("copied").where(F.regexp_count("text", F.lit(_WORD)) >= words)
    hits = hits.unionByName(copied.select("id", F.lit(0).alias("start"), F.octet_length("text").alias("end")))
    lists = hits.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = work.save(_joint(lists).join(numbers, "id").select("digest", "spans"), "spans")
    work.drop("texts", "repeated", "contexts", "windows", "again")
    return out


def without(text: Column, spans: Column) -> Column:
    """The text without the spans (start, end) of its bytes, which are in order and apart and begin and end between characters."""
    raw = text.cast("binary")
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"].cast("int")))
    ends = F.concat(F.transform(spans, lambda x: x["start"].cast("int")), F.array(F.octet_length(text)))
    pieces = F.zip_with(begins, ends, lambda a, b: F.substring(raw, a + 1, b - a))
    return F.aggregate(pieces, F.lit(b""), lambda kept, x: F.concat(kept, x)).cast("string")


def strip(docs: DataFrame, text: str = "text", words: int = WORDS, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut from the text, in the same columns; ``n_chars`` is counted anew if it is there."""
    found = repeated(docs, text, words).select(F.col("digest").alias("__found"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__digest", F.unhex(F.md5(F.col(text))))
    # the spans grow with the corpus, so the join is the same at every size
    joined = keyed.join(found.hint("merge"), F.col("__digest") == F.col("__found"), "left")
    cut = joined.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("__spans"))))
    if n_chars in docs.columns:
        cut = cut.withColumn(n_chars, F.coalesce(F.length(text), F.lit(0)).cast(dict(docs.dtypes)[n_chars]))
    return cut.select(*docs.columns)
