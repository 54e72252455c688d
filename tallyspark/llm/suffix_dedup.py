"""Suffix-array dedup with a logarithmic family of indexes.

Every string of ``LENGTH`` bytes that starts more than once in the corpus is to be found. Indexed are not all suffixes
but those that every such string is sure to contain: in each window of ``LENGTH`` bytes the 64-byte gram with the smallest hash
is the window's anchor, and equal windows have it at the same place. An entry of a suffix array is an anchor: the hash of the
gram that the suffix begins with, a hash of its context (all windows that it anchors), text and position. Beside each array stands its
directory: every gram once, with the number of its suffixes, so that a gram that most texts have is one row in each comparison.

A new batch of texts gets its array and directory, which is merged against itself and against each existing level's for grams
that occur elsewhere. Before a batch is added, levels of comparable size merge: each is at least twice as large as the next, so levels are
few and an entry is rewritten a logarithmic number of times. An index stays usable: batches can be added at any time.

This is a sparse suffix index and not a full suffix array: suffixes meet by their first 64 bytes, as a hash, and are not sorted beyond. Sorting
every suffix (a row for each byte) would shuffle dozens of times the input.

Anchors whose gram repeats are then extended. Anchors with equal contexts repeat in all their windows. The others are compared
window by window within their gram: groups of up to ``GROUP`` contexts in one task, larger ones by hashes of blocks of
windows, which are counted by a shuffle and split where they agree in part. As the windows of one anchor all contain it, what they cover is one span.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing; equal texts are indexed once
and, if long enough, lose everything; texts are identified by their MD5, whatever the rows' other columns; columns of ``docs`` named n_removed,
spans or kept are replaced, others stay; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import rolling
from tallyspark.llm.store import Workspace

LENGTH = 400
_DOUBLINGS = 6
_GRAM = 1 << _DOUBLINGS
GROUP = 1000  # contexts of one gram that are compared in one task
STEPS = (64, 8, 1)  # windows in a block where there are more
_CHUNK = 1 << 19  # bytes of text that are hashed at once
_SLICES = 8 << 20  # bytes of contexts that are compared at once
_LOW = np.uint64(0xFFFFFFFF)
_ENTRY = "fp long, ctx long, digest binary, pos int, back short, more short"


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(fp, ctx, text number, pos, back, more) of every anchor: its windows start at pos - back .. pos - back + more."""
    data, bounds = rolling.joined(texts)
    h = rolling.gram_hashes(data, _DOUBLINGS, 1)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    at = (rolling.sliding_min(key, length - _GRAM + 1) & _LOW).astype(np.int64)
    inside = np.diff(bounds) >= length
    edge = np.zeros(len(data) + 1, np.int8)
    edge[bounds[:-1][inside]] = 1
    edge[bounds[1:][inside] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge[: len(at)], dtype=np.int8))
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    at = at[starts]
    new = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = np.concatenate(([0], new))
    low, high, pos = starts[first], starts[np.concatenate((new - 1, [len(starts) - 1]))], at[first]
    ctx = rolling.Spans(data, 7).hash(low, high + length)
    number = np.searchsorted(bounds, pos, "right") - 1
    return h[pos].view(np.int64), ctx.view(np.int64), number, pos - bounds[number], pos - low, high - low


def entries(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The suffix array entries of ``texts`` (digest, text), not yet in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(digests: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
            fp, ctx, number, pos, back, more = anchors(raw, length)
            own = pa.array(digests, pa.binary()).take(pa.array(number, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), pa.array(ctx, pa.int64()), own, pa.array(pos.astype(np.int32)), pa.array(back.astype(np.int16)), pa.array(more.astype(np.int16))], names=["fp", "ctx", "digest", "pos", "back", "more"])

        for b in batches:
            digests, raw, size = [], [], 0
            for d, t in zip(b.column(0), b.column(1), strict=True):
                digests.append(d.as_py())
                raw.append(t.as_py())
                size += len(raw[-1])
                if size >= _CHUNK:
                    yield out(digests, raw)
                    digests, raw, size = [], [], 0
            if raw:
                yield out(digests, raw)

    return texts.select("digest", F.col("text").cast("binary")).mapInArrow(run, _ENTRY)


@dataclass
class Level:
    """An array with its directory (fp, n), and how many entries it has."""

    name: str
    size: int
    array: DataFrame
    directory: DataFrame


class SuffixIndex:
    """Suffix arrays of the batches so far, in levels of growing size.

    ``make`` makes the entries of texts: rows with the gram ``fp`` that a suffix begins with. Those of :func:`entries` count in bytes, those of ``passages`` in words.
    """

    def __init__(self, work: Workspace, length: int = LENGTH, make: Callable[[DataFrame, int], DataFrame] = entries):
        self.work, self.length, self.make = work, length, make
        self.levels: list[Level] = []
        self.repeats: list[DataFrame] = []  # (fp) of grams found more than once
        self.batches = 0

    def add(self, texts: DataFrame) -> None:
        """Index a batch of ``texts`` (digest, text), none of which has been indexed before."""
        self.merge()
        name = f"array{self.batches}"
        array = self.work.save(self.make(texts, self.length), name)
        directory = self.work.save(array.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), f"{name}_grams")
        found = directory.where("n > 1").select("fp")
        for level in self.levels:
            found = found.unionByName(directory.join(level.directory, "fp", "left_semi").select("fp"))
        self.repeats.append(self.work.save(found.distinct(), f"repeats{self.batches}"))
        self.levels.append(Level(name, array.count(), array, directory))
        self.batches += 1

    def merge(self) -> None:
        """Merge the newest levels while the older one isn't twice as large."""
        while len(self.levels) > 1 and self.levels[-2].size < 2 * self.levels[-1].size:
            b, a = self.levels.pop(), self.levels.pop()
            name = f"{a.name}_{b.name}"
            array = self.work.save(a.array.unionByName(b.array), name)
            directory = self.work.save(a.directory.unionByName(b.directory).groupBy("fp").agg(F.sum("n").alias("n")), f"{name}_grams")
            self.work.drop(*(x for old in (a, b) for x in (old.name, f"{old.name}_grams")))
            self.levels.append(Level(name, a.size + b.size, array, directory))

    def repeated(self) -> DataFrame:
        """The entries of all levels whose gram occurs more than once."""
        grams = self.repeats[0]
        for more in self.repeats[1:]:
            grams = grams.unionByName(more)
        grams = self.work.save(grams.distinct(), "grams")
        rows = self.levels[0].array
        for level in self.levels[1:]:
            rows = rows.unionByName(level.array)
        return rows.join(grams, "fp", "left_semi")

    def drop(self) -> None:
        """Delete the index."""
        self.work.drop("grams", *(x for level in self.levels for x in (level.name, f"{level.name}_grams")), *(f"repeats{i}" for i in range(self.batches)))
        self.levels, self.repeats = [], []


def _slices(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(fp, digest, low, back, lone, slice) for ``wanted`` (digest, fp, pos, back, more, lone): the bytes of all windows."""
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("fp", "pos", "back", "more", "lone")).alias("w"))
    rows = texts.join(lists, "digest").select("digest", F.col("text").cast("binary").alias("raw"), "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, w in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw, own = t.as_py(), w.values
                back = np.asarray(own.field("back")).astype(np.int64)
                low = np.asarray(own.field("pos")).astype(np.int64) - back
                high = low + np.asarray(own.field("more")) + length
                parts = [raw[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.field("fp"), pa.array([d.as_py()] * len(low), pa.binary()), pa.array(low), pa.array(back), own.field("lone"), pa.array(parts, pa.binary())], names=["fp", "digest", "low", "back", "lone", "slice"])

    return rows.mapInArrow(run, "fp long, digest binary, low long, back long, lone boolean, slice binary")


def _window_hashes(fp: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for every window of every slice, mixed with the slice's gram; the windows' slice numbers and offsets."""
    data, bounds = rolling.joined(parts)
    n = np.diff(bounds) - length + 1
    number = np.repeat(np.arange(len(parts)), n)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[number] + offset
    h = rolling.Spans(data, 11).hash(start, start + length)
    return rolling.mix(h ^ rolling.mix(fp.view(np.uint64))[number]), number, offset


def _compared(rows: DataFrame, length: int) -> DataFrame:
    """(digest, start, end) of what repeats in lone contexts; whole groups of a gram come in one partition, in order."""

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lone = t.column("lone").to_numpy()
        h, number, offset = _window_hashes(t.column("fp").to_numpy(), t.column("slice").to_pylist(), length)
        order = np.argsort(h)
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        hit = hit[lone[number[hit]]]
        first, last = np.full(t.num_rows, 1 << 30), np.full(t.num_rows, -1)
        np.minimum.at(first, number[hit], offset[hit])
        np.maximum.at(last, number[hit], offset[hit])
        own = np.flatnonzero(last >= 0)
        low = t.column("low").to_numpy()[own]
        return pa.RecordBatch.from_arrays([t.column("digest").take(pa.array(own)).combine_chunks(), pa.array(low + first[own]), pa.array(low + last[own] + length)], names=["digest", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_size = 0
        for b in batches:
            if not b.num_rows:
                continue
            fp = b.column(0).to_numpy()
            begins = [0, *(np.flatnonzero(fp[1:] != fp[:-1]) + 1).tolist()]  # of the groups
            sizes = np.concatenate(([0], np.cumsum(pc.binary_length(b.column(5)).to_numpy())))
            done = 0
            for i in begins:
                group_goes_on = i == 0 and held and held[-1].column(0)[-1].as_py() == fp[0]
                if not group_goes_on and held_size + int(sizes[i] - sizes[done]) >= _SLICES:
                    if i > done:
                        held.append(b.slice(done, i - done))
                    yield spans(held)
                    held, held_size, done = [], 0, i
            if len(fp) > done:
                held.append(b.slice(done))
                held_size += int(sizes[-1] - sizes[done])
        if held:
            yield spans(held)

    dealt = rows.repartition("fp").sortWithinPartitions("fp")
    return dealt.mapInArrow(run, "digest binary, start long, end long")


def _blocks(rows: DataFrame, size: int, length: int) -> DataFrame:
    """The blocks of ``size`` windows of every context in ``rows`` (fp, digest, low, back, lone, slice, of).

    Windows are numbered by how far before the anchor they start; a block holds those from ``block`` * ``size`` on. ``of``
    lists the larger blocks that are still of interest, or is null for all. core is a hash of the bytes that all windows of the
    block have, whole one of the bytes of all windows, null if the context hasn't all of them.
    """
    larger = dict(zip(STEPS[1:], STEPS, strict=False)).get(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                fp, back = part.column(0).to_numpy().view(np.uint64), part.column(3).to_numpy().astype(np.int64)
                data, bounds = rolling.joined(part.column(5).to_pylist())
                least = back - (np.diff(bounds) - length)  # windows least .. back
                if larger is None:
                    first, last = least // size, back // size
                    own = np.repeat(np.arange(part.num_rows), last - first + 1)
                    block = np.arange(len(own)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[own]
                else:
                    lists = part.column(6)
                    own = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                    each = larger // size
                    block = (lists.flatten().to_numpy().astype(np.int64)[:, None] * each + np.arange(each)).ravel()
                    own = np.repeat(own, each)
                    inside = (block * size <= back[own]) & (block * size + size > least[own])
                    own, block = own[inside], block[inside]
                near, far = block * size, block * size + size - 1
                spans = rolling.Spans(data, 11)
                tag = rolling.mix(rolling.mix(fp[own]) + block.astype(np.uint64))
                origin = bounds[own] + back[own]
                core = spans.hash(origin - near, origin - far + length) ^ tag
                full = (near >= least[own]) & (far <= back[own])
                span = [np.where(full, x, 0) for x in (origin - far, origin - near + length)]
                whole = pa.array((spans.hash(*span) ^ rolling.mix(tag)).view(np.int64), mask=~full)
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), whole, pa.array(block.astype(np.int32)), *(part.column(i).take(take) for i in (1, 2, 3, 4))], names=["core", "whole", "block", "digest", "low", "back", "lone"])

    return rows.mapInArrow(run, "core long, whole long, block int, digest binary, low long, back long, lone boolean")


def _counted(rows: DataFrame, length: int, work: Workspace) -> DataFrame:
    """The same for contexts of any number, by counting hashes of blocks of windows.

    A block whose core no other context has holds no repeat. One that another context has as a whole repeats in all its windows; of
    equal ones one goes on, so that others can still meet it. What remains is split into smaller blocks, down to windows.
    """
    found = []
    todo = rows.withColumn("of", F.lit(None).cast("array<int>"))
    for size in STEPS:
        blocks = work.save(_blocks(todo, size, length), f"blocks{size}")
        shared = blocks.groupBy("core").count().where("count > 1").select("core")
        wholes = blocks.groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "low")).alias("one")).where("n > 1")
        live = blocks.join(shared, "core", "left_semi").join(wholes, "whole", "left")
        marked = work.save(live.select("digest", "low", "back", "block", "lone", F.col("n").isNotNull().alias("repeats"), (F.col("one") == F.struct("digest", "low")).alias("stays")), f"live{size}")
        near = F.col("block") * size
        start = F.col("low") + F.col("back")
        found.append(marked.where("lone and repeats").select("digest", (start - near - size + 1).alias("start"), (start - near + length).alias("end")))
        going = marked.where("not repeats or stays").groupBy("digest", "low", "back").agg(F.collect_list("block").alias("of"))
        todo = rows.join(going, ["digest", "low", "back"]).select("fp", "digest", "low", "back", "lone", "slice", "of")
        work.drop(f"blocks{size}")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def long_matches(index: SuffixIndex, texts: DataFrame) -> DataFrame:
    """(digest, start, end): spans that together cover every repeated string; they may overlap."""
    work, length = index.work, index.length
    rows = work.save(index.repeated(), "repeated")
    contexts = work.save(rows.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "pos", "back", "more")).alias("one")), "contexts")
    low = F.col("pos") - F.col("back")
    alike = contexts.where("n > 1").select("fp", "ctx")
    whole = rows.join(alike, ["fp", "ctx"], "left_semi").select("digest", low.cast("long").alias("start"), (low + F.col("more") + length).cast("long").alias("end"))
    groups = contexts.groupBy("fp").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    wanted = contexts.join(groups, "fp").select("fp", "one.*", (F.col("n") == 1).alias("lone"), (F.col("contexts") > GROUP).alias("large"))
    small = _compared(_slices(texts, wanted.where("not large"), length), length)
    parts = [whole, small]
    if not wanted.where("large").isEmpty():
        large = work.save(_slices(texts, wanted.where("large"), length), "large")
        parts.append(_counted(large, length, work))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    return spans


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) spans in order, those that overlap or touch made one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    last = np.concatenate((first[1:] - 1, [len(spans) - 1]))
    return list(zip(spans[first, 0].tolist(), reach[last].tolist(), strict=True))


def distinct_texts(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(digest, text, copies > 1) of every different text that is long enough to hold a match."""
    keyed = docs.where(F.octet_length(text) >= length).select(F.unhex(F.md5(F.col(text))).alias("digest"), F.col(text).alias("text"))
    return keyed.groupBy("digest").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied"))


def removals(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = 3) -> DataFrame:
    """(digest, n_removed, spans, kept): for each different text that loses something, the removed (start, end) and the rest."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "suffixes")
    texts = work.save_bucketed(distinct_texts(docs, text, length), "texts", "digest", dealt=True)
    index = SuffixIndex(work, length)
    batch = F.pmod(F.xxhash64("digest"), F.lit(batches))
    for i in range(batches):
        index.add(texts.where(batch == i))
    spans = long_matches(index, texts.select("digest", "text"))
    lists = work.save(spans.groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    rows = texts.select("digest", F.col("text").cast("binary").alias("raw"), "copied").join(lists, "digest", "left").where("copied or spans is not null")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches_:
            removed, found, kept = [], [], []
            for t, copied, s in zip(b.column(1), b.column(2), b.column(3), strict=True):
                raw = t.as_py()
                own = [(0, len(raw))] if copied.as_py() else merged(np.stack([np.asarray(s.values.field(0)), np.asarray(s.values.field(1))], 1))
                removed.append(sum(e - a for a, e in own))
                found.append([{"start": a, "end": e} for a, e in own])
                ends = [0, *(e for _, e in own)]
                kept.append(b"".join(raw[i:j] for i, j in zip(ends, [*(a for a, _ in own), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary())], names=["digest", "n_removed", "spans", "kept"])

    out = work.save(rows.mapInArrow(run, "digest binary, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"), "removals")
    index.drop()
    work.drop("texts", "repeated", "contexts", "large", "spans", *(f"live{n}" for n in STEPS))
    return out


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = 3) -> DataFrame:
    """``docs`` with n_removed, spans (start, end of each removed run of bytes) and kept (the remaining bytes)."""
    found = removals(docs, text, length, batches).withColumnRenamed("digest", "__found")
    plain = docs.drop("n_removed", "spans", "kept")
    keyed = plain.withColumn("__digest", F.unhex(F.md5(F.col(text))))
    joined = keyed.join(found, F.col("__digest") == F.col("__found"), "left")
    kept = F.when(F.col("__found").isNull(), F.coalesce(F.col(text), F.lit("")).cast("binary")).otherwise(F.col("kept"))
    return joined.withColumns({"n_removed": F.coalesce("n_removed", F.lit(0).cast("long")), "spans": F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")), "kept": kept}).drop("__found", "__digest")


def strip(docs: DataFrame, text: str = "text", length: int = LENGTH, batches: int = 3, n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the removed runs cut from the text, in the same columns; ``n_chars`` is counted anew if it is there.

    A character is cut only if all its bytes are removed, so texts stay valid UTF-8. Null texts stay null.
    """
    return cut(docs, removals(docs, text, length, batches).select("digest", "spans"), text, n_chars)


def cut(docs: DataFrame, found: DataFrame, text: str, n_chars: str) -> DataFrame:
    """``docs`` without the spans in ``found`` (digest, spans), which are in order and apart."""
    found = found.select(F.col("digest").alias("__found"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__digest", F.unhex(F.md5(F.col(text))))
    # the spans grow with the corpus, so the join is the same at every size
    joined = keyed.join(found.hint("merge"), F.col("__digest") == F.col("__found"), "left")
    names = [c for c in docs.columns if c != text]
    rows = joined.select(*(F.col(f"`{c}`") for c in names), F.col(text).alias("__text"), "__spans")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(len(names)), b.column(len(names) + 1)
            hit = np.flatnonzero(np.asarray(spans.is_valid()))
            if len(hit):
                shown = texts.to_pylist()
                for i in hit.tolist():
                    shown[i] = _without(shown[i].encode(), [(x["start"], x["end"]) for x in spans[i].as_py()])
                texts = pa.array(shown, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], texts], names=[*names, text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2]]
    cut = rows.mapInArrow(rest, ", ".join([*fields, f"`{text}` string"]))
    if n_chars in docs.columns:
        cut = cut.withColumn(n_chars, F.coalesce(F.length(text), F.lit(0)).cast(dict(docs.dtypes)[n_chars]))
    return cut.select(*docs.columns)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for start, end in spans:
        while start < end and raw[start] & 0xC0 == 0x80:  # the first character begins before the run
            start += 1
        while end < len(raw) and end > start and raw[end] & 0xC0 == 0x80:  # the last one goes on after it
            end -= 1
        parts.append(raw[at:start])
        at = end
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "replace")
