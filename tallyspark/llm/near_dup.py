"""MinHash near-dedup by Order MinHash.

Texts become words (lower case; runs of letters, digits and bytes beyond ASCII) and those overlapping shingles of ``SHINGLE`` words. A shingle is
labelled with its occurrence number in the text, so that repeats count. Each of ``BANDS`` sketches takes the ``TAKE`` labelled shingles
with the smallest hashes and keeps them in text order: texts share a sketch if they share these shingles in the same order, which
is sensitive to edit similarity.

Texts that share a sketch are candidates. Each is compared with one text of the bucket, its centre; where a bucket still holds
texts of different groups, all pairs between these groups are compared as well, but for those that can't be alike: shingles
that no other text has bound the similarity from above. So no link between groups that the sketches offer is lost. A comparison aligns the labelled shingles of both texts inside the band that the threshold allows: with m
aligned, the similarity is m / (n1 + n2 - m), at least ``SIMILARITY`` for a link. Groups are the connected components.

Two texts of similarity s share a sketch with probability about 1 - (1 - s ** TAKE) ** BANDS: 0.9999 at 0.8. That holds for long texts;
short ones have few shingles to draw from. So texts of up to ``SHORT`` shingles are offered exactly as well: of two that are alike each has
one in common among its first n - ceil(0.8 n) + 1 shingles in order of hash, and each of these is a bucket of its own.

Defined results: equal texts are one group; a null text is a group of its own row; texts without words link only if equal; a text
of fewer than ``SHINGLE`` words is one shingle; long texts are sketched whole; of a group stays the row with the smallest key (null last; then by
digest), of rows equal in key and text one; columns of ``docs`` named class_id or class_size are replaced by :func:`classes`, all others stay; empty tables
give empty tables. Words and sketches are compared by 64-bit hashes, shingles in an alignment by 32 bits of theirs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import rolling
from tallyspark.llm.components import connected_components
from tallyspark.llm.store import Workspace

SHINGLE = 5
SIMILARITY = 0.8
BANDS, TAKE = 18, 4
SHORT = 12  # shingles of the shorter text up to which similar texts always meet
LARGE = 4  # texts of a bucket beyond which rare shingles are looked at before pairs are made
RARE = 16  # texts that have a rare shingle at most
SMALL = 200_000  # digests (16 bytes) that are broadcast at most
_CHUNK = 1 << 19
_SLACK = 1e-9  # of comparisons of shares that were rounded
_U = np.uint64
_SEEDS = rolling.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_WORD_BYTE = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text after text, and where each text's words begin."""
    data, bounds = rolling.joined([f"{t.lower()} ".encode("utf-8", "surrogatepass") for t in texts])
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]  # every text ends outside a word
    return rolling.Spans(data, 3).hash(start, end), np.searchsorted(start, bounds)


def _shingles(words: np.ndarray) -> np.ndarray:
    """Labelled shingle hashes of one text, in order."""
    n = len(words)
    if not n:
        return words
    size = min(SHINGLE, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = h * _U(0x5851F42D4C957F2D) + words[i : n - size + 1 + i]
    h = rolling.mix(h + _U(size))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        count = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = count
        h = rolling.mix(h + occurrence * _U(0x9E3779B97F4A7C15))
    return h


def sketches(h: np.ndarray) -> np.ndarray:
    """One hash per band: the ``TAKE`` smallest labelled shingles in text order."""
    g = (h[None, :] ^ _SEEDS[:, None]) * _U(0xBF58476D1CE4E5B9)
    g ^= g >> _U(31)
    g *= _U(0x94D049BB133111EB)
    if len(h) > TAKE:
        at = np.sort(np.argpartition(g, TAKE - 1, axis=1)[:, :TAKE], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(h)), (BANDS, len(h)))
    out = _SEEDS.copy()
    for i in range(at.shape[1]):
        out = rolling.mix(out * _U(0x5851F42D4C957F2D) + h[at[:, i]])
    return out


def prefix(h: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The shingles one of which a text that is alike has among its own, if this text or that one is short."""
    n = len(h)
    return np.sort(h)[: n - ceil(least * n - _SLACK) + 1] if n * least <= SHORT else h[:0]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    digests, texts, size = [], [], 0
    for d, t in zip(batch.column(0), batch.column(1), strict=True):
        digests.append(d.as_py())
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= _CHUNK:
            yield digests, texts
            digests, texts, size = [], [], 0
    if texts:
        yield digests, texts


def sketch_table(keyed: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(digest, n, bands) of every text in ``keyed`` (digest, text) that has words; bands beyond ``BANDS`` are a short text's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digests, texts in _chunks(b):
                words, begin = _word_hashes(texts)
                rows, seen = [], set()
                for i, d in enumerate(digests):
                    if begin[i + 1] > begin[i] and d not in seen:
                        seen.add(d)
                        h = _shingles(words[begin[i] : begin[i + 1]])
                        rows.append((d, len(h), np.concatenate((sketches(h), prefix(h, least))).view(np.int64).tolist()))
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], names=["digest", "n", "bands"])

    return keyed.mapInArrow(run, "digest binary, n int, bands array<long>").dropDuplicates(["digest"])


def shingle_table(keyed: DataFrame) -> DataFrame:
    """(digest, shingles): labelled shingle hashes in text order, 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digests, texts in _chunks(b):
                words, begin = _word_hashes(texts)
                packed = [(_shingles(words[i:j]) >> _U(32)).astype(np.uint32).tobytes() for i, j in zip(begin, begin[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "shingles"])

    return keyed.mapInArrow(run, "digest binary, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """m / (len(a) + len(b) - m) for the longest alignment of m equal labelled shingles inside the band of ``least``.

    An alignment that reaches ``least`` skips at most (1 - least) / (1 + least) of both together, so it strays from
    the diagonal by no more. A value below ``least`` may be an upper bound.
    """
    total = len(a) + len(b)
    if not total or min(len(a), len(b)) < least * max(len(a), len(b)) - _SLACK:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    m = len(ia)
    if m < least * (total - m) - _SLACK:
        return m / (total - m)
    band = np.abs(ia - ib) <= total * (1 - least) / (1 + least) + _SLACK
    ia, ib = ia[band], ib[band]
    path = ib[np.argsort(ia)]
    if not (path[1:] > path[:-1]).all():
        tails: list[int] = []
        for x in path.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        m = len(tails)
    else:
        m = len(path)
    return m / (total - m)


def _linked(pairs: DataFrame, shingles: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts align to ``least`` at least."""
    left = shingles.select(F.col("digest").alias("da"), F.col("shingles").alias("sa"))
    right = shingles.select(F.col("digest").alias("db"), F.col("shingles").alias("sb"))
    rows = pairs.join(left, F.col("a") == F.col("da")).select("a", "b", "sa").join(right, F.col("b") == F.col("db")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32), least) >= least - _SLACK for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            keep = pa.array(np.flatnonzero(good), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def _shingles_of(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """The shingle table of the texts in ``wanted`` (digest)."""
    small = wanted.limit(SMALL + 1).count() <= SMALL
    texts = keyed.join(F.broadcast(wanted) if small else wanted, "digest", "left_semi").dropDuplicates(["digest"])
    return shingle_table(texts.select("digest", "text"))


def _rare(shingles: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, shingle, texts): the shingles that at most ``RARE`` of ``texts`` (digest) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in zip(b.column(0), b.column(1), strict=True):
                h = np.frombuffer(x.as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * len(h), pa.binary()), pa.array(h)], names=["digest", "shingle"])

    each = shingles.join(texts, "digest", "left_semi").mapInArrow(run, "digest binary, shingle int")
    few = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") <= RARE)
    return each.join(few, "shingle").select("digest", "shingle", "texts")


def _can_link(n1: Column, rare1: Column, n2: Column, rare2: Column, least: float) -> Column:
    """Whether texts of n1 and n2 shingles that share none of their rare1 and rare2 can be alike."""
    most = F.least(n1 - rare1, n2 - rare2)
    return most >= least * (n1 + n2 - most) - _SLACK


def _other_pairs(rows: DataFrame, shingles: DataFrame, least: float, work: Workspace) -> DataFrame:
    """(a, b): all pairs of a bucket in ``rows`` (bucket, digest, n, label, main) whose labels differ and that can be alike.

    Most texts of a large bucket with a label of their own owe it to shingles that few others have. Such texts can be alike
    only if they share some of these: those pairs are found by the rarest shingles. Without a rare shingle in common, what is left
    of each bounds the similarity; texts that can reach nobody go before pairs are made by the bucket.
    """
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("shortest"))
    sized = rows.join(sizes, "bucket")
    large = sized.where(F.col("size") > LARGE)
    rare = work.save(_rare(shingles, large.select("digest").distinct()), "rare")
    counts = rare.groupBy("digest").agg(F.count(F.lit(1)).cast("int").alias("rare"))
    counted = sized.join(counts, "digest", "left").withColumn("rare", F.when(F.col("size") > LARGE, F.coalesce("rare", F.lit(0))).otherwise(0))
    shared = F.col("n") - F.col("rare")
    hopeful = work.save(counted.where(shared >= least * (F.col("n") + F.greatest("shortest", shared) - shared) - _SLACK).select("bucket", "digest", "n", "label", "main", "rare"), "hopeful")
    # a pair that shares several buckets meets in the first of them only
    lists = hopeful.groupBy("digest").agg(F.collect_set("bucket").alias("own"))
    listed = hopeful.join(lists, "digest")
    x = listed.where("label <> main").select("bucket", F.col("digest").alias("d2"), F.col("n").alias("n2"), F.col("label").alias("l2"), F.col("rare").alias("r2"), F.col("own").alias("o2"))
    once = F.col("bucket") == F.array_min(F.array_intersect("own", "o2"))
    meet = (F.col("label") != F.col("l2")) & _can_link(F.col("n"), F.col("rare"), F.col("n2"), F.col("r2"), least) & once
    by_bucket = listed.join(x, "bucket").where(meet)

    # texts that are alike share at least ``need`` of their rare shingles, so one of the first so many in order of rarity
    known = large.select("digest", "n", "label").distinct().join(counts, "digest")
    need = F.greatest(F.ceil(least * F.col("n") - (F.col("n") - F.col("rare")) - _SLACK), F.lit(1))
    order = Window.partitionBy("digest").orderBy("texts", "shingle")
    prefix = rare.join(known, "digest").withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("rare") - need + 1)
    own = prefix.where("texts > 1").select("shingle", "digest", "n", "label")
    other = own.select("shingle", F.col("digest").alias("d2"), F.col("n").alias("n2"), F.col("label").alias("l2"))
    by_shingle = own.join(other, "shingle").where((F.col("digest") > F.col("d2")) & (F.col("label") != F.col("l2")) & _can_link(F.col("n"), F.lit(0), F.col("n2"), F.lit(0), least))
    return by_bucket.select("digest", "d2").unionByName(by_shingle.select("digest", "d2")).select(F.greatest("digest", "d2").alias("a"), F.least("digest", "d2").alias("b")).distinct()


def text_groups(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(node, label) for the texts (by MD5) that belong to a group of several: label is the group's smallest digest."""
    work = Workspace(docs.sparkSession, "near")
    keyed = docs.where(F.col(text).isNotNull()).select(F.unhex(F.md5(F.col(text))).alias("digest"), F.col(text).alias("text"))
    sketched = work.save(sketch_table(keyed, least), "sketches")
    members = sketched.select("digest", "n", F.posexplode("bands").alias("band", "sketch")).select(F.xxhash64(F.least("band", F.lit(BANDS)), "sketch").alias("bucket"), "digest", "n")
    # buckets of one text offer nothing
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    rows = work.save(members.join(shared, "bucket"), "shared")
    # the text of which most buckets are full, such as the one that others were derived from, is the best centre
    fame = rows.groupBy("digest").agg(F.sum("texts").alias("fame"))
    rows = work.save(rows.join(fame, "digest").select("bucket", "digest", "n", "fame"), "members")
    work.drop("sketches", "shared")
    shingles = work.save(_shingles_of(rows.select("digest").distinct(), keyed), "shingles")

    def to_centres(rows: DataFrame) -> DataFrame:
        """(a, b) of every text and the centre of its bucket."""
        centres = rows.groupBy("bucket").agg(F.max(F.struct("fame", "digest", "n")).alias("centre"))
        fits = F.least("n", "centre.n") >= least * F.greatest("n", "centre.n") - _SLACK
        met = rows.join(centres, "bucket").where(fits & (F.col("digest") != F.col("centre.digest")))
        return met.select(F.greatest("digest", "centre.digest").alias("a"), F.least("digest", "centre.digest").alias("b")).distinct()

    tried = work.save(to_centres(rows), "pairs0")
    links = work.save(_linked(tried, shingles, least), "links0")
    labels = connected_components(links, work, "round0_")
    for i in (1, 2):
        own = rows.join(labels, F.col("digest") == F.col("node"), "left").select("bucket", "digest", "n", "fame", F.coalesce("label", "digest").alias("label"))
        mixed = own.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.struct("fame", "label")).alias("main")).where("low <> high")
        left = work.save(own.join(mixed, "bucket").select("bucket", "digest", "n", "fame", "label", F.col("main.label").alias("main")), f"mixed{i}")
        # first the texts outside the main group get a centre of their own, then all pairs between groups meet
        new = to_centres(left.where("label <> main")) if i == 1 else _other_pairs(left, shingles, least, work)
        fresh = work.save(new.join(tried, ["a", "b"], "left_anti"), f"pairs{i}")
        more = work.save(_linked(fresh, shingles, least), f"links{i}")
        links, tried = links.unionByName(more), tried.unionByName(fresh)
        if not more.isEmpty():
            labels = connected_components(links, work, f"round{i}_")
    out = work.save(labels, "groups")
    work.drop("members", "shingles", "rare", "hopeful", *(f"{n}{i}" for n in ("pairs", "links", "mixed") for i in range(3)))
    return out


def _ranked(docs: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """``docs`` with __label (null for a null text), and per label (first: the row that stays, size, twins)."""
    groups = text_groups(docs, text, least).toDF("__node", "__root")
    marked = docs.withColumn("__digest", F.unhex(F.md5(F.col(text))))
    labelled = marked.join(groups, F.col("__digest") == F.col("__node"), "left").withColumn("__label", F.coalesce("__root", "__digest")).drop("__node", "__root")
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__digest").alias("digest"))
    rows = labelled.where(F.col("__label").isNotNull()).groupBy("__label", rank.alias("__rank")).agg(F.count(F.lit(1)).alias("__n"))
    first = rows.groupBy(F.col("__label").alias("l")).agg(F.min(F.struct(F.col("__rank").alias("rank"), F.col("__n").alias("count"))).alias("first"), F.sum("__n").alias("size"))
    return labelled, first.select("l", "first.rank.key", "first.rank.digest", (F.col("first.count") > 1).alias("twins"), "size")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with class_id (the smallest key of the row's group) and class_size (rows in it)."""
    labelled, first = _ranked(docs.drop("class_id", "class_size"), key, text, least)
    joined = labelled.join(first.select(F.col("l").alias("__l"), F.col("key").alias("class_id"), F.col("size").alias("class_size")), F.col("__label") == F.col("__l"), "left")
    null = F.col("__label").isNull()
    out = joined.withColumns({"class_id": F.when(null, F.col(key)).otherwise(F.col("class_id")), "class_size": F.when(null, 1).otherwise(F.col("class_size"))})
    return out.drop("__digest", "__label", "__l")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    work = Workspace(docs.sparkSession, "stays")
    _, first = _ranked(docs, key, text, least)
    stays = work.save(first.select(F.col("key").alias("__k"), F.col("digest").alias("__d"), F.col("twins").alias("__twins")), "first")
    marked = docs.withColumn("__digest", F.unhex(F.md5(F.col(text))))
    kept = marked.join(stays, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__digest") == F.col("__d")))
    single = kept.where("not __twins").drop("__k", "__d", "__twins", "__digest")
    double = kept.where("__twins").dropDuplicates(["__digest"]).drop("__k", "__d", "__twins", "__digest")
    return single.unionByName(double).unionByName(docs.where(F.col(text).isNull()))
