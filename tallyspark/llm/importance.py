"""Target-distribution importance resampling over a sparse document-by-bucket matrix.

Features are runs of one and two consecutive words; a feature's bucket is its CRC-32 modulo ``BUCKETS``. The counts of each document are a row
of a sparse matrix that is persisted in CSR blocks (:func:`count_blocks`): row starts, buckets and counts of some documents, packed. Column
sums of the blocks give the distributions of the corpus and of the target, their ratio a whole-numbered gain per bucket, and a sparse
matrix-vector product with the gains the weight of each document. Gumbel noise from a hash of the key turns weights into scores, of which
the highest are drawn without replacement (:func:`draw`).

No score list is sorted whole: scores are whole numbers of a bounded range, so a histogram says where each score's ranks begin, and only rows of one
score are put in order.

Defined results: a null text has no words, weight 0 and no rank; a null key is hashed like an empty one and comes last among ties; rows that
agree in key and text get the same score and neighbouring ranks; texts of any length are counted whole, in pieces; an empty corpus
gives an empty table; without target texts every gain follows from the corpus alone; columns of ``docs`` other than key and text play no part, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.store import Workspace

BUCKETS = 10_000
PERCENT = 25  # of the documents long enough that are drawn
LEAST_WORDS = 20
SEED = 7
COARSE = 8  # bits of a score within which ranks are summed in one group
_CHUNK = 1 << 19  # bytes of text in a block
_PIECE = 1 << 20  # bytes of a longer text that are split into words at once

#: Lower case for A-Z; what is neither a letter, a digit nor beyond ASCII sets words apart.
_FOLD = bytes(i if i >= 128 or chr(i).isdigit() or chr(i).islower() else i + 32 if chr(i).isupper() else 32 for i in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, some at a time."""
    folded, start = text.translate(_FOLD), 0
    while len(folded) - start > _PIECE:
        end = folded.find(b" ", start + _PIECE)
        if end < 0:
            break
        yield folded[start:end].split()
        start = end
    yield folded[start:].split()


def buckets(text: bytes) -> tuple[np.ndarray, int]:
    """The bucket of every feature of ``text``, repeats included, and the number of its words."""
    found, n_words, last = [], 0, None
    for words in _pieces(text):
        if not words:
            continue
        single = list(map(crc32, words))
        before = single[:-1] if last is None else [last, *single[:-1]]
        follow = words[1:] if last is None else words
        found += single
        found += map(crc32, follow, map(crc32, repeat(b" "), before))  # the sum goes on from that of the word before
        n_words, last = n_words + len(words), single[-1]
    return np.array(found, np.uint32) % np.uint32(BUCKETS), n_words


def _block(keys: pa.Array, rows: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    sizes = np.array([len(b) for b, _ in rows], np.int64)
    row = np.repeat(np.arange(len(rows), dtype=np.int64), sizes)
    cells, counts = np.unique(row * BUCKETS + np.concatenate([b for b, _ in rows]).astype(np.int64), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(rows) + 1) * BUCKETS)
    packed = (np.array([w for _, w in rows], np.int64), starts, (cells % BUCKETS).astype(np.uint16), counts.astype(np.uint32))
    column = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
    return pa.RecordBatch.from_arrays([column, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["keys", "words", "starts", "buckets", "counts"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """words, starts, buckets and counts of every block in ``batch``."""
    columns = [batch.column(c) for c in ("words", "starts", "buckets", "counts")]
    kinds = (np.int64, np.int64, np.uint16, np.uint32)
    for values in zip(*columns, strict=True):
        yield tuple(np.frombuffer(v.as_py(), k) for v, k in zip(values, kinds, strict=True))


def count_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(keys, words, starts, buckets, counts): the count matrix of ``docs`` in CSR blocks, and the number of words of each row."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size, first = [], 0, 0
            for i, value in enumerate(b.column(1)):
                raw = value.as_py()
                held.append(buckets(raw))
                size += len(raw)
                if size >= _CHUNK:
                    yield _block(b.column(0).slice(first, len(held)), held)
                    held, size, first = [], 0, i + 1
            if held:
                yield _block(b.column(0).slice(first, len(held)), held)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"keys array<{kind}>, words binary, starts binary, buckets binary, counts binary")


def column_sums(blocks: DataFrame) -> DataFrame:
    """(bucket, n): features in each bucket; a task sends on at most ``BUCKETS`` sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, at, counts in _unpacked(b):
                total += np.bincount(at, counts, BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    return blocks.select("words", "starts", "buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """For each bucket 1000 times the logarithm of how much more frequent it is in ``target`` than in ``corpus``, both smoothed, floored."""

    def counted(sums: DataFrame) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for r in sums.collect():  # BUCKETS rows at most
            out[r["bucket"]] = r["n"]
        return out

    s, t = counted(corpus), counted(target)
    ratio = (t + 1).astype(float) * float(s.sum() + BUCKETS) / ((s + 1).astype(float) * float(t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(blocks: DataFrame, vector: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the matrix times the gains, floored means over each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, (words, starts, at, counts) in zip(b.column(0), _unpacked(b), strict=True):
                products = np.concatenate(([0], np.cumsum(vector[at] * counts)))
                features = np.diff(np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[starts])
                mean = np.diff(products[starts]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(words), pa.array(features), pa.array(mean)], names=["key", "n_words", "n_features", "weight"])

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with score: the weight plus 1000 times a Gumbel variate that the key's hash decides."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def draw(rows: DataFrame, work: Workspace, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (key, n_words, score, ..) with rank: 1, 2, .. for the drawn ones, null for the others.

    Weights are logarithms of ratios of counts and Gumbel variates of 32-bit hashes stay between -3100 and 22200, so there are fewer than 120000 different
    scores however many documents: that bounds the histogram, which is broadcast. The noise spreads even equal texts over thousands of scores.
    """
    able = F.col("n_words") >= least_words
    by_score = work.save(rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    total = by_score.agg(F.sum("n")).first()[0] or 0
    drawn = percent * total // 100
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = F.shiftright("score", COARSE).alias("block")
    above = by_score.groupBy(block).agg(F.sum("n").alias("n")).select("block", earlier(Window.orderBy(F.desc("block"))).alias("above"))
    inside = by_score.select("score", block, earlier(Window.partitionBy(block).orderBy(F.desc("score"))).alias("inside"))
    starts = inside.join(F.broadcast(above), "block").select("score", (F.col("above") + F.col("inside")).alias("before")).where(F.col("before") < drawn)
    placed = rows.join(F.broadcast(starts), "score", "left").withColumn("before", F.when(able, F.col("before")))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("key"), "n_features", "weight")
    rank = F.col("before") + F.row_number().over(order)
    inside_reach = placed.where("before is not null").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return inside_reach.unionByName(placed.where("before is null").withColumn("rank", F.lit(None).cast("long"))).drop("before")


def ranked(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for every row of ``docs``; the drawn ones have a rank."""
    work = Workspace(docs.sparkSession, "importance")
    blocks = work.save(count_blocks(docs, key, text), "blocks")
    wanted = count_blocks(target.select(F.lit(None).cast("long").alias("none"), F.col(target_text).alias("text")), "none", "text")
    rows = work.save(scored(weights(blocks, gains(column_sums(blocks), column_sums(wanted))), seed), "scored")
    work.drop("blocks")
    return draw(rows, work, percent, least_words)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that are drawn to look like ``target``; of a key with several rows all stay if one is drawn."""
    drawn = ranked(docs, target, key, text, **options).where("rank is not null").select(F.col("key").alias("__key")).distinct()
    return docs.join(drawn, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
