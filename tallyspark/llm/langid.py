"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent letter 1-, 2- and 3-grams (inside words, blanks mark word ends),
ordered by count and then by gram. A text is compared with each profile by the out-of-place distance: the sum over its own most
frequent grams of the difference of ranks, ``size`` where the profile lacks the gram. The nearest language wins, the
first by code point on a tie; ``score`` is 1 - distance / largest possible distance.

Defined results: a null text or one without letters is ``und`` with score 0, as is every text when nothing could be
learned; rows with a null language or null text teach nothing; repeated rows count as often as they occur; long texts are ranked whole; columns of
``docs`` named lang_pred or score are replaced, others stay; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 300  # grams in a profile
MAX_LANGUAGES = 2000  # profiles are sent to every task; more languages than this is an error
UNKNOWN = "und"
_BITS = 21
_BLANK = 32
_SLICE = 4_000_000  # code points that are counted at once

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _code_points(text: str) -> np.ndarray:
    """Lower-case letters, runs of anything else as one blank, a blank at the start and two at the end."""
    a = np.frombuffer(f" {text.lower()}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(_is_letter()[a], a, _BLANK)
    keep = a != _BLANK
    keep[1:] |= a[:-1] != _BLANK
    keep[0] = True
    a = a[keep].astype(np.int64)
    return np.append(a, _BLANK)


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum counts of equal neighbours in sorted codes."""
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(counts, starts)


def gram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 1-, 2- and 3-grams of a code point array and their counts.

    Only the 3-grams are sorted: every shorter gram is the beginning of one.
    """
    if len(points) < 4:  # blanks only
        return np.empty(0, np.int64), np.empty(0, np.int64)
    triples = (points[:-2] << 2 * _BITS) | (points[1:-1] << _BITS) | points[2:]
    triples.sort()
    t, n = _counted(triples, np.ones(len(triples), np.int64))
    b, nb = _counted(t >> _BITS, n)
    u, nu = _counted(t >> 2 * _BITS, n)
    mask = (1 << _BITS) - 1
    inside = ((t >> _BITS) & mask) != _BLANK
    letters = u != _BLANK
    word = b != (_BLANK << _BITS | _BLANK)  # where one text ends and the next begins
    return np.concatenate((u[letters], b[word], t[inside])), np.concatenate((nu[letters], nb[word], n[inside]))


def top_grams(points: np.ndarray, size: int) -> np.ndarray:
    grams, counts = gram_counts(points)
    if len(grams) > size:  # keep all that tie with the last one, then order
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:size]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> DataFrame:
    """Profiles (lang, gram, rank from 0) of all rows that have a language and a text.

    Each task sums what it has read before anything is shuffled, so a language that most rows have is no hot key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name: str, parts: list[np.ndarray]) -> pa.RecordBatch:
            g, n = gram_counts(np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for b in batches:
            for name, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                points = _code_points(value.as_py())
                if len(points) < 4:
                    continue
                held.setdefault(name, []).append(points)
                sizes[name] = sizes.get(name, 0) + len(points)
                if sizes[name] >= _SLICE:
                    yield out(name, held.pop(name))
                    del sizes[name]
        for name, parts in held.items():
            yield out(name, parts)

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def predict(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with lang_pred and score. At most ``MAX_LANGUAGES`` x ``size`` profile rows go to the tasks."""
    bound = MAX_LANGUAGES * size
    rows = profiles.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted({r["lang"] for r in rows})
    grams = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(names), len(grams)), -1, np.int32)
    if rows:
        number = {n: i for i, n in enumerate(names)}
        ranks[[number[r["lang"]] for r in rows], np.searchsorted(grams, [r["gram"] for r in rows])] = [r["rank"] for r in rows]

    def nearest(value: str | None) -> tuple[str, float]:
        own = top_grams(_code_points(value), size) if value is not None and names else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        there = ranks[:, at]
        apart = np.where((grams[at] == own) & (there >= 0), np.abs(there - np.arange(len(own))), size)
        total = apart.sum(axis=1)
        best = int(total.argmin())
        return names[best], 1 - int(total[best]) / (size * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(x.as_py()) for x in b.column(at_text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    at_text = kept.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def fold(key: str = "doc_id", folds: int = 4):
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % folds
