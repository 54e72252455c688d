"""Quality classifier from weak labels.

Eight heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote patterns (at
most 3 ** 8, counted over all documents) estimates how often each labeller casts each vote on good and on bad
documents, from what is expected of any labeller and with no labelled row. The posterior of a document's pattern is its weak label. On these labels a linear
scorer over hashed byte trigrams is fitted, from a sample of about ``SAMPLE`` documents drawn by hash; it scores all.

Defined results: a null or blank text has posterior and score 0 and isn't kept; repeated rows get equal results and count
as often as they occur; without any votes against each other the posterior is the labellers' majority; long texts are read whole, by slices of
rows; the sample's size is bounded by 2 x ``SAMPLE`` in order of hash, so reruns agree; only the key of ``docs`` is returned, other columns have no
influence; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import rolling

LABELLERS = ("symbols", "marks", "capitals", "bars", "variety", "word_length", "endings", "lines")
SAMPLE = 3000  # documents that the scorer is fitted on
BUCKETS = 2048
KEEP = 0.5
# What a labeller is expected to do before any document is seen, as none, bad, good, on bad and on good documents. STRENGTH is the
# weight beside that of all documents, 1. MOST_FALSE bounds the share of good documents that a labeller may blame: it tells the
# classes apart and keeps a fault that only one labeller sees from counting as its error.
EXPECTED, STRENGTH = ((0.45, 0.2, 0.35), (0.498, 0.002, 0.5)), 0.1
MOST_FALSE = 0.001
_ROUNDS = 100
_STEPS = 300
_CHUNK = 1 << 19
_GOOD, _BAD, _NONE = 2, 1, 0


def _kind(chars: str) -> np.ndarray:
    return np.array([chr(i) in chars for i in range(256)])


_SYMBOL, _MARK, _BAR, _END = _kind("#*$%&@^~<>{}[]\\_=+"), _kind("!?"), _kind("|\t"), _kind('.!?:;"')
_UPPER, _LOWER = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("abcdefghijklmnopqrstuvwxyz")
_SPACE = _kind(" \t\n\r\v\f")


def _vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, _BAD, np.where(good, _GOOD, _NONE)) * np.ones(len(value), np.int64)


def votes(raw: list[bytes]) -> np.ndarray:
    """The labellers' votes on each text: 2 good, 1 bad, 0 none; one row per text."""
    data, bounds = rolling.joined([b"\n" + r + b"\n" for r in raw])
    start, size = bounds[:-1], np.maximum(np.diff(bounds) - 2, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[data], start, dtype=np.int64)

    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    begin = np.searchsorted(first, bounds)
    n_words = np.maximum(np.diff(begin), 1)
    words = rolling.Spans(data, 5).hash(first, last)
    owner = np.repeat(np.arange(len(raw)), np.diff(begin))
    distinct = np.bincount(np.unique(np.stack([owner.astype(np.uint64), words], 1), axis=0)[:, 0].astype(np.int64), minlength=len(raw)) if len(words) else np.zeros(len(raw))
    length = np.bincount(owner, last - first, minlength=len(raw)) / n_words
    line_end = np.flatnonzero((data[1:] == 10) & inside[:-1])
    line_owner = np.searchsorted(bounds, line_end, "right") - 1
    lines = np.bincount(line_owner, minlength=len(raw))
    ended = np.bincount(line_owner, _END[data[line_end]], minlength=len(raw))
    symbols, marks, bars = share(_SYMBOL) / size, share(_MARK) / n_words, share(_BAR) / n_words
    upper, lower = share(_UPPER), share(_LOWER)
    capitals = upper / np.maximum(upper + lower, 1)
    variety = distinct / np.sqrt(n_words)
    repeats = n_words / np.maximum(distinct, 1)
    closed = ended / np.maximum(lines, 1)
    per_line = n_words / np.maximum(lines, 1)
    none = np.zeros(len(raw), bool)
    table = [
        _vote(symbols, none, symbols > 0.06),
        _vote(marks, none, marks > 0.6),
        _vote(capitals, none, capitals > 0.5),
        _vote(bars, none, bars > 0.3),
        _vote(variety, none, (repeats > 8) & (n_words > 30) & (variety < 1.5)),
        _vote(length, none, (length < 1.8) | (length > 16)),
        _vote(closed, closed > 0.6, (closed < 0.2) & (n_words > 30)),
        _vote(per_line, (per_line > 5) & (n_words > 20), (per_line < 2) & (n_words > 20)),
    ]
    return np.stack(table, 1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, P(vote | class) as labellers x classes x votes, prior of good)."""
    weight = counts / counts.sum()
    good, bad = (patterns == _GOOD).sum(1), (patterns == _BAD).sum(1)
    q = (good + 1.0) / (good + 30.0 * bad + 2.0)  # one vote against is enough to begin with: labellers see one fault each
    table = np.zeros((patterns.shape[1], 2, 3))
    prior = 0.5
    for _ in range(_ROUNDS):
        prior = float(np.clip((weight * q).sum(), 0.02, 0.98))
        for j in range(patterns.shape[1]):
            for c, w in enumerate((1 - q, q)):
                n = np.bincount(patterns[:, j], weight * w, minlength=3) + STRENGTH * np.array(EXPECTED[c])
                table[j, c] = n / n.sum()
            false = table[j, 1, _BAD]
            if false > MOST_FALSE:
                table[j, 1] *= (1 - MOST_FALSE) / (1 - false)
                table[j, 1, _BAD] = MOST_FALSE
        log = np.log(table)
        each = [sum(log[j, c][patterns[:, j]] for j in range(patterns.shape[1])) for c in (0, 1)]
        odds = each[1] - each[0] + np.log(prior) - np.log(1 - prior)
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return q, table, prior


_code = rolling.byte_codes(99)


def trigram_buckets(raw: bytes) -> np.ndarray:
    """The bucket of every byte trigram of the text."""
    x = _code[np.frombuffer(b" " + raw + b"  ", np.uint8)]
    h = (x[:-2] * np.uint64(31) + x[1:-1]) * np.uint64(31) + x[2:]
    return ((h ^ (h >> np.uint64(33))) % np.uint64(BUCKETS)).astype(np.int64)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft labels ``y``, classes weighed alike, by Adam over all rows."""
    w, b = np.zeros(x.shape[1]), 0.0
    weigh = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weigh /= weigh.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, _STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        d = weigh * (p - y)
        g = np.append(x.T @ d + 1e-5 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, votes, posterior, score, keep) for every row."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
        for b in batches:
            at = size = 0
            for i, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
                size += n
                if size >= _CHUNK or i + 1 == b.num_rows:
                    part = b.slice(at, i + 1 - at)
                    yield part.column(0), part.column(1).to_pylist()
                    at, size = i + 1, 0

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in chunks(batches):
            blank = np.array([not r.strip() for r in raw])
            code = np.where(blank, -1, votes(raw) @ 3 ** np.arange(len(LABELLERS)))
            found, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    counted = rows.mapInArrow(cast, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3 ** 8 + 1 rows at most
    seen = sorted((r["pattern"], r["n"]) for r in counted if r["pattern"] >= 0)
    total = sum(n for _, n in seen)
    posterior = np.zeros(3 ** len(LABELLERS))
    w, bias = np.zeros(BUCKETS), 0.0
    if seen:
        codes = np.array([c for c, _ in seen])
        patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        posterior[codes] = expectation_maximisation(patterns, np.array([n for _, n in seen], float))[0]

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, raw in chunks(batches):
                labels = posterior[votes(raw) @ 3 ** np.arange(len(LABELLERS))]
                vectors = [(np.bincount(b := trigram_buckets(r), minlength=BUCKETS) / len(b)).astype(np.float32).tobytes() for r in raw]
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(vectors, pa.binary())], names=["label", "x"])

        hashed = F.xxhash64("key", "raw")
        drawn = F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))
        chosen = rows.where(drawn & (F.trim(F.col("raw").cast("string")) != "")).orderBy(hashed).limit(2 * sample)
        drawn_rows = chosen.mapInArrow(features, "label double, x binary").collect()
        if drawn_rows:
            drawn_rows.sort(key=lambda r: (r["x"], r["label"]))
            x = np.stack([np.frombuffer(r["x"], np.float32) for r in drawn_rows]).astype(float)
            w, bias = fit(x * BUCKETS, np.array([r["label"] for r in drawn_rows]))
    w = w * BUCKETS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raw in chunks(batches):
            v = votes(raw)
            blank = np.array([not r.strip() for r in raw])
            label = np.where(blank, 0.0, posterior[v @ 3 ** np.arange(len(LABELLERS))])
            z = np.array([w[trigram_buckets(r)].mean() for r in raw]) + bias
            s = np.where(blank, 0.0, 1 / (1 + np.exp(-np.clip(z, -40, 40))))
            cast_ = pa.array(["".join("-01"[int(k)] for k in row) for row in v], pa.string())
            yield pa.RecordBatch.from_arrays([keys, cast_, pa.array(label), pa.array(s), pa.array(s >= KEEP)], names=["key", "votes", "posterior", "score", "keep"])

    return rows.mapInArrow(score, f"key {kind}, votes string, posterior double, score double, keep boolean").withColumnRenamed("key", key)
