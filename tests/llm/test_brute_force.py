"""Whole operators and pipeline stages against plain Python, on small tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import langid, ogg, quality, queries

RNG = random.Random(77)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(600)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_pages(media):
    """(serial, flags, granule, lacing, body) of every page, checksums by the bit."""
    at = 0
    while at < len(media):
        assert media[at : at + 4] == b"OggS"
        _, flags, granule, serial, number, crc, n = struct.unpack("<BBqIIIB", media[at + 4 : at + 27])
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = bytearray(media[at:end])
        page[22:26] = b"\0\0\0\0"
        c = 0
        for b in page:
            c ^= b << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        assert c == crc
        yield serial, flags, granule, lacing, media[at + 27 + n : end]
        at = end


def test_op5_query(docs, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 500), (4, "x" * 192), (5, prose(900)), (5, prose(3))]
    docs(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op5_ogg(docs([]).sparkSession, str(tmp_path)).collect()
    media = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in ogg.media_column(docs(rows, extra=False)).collect()}
    assert len(out) == len(rows)
    for r in out:
        raw = next((t or "").encode() for k, t in rows if k == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        stored = media[r["doc_id"], r["n_bytes"]]
        packets, part = [], b""
        for serial, _, _, lacing, body in plain_pages(stored):
            if serial != ogg.SAMPLES:
                continue
            for size in lacing:
                part, body = part + body[:size], body[size:]
                if size < 255:
                    packets.append(part)
                    part = b""
        assert b"".join(packets[1:]) == payload
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and f"seconds={len(payload) / ogg.RATE:.6f}" in r["feature"]


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = f" {' '.join(t.split())} " if t.strip() else ""
    counts = Counter()
    for i, c in enumerate(t):
        if c != " ":
            counts[c] += 1
        if i + 1 < len(t):
            counts[t[i : i + 2]] += 1
        if 0 < i < len(t) - 1 and c != " ":
            counts[t[i - 1 : i + 2]] += 1
    return counts


def ranked(counts, size=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], langid_code(x[0])))][:size]


def langid_code(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def test_op10_query(docs, tmp_path):
    rng = random.Random(5)
    alphabets = {"aa": "abcdeé", "bb": "defghi", "cc": "aeiouy"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))), k) for i, k in enumerate(list(alphabets) * 30)]
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "Abc DEF", None), (903, prose(4000, rng), None)]
    docs(rows, extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in queries.op10_language(docs([]).sparkSession, str(tmp_path)).collect()}
    totals = {}
    for i, t, k in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and t and k:
            totals.setdefault(k, Counter()).update(plain_grams(t))
    profiles = {k: {g: n for n, g in enumerate(ranked(c))} for k, c in totals.items()}
    for i, t, _ in rows:
        own = ranked(plain_grams(t or ""))
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not own:
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
            continue
        apart = {k: sum(abs(p[g] - n) if g in p else 300 for n, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert out[i]["lang_pred"] == best and out[i]["score"] == pytest.approx(1 - apart[best] / (300 * len(own)))


def plain_votes(t):
    """What each labeller says about a text, from its definition."""
    words, size = t.split(), max(len(t.encode()), 1)
    n = max(len(words), 1)
    symbols = sum(c in "#*$%&@^~<>{}[]\\_=+" for c in t) / size
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    lines = [x for x in t.split("\n") if x.strip() and not x[-1].isspace()]
    closed = sum(x[-1] in '.!?:;"' for x in lines) / max(len(lines), 1)
    per_line = n / max(len(lines), 1)
    distinct = len(set(words))
    length = sum(len(w.encode()) for w in words) / n
    bad = [
        symbols > 0.06, sum(c in "!?" for c in t) / n > 0.6, upper / max(upper + lower, 1) > 0.5, sum(c in "|\t" for c in t) / n > 0.3,
        n / max(distinct, 1) > 8 and n > 30 and distinct / n**0.5 < 1.5, length < 1.8 or length > 16, closed < 0.2 and n > 30, per_line < 2 and n > 20,
    ]
    good = [False] * 6 + [closed > 0.6, per_line > 5 and n > 20]
    return "".join("0" if b else "1" if g else "-" for b, g in zip(bad, good, strict=True))


def test_op4_votes_and_posteriors(docs):
    rng = random.Random(6)
    texts = [". ".join(prose(rng.randint(4, 14), rng) for _ in range(5)) + rng.choice([".", "", "\n\nmore words here."]) for _ in range(60)]
    texts += [" ".join(w.upper() + "!!" for w in prose(40, rng).split()) for _ in range(8)] + ["| a | b\t" * 30, "same " * 200, "x*#$ " * 50, "ab\ncd\n" * 30, "q " * 40, prose(9000, rng)]
    out = {r["doc_id"]: r for r in quality.classify(docs(list(enumerate(texts)))).collect()}
    assert [out[i]["votes"] for i in range(len(texts))] == list(map(plain_votes, texts))
    votes = [out[i]["votes"] for i in range(len(texts))]
    shown = {"-": 0, "0": 1, "1": 2}
    # expectation-maximisation document by document, in plain sums
    q = [(v.count("1") + 1.0) / (v.count("1") + 30.0 * v.count("0") + 2.0) for v in votes]
    for _ in range(100):
        prior = min(max(sum(q) / len(q), 0.02), 0.98)
        table = []
        for j in range(8):
            per = []
            for c in (0, 1):
                n = [quality.STRENGTH * e for e in quality.EXPECTED[c]]
                for v, p in zip(votes, q, strict=True):
                    n[shown[v[j]]] += (p if c else 1 - p) / len(votes)
                per.append([x / sum(n) for x in n])
            if per[1][1] > quality.MOST_FALSE:
                scale = (1 - quality.MOST_FALSE) / (1 - per[1][1])
                per[1] = [x * scale for x in per[1]]
                per[1][1] = quality.MOST_FALSE
            table.append(per)
        new = []
        for v in votes:
            good, bad = prior, 1 - prior
            for j in range(8):
                good, bad = good * table[j][1][shown[v[j]]], bad * table[j][0][shown[v[j]]]
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, q, strict=True)) < 1e-9
        if done:
            break
        q = new
    for i in range(len(texts)):
        assert out[i]["posterior"] == pytest.approx(q[i], abs=1e-6)


def test_pipeline_stages_keep_their_promises(spark, docs, tmp_path):
    """Language and mixture by brute force; the stages between have theirs in test_corpus_operators and test_corpus_pipeline."""
    rng = random.Random(9)
    rows = [(i, prose(rng.randint(5, 60), rng), "en" if i % 3 else None, f"s{i % 3}") for i in range(80)] + [(200, "123", "en", "s0"), (201, None, None, "s1"), (202, "", "en", None), (300, "twice", "en", "s0"), (300, "twice", "en", "s0")]
    table = docs(rows, extra=False)
    kept = corpus_pipeline.language(spark, table, "").collect()
    scores = {r["doc_id"]: r for r in langid.predict(table, langid.learn(table)).collect()}
    assert Counter(r["doc_id"] for r in kept) == Counter(i for i, *_ in rows if scores[i]["lang_pred"] != "und" and scores[i]["score"] >= corpus_pipeline.LEAST_SCORE)
    assert all(r["lang"] for r in kept)
    for stage in corpus_pipeline.STAGES[:3]:
        empty = stage[1](spark, table.where("false"), "")
        assert empty.count() == 0 and empty.columns == table.columns
    mixed = corpus_pipeline.mixture(spark, table, "").collect()
    sizes = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * sizes[r["doc_id"], r["text"]] for r in mixed)
    total = sum(sizes[i, t] for i, t, *_ in rows)
    assert abs(sum(r["taken"] for r in mixed) - min(1.5, 2) * total) <= 3 * max(sizes.values())
    clashing = docs(rows).withColumn("text_", F.lit(1))
    assert corpus_pipeline.near_duplicates(spark, clashing, "").columns == clashing.columns
