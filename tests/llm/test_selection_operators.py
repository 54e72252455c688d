"""Importance resampling, filter audit and SimHash against plain Python, on small tables with awkward rows."""

import math
import random
import re
import zlib
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import filter_audit, importance, simhash
from tallyspark.llm.store import Workspace

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(300)]
AWKWARD = ["", "   ", "one", "Éa b\tC\x0bd", "a-b_c É9 ß", "x" * 3000, None, "#", "one two three"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


LONG = prose(30_000)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    texts = [*AWKWARD, LONG, *(prose(RNG.randint(15, 60)) for _ in range(60))]
    found = [(i, t, None, RNG.choice(["web", "Web", None, "é"])) for i, t in enumerate(texts)]
    found += [(100, texts[20], None, "web"), (101, texts[20], None, "web"), (101, texts[20], None, None), (None, texts[20], None, "web"), (None, None)]
    found += [(200 + i, re.sub(r"^\S+", RNG.choice(WORDS), LONG), None, "copy") for i in range(3)]
    return found


# importance


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return words, [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def plain_ranked(rows, target):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for x in rows:
        np.add.at(s, plain_features(x[1])[1], 1)
    for x in target:
        np.add.at(t, plain_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for key, text, *_ in rows:
        words, features = plain_features(text)
        weight = sum(gain[f] for f in features) // len(features) if features else 0
        h = int(sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("piece", [importance._PIECE, 100])
def test_importance_agrees_with_plain_python(spark, docs, rows, monkeypatch, piece):
    monkeypatch.setattr(importance, "_PIECE", piece)
    found, n = importance.buckets(LONG.encode())
    assert sorted(found.tolist()) == sorted(plain_features(LONG)[1]) and n == 30_000
    monkeypatch.undo()
    target = [prose(40) for _ in range(5)] + [None, ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.ranked(docs(rows), benchmark).select("key", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_ranked(rows, target)


def test_importance_of_empty_tables_and_string_keys(spark, docs, rows):
    nothing = spark.createDataFrame([], "text string")
    assert importance.ranked(docs([]), nothing).count() == 0
    named = docs(rows).withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id")))
    drawn = importance.resample(named, nothing)
    assert drawn.columns == named.columns
    ranks = sorted(r["rank"] for r in importance.ranked(named, nothing).where("rank is not null").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and drawn.count() == len(ranks)


def test_target_like_documents_are_drawn(spark, docs):
    near = [(i, "quantum lattice " + prose(30) + " quantum lattice" * 30) for i in range(0, 400, 10)]
    far = [(i, prose(80)) for i in range(400) if i % 10]
    target = spark.createDataFrame([("quantum lattice " * 20_000,)], "text string")
    drawn = {r["doc_id"] for r in importance.resample(docs(near + far), target).collect()}
    assert len(drawn) == 100 and len(drawn & {k for k, _ in near}) >= 36


# filter audit


def plain_masks(rows):
    out = []
    for key, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t))]
        fails.append(key is not None and any(k is not None and k < key and (x or "") == t for k, x, *_ in rows))
        out.append(fails)
    return out


def test_audit_agrees_with_plain_python(spark, docs, rows):
    rows = [*rows, (300, ("A few Words # here ") * 60, None, "web"), (301, prose(250), None, "web"), (302, LONG, None, "é")]
    labels = [(2, 1, 0), (2, 0, 1), (300, 1, 1), (101, 0, 1), (100, 1, None), (None, 1, 1), (999, 1, 1), (301, 1, 0)]
    good, toxic = {k for k, q, _ in labels if q == 1} - {None}, {k for k, _, x in labels if x == 1} - {None}
    want = {}
    for (key, _, *rest), fails in zip(rows, plain_masks(rows), strict=True):
        part = (rest[1] if len(rest) > 1 else None) or ""
        for order in permutations(range(5)):
            left = True
            for step, f in enumerate(order, 1):
                cell = want.setdefault((part, "".join("ABCDE"[i] for i in order), step), [0] * 7)
                cell[2] += fails[f] and not left
                cell[3] += fails[f] and sum(fails) == 1
                if left and fails[f]:
                    left = False
                    cell[1] += 1
                    cell[4] += key in good
                    cell[5] += key in toxic
                cell[0] += left
    total = {}
    for (part, order, step), cell in want.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + cell[1]
    for (part, order, step), cell in want.items():
        cell[6] = total[part, order[step - 1]]
    got = filter_audit.audit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:3]: list(tuple(r)[3:]) for r in got} == want and len(got) == len(want) == 600 * len({k[0] for k in want})


def test_incidence_has_a_row_per_mask_and_a_column_per_step():
    by, filters = filter_audit.incidence(5)
    assert {m.shape for m in by.values()} == {(32, 600)} and filters.shape == (600,)
    assert all((by["kept"][m].reshape(120, 5)[:, -1] == (m == 0)).all() for m in range(32))
    assert (by["removed"].reshape(32, 120, 5).sum(axis=2).T == (np.arange(32) > 0)).all()  # a failing document goes once in every order


def test_audit_takes_other_filters_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs([]), labels).count() == 0
    got = filter_audit.audit(docs([(1, "a"), (2, "a"), (3, "bb")]), labels, filters={"X": F.length("text") > 1}).collect()
    assert sorted((r["filter_order"], r["step"], r["kept"], r["removed"]) for r in got) == [("EX", 1, 2, 1), ("EX", 2, 1, 1), ("XE", 1, 2, 1), ("XE", 2, 1, 1)]


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits):
    label = list(range(len(bits)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(bits))]


def test_simhash_agrees_with_plain_python(docs, rows):
    got = simhash.classes(docs(rows)).collect()
    bits = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(bits)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        least[c] = min(x for x in (r[0], least.get(c)) if x is not None) if (r[0], least.get(c)) != (None, None) else None
    want = [(r[0], f"{b:016x}", least[c]) for r, b, c in zip(rows, bits, roots, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({f for _, f, _ in want}) < len(want)


@pytest.mark.parametrize(("size", "spread"), [(4, 2), (16, 6), (1024, 6)])
def test_index_finds_the_components_of_brute_force(spark, size, spread):
    rng = random.Random(size)
    centres = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 0xFFF << 52]
    bits = set(centres)
    for _ in range(900):  # chains and dense clusters, many of which share a leading segment
        x = rng.choice(sorted(bits)[:60]) if rng.random() < 0.3 else rng.choice(centres)
        for _ in range(rng.randint(1, spread)):
            x ^= 1 << rng.randrange(64)
        bits.add(x)
    bits |= {(0xABC << 52) | rng.getrandbits(40) for _ in range(300)}
    bits = sorted(bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    table = spark.createDataFrame([(b,) for b in signed], "bits long")
    found = {r["node"]: r["label"] for r in simhash.groups(table, Workspace(spark, "t"), size).collect()}
    want = {}
    for b, root in zip(signed, plain_components(bits), strict=True):
        want.setdefault(root, set()).add(b)
    groups = {}
    for b in signed:
        groups.setdefault(found.get(b, b), set()).add(b)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert len(want) < len(bits) * 0.8


def test_every_pair_within_the_distance_has_a_turn_that_keeps_the_limits():
    rng = random.Random(9)
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        kept = []
        for turn in range(simhash.SEGMENTS):
            y = int(simhash.turned(np.array([x], np.uint64), simhash.EDGES[turn])[0])
            kept.append(all((y >> 64 - bits).bit_count() <= most for bits, most in simhash.allowed(turn)))
        assert any(kept)


def test_gray_rank_orders_the_gray_codes():
    codes = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


def test_blocks_are_cut_by_lead_and_size_across_batches(spark):
    bits = spark.range(500).select((F.col("id") * 7).alias("bits"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        dealt = simhash.entries(bits).repartitionByRange(3, "turn", "lead", "rank").sortWithinPartitions("turn", "lead", "rank")
        table = simhash.blocks(dealt, 16).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["n"] for r in table) == 2500 and max(r["n"] for r in table) == 16
    assert len({(r["task"], r["block"]) for r in table}) == len(table)
    for r in table:
        values = np.frombuffer(r["body"], np.int64)
        assert len(values) == r["n"] and np.bitwise_and.reduce(values) == r["ones"] and np.bitwise_or.reduce(values) == r["anys"]


def test_simhash_dedup_keeps_the_smallest_key(docs, rows):
    table = docs(rows)
    kept = simhash.dedup(table)
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = {r["component_id"] for r in simhash.classes(table).collect()}
    assert set(ids) - {None} == want - {None} and ids.count(None) == 2
    assert simhash.classes(docs([])).count() == 0 == simhash.dedup(docs([])).count()
