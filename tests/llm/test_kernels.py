"""Helpers against plain definitions."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import langid, near_dup, ogg, rolling, suffix_dedup


def plain_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_page_crc(data):
    assert ogg.page_crc(data) == plain_crc(data)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 40))
def test_ogg_round_trip(data, repeat):
    raw = data * repeat
    media = ogg.encode(ogg.pad(raw), len(raw))
    payload, n, times = ogg.decode(media)
    assert payload == ogg.pad(raw) and n == len(raw) and len(payload) % 192 == 0
    assert times[-1] == len(payload) / ogg.RATE


@pytest.mark.parametrize("size", [1, 254, 255, 256, 510, 65_025, 70_000, 200_000])
def test_packets_over_pages(size):
    packets = [bytes([i]) * size for i in range(3)]
    pages = ogg.write_stream(7, b"head", packets, [1, 2, 3])
    assert [p for _, p in ogg.demultiplex(b"".join(pages))[7]] == [b"head", *packets]


def test_damaged_ogg():
    media = bytearray(ogg.encode(ogg.pad(b"abc" * 99), 297))
    media[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.decode(bytes(media))
    with pytest.raises(ValueError, match="cut off"):
        list(ogg.read_pages(bytes(media[:-5])))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_min(values, width):
    a = np.array(values, np.uint64)
    assert rolling.sliding_min(a, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_span_hashes(data):
    x = np.frombuffer(data + data, np.uint8)
    s = rolling.Spans(x, 1)
    n = len(data)
    i = np.arange(n)
    assert (s.hash(i, i + n - i) == s.hash(i + n, np.full(n, 2 * n))).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=20), st.lists(st.integers(0, 30), unique=True, max_size=20))
def test_similarity_is_longest_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    m = table[-1][-1]
    true = m / (len(a) + len(b) - m) if a or b else 0.0
    for least in (0.5, 0.8):
        found = near_dup.similarity(np.array(a, np.uint32), np.array(b, np.uint32), least)
        assert (found >= least) == (true >= least and bool(a or b))


def test_gram_counts():
    grams, counts = langid.gram_counts(langid._code_points("Aba 1 ab"))
    pack = lambda s: sum(ord(c) << 21 * i for i, c in enumerate(reversed(s)))
    found = dict(zip(grams.tolist(), counts.tolist(), strict=True))
    assert found[pack("a")] == 3 and found[pack("b")] == 2 and found[pack(" a")] == 2 and found[pack("aba")] == 1 and found[pack(" ab")] == 2
    assert pack("a a") not in found


def test_anchors_hold_every_window():
    rng = random.Random(5)
    shared = bytes(rng.randrange(256) for _ in range(500))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + shared for n in (0, 17, 900)]
    fp, ctx, number, pos, back, more = suffix_dedup.anchors(texts)
    for i, t in enumerate(texts):
        own = number == i
        starts = sorted(s for p, b, m in zip(pos[own], back[own], more[own], strict=True) for s in range(p - b, p - b + m + 1))
        assert starts == list(range(len(t) - 399))
    common = set(fp[number == 0]) & set(fp[number == 1]) & set(fp[number == 2])
    assert common


def test_tail_crc_is_unsigned():
    assert zlib.crc32(b"abc") >= 0
