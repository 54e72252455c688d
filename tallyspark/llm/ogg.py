"""Media columns: Ogg.

A payload of 8-bit mono samples is stored as an Ogg physical stream that carries two multiplexed logical streams:
the samples (packets of ``PACKET`` samples, granule position = samples so far) and a small stream of notes. Reading
verifies every page checksum and sequence number, reassembles packets from the lacing values (packets may continue
over pages), separates the logical streams and derives time stamps from the granule positions.

Defined results: a null text counts as empty; an empty text gives one padding unit of 192 blanks; a damaged stream
raises ``ValueError`` in :func:`read_pages`. Rows are handled one by one inside Arrow batches, so repeated rows, ties
in the key and extra columns have no influence; texts of any length are stored whole, one at a time; the key is of any type; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192  # the payload is a positive multiple of this
PACKET = 960  # samples in a packet
RATE = 8000  # samples a second
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445  # serial numbers of the two logical streams
CONTINUED, FIRST, LAST = 1, 2, 4  # header flags of a page
NO_GRANULE = -1  # no packet ends on the page

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")


def page_crc(page: bytes) -> int:
    """The checksum of an Ogg page: polynomial 0x04C11DB7, most significant bit first, from 0.

    zlib has the same polynomial with reversed bits, so bytes go in and the sum comes out reversed.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = b"".join((head, lacing, body))
    return b"".join((page[:22], page_crc(page).to_bytes(4, "little"), page[26:]))


def write_stream(serial: int, head: bytes, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; ``head`` stands alone on the first page."""
    pages = [_page(FIRST, 0, serial, 0, _lace(len(head)), head)]
    lacing = b"".join(_lace(len(p)) for p in packets)
    body = b"".join(packets)
    at = done = 0
    open_packet = False
    for start in range(0, len(lacing), 255):
        part = lacing[start : start + 255]
        size = sum(part)
        ended = len(part) - part.count(255)
        done += ended
        flags = (CONTINUED if open_packet else 0) | (LAST if start + 255 >= len(lacing) else 0)
        granule = granules[done - 1] if ended else NO_GRANULE
        pages.append(_page(flags, granule, serial, len(pages), part, body[at : at + size]))
        open_packet = part[-1] == 255
        at += size
    return pages


def _lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stored form of a payload; ``n_bytes`` (its length before padding) goes into the notes."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [min(len(payload), i + PACKET) for i in range(0, len(payload), PACKET)]
    samples = write_stream(SAMPLES, struct.pack("<8sII", b"PCM8mono", RATE, PACKET), packets, granules)
    notes = write_stream(NOTES, b"NOTE", [struct.pack("<Q", n_bytes)], [1])
    # both first pages come before all others; the notes' second page stands among the samples
    return b"".join([samples[0], notes[0], *samples[1:2], *notes[1:], *samples[2:]])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule, lacing, body) of every page, its checksum verified."""
    at = 0
    while at < len(media):
        mark, version, flags, granule, serial, number, crc, count = _HEADER.unpack_from(media, at)
        if mark != b"OggS" or version != 0:
            raise ValueError(f"no page at byte {at}")
        start = at + 27 + count
        lacing = media[at + 27 : start]
        end = start + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise ValueError(f"the page at byte {at} is cut off")
        if page_crc(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : end]))) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        yield serial, number, flags, granule, lacing, media[start:end]
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[int | None, bytes]]]:
    """Packets of each logical stream in order, each with the granule position known at its end, if any."""
    streams: dict[int, list[tuple[int | None, bytes]]] = {}
    following: dict[int, int] = {}
    rest: dict[int, list[bytes]] = {}
    for serial, number, flags, granule, lacing, body in read_pages(media):
        if number != following.get(serial, 0):
            raise ValueError(f"stream {serial:#x}: page {number} follows {following.get(serial, 0) - 1}")
        following[serial] = number + 1
        packets, parts = streams.setdefault(serial, []), rest.setdefault(serial, [])
        if bool(flags & CONTINUED) != bool(parts):
            raise ValueError(f"stream {serial:#x}: page {number} doesn't continue its packet")
        at = size = 0
        before = len(packets)
        for value in lacing:
            size += value
            if value < 255:
                parts.append(body[at : at + size])
                packets.append((None, b"".join(parts) if len(parts) > 1 else parts[0]))
                parts.clear()
                at, size = at + size, 0
        if size:
            parts.append(body[at : at + size])
        if len(packets) > before and granule != NO_GRANULE:
            packets[-1] = (granule, packets[-1][1])
    if any(rest.values()):
        raise ValueError("the last packet is cut off")
    return streams


def decode(media: bytes) -> tuple[bytes, int, list[float]]:
    """Samples, length before padding, and the end time in seconds of every sample packet."""
    streams = demultiplex(media)
    (_, head), *packets = streams[SAMPLES]
    name, rate, _ = struct.unpack("<8sII", head)
    if name != b"PCM8mono":
        raise ValueError("unknown codec")
    payload = b"".join(p for _, p in packets)
    times, position = [], 0
    for granule, packet in packets:
        position += len(packet)
        if granule is not None and granule != position:
            raise ValueError(f"granule position {granule} after {position} samples")
        times.append(position / rate)
    return payload, struct.unpack("<Q", streams[NOTES][1][1])[0], times


def features(payload: bytes, seconds: float) -> str:
    """Duration, mean, root mean square, zero crossings and peak of the samples around the middle 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    rms = float(np.sqrt(int((x * x).sum(dtype=np.int64)) / len(x)))
    return (
        f"seconds={seconds:.6f};mean={int(x.sum(dtype=np.int64)) / len(x):.6f};rms={rms:.6f}"
        f";crossings={crossings};peak={int(np.abs(x).max())}"
    )


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text in its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x.as_py() for x in b.column(1)]
            media = [encode(pad(x), len(x)) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())],
                names=["key", "n_bytes", "media"],
            )

    return _keyed(docs, key, text).mapInArrow(run, f"key {_kind(docs, key)}, n_bytes long, media binary").withColumnRenamed("key", key)


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of every logical stream: (key, serial, packet, seconds, data); seconds where a granule says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in zip(b.column(0), b.column(1), strict=True):
                for serial, packets in demultiplex(m.as_py() or b"").items():
                    n = len(packets)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k.as_py()] * n, k.type),
                            pa.array([serial] * n, pa.int64()),
                            pa.array(range(n), pa.int64()),
                            pa.array([None if g is None else g / RATE for g, _ in packets], pa.float64()),
                            pa.array([p for _, p in packets], pa.binary()),
                        ],
                        names=["key", "serial", "packet", "seconds", "data"],
                    )

    rows = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    schema = f"key {_kind(media, key)}, serial long, packet long, seconds double, data binary"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text, read the stored bytes back and describe both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for value in b.column(1):
                raw = value.as_py()
                media = encode(pad(raw), len(raw))
                payload, n_bytes, times = decode(media)
                sha = hashlib.sha256(payload).hexdigest()
                out.append((n_bytes, len(payload), sha, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, times[-1])))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = f"key {_kind(docs, key)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _keyed(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def pad(raw: bytes) -> bytes:
    """``raw`` with blanks up to a positive multiple of ``UNIT``."""
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def _kind(docs: DataFrame, key: str) -> str:
    return docs.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
