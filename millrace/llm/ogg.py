"""Ogg bitstreams in media columns: paging, checksums, lacing, demultiplexing, timestamps.

A text's bytes are stored as 8-bit samples in one logical stream, beside a
second logical stream that carries the unpadded size; both are interleaved in
one physical stream. Reading verifies every page's checksum and sequence number,
reassembles packets from lacing values (over pages if they continue), splits the
logical streams by serial number and turns granule positions into timestamps.

Defined cases: a null text is stored as the empty text, whose payload is one
frame of blanks; equal texts give equal streams, so repeated rows do; a stream
with a bad checksum, a gap or an open packet is reported as damaged in its row,
never repaired, and never ends the job; null media are damaged too. Columns of
the input other than the key do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import stored, with_columns

FRAME, PACKET, RATE = 192, 192 * 20, 8000
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
SAMPLES, NOTES = b"\x7fSAMPLE8", b"\x7fNOTES"
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, from 0: zlib's, of bit-reversed bytes, bit-reversed."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def pages(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream. granules: the position at the end of each packet. The first packet has a page of its own."""
    groups: list[tuple[list[int], list[bytes], int, bool]] = []
    lacing, body, granule, begun = [], [], -1, False
    for k, packet in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        done = 0
        while values:
            room = 255 - len(lacing)
            part, values = values[:room], values[room:]
            size = sum(part)
            lacing += part
            body.append(packet[done : done + size])
            done += size
            if not values:
                granule = granules[k]
            if len(lacing) == 255 or (k == 0 and not values):
                groups.append((lacing, body, granule, begun))
                begun = bool(values)  # the next page continues this packet
                lacing, body, granule = [], [], -1
    if lacing:
        groups.append((lacing, body, granule, begun))
    out = []
    for k, (lacing, body, granule, continued) in enumerate(groups):
        kind = CONTINUED * continued | FIRST * (k == 0) | LAST * (k == len(groups) - 1)
        rest = bytes(lacing) + b"".join(body)
        crc = checksum(HEAD.pack(b"OggS", 0, kind, granule, serial, k, 0, len(lacing)) + rest)
        out.append(HEAD.pack(b"OggS", 0, kind, granule, serial, k, crc, len(lacing)) + rest)
    return out


def interleaved(streams: list[list[bytes]]) -> bytes:
    """One physical stream: every stream's first page first, then the others in turn."""
    out, k = [s[0] for s in streams], 1
    while any(k < len(s) for s in streams):
        out += [s[k] for s in streams if k < len(s)]
        k += 1
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream as read: packets, the granule position at each one's end (-1: inside a page), and faults."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    faults: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages were damaged."""
    streams: dict[int, Stream] = {}
    at, damaged = 0, 0
    while at < len(data):
        if data[at : at + 4] != b"OggS" or at + HEAD.size > len(data):  # find the next page
            damaged += 1
            at = data.find(b"OggS", at + 1)
            if at < 0:
                break
            continue
        _, _, kind, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
        lacing = data[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        page = data[at:end]
        if len(page) < end - at or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            damaged += 1
            at += 4
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.pages or bool(kind & FIRST) != (number == 0):
            s.faults += 1
            s.pages = number
        if bool(kind & CONTINUED) != bool(s.open):
            s.faults += 1
            s.open = []
        place, size = at + HEAD.size + n, 0
        for value in lacing:
            size += value
            if value < 255:  # a packet ends with the first lacing value below 255
                s.packets.append(b"".join([*s.open, data[place : place + size]]))
                s.granules.append(-1)
                s.open, place, size = [], place + size, 0
        if size:
            s.open.append(data[place : place + size])
        if granule >= 0 and s.granules:
            s.granules[-1] = granule
        s.pages += 1
        s.ended |= bool(kind & LAST)
        at = end
    return streams, damaged


def of_text(text: str | None) -> bytes:
    """The media of a text: samples (padded with blanks to whole frames) and its size, in two logical streams."""
    data = (text or "").encode("utf-8")
    frames = max(1, -(-len(data) // FRAME))
    payload = data.ljust(frames * FRAME, b" ")
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = np.minimum(np.arange(1, len(packets) + 1) * PACKET, len(payload)).tolist()
    samples = pages([SAMPLES + struct.pack("<I", RATE), *packets], [0, *ends], 1)
    notes = pages([NOTES, struct.pack("<q", len(data))], [0, 0], 2)
    return interleaved([samples, notes])


def facts(media: bytes | None) -> dict[str, object]:
    """What is read back from one media value; of a damaged one only that it is, and its size and digest."""
    streams, damaged = read(media or b"")
    own = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()} if media is not None else {}
    by_kind = {next((x for x in (SAMPLES, NOTES) if s.packets and s.packets[0].startswith(x)), b""): s for s in streams.values()}
    samples, notes = by_kind.get(SAMPLES), by_kind.get(NOTES)
    whole = samples and notes and len(samples.packets) > 1 and len(samples.packets[0]) == len(SAMPLES) + 4 and len(notes.packets) == 2 and len(notes.packets[1]) == 8
    if damaged or not whole or samples.granules[-1] < 0 or any(s.faults or s.open or not s.ended for s in streams.values()):
        return own | {"damaged": True}
    (rate,) = struct.unpack("<I", samples.packets[0][len(SAMPLES) :])
    payload = b"".join(samples.packets[1:])
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    last = samples.granules[-1]
    times = [g / rate for g in samples.granules[1:] if g >= 0]
    # Timestamps of the pages, the level, the power and how often the sign turns.
    feature = (
        f"samples={last} seconds={times[-1]:.6f} stamps={len(times)} packets={len(samples.packets) - 1} pages={samples.pages} "
        f"sum={int(x.sum())} power={int((x * x).sum())} turns={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
    )
    return {
        "n_bytes": struct.unpack("<q", notes.packets[1])[0],
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-16:]),
        **own,
        "feature": feature,
        "seconds": last / rate,
        "damaged": False,
    }


FACTS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, seconds double, damaged boolean"


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and media: the Ogg stream of each whole text."""

    def make():
        return lambda block: {"media": [of_text(t) for t in block.column("text").to_pylist()]}

    return with_columns(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), "text", make, "media binary").drop("text")


PACKETS = "serial bigint, packet bigint, granule bigint, seconds double, data binary, faults bigint, damaged boolean"


def packets(stored_media: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per packet: key, serial, packet, granule, seconds (null inside a page), data, faults and damaged.

    ``faults`` counts the stream's gaps and misplaced pages (one more if its last
    packet is open or its end is missing); ``damaged`` says that any page of the
    value was damaged or any of its streams has faults: its packets are what
    could be read. A value without any packet (null, empty, all pages damaged)
    has one row, damaged, with nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = stored_media.schema[key].dataType
    key_type = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            for k, m in zip(batch.column(key), batch.column("media"), strict=True):
                streams, lost = read(m.as_py() or b"")
                faults = {serial: s.faults + bool(s.open or not s.ended) for serial, s in streams.items()}
                bad = bool(lost or not streams or any(faults.values()))
                rows = [
                    (serial, i, g if g >= 0 else None, g / RATE if g >= 0 else None, data, faults[serial], bad)
                    for serial, s in streams.items() for i, (g, data) in enumerate(zip(s.granules, s.packets, strict=True))
                ]
                rows = rows or [(None, None, None, None, None, sum(faults.values()), True)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.bool_())
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k.as_py()] * len(rows), key_type), *columns], names=[key, "serial", "packet", "granule", "seconds", "data", "faults", "damaged"]
                )

    return stored_media.select(key, "media").mapInArrow(run, f"`{key}` {kind.simpleString()}, {PACKETS}")


def read_back(stored_media: DataFrame) -> DataFrame:
    """The facts of media values beside the other columns; of damaged ones, that they are."""
    names = [x.split()[0] for x in FACTS.split(", ")]

    def make():
        def run(block: pa.RecordBatch) -> dict[str, object]:
            found = [facts(m.as_py()) for m in block.column("media")]
            return {name: [f.get(name) for f in found] for name in names}

        return run

    return with_columns(stored_media, "media", make, FACTS).drop("media")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the media of all texts, reads them back and returns their facts."""
    return read_back(stored(media(docs, key, text)))
