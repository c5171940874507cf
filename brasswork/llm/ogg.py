"""Ogg media columns (operator 3).

Reading: pages are found by their capture pattern and checked against their checksum, packets are put together from
lacing values and continued pages, logical streams are told apart by serial number, and each packet gets a time from
the granule position of the page on which it ends. Writing makes such files from bytes, taken as unsigned 8-bit
samples of one channel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brasswork.llm.common import doc_texts, slices

HEADER = struct.Struct("<4sBBqIIIB")
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
#: Head of the sample stream's first packet: name, rate, channels, bits.
SAMPLE_HEAD = struct.Struct("<8sIBB")
SAMPLE_NAME, NOTE_NAME = b"rawpcm8\0", b"rawnote\0"
RATE = 8000
PACKET_SAMPLES = 4096
MAX_SEGMENTS = 255

#: The checksum's polynomial is that of zlib.crc32 with the bits of each byte the other way round.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC of a page whose checksum field is zero: polynomial 0x04c11db7, start 0, no final inversion."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(struct.pack("<I", mirrored).translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    checksum = page_checksum(head + body)
    return head[:22] + struct.pack("<I", checksum) + head[26:] + body


class StreamWriter:
    """Pages of one logical stream. A page is closed when its 255 segments are full or on flush."""

    def __init__(self, serial: int):
        self.serial, self.number, self.flags = serial, 0, FIRST
        self.lacing, self.body, self.granule = bytearray(), bytearray(), -1

    def _close(self, last: bool = False) -> bytes:
        page = _page(self.flags | (LAST if last else 0), self.granule, self.serial, self.number, bytes(self.lacing), bytes(self.body))
        self.number, self.flags, self.granule = self.number + 1, 0, -1
        self.lacing.clear()
        self.body.clear()
        return page

    def packet(self, data: bytes, granule: int) -> bytes:
        out, at, left = b"", 0, len(data)
        while True:
            if len(self.lacing) == MAX_SEGMENTS:
                out += self._close()
                self.flags = CONTINUED if at else 0
            take = min(left, 255)
            self.lacing.append(take)
            self.body += data[at : at + take]
            at, left = at + take, left - take
            if take < 255:  # a last segment of 255 bytes would say that the packet goes on
                self.granule = granule
                return out

    def flush(self, last: bool = False) -> bytes:
        return self._close(last) if self.lacing or last else b""


def write_samples(payload: bytes) -> bytes:
    """A file with two logical streams: the samples, and a note of their number and checksum."""
    serial = zlib.crc32(payload)
    samples, note = StreamWriter(serial), StreamWriter(serial ^ 0xFFFFFFFF)
    parts = [samples.packet(SAMPLE_HEAD.pack(SAMPLE_NAME, RATE, 1, 8), 0), samples.flush()]
    parts += [note.packet(NOTE_NAME, 0), note.flush()]
    for start in range(0, len(payload), PACKET_SAMPLES):
        parts.append(samples.packet(payload[start : start + PACKET_SAMPLES], min(start + PACKET_SAMPLES, len(payload))))
    parts += [note.packet(struct.pack("<QI", len(payload), serial), len(payload)), note.flush(last=True), samples.flush(last=True)]
    return b"".join(parts)


@dataclass
class Packet:
    data: bytes
    granule: int | None  # known for the last packet that ends on a page
    page: int


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    pages: int = 0
    lost_pages: int = 0
    ended: bool = False
    pending: bytearray | None = None
    next_number: int = 0

    def add(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview) -> None:
        if number != self.next_number:
            self.lost_pages += max(0, number - self.next_number)
            self.pending = None
        if not flags & CONTINUED:
            self.pending = None
        skip = bool(flags & CONTINUED) and self.pending is None  # the start of this packet is lost
        part = self.pending if self.pending is not None else bytearray()
        at, done = 0, []
        for size in lacing:
            part += body[at : at + size]
            at += size
            if size < 255:
                if not skip:
                    done.append(Packet(bytes(part), None, number))
                skip, part = False, bytearray()
        if done and granule >= 0:
            done[-1].granule = granule
        self.packets += done
        self.pending = part if lacing and lacing[-1] == 255 and not skip else None
        self.next_number, self.pages, self.ended = number + 1, self.pages + 1, self.ended or bool(flags & LAST)


def read_streams(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial, and how many pages were damaged. After a damaged page the next capture pattern is sought."""
    streams: dict[int, Stream] = {}
    view, at, damaged = memoryview(data), 0, 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            damaged += 1
            break
        _, version, flags, granule, serial, number, checksum, n = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        start = at + HEADER.size + n
        end = start + sum(lacing)
        zeroed = data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]
        if version or len(lacing) < n or end > len(data) or page_checksum(zeroed) != checksum:
            damaged, at = damaged + 1, at + len(CAPTURE)
            continue
        streams.setdefault(serial, Stream(serial)).add(flags, granule, number, lacing, view[start:end])
        at = end
    return streams, damaged


def packet_times(packets: list[Packet], rate: int) -> list[float]:
    """Seconds at which each packet of one-byte samples ends, counted back from the next known granule position."""
    times: list[float] = [0.0] * len(packets)
    known, after = None, 0
    for i in range(len(packets) - 1, -1, -1):
        if packets[i].granule is not None:
            known, after = packets[i].granule, 0
        times[i] = (known - after) / rate if known is not None else float("nan")
        after += len(packets[i].data)
    return times


@dataclass
class Samples:
    payload: bytes
    rate: int
    times: list[float]
    streams: int
    pages: int
    packets: int


def read_samples(data: bytes) -> Samples:
    """The samples of a file, checked against its note; raises ValueError if a page or a packet is missing."""
    streams, damaged = read_streams(data)
    own = next((s for s in streams.values() if s.packets and s.packets[0].data.startswith(SAMPLE_NAME)), None)
    note = next((s for s in streams.values() if s.packets and s.packets[0].data.startswith(NOTE_NAME)), None)
    if damaged or own is None or note is None or any(s.lost_pages or not s.ended for s in (own, note)):
        raise ValueError(f"damaged file: {damaged} pages fail their checksum or a stream is not whole")
    rate = SAMPLE_HEAD.unpack(own.packets[0].data)[1]
    payload = b"".join(p.data for p in own.packets[1:])
    if struct.unpack("<QI", note.packets[1].data) != (len(payload), zlib.crc32(payload)):
        raise ValueError("the samples don't agree with the note")
    return Samples(payload, rate, packet_times(own.packets[1:], rate), len(streams), own.pages + note.pages, len(own.packets) + len(note.packets))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def feature_of(samples: Samples) -> str:
    """What the file and its samples are like: streams, pages, packets, seconds, least and greatest sample, level, sign changes, and the level of each quarter of the time.

    Samples are taken as signed around 128. A packet belongs to the quarter in which it ends by its granule time.
    """
    wave = np.frombuffer(samples.payload, np.uint8).astype(np.int64) - 128
    level = float(np.sqrt((wave * wave).mean()))
    turns = int((np.signbit(wave[1:]) != np.signbit(wave[:-1])).sum())
    ends = np.minimum(np.rint(np.array(samples.times) * samples.rate).astype(np.int64), len(wave))
    quarter = np.minimum(4 * (ends - 1) // max(1, len(wave)), 3)
    starts = np.concatenate([[0], ends[:-1]])
    energy, count = np.zeros(4), np.zeros(4)
    squares = np.concatenate([[0], np.cumsum(wave * wave)])
    np.add.at(energy, quarter, squares[ends] - squares[starts])
    np.add.at(count, quarter, ends - starts)
    levels = "/".join(f"{v:.3f}" for v in np.sqrt(energy / np.maximum(count, 1)))
    head = f"streams={samples.streams};pages={samples.pages};packets={samples.packets};seconds={samples.times[-1]:.4f}"
    return f"{head};low={int(wave.min()) + 128};high={int(wave.max()) + 128};level={level:.4f};turns={turns};levels={levels}"


def media_documents(documents: DataFrame) -> DataFrame:
    """doc_id, media binary: each whole text stored as an Ogg file. A null or empty text is stored as 64 zero samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            media = [write_samples(pad(text.encode())) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return doc_texts(documents).mapInArrow(run, "doc_id long, media binary")


def digest_documents(documents: DataFrame) -> DataFrame:
    """Writes each whole text as a file, reads that file back and describes both, for each row. Equal texts give equal values.

    A null text counts as empty and is stored as 64 zero samples; texts of any length are stored whole, over as many pages as
    they need; repeated rows and null ids are described like any other. Other columns are left out, an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    longs = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes"}

    def describe(text: str) -> tuple:
        raw = text.encode()
        media = write_samples(pad(raw))
        back = read_samples(media)
        return (len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [describe(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64() if n in longs else pa.string()) for i, n in enumerate(names[1:])]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=names)

    return doc_texts(documents).mapInArrow(run, ", ".join(f"{n} {'long' if n in longs or n == 'doc_id' else 'string'}" for n in names))
