"""Ogg media columns: write, verify, reassemble, demultiplex and time logical streams.

``pages`` walks the capture patterns, verifies each page's checksum (a damaged page is skipped and the
next capture pattern sought).  ``demultiplex`` groups the pages by serial number, puts packets together
from lacing values across pages (a packet with a missing page is dropped and counted), and turns the
granule positions into times with the sample rate of the stream's first packet.

Defined results: null or empty media has no streams; bytes without a valid page have none either and
count as damaged; repeated rows are read row by row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlake.llm.common import raw, slices

# The page header of the container format (RFC 3533) and its polynomial's bit order.
CAPTURE, HEADER, CONTINUED, FIRST, LAST = b"OggS", struct.Struct("<4sBBqIIIB"), 1, 2, 4
NO_GRANULE = -1
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

# The two stream kinds written here.
PCM_HEAD, NOTE_HEAD, RATE = struct.Struct("<8sIHHQ"), b"noteline", 8000
PCM_MAGIC = b"pcm8mono"
PACKET, PAGE_PACKETS = 4096, 8

STREAM_ROWS = "doc_id long, serial long, codec string, n_pages long, n_packets long, n_lost long, n_damaged long, closed boolean, seconds double, packet_ends array<double>, payload binary"
STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, damaged_pages long"


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, zero start and end: zlib's on reversed bits."""
    out = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{out:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEADER.pack(CAPTURE, 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def paginate(serial: int, packets: list[tuple[bytes, int]], per_page: int = PAGE_PACKETS) -> list[bytes]:
    """Pages of one logical stream from (packet, granule at its end); the first packet has a page of its own."""
    pages: list[bytes] = []
    lacing, body, granule, ended, carried = bytearray(), bytearray(), NO_GRANULE, 0, False

    def flush(last: bool) -> None:
        nonlocal granule, ended, carried
        kind = (CONTINUED if carried else 0) | (FIRST if not pages else 0) | (LAST if last else 0)
        pages.append(_page(kind, granule, serial, len(pages), bytes(lacing), bytes(body)))
        carried = bool(lacing) and lacing[-1] == 255
        lacing.clear()
        body.clear()
        granule, ended = NO_GRANULE, 0

    for at, (packet, end) in enumerate(packets):
        laces = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while done < len(laces):
            if len(lacing) == 255:
                flush(False)
            take = laces[done : done + 255 - len(lacing)]
            lacing += take
            body += packet[done * 255 : (done + len(take)) * 255]
            done += len(take)
        granule, ended = end, ended + 1
        if at == 0 or ended == per_page or at + 1 == len(packets):
            flush(at + 1 == len(packets))
    return pages


def store(payload: bytes, rate: int = RATE) -> bytes:
    """One physical stream: the payload as 8-bit mono samples, interleaved with a note stream that holds its digest."""
    serial = zlib.crc32(payload)
    packets = [(PCM_HEAD.pack(PCM_MAGIC, rate, 1, 8, len(payload)), 0)]
    packets += [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    note = [(NOTE_HEAD, 0), (hashlib.sha256(payload).digest(), len(payload))]
    sound, notes = paginate(serial, packets), paginate(serial ^ 0xFFFFFFFF, note)
    return b"".join([sound[0], notes[0], *sound[1:2], notes[1], *sound[2:]])


@dataclass
class Page:
    kind: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def pages(media: bytes) -> Iterator[Page | None]:
    """Pages whose checksum holds; None stands for each stretch that is damaged."""
    at, sound = 0, True
    while at < len(media):
        start = media.find(CAPTURE, at)
        if start != at and sound:
            yield None
            sound = False
        if start < 0:
            return
        page = None
        if start + 27 <= len(media):
            _, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(media, start)
            lacing = media[start + 27 : start + 27 + n]
            end = start + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(media):
                whole = media[start:end]
                if checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc:
                    page = Page(kind, granule, serial, number, lacing, whole[27 + n :])
        if page is None:
            if sound:
                yield None
            at, sound = start + 1, False
        else:
            yield page
            at, sound = end, True


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    n_pages: int = 0
    lost: int = 0
    closed: bool = False
    _next: int = -1
    _open: list[bytes] | None = None

    def add(self, page: Page) -> None:
        """Reassemble: a lacing value below 255 ends a packet; a gap in page numbers loses the open one."""
        gap = self._next >= 0 and page.number != self._next
        self._next, self.n_pages = page.number + 1, self.n_pages + 1
        skip = False
        if self._open is not None and (gap or not page.kind & CONTINUED):
            self.lost, self._open = self.lost + 1, None
        if page.kind & CONTINUED and self._open is None:
            skip, self.lost = True, self.lost + (not gap or self.n_pages == 1)
        at, size, first = 0, 0, len(self.packets)
        for lace in page.lacing:
            size += lace
            if lace < 255:
                piece, at, size = page.body[at : at + size], at + size, 0
                if skip:
                    skip = False
                else:
                    self.packets.append(b"".join([*(self._open or ()), piece]))
                self._open = None
        if size and not skip:
            self._open = [*(self._open or ()), page.body[at : at + size]]
        elif page.lacing and page.lacing[-1] == 255 and not skip and self._open is None:
            self._open = []
        self.ends += [NO_GRANULE] * (len(self.packets) - first)
        if len(self.packets) > first:
            self.ends[-1] = page.granule
        if page.kind & LAST:
            self.closed = True
            self.lost, self._open = self.lost + (self._open is not None), None

    @property
    def codec(self) -> str:
        head = self.packets[0] if self.packets else b""
        return "pcm8" if head[:8] == PCM_MAGIC and len(head) == PCM_HEAD.size else "note" if head == NOTE_HEAD else "unknown"

    def times(self, rate: int = RATE) -> list[float]:
        """Seconds at the end of each packet behind the head; between two known positions, in proportion to the packets' bytes."""
        if self.codec == "pcm8":
            rate = PCM_HEAD.unpack(self.packets[0])[1] or rate
        out: list[float] = []
        done, held = 0, []
        for packet, end in zip(self.packets[1:], self.ends[1:]):
            held.append(len(packet))
            if end != NO_GRANULE:
                total, so_far = sum(held) or 1, 0
                for n in held:
                    so_far += n
                    out.append((done + (end - done) * so_far / total) / rate)
                done, held = end, []
        return out + [done / rate] * len(held)


def demultiplex(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, in order of their first page, and the count of damaged stretches."""
    streams: dict[int, Stream] = {}
    damaged = 0
    for page in pages(media):
        if page is None:
            damaged += 1
        else:
            streams.setdefault(page.serial, Stream(page.serial)).add(page)
    return streams, damaged


def padded(text: bytes, unit: int = 64) -> bytes:
    """The bytes with zeros up to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit or (0 if text else unit))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, bytes of the text and the stored media of its padded bytes; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=4 << 20):
            texts = raw(part.column(1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(padded(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, STORED)


def streams(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per logical stream: its pages, packets, losses, times and payload (the packets behind the head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=4 << 20):
            rows = []
            for doc, media in zip(part.column(0).to_pylist(), raw(part.column(1))):
                found, damaged = demultiplex(media)
                for s in found.values():
                    times = s.times()
                    rows.append((doc, s.serial, s.codec, s.n_pages, len(s.packets), s.lost, damaged, s.closed, times[-1] if times else 0.0, times, b"".join(s.packets[1:])))
            names = [x.split()[0] for x in STREAM_ROWS.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, STREAM_ROWS)


def features(df: DataFrame) -> DataFrame:
    """Per row of ``store_texts``: what its stored bytes hold when read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sha = hashlib.sha256
        for part in slices(batches, column=2, most=4 << 20):
            rows = []
            for n, media in zip(part.column(1).to_pylist(), raw(part.column(2))):
                found, damaged = demultiplex(media)
                sound = next((s for s in found.values() if s.codec == "pcm8"), None)
                note = next((s for s in found.values() if s.codec == "note"), None)
                payload = b"".join(sound.packets[1:]) if sound else b""
                digest, times = sha(payload), sound.times() if sound else []
                seconds = times[-1] if times else 0.0
                level = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))
                agrees = bool(note and note.packets[1:] == [digest.digest()])
                feature = f"streams={len(found)};pages={sum(s.n_pages for s in found.values())};packets={sum(len(s.packets) for s in found.values())};ms={seconds * 1000:.3f};level={level};agrees={int(agrees)}"
                rows.append((n, len(payload), digest.hexdigest(), zlib.crc32(payload[-64:]), len(media), sha(media).hexdigest(), feature, seconds, damaged))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=[x.split()[0] for x in FEATURES.split(", ")])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)
