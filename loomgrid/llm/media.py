"""MPEG audio columns: build, resynchronise, verify and measure MPEG-1/2/2.5 audio streams.

``read_stream`` skips ID3v2 and ID3v1 tags, finds frame headers again after damage, parses Xing/Info and VBRI tables,
verifies CRC-16 where the protected range has a fixed length (Layers I and III), and returns the exact duration as a
number of samples and a rate, with the byte offset of every frame. ``write_stream`` stores any bytes losslessly as
the main data of Layer III frames, so that they survive as a media column.

Cases: null media gives null features; empty media has no frames and a duration of zero; bytes without any frame are
counted as junk; a frame cut off at the end is not counted. A null text is stored as an empty payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.common import table

# Fixed values of the MPEG audio standard: kbit/s by (MPEG-1?, layer), sampling rates by version.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
CRC_POLY = 0x8005


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ CRC_POLY if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for x in data:
        c = (c << 8 ^ _CRC[c >> 8 ^ x]) & 0xFFFF
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    mode: int
    mode_ext: int
    length: int
    samples: int

    @property
    def kind(self) -> tuple[int, int, int]:
        """What stays the same in a stream."""
        return self.version, self.layer, self.rate

    @property
    def side_info(self) -> int:
        return (17 if self.mode == 3 else 32) if self.version == 3 else (9 if self.mode == 3 else 17)

    @property
    def protected(self) -> int | None:
        """Bytes after the CRC that it covers, if their number is fixed."""
        if self.layer == 3:
            return self.side_info
        if self.layer == 1:
            bound = 4 * (self.mode_ext + 1) if self.mode == 1 else 32
            return (4 * ((1 if self.mode == 3 else 2) * bound + 32 - bound if self.mode != 3 else 32)) // 8
        return None


@lru_cache(8192)
def parse_header(b: bytes) -> Header | None:
    """A frame header of four bytes; None if it is none, or of free format."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3)
    if version == 1 or layer == 4 or b[2] >> 4 in (0, 15) or b[2] >> 2 & 3 == 3 or b[3] & 3 == 2:
        return None
    kbps = BITRATES[version == 3, layer][b[2] >> 4]
    rate, pad = RATES[version][b[2] >> 2 & 3], b[2] >> 1 & 1
    if layer == 1:
        length, samples = (12_000 * kbps // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * 1000 * kbps // rate + pad
    return Header(version, layer, not b[1] & 1, kbps, rate, b[3] >> 6, b[3] >> 4 & 3, length, samples)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _safe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def read_id3(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2.3/2.4 tag (TXXX by description) and the tag's length."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    major, flags, end = data[3], data[5], 10 + _syncsafe(data[6:10])
    tags, at = {}, 10
    if flags & 0x40 and major >= 3 and at + 4 <= end:
        at += _syncsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    while at + 10 <= min(end, len(data)) and data[at] and major >= 3:
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            enc = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(enc, "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text
        at += 10 + size
    return tags, end + (10 if flags & 0x10 else 0)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    rate: int = 0
    layer: int = 0
    frames: int = 0
    samples: int = 0
    junk: int = 0
    resyncs: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    table: str = "none"  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes | None = None
    bitrates: set = field(default_factory=set)
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)


def _read_table(frame: bytes, h: Header, s: Stream) -> bool:
    """A Xing/Info or VBRI table in the first frame."""
    at = 4 + (2 if h.crc else 0) + h.side_info
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        at = 4 + h.side_info  # some writers leave the CRC out of the count
    mark = frame[at : at + 4]
    if mark in (b"Xing", b"Info"):
        s.table, flags, at = mark.decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            s.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 2:
            s.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            s.toc = frame[at : at + 100]
        return True
    if frame[36:40] == b"VBRI":
        s.table, s.table_bytes, s.table_frames = "VBRI", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        return True
    return False


def _leads_on(data: bytes, at: int, h: Header) -> bool:
    nxt = parse_header(data[at + h.length : at + h.length + 4])
    return nxt is not None and nxt.kind == h.kind


def _better_inside(data: bytes, at: int, h: Header, end: int) -> bool:
    """Whether a frame of the same kind that leads on to another starts inside this one."""
    i = data.find(b"\xff", at + 1, at + h.length)
    while i >= 0:
        x = parse_header(data[i : i + 4])
        if x is not None and x.kind == h.kind and i + x.length + 4 <= end and _leads_on(data, i, x):
            return True
        i = data.find(b"\xff", i + 1, at + h.length)
    return False


def read_stream(data: bytes, bodies: bool = False) -> Stream:
    s = Stream()
    s.tags, at = read_id3(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    kind, lost = None, False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        ok = h is not None and at + h.length <= end and (kind is None or h.kind == kind)
        if ok and at + h.length + 4 <= end and not _leads_on(data, at, h):
            # a sync found by searching must lead to another; a frame in its place is given up if a better one starts inside it
            ok = kind is not None and not lost and not _better_inside(data, at, h, end)
        if not ok:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            s.junk += step - at
            at, lost = step, True
            continue
        s.resyncs += lost and kind is not None
        lost, kind = False, h.kind
        frame = data[at : at + h.length]
        skip = 4
        if h.crc:
            skip = 6
            if (n := h.protected) is not None:
                good = crc16(frame[2:4] + frame[6 : 6 + n]) == int.from_bytes(frame[4:6], "big")
                s.crc_ok, s.crc_bad = s.crc_ok + good, s.crc_bad + (not good)
        if not s.frames and s.table == "none" and h.layer == 3 and _read_table(frame, h, s):
            at += h.length
            continue
        s.rate, s.layer = h.rate, h.layer
        s.frames, s.samples = s.frames + 1, s.samples + h.samples
        s.bitrates.add(h.kbps)
        s.offsets.append(at)
        if bodies:
            s.bodies.append(frame[skip + (h.side_info if h.layer == 3 else 0) :])
        at += h.length
    s.junk += max(0, end - at)
    return s


def seek(s: Stream, sample: int) -> int | None:
    """Byte offset of the frame that holds a sample."""
    if not s.offsets or not 0 <= sample < s.samples:
        return None
    return s.offsets[sample * s.frames // s.samples]


_INDEX = [(i, 3 * BITRATES[True, 3][i]) for i in range(1, 15)]  # 48 kHz: a frame has three bytes per kbit/s
_OVERHEAD = 4 + 2 + 17


@lru_cache(32)
def _frame_head(index: int) -> bytes:
    """Header, CRC and empty side info of a protected mono Layer III frame at 48 kHz."""
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + crc16(head[2:4] + bytes(17)).to_bytes(2, "big") + bytes(17)


def write_stream(payload: bytes, tags: dict[str, str]) -> bytes:
    """ID3v2.4 tag, a Xing frame, and frames that carry the payload."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index, length = next(((i, n) for i, n in _INDEX if n - _OVERHEAD >= left), _INDEX[-1])
        body = payload[at : at + length - _OVERHEAD]
        frames.append(_frame_head(index) + body.ljust(length - _OVERHEAD, b"\0"))
        at += len(body)
    text = b"".join(b"TXXX" + _safe(len(b)) + b"\0\0" + b for b in (b"\x03" + k.encode() + b"\0" + v.encode() for k, v in tags.items()))
    audio = b"".join(frames)
    xing_length = dict(_INDEX)[5]  # 64 kbit/s, 192 bytes: room for the table
    total, ends, size = xing_length + len(audio), [], xing_length
    for f in frames:
        ends.append(size)
        size += len(f)
    toc = bytes(min(255, ends[i * len(ends) // 100] * 256 // total) if ends else 0 for i in range(100))
    table_ = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return b"ID3\x04\0\0" + _safe(len(text)) + text + (_frame_head(5) + table_).ljust(xing_length, b"\0") + audio


def store_text(text: bytes | None) -> bytes:
    """A text as a media value: its bytes, filled with zeros to a positive multiple of 64."""
    text = text or b""
    size = max(64, -(-len(text) // 64) * 64)
    return write_stream(text.ljust(size, b"\0"), {"n_bytes": str(len(text)), "payload_bytes": str(size)})


def store(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``media``, the stored form of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 1).cast(pa.binary())
            media = pa.array((store_text(raw[i].as_py()) for i in range(len(raw))), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], media], names)

    rows = df.select(*keep, F.col(text_col).cast("string").alias("media"))
    names = rows.columns
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", media binary")


FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "duration_samples long, sample_rate int, frame_offsets array<long>"
)


def features(media: bytes) -> tuple:
    """What is read back from one stored value."""
    s = read_stream(media, bodies=True)
    size = int(s.tags.get("payload_bytes", -1))
    payload = b"".join(s.bodies)
    payload = payload[:size] if size >= 0 else payload
    intact = s.table_frames in (None, s.frames) and not s.crc_bad and not s.junk
    feature = (
        f"layer={s.layer};rate={s.rate};frames={s.frames};samples={s.samples};table={s.table};kbps={min(s.bitrates, default=0)}-{max(s.bitrates, default=0)};"
        f"crc_ok={s.crc_ok};crc_bad={s.crc_bad};junk={s.junk};resyncs={s.resyncs};intact={int(intact)}"
    )
    return (
        int(s.tags.get("n_bytes", len(payload))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, s.samples, s.rate, s.offsets,
    )


def measure(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus FEATURES, read from the stored ``media`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column(b.num_columns - 1)
            rows = [(None,) * 10 if (m := media[i].as_py()) is None else features(m) for i in range(len(media))]
            cols = list(zip(*rows)) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types))], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    rows = df.select(*keep, "media")
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    names = [*rows.columns[:-1], *(x.split()[0] for x in FEATURES.split(", "))]
    return rows.mapInArrow(run, head + FEATURES)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(store(table(spark, sf_dir, "documents"), "text", ["doc_id"]), ["doc_id"])
