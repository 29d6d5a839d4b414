"""MPEG audio columns: streams are parsed frame by frame, and payloads are stored as streams.

Parsing finds ID3 tags, resynchronises on frame headers (one counts if the next frame or the end of
the audio stands where its length says), reads variable-bitrate tables (Xing, Info, VBRI), verifies
the checksums of Layer III and Layer I frames, and gives the exact duration in samples and the byte
offset of every frame.

Storing writes MPEG-1 Layer III frames of 48 kHz, mono, with checksums. Their side information is
zero, so a player hears silence, and all bytes behind it are ancillary data: the payload. The last
frame takes the smallest bitrate that holds the rest, so a stream has a variable bitrate and begins
with a Xing table; an ID3v2 text frame says how long the payload is.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import text_arrays as ta

# Fixed values of the MPEG audio standards: kbit/s by (MPEG-1?, layer) and index; Hz by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 64
_SIDE = 17
_FRAME, _BODY = 960, 960 - 6 - _SIDE


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFF00) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The header that four bytes hold, if they can be one; free formats are not."""
    if word in _headers:
        return _headers[word]
    found = None
    version, layer, kbit, hz, pad = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if word >> 21 == 0x7FF and version != 1 and layer != 4 and kbit not in (0, 15) and hz != 3 and word & 3 != 2:
        first = version == 3
        bitrate, rate = BITRATES[first, layer][kbit] * 1000, RATES[version][hz]
        samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
        length = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
        found = Header(version, layer, not word >> 16 & 1, bitrate, rate, word >> 6 & 3 == 3, length, samples)
    if len(_headers) > 10_000:
        _headers.clear()
    _headers[word] = found
    return found


@dataclass
class Stream:
    """What a stream holds. offsets, bodies: where each audio frame and its data start; skipped: bytes that belong to nothing."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int | str | list[int]] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    bodies: list[tuple[int, int]] = field(default_factory=list)
    bitrates: dict[int, int] = field(default_factory=dict)
    samples: int = 0
    rate: int = 0
    version: int = 0
    layer: int = 0
    channels: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0

    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0

    def seek(self, sample: int) -> int:
        """The offset of the frame that holds a sample; all frames hold the same number."""
        per = self.samples // len(self.offsets) if self.offsets else 1
        return self.offsets[min(sample // per, len(self.offsets) - 1)] if self.offsets else 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    kinds = ("latin-1", "utf-16", "utf-16-be", "utf-8")
    return b[1:].decode(kinds[b[0]], "replace").rstrip("\0").replace("\0", "=") if b and b[0] < 4 else ""


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag at ``at`` and returns where it ends; at itself if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at
    major, end = data[at + 3], at + 10 + _synchsafe(data[at + 6 : at + 10])
    p = at + 10
    if data[at + 5] & 0x40 and p + 4 <= len(data):
        p += _synchsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    while major in (3, 4) and p + 10 <= min(end, len(data)) and data[p]:
        size = _synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        name = data[p : p + 4].decode("latin-1")
        if name.startswith("T"):
            value = _text(data[p + 10 : p + 10 + size])
            key, sep, rest = value.partition("=")
            tags.update({f"TXXX:{key}": rest} if name == "TXXX" and sep else {name: value})
        p += 10 + size
    return min(len(data), end + (10 if data[at + 5] & 0x10 else 0))


def _vbr_table(data: bytes, at: int, h: Header) -> dict[str, int | str | list[int]]:
    p = at + 4 + 2 * h.protected + h.side
    mark = data[p : p + 4]
    if mark in (b"Xing", b"Info") and p + 8 <= len(data):
        flags, q, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": mark.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[q : q + 4], "big")
                q += 4
        if flags & 4:
            out["toc"] = list(data[q : q + 100])
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= len(data):
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[p + 10 : p + 24])
        toc = [scale * int.from_bytes(data[p + 26 + width * k : p + 26 + width * (k + 1)], "big") for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return {}


_sums: dict[bytes, int] = {}


def parse(data: bytes) -> Stream:
    """All of a stream; bytes that are no MPEG audio give a stream without frames."""
    s, end = Stream(), len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        for k, (a, b) in {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}.items():
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                s.tags[f"ID3v1:{k}"] = value
    p = 0
    while (q := _id3v2(data, p, s.tags)) > p:
        p = q
    synced, kind, first = False, None, True
    while p + 4 <= end:
        h = header(int.from_bytes(data[p : p + 4], "big"))
        good = h is not None and p + h.length <= end and (kind is None or (h.version, h.layer, h.rate) == kind)
        if good and not synced:
            n = p + h.length
            after = header(int.from_bytes(data[n : n + 4], "big")) if n + 4 <= end else None
            good = n == end or (after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate))
        if not good:
            q = data.find(b"\xff", p + 1, end)
            q = end if q < 0 else q
            s.skipped += q - p
            p, synced = q, False
            continue
        synced, kind = True, (h.version, h.layer, h.rate)
        if first:
            first = False
            s.version, s.layer, s.rate, s.channels = h.version, h.layer, h.rate, 1 if h.mono else 2
            if h.layer == 3 and (table := _vbr_table(data, p, h)):
                s.vbr = table
                p += h.length
                continue
        body = p + 4 + 2 * h.protected
        if h.protected and h.layer != 2:
            covered = data[p + 2 : p + 4] + data[body : body + (h.side if h.layer == 3 else 16 * (2 - h.mono))]
            if (c := _sums.get(covered)) is None:
                if len(_sums) > 10_000:
                    _sums.clear()
                c = _sums[covered] = crc16(covered)
            ok = c == int.from_bytes(data[p + 4 : p + 6], "big")
            s.crc_ok, s.crc_bad = s.crc_ok + ok, s.crc_bad + (not ok)
        s.offsets.append(p)
        s.bodies.append((body + (h.side if h.layer == 3 else 0), p + h.length))
        s.bitrates[h.bitrate] = s.bitrates.get(h.bitrate, 0) + 1
        s.samples += h.samples
        p += h.length
    s.skipped += max(0, end - p)
    return s


def _head(index: int) -> bytes:
    return bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])


def _opening(index: int) -> bytes:
    """Header, checksum and empty side information of a frame."""
    h = _head(index)
    return h + crc16(h[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


_OPENINGS = [_opening(k) for k in range(15)]


def pad(text: bytes) -> bytes:
    """Zeros up to a positive multiple of UNIT."""
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(payload: bytes) -> bytes:
    """A stream whose frames carry the payload."""
    whole, rest = divmod(len(payload), _BODY)
    frames = np.zeros((whole, _FRAME), np.uint8)
    frames[:, : 6 + _SIDE] = np.frombuffer(_OPENINGS[14], np.uint8)
    frames[:, 6 + _SIDE :] = np.frombuffer(payload, np.uint8)[: whole * _BODY].reshape(whole, _BODY)
    audio = frames.tobytes()
    if rest:
        k = next(k for k in range(1, 15) if 3 * BITRATES[True, 3][k] - 6 - _SIDE >= rest)
        tail = _OPENINGS[k] + payload[whole * _BODY :]
        audio += tail + bytes(3 * BITRATES[True, 3][k] - len(tail))
    count, k = whole + bool(rest), 5
    total = 3 * BITRATES[True, 3][k] + len(audio)
    toc = bytes(min(255, 256 * (3 * BITRATES[True, 3][k] + min(len(audio), count * i // 100 * _FRAME)) // total) for i in range(100))
    table = _OPENINGS[k] + b"Xing" + struct.pack(">III", 7, count, total) + toc
    table += bytes(3 * BITRATES[True, 3][k] - len(table))
    said = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    tag = b"TXXX" + len(said).to_bytes(4, "big") + b"\x00\x00" + said
    n = len(tag)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + tag + table + audio


def payload_of(data: bytes, s: Stream) -> bytes:
    """What ``store`` was given."""
    return b"".join(data[a:b] for a, b in s.bodies)[: int(s.tags.get("TXXX:payload_bytes", 1 << 62))]


def store_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded, as an MPEG stream; null texts as empty ones.

    Repeated rows give equal rows; extra columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets, _ = ta.column(batch.column(1))
            for a, b in ta.row_slices(offsets):
                raw = [buf[x:y].tobytes() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(len, raw), pa.int64()), pa.array([store(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


PARSED = "channels int, rate int, samples long, seconds double, frames int, crc_ok int, crc_bad int, skipped long, vbr_kind string, vbr_frames long, tags map<string,string>, offsets array<long>"


def parse_media(rows: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and what the streams in column ``media`` hold (PARSED); null media give nulls, other bytes no frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(len(keep)):
                s = parse(x.as_py()) if x.is_valid else None
                out.append((s.channels, s.rate, s.samples, s.seconds(), len(s.offsets), s.crc_ok, s.crc_bad, s.skipped, s.vbr.get("kind"), s.vbr.get("frames"), list(s.tags.items()), s.offsets) if s else (None,) * 12)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], [*keep, *(f"c{k}" for k in range(12))])

    kept = rows.select(*keep, media)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]), PARSED]) if keep else PARSED)


def digests(stored: DataFrame) -> DataFrame:
    """What the stored bytes of ``store_texts`` give when they are read back; see op5 for the columns. A row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                data = x.as_buffer().to_pybytes()
                s = parse(data)
                payload = payload_of(data, s)
                rates = ",".join(f"{r // 1000}x{n}" for r, n in sorted(s.bitrates.items()))
                feature = f"mpeg1-layer{s.layer};{s.rate}Hz;{s.channels}ch;frames={len(s.offsets)};samples={s.samples};kbit={rates};vbr={s.vbr.get('kind')}:{s.vbr.get('frames')};crc={s.crc_ok}/{s.crc_ok + s.crc_bad};skipped={s.skipped};last={s.seek(s.samples - 1)}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.seconds()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds"])

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double")


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole documents table, and the duration in seconds."""
    return digests(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
