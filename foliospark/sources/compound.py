"""Compound files (.msg mail, .doc) as tables: the streams of their root storage, and texts from them."""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.sources.pdf import BROKEN

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_END = 0xFFFFFFFE
#: What reading a damaged file raises.
UNREADABLE = (ValueError, KeyError, IndexError, struct.error)


class Compound:
    """The streams of a compound file's root storage, by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        n_fat, first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<I I I I I I I I", data, 44)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("sector sizes")
        sectors = list(struct.unpack_from("<109I", data, 76))
        per = self.size // 4
        for _ in range(min(n_difat, len(data) // self.size + 1)):
            if first_difat >= _END:
                break
            block = struct.unpack(f"<{per}I", self._sector(first_difat))
            sectors += block[:-1]
            first_difat = block[-1]
        self.fat = [x for s in sectors[:n_fat] if s < _END for x in struct.unpack(f"<{per}I", self._sector(s))]
        raw = self._chain(first_dir)
        self.entries = [self._entry(raw[k : k + 128]) for k in range(0, len(raw) - 127, 128)]
        if not self.entries or self.entries[0][1] != 5:
            raise ValueError("no root")
        mini = self._chain(first_mini) if first_mini < _END else b""
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        self.mini = self._chain(self.entries[0][5])[: self.entries[0][6]] if self.entries[0][5] < _END else b""

    def _sector(self, k: int) -> bytes:
        part = self.data[(k + 1) * self.size : (k + 2) * self.size]
        if not part:
            raise ValueError("a sector beyond the end")
        return part.ljust(self.size, b"\0")

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < _END:
            if at in seen or at >= len(self.fat):
                raise ValueError("a chain without end")
            seen.add(at)
            out.append(self._sector(at))
            at = self.fat[at]
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes) -> tuple[str, int, int, int, int, int, int]:
        """(name, kind, left, right, child, first sector, size)."""
        length = struct.unpack_from("<H", raw, 64)[0]
        left, right, child = struct.unpack_from("<III", raw, 68)
        first, size = struct.unpack_from("<IQ", raw, 116)
        return raw[: max(0, min(length, 64) - 2)].decode("utf-16-le", "ignore"), raw[66], left, right, child, first, size

    def children(self, of: int = 0) -> dict[str, int]:
        """The entries of a storage: its names are a tree of left and right neighbours."""
        out: dict[str, int] = {}
        todo, seen = [self.entries[of][4]], set()
        while todo:
            k = todo.pop()
            if k in seen or k >= len(self.entries):
                continue
            seen.add(k)
            name, _, left, right, *_ = self.entries[k]
            out[name] = k
            todo += [left, right]
        return out

    def stream(self, k: int) -> bytes:
        _, _, _, _, _, at, size = self.entries[k]
        size &= 0xFFFFFFFF if self.size == 512 else (1 << 63) - 1
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out, seen = [], set()
        while at < _END and len(out) * self.mini_size < size:
            if at in seen or at >= len(self.mini_fat):
                raise ValueError("a chain without end")
            seen.add(at)
            out.append(self.mini[at * self.mini_size : (at + 1) * self.mini_size])
            at = self.mini_fat[at]
        return b"".join(out)[:size]


# Numbers of mail properties and of their types.
SUBJECT, SENDER, SENDER_ADDRESS, SENT, BODY, HTML = 0x0037, 0x0C1A, 0x0C1F, 0x0039, 0x1000, 0x1013
DELIVERED, CODEPAGE = 0x0E06, 0x3FFD
UNICODE, ANSI, BINARY = 0x001F, 0x001E, 0x0102
_EPOCH = datetime.datetime(1601, 1, 1)


def mail(data: bytes) -> dict[str, str | None]:
    """subject, sender, sent, body of a .msg file; a body in HTML only is given as its text."""
    whole = Compound(data)
    names = whole.children()
    fixed: dict[int, bytes] = {}
    if "__properties_version1.0" in names:
        raw = whole.stream(names["__properties_version1.0"])
        for k in range(32, len(raw) - 15, 16):
            fixed[struct.unpack_from("<H", raw, k + 2)[0]] = raw[k + 8 : k + 16]
    page = struct.unpack_from("<I", fixed[CODEPAGE])[0] if CODEPAGE in fixed else 1252

    def plain(raw: bytes) -> str:
        try:
            return raw.decode({65001: "utf-8", 20127: "ascii", 28591: "latin-1"}.get(page, f"cp{page}"), "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")

    def read(number: int) -> str | None:
        for kind in (UNICODE, ANSI, BINARY):
            k = names.get(f"__substg1.0_{number:04X}{kind:04X}")
            if k is not None:
                raw = whole.stream(k)
                return (raw.decode("utf-16-le", "replace") if kind == UNICODE else plain(raw)).rstrip("\0")
        return None

    sent = fixed.get(SENT) or fixed.get(DELIVERED)
    ticks = struct.unpack("<Q", sent)[0] if sent else 0
    body = read(BODY)
    if not body and (page_text := read(HTML)):
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1\s*>|<[^>]+>", " ", page_text).strip()
    name, address = read(SENDER), read(SENDER_ADDRESS)
    sender = f"{name} <{address}>" if name and address and address != name else name or address
    when = (_EPOCH + datetime.timedelta(microseconds=ticks // 10)).isoformat(" ", "seconds") if 0 < ticks < 2 * 10**18 else None
    return {"subject": read(SUBJECT), "sender": sender, "sent": when, "body": body}


def word_text(data: bytes) -> str:
    """The text of a .doc file by its table of pieces; field codes and marks of objects are left out."""
    whole = Compound(data)
    names = whole.children()
    main = whole.stream(names["WordDocument"])
    if struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ValueError("no Word document")
    flags = struct.unpack_from("<H", main, 10)[0]
    if flags & 0x0100:
        raise ValueError("encrypted")
    table = whole.stream(names["1Table" if flags & 0x0200 else "0Table"])
    at, size = struct.unpack_from("<II", main, 0x01A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k >= len(clx) or clx[k] != 2:
        raise ValueError("no table of pieces")
    plc = clx[k + 5 : k + 5 + struct.unpack_from("<I", clx, k + 1)[0]]
    n = (len(plc) - 4) // 12
    ends, out = struct.unpack_from(f"<{n + 1}I", plc), []
    for i in range(n):
        place = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * i + 2)[0]
        chars = ends[i + 1] - ends[i]
        if place & 0x40000000:
            start = (place & 0x3FFFFFFF) // 2
            out.append(main[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * chars].decode("utf-16-le", "replace"))
    text = re.sub("\x13[^\x14\x15]*\x14?|\x15", "", "".join(out))
    return re.sub("[\x00-\x08\x0e-\x1f]", "", text.replace("\r", "\n").replace("\x07", "\t").replace("\x0b", "\n").replace("\x0c", "\n"))


def mail_text(found: dict[str, str | None]) -> str:
    """One text of a mail: its heading lines as far as they are known, a blank line, the body."""
    head = [f"{label}: {found[c]}" for label, c in (("Objet", "subject"), ("De", "sender"), ("Date", "sent")) if found[c]]
    return "\n".join([*head, *([f"\n{found['body']}"] if found["body"] else [])])


def mails(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, subject, sender, sent, body, reason of .msg files; all null with ``ILLISIBLE`` where a file is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict[str, str | None]] = []
            for raw in batch.column(1):
                try:
                    rows.append(mail(raw.as_py() or b"") | {"reason": None})
                except UNREADABLE:
                    rows.append({"reason": BROKEN})
            names = ("subject", "sender", "sent", "body", "reason")
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(c) for r in rows], pa.string()) for c in names]], names=[key, *names])

    kind = dict(files.dtypes)[key]
    return files.select(key, content).mapInArrow(run, f"{key} {kind}, subject string, sender string, sent string, body string, reason string")
