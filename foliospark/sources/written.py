"""Texts written as PDF and mail files: exports of an archive, and what the readers are tried on."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.sources.compound import BODY, MAGIC, SENDER, SENT, SUBJECT, UNICODE

#: Characters of a line and of a page.
LINE, PAGE = 80, 2400
FORMS = ("plain", "packed", "objects", "updated", "damaged")


def _literal(line: str) -> bytes:
    raw = line.encode("cp1252")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"


def _map(codes: dict[str, int]) -> bytes:
    """A character map from two-byte codes to text."""
    rows = [f"<{k:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, k in codes.items()]
    parts = ["/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    for k in range(0, len(rows), 100):
        parts += [f"{len(rows[k : k + 100])} beginbfchar", *rows[k : k + 100], "endbfchar"]
    return "\n".join([*parts, "endcmap end"]).encode()


def pdf_bytes(text: str, form: str = "plain") -> bytes:
    """A PDF file of a text in lines of LINE and pages of PAGE characters.

    ``plain``: literal strings in the Western encoding where that holds the text, a table of places;
    ``packed``: codes with a character map, compressed; ``objects``: object streams and a stream of places with
    row filters; ``updated``: a first state whose last page is replaced by an update; ``damaged``: the
    table's place is wrong.
    """
    pages = [text[k : k + PAGE] for k in range(0, len(text), PAGE)] or [""]
    codes: dict[str, int] = {}
    for c in text:
        codes.setdefault(c, len(codes) + 1)
    try:
        simple = form in ("plain", "damaged") and text.encode("cp1252") is not None
    except UnicodeEncodeError:
        simple = False

    def stream(head: str, raw: bytes, packed: bool) -> bytes:
        raw = zlib.compress(raw) if packed else raw
        return f"<< {head} /Length {len(raw)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + raw + b"\nendstream"

    def content(page: str) -> bytes:
        lines = [page[k : k + LINE] for k in range(0, len(page), LINE)]
        shown = [_literal(x) if simple else b"<" + "".join(f"{codes[c]:04X}" for c in x).encode() + b">" for x in lines]
        return stream("", b"BT /F1 10 Tf 12 TL 40 800 Td " + b" Tj T*\n".join(shown) + (b" Tj" if shown else b"") + b" ET", not simple)

    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = [10 + 2 * k for k in range(len(pages))]
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    if simple:
        objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    else:
        objects[3] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
        objects[4] = b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 500 >>"
        objects[5] = stream("", _map(codes), True)
    for k, page in zip(kids, pages, strict=True):
        objects[k] = f"<< /Type /Page /Parent 2 0 R /Contents {k + 1} 0 R >>".encode()
        objects[k + 1] = content(page)
    last = objects[kids[-1] + 1]
    if form == "updated":
        objects[kids[-1] + 1] = content(text[:20])

    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    places: dict[int, int] = {}

    def put(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(f"{number} 0 obj\n".encode() + body + b"\nendobj\n")

    def table(trailer: str) -> None:
        at = len(out)
        out.extend(b"xref\n0 1\n0000000000 65535 f \n")
        for number, place in sorted(places.items()):
            out.extend(f"{number} 1\n{place:010d} 00000 n \n".encode())
        out.extend(f"trailer\n<< {trailer} >>\nstartxref\n{at if form != 'damaged' else at + 7}\n%%EOF\n".encode())

    size = max(objects) + 1
    if form != "objects":
        for number, body in objects.items():
            put(number, body)
        table(f"/Size {size} /Root 1 0 R")
        if form == "updated":
            first = out.rfind(b"xref\n0 1")
            places.clear()
            put(kids[-1] + 1, last)
            table(f"/Size {size} /Root 1 0 R /Prev {first}")
        return bytes(out)

    inner = [n for n, body in objects.items() if not body.endswith(b"endstream")]
    heads, bodies = [], b""
    for n in inner:
        heads.append(f"{n} {len(bodies)}")
        bodies += objects[n] + b"\n"
    head = " ".join(heads).encode() + b"\n"
    for n, body in objects.items():
        if n not in inner:
            put(n, body)
    put(size, stream(f"/Type /ObjStm /N {len(inner)} /First {len(head)}", head + bodies, True))
    rows = b""
    for n in range(size + 2):
        kind, a, b = (2, size, inner.index(n)) if n in inner else (1, places[n], 0) if n in places else (1, len(out), 0) if n == size + 1 else (0, 0, 0)
        rows += struct.pack(">BIH", kind, a, b)
    filtered, above = b"", bytes(7)
    for k in range(0, len(rows), 7):
        row = rows[k : k + 7]
        filtered += b"\2" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    at = len(out)
    put(size + 1, stream(f"/Type /XRef /Size {size + 2} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>", filtered, True))
    out.extend(f"startxref\n{at}\n%%EOF\n".encode())
    return bytes(out)


def compound_bytes(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams: small ones in the stream of small sectors, others in sectors of their own."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def chain(raw: bytes) -> int:
        """Puts raw into new sectors and returns the first; without bytes, the end mark."""
        n = -(-len(raw) // 512)
        first = len(sectors)
        for k in range(n):
            sectors.append(raw[512 * k : 512 * k + 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return first if n else 0xFFFFFFFE

    mini, mini_fat, places = b"", [], {}
    for name, raw in streams.items():
        if len(raw) >= 4096:
            places[name] = chain(raw)
        else:
            n = -(-len(raw) // 64)
            places[name] = len(mini_fat) if n else 0xFFFFFFFE
            mini_fat += [len(mini_fat) + k + 1 if k + 1 < n else 0xFFFFFFFE for k in range(n)]
            mini += raw.ljust(64 * n, b"\0")
    mini_first = chain(mini)

    def entry(name: str, kind: int, right: int, child: int, first: int, size: int) -> bytes:
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<IQ", first, size)

    names = list(streams)
    directory = entry("Root Entry", 5, 0xFFFFFFFF, 1 if names else 0xFFFFFFFF, mini_first, len(mini))
    for k, name in enumerate(names):
        directory += entry(name, 2, k + 2 if k + 1 < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, places[name], len(streams[name]))
    first_dir = chain(directory)
    first_mini_fat = chain(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) // 128) * 512, b"\xff"))
    n_mini = -(-len(mini_fat) // 128)
    # the table of sectors holds itself, and what lists it beyond the heading's 109 places
    used, n_fat, n_difat = len(sectors), 0, 0
    while n_fat * 128 < used + n_fat + n_difat or n_difat * 127 < n_fat - 109:
        n_fat = -(-(used + n_fat + n_difat) // 128)
        n_difat = max(0, -(-(n_fat - 109) // 127))
    where = list(range(used, used + n_fat))
    more = list(range(used + n_fat, used + n_fat + n_difat))
    fat += [0xFFFFFFFD] * n_fat + [0xFFFFFFFC] * n_difat
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(512 * n_fat, b"\xff")
    listed = b"".join(struct.pack("<127I", *(where[109 + 127 * k : 236 + 127 * k] + [0xFFFFFFFF] * 127)[:127]) + struct.pack("<I", more[k + 1] if k + 1 < n_difat else 0xFFFFFFFE) for k in range(n_difat))
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, n_fat, first_dir, 0, 4096, first_mini_fat if n_mini else 0xFFFFFFFE, n_mini, more[0] if more else 0xFFFFFFFE, n_difat)
    head += struct.pack("<109I", *(where + [0xFFFFFFFF] * 109)[:109])
    return head + b"".join(sectors) + raw + listed


def mail_bytes(subject: str, sender: str, body: str, ticks: int = 0) -> bytes:
    """A .msg file; ``ticks``: time sent in tenths of microseconds since 1601."""
    name = lambda number: f"__substg1.0_{number:04X}{UNICODE:04X}"
    fixed = bytes(32) + (struct.pack("<HHIQ", 0x0040, SENT, 6, ticks) if ticks else b"")
    return compound_bytes({"__properties_version1.0": fixed, name(SUBJECT): subject.encode("utf-16-le"), name(SENDER): sender.encode("utf-16-le"), name(BODY): body.encode("utf-16-le")})


def as_pdf(docs: DataFrame, key: str, text: str, form: str = "form") -> DataFrame:
    """key, content: each text as a PDF file of the kind that the column ``form`` names; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                files = [pdf_bytes(t.as_py() or "", f.as_py()) for t, f in zip(part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], names=[key, "content"])

    return docs.select(key, text, form).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, content binary")


def as_mail(docs: DataFrame, key: str, columns: Sequence[str] = ("subject", "sender", "body", "ticks")) -> DataFrame:
    """key, content: each row as a .msg file; nulls are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                files = [mail_bytes(s or "", f or "", b or "", t or 0) for s, f, b, t in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], names=[key, "content"])

    return docs.select(key, *columns).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, content binary")
