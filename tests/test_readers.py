"""PDF, mail and Word readers: round trips, what real files hold, damaged files, a folder of files."""

import base64
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.sources import compound, files, pdf, written


def one(content, resources=b"<< /Font << /F1 3 0 R >> >>", objects=b"", head=b""):
    """A file of one page without a table of places."""
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [4 0 R] >> endobj 3 0 obj << /Type /Font /Subtype /Type1 >> endobj 4 0 obj << /Type /Page /Resources " + resources + (
        b" /Contents 5 0 R >> endobj 5 0 obj << /Length %d %s >>\nstream\n" % (len(content), head)) + content + b"\nendstream endobj\n" + objects + b"\ntrailer << /Root 1 0 R >>"


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=300), st.sampled_from(written.FORMS))
def test_pdf_round_trip(text, form):
    pages = [text[k : k + written.PAGE] for k in range(0, len(text), written.PAGE)] or [""]
    want = [(n, "\n".join(p[k : k + written.LINE] for k in range(0, len(p), written.LINE)), None) for n, p in enumerate(pages, 1)]
    assert pdf.page_texts(written.pdf_bytes(text, form)) == want


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cc")), max_size=200), st.text(st.characters(exclude_categories=("Cs", "Cc")), max_size=20), st.integers(1, 40))
def test_mail_round_trip(body, name, times):
    found = compound.mail(written.mail_bytes(name, name, body * times, 133_000_000_000_000_000))
    assert (found["subject"], found["body"], found["sender"], found["sent"]) == (name, body * times, name or None, "2022-06-18 04:26:40")


def lzw(raw):
    """Codes of nine bits with a clearing code before the table outgrows them."""
    codes = []
    for k in range(0, len(raw), 200):
        codes += [256, *raw[k : k + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_pdf_filters():
    shown = b"BT /F1 12 Tf 10 700 Td (Filtered text) Tj ET"
    cases = {
        b"/Filter /FlateDecode": zlib.compress(shown), b"/Filter [/ASCII85Decode /FlateDecode]": base64.a85encode(zlib.compress(shown)) + b"~>", b"/Filter /ASCIIHexDecode": shown.hex().encode() + b">",
        b"/Filter /LZWDecode": lzw(shown), b"/Filter /RunLengthDecode": bytes([len(shown) - 1]) + shown + b"\x80",
        b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 4 >>": zlib.compress(b"".join(b"\0" + shown[k : k + 4].ljust(4) for k in range(0, len(shown), 4))),
    }
    for head, raw in cases.items():
        assert pdf.page_texts(one(raw, head=head)) == [(1, "Filtered text", None)], head
    assert pdf.page_texts(one(shown, head=b"/Filter /JPXDecode")) == [(1, None, pdf.PAGE_BROKEN)]
    for kind, row in ((1, b"\1\1\1\1"), (3, b"\1\2\2\2"), (4, b"\1\1\1\1")):
        assert pdf._predicted(bytes([kind]) + row, {"Predictor": 10 + kind, "Columns": 4})[:1] == b"\1"


def test_pdf_text_operators():
    read = lambda content, **more: pdf.page_texts(one(content, **more))[0][1]
    assert read(b"BT /F1 10 Tf 12 TL 0 700 Td [(Ker) -20 (ned) -300 (words)] TJ T* (two \\(2\\) \\101\\\nB) Tj (three) ' 1 2 (four) \" ET") == "Kerned words\ntwo (2) AB\nthree\nfour"
    assert read(b"BT /F1 10 Tf 1 0 0 1 10 700 Tm (left) Tj 1 0 0 1 300 700 Tm (right) Tj 1 0 0 1 10 680 Tm (below) Tj ET") == "left right\nbelow"
    assert read(b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 0 100 Td <41 42 4> Tj ET Q % comment (no)\nBI /W 1 /H 1 ID \x00(Tj) EI BT /F1 9 Tf 0 50 Td (after) Tj ET") == "AB@\nafter"
    fonts = b"<< /Font << /F1 << /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /uni20AC /fi /nothing 97 /Ccedilla] >> >> >> /XObject << /X 9 0 R >> >>"
    form = b"9 0 obj << /Subtype /Form /Length 41 >>\nstream\nBT /F1 10 Tf 0 10 Td (a in a form) Tj ET  \nendstream endobj"
    assert read(b"BT /F1 10 Tf 0 700 Td (ABCDE\x92) Tj ET /X Do", resources=fonts, objects=form) == "é€fiE’\nÇ in Ç form"
    widths = b"<< /Font << /F1 << /Subtype /Type1 /FirstChar 65 /Widths [500 500 500] >> >> >>"
    assert read(b"BT /F1 10 Tf 0 700 Td (AB) Tj 10 0 Td (C) Tj 20 0 Td (A) Tj ET", resources=widths) == "ABC A"
    ranges = b"9 0 obj << /Length 150 >>\nstream\n1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <41> <43> <0061> <50> <51> [<00660066> <D83DDE00>] endbfrange                    \nendstream endobj"
    assert read(b"BT /F1 10 Tf 0 700 Td (ABCPQ) Tj ET", resources=b"<< /Font << /F1 << /Subtype /Type1 /ToUnicode 9 0 R >> >> >>", objects=ranges) == "abcff😀"


def test_pdf_files_that_cannot_be_read():
    whole = written.pdf_bytes("A page of text. " * 400, "objects")
    for raw in (b"", b"no PDF", whole[:40], b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 1 0 R /Kids [1 0 R] >> endobj"):
        assert pdf.page_texts(raw) == [(0, None, pdf.BROKEN)]
    assert pdf.page_texts(written.pdf_bytes("x").replace(b"/Root 1 0 R", b"/Encrypt 3 0 R /Root 1 0 R")) == [(0, None, pdf.ENCRYPTED)]
    rng = random.Random(5)
    for _ in range(150):
        raw = bytearray(whole if rng.random() < 0.5 else written.pdf_bytes("Some text (of) a page. " * 200, rng.choice(written.FORMS)))
        for _ in range(rng.randrange(1, 30)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        rows = pdf.page_texts(bytes(raw[: rng.randrange(len(raw))] if rng.random() < 0.3 else raw))
        assert rows and all((text is None) == (reason is not None) for _, text, reason in rows)


def test_mail_kinds_and_damage():
    fixed = bytes(32) + struct.pack("<HHIQ", 3, compound.CODEPAGE, 6, 1252) + struct.pack("<HHIQ", 0x0040, compound.DELIVERED, 6, 0)
    raw = written.compound_bytes({
        "__properties_version1.0": fixed, "__substg1.0_0037001E": "Été".encode("cp1252"), "__substg1.0_0C1A001E": b"Ann", "__substg1.0_0C1F001E": b"ann@x.test",
        "__substg1.0_10130102": b"<html><style>p</style><p>Hello <b>you</b></p></html>",
    })
    assert compound.mail(raw) == {"subject": "Été", "sender": "Ann <ann@x.test>", "sent": None, "body": "Hello  you"}
    assert compound.mail_text(compound.mail(raw)) == "Objet: Été\nDe: Ann <ann@x.test>\n\nHello  you"
    big = written.mail_bytes("s", "x", "é" * 5_000_000)
    assert len(compound.mail(big)["body"]) == 5_000_000  # places of the table beyond the heading's 109
    rng = random.Random(7)
    for _ in range(150):
        part = bytearray(written.mail_bytes("subject", "sender", "body " * rng.randrange(3000)))
        for _ in range(rng.randrange(1, 40)):
            part[rng.randrange(len(part))] = rng.randrange(256)
        try:
            compound.mail(bytes(part[: rng.randrange(len(part))] if rng.random() < 0.3 else part))
        except compound.UNREADABLE:
            pass


def word_bytes(pieces):
    """A .doc file of (text, compressed) pieces."""
    main, plc, ends = bytearray(2048), b"", [0]
    main[0:2], main[10:12] = b"\xec\xa5", struct.pack("<H", 0x0200)
    for text, packed in pieces:
        at = len(main)
        main += text.encode("cp1252" if packed else "utf-16-le")
        main += b"\0" * (len(main) % 2)
        plc += struct.pack("<HIH", 0, 2 * at | 0x40000000 if packed else at, 0)
        ends.append(ends[-1] + len(text))
    plc = struct.pack(f"<{len(ends)}I", *ends) + plc
    clx = b"\1\2\0ab\2" + struct.pack("<I", len(plc)) + plc
    main[0x1A2:0x1AA] = struct.pack("<II", 8, len(clx))
    return written.compound_bytes({"WordDocument": bytes(main), "1Table": bytes(8) + clx})


def test_word_text():
    assert compound.word_text(word_bytes([("Première ligne\rdeux ", True), ("трое\x07", False), ("\x13 HYPERLINK x \x14shown\x15\x01 end\r" * 400, True)])).startswith("Première ligne\ndeux трое\tshown end\nshown end\n")
    with pytest.raises(compound.UNREADABLE):
        compound.word_text(written.mail_bytes("a", "b", "c"))


def test_read_texts_of_a_folder(spark, tmp_path):
    long = "A page has words enough to be native. " * 40
    made = {
        "a/native.pdf": written.pdf_bytes(long, "packed"), "scan.PDF": written.pdf_bytes("few words"), "blank.pdf": written.pdf_bytes(""), "broken.pdf": b"nothing", "m.msg": written.mail_bytes("S", "me", "Body"), "bad.msg": b"x",
        "w.doc": word_bytes([("Word text\r", True)]), "t.txt": "été".encode("latin-1"), "blank.txt": b"  ", "old.xls": b"x", "secret.pdf": written.pdf_bytes("x").replace(b"/Root 1 0 R", b"/Encrypt 3 0 R /Root 1 0 R"),
    }
    for name, raw in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.split(str(tmp_path))[1][1:]: (r.text, r.n_pages, r.reason) for r in files.read_texts(spark, str(tmp_path)).collect()}
    native = "\n".join(long[k : k + 80] for k in range(0, len(long), 80))
    assert got == {
        "a/native.pdf": (native, 1, None), "scan.PDF": (None, 1, "SCAN"), "blank.pdf": (None, 1, "VIDE"), "broken.pdf": (None, 0, "ILLISIBLE"), "m.msg": ("Objet: S\nDe: me\n\nBody", None, None), "bad.msg": (None, None, "ILLISIBLE"),
        "w.doc": ("Word text\n", None, None), "t.txt": ("été", None, None), "blank.txt": (None, None, "VIDE"), "old.xls": (None, None, "NO_READER"), "secret.pdf": (None, 0, "CHIFFRE"),
    }
    ocr = spark.createDataFrame([(f"file:{tmp_path}/scan.PDF", "read by OCR")], "path string, text string")
    again = {r.path: (r.text, r.reason) for r in files.read_texts(spark, str(tmp_path), ocr).where(F.col("path").endswith("scan.PDF")).collect()}
    assert list(again.values()) == [("read by OCR", None)]
