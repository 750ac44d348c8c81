"""Compact fonts, built here byte by byte."""

import struct

import pytest

from palimpsest.functions import cff
from palimpsest.functions.truetype import FontFault
from palimpsest.sources import fonts, pdf_pages
from palimpsest.sources.pdf_syntax import Name, Stream, read_document
from tests.pdf_samples import DEJAVU, sample


def number(v):
    if -107 <= v <= 107:
        return bytes([v + 139])
    return b"\x1c" + struct.pack(">h", v)


def ops(*parts):
    """Charstring or dictionary bytes: numbers, and operators as bytes."""
    return b"".join(p if isinstance(p, bytes) else number(p) for p in parts)


def index(items):
    if not items:
        return b"\0\0"
    ends, at = [1], 1
    for x in items:
        at += len(x)
        ends.append(at)
    return struct.pack(">HB", len(items), 2) + b"".join(struct.pack(">H", e) for e in ends) + b"".join(items)


def big(v):
    return b"\x1d" + struct.pack(">i", v)


def font(charstrings, charset=(), encoding=None, subrs=(), general=(), strings=(), extra=b"", cid=None):
    """A CFF font; charset lists string ids (or CIDs) of glyphs 1 and up."""
    head = b"\x01\0\x04\x02" + index([b"Made"])
    tail = index([s.encode() for s in strings]) + index(list(general))
    sets = b"\0" + b"".join(struct.pack(">H", i) for i in charset)
    codes = b"" if encoding is None else b"\0" + bytes([len(encoding), *encoding])
    widths = ops(500, b"\x14", 600, b"\x15")
    private = widths + (ops(len(widths) + 2, b"\x13") if subrs else b"")
    selects = b"" if cid is None else b"\x03" + struct.pack(">HHBH", 1, 0, 0, len(charstrings))

    def top(at):
        out = extra + big(at[0]) + b"\x0f" + big(at[2]) + b"\x11"
        if encoding is not None:
            out += big(at[1]) + b"\x10"
        if cid is None:
            return out + big(len(private)) + big(at[3]) + b"\x12"
        return ops(391, 392, 0, b"\x0c\x1e") + out + big(at[4]) + b"\x0c\x24" + big(at[5]) + b"\x0c\x25"

    size = len(head) + len(index([top([0] * 6)])) + len(tail)
    chars = index(list(charstrings))
    places, at, body = [], size, b""
    for part in (sets, codes, chars, private + (index(list(subrs)) if subrs else b"")):
        places.append(at)
        at += len(part)
        body += part
    fonts_part = index([big(len(private)) + big(places[3]) + b"\x12"]) if cid is not None else b""
    places += [at, at + len(fonts_part)]
    return head + index([top(places)]) + tail + body + fonts_part + selects


SQUARE = ops(100, b"\x16", 200, b"\x06", 200, b"\x07", -200, b"\x06", b"\x0e")  # hmoveto, lines, endchar
WIDE = ops(-100, 10, 20, b"\x15", 30, 40, 50, 60, 70, 80, b"\x08", b"\x0e")  # width 500, rmoveto, rrcurveto
NOTDEF = ops(b"\x0e")


def test_outlines_and_widths():
    face = cff.Compact(font([NOTDEF, SQUARE, WIDE], charset=(34, 35)))  # A and B
    assert (face.units, face.glyphs, face.names) == (1000, 3, [".notdef", "A", "B"])
    assert face.glyph_of(ord("A")) == 1 and face.glyph_of(ord("C")) is None and face.codes == {65: 1, 66: 2}
    assert face.outline(1) == (("M", 100, 0), ("L", 300, 0), ("L", 300, 200), ("L", 100, 200), ("Z",))
    assert face.outline(2) == (("M", 10, 20), ("C", 40, 60, 90, 120, 160, 200), ("Z",))
    assert [face.advance(g) for g in range(3)] == [500, 500, 500] and face.outline(7) == ()


@pytest.mark.parametrize(
    ("code", "steps"),
    [
        (ops(5, b"\x04", 1, 2, 3, 4, b"\x1e", b"\x0e"), [("M", 0, 5), ("C", 0, 6, 2, 9, 6, 9)]),  # vhcurveto
        (ops(5, b"\x04", 1, 2, 3, 4, 9, b"\x1f", b"\x0e"), [("M", 0, 5), ("C", 1, 5, 3, 8, 12, 12)]),  # hvcurveto
        (ops(5, b"\x04", 7, 1, 2, 3, 4, b"\x1a", b"\x0e"), [("M", 0, 5), ("C", 7, 6, 9, 9, 9, 13)]),  # vvcurveto
        (ops(5, b"\x04", 7, 1, 2, 3, 4, b"\x1b", b"\x0e"), [("M", 0, 5), ("C", 1, 12, 3, 15, 7, 15)]),  # hhcurveto
        (ops(0, b"\x04", 1, 2, 1, 1, 1, 1, 1, 1, b"\x19", b"\x0e"), [("M", 0, 0), ("L", 1, 2), ("C", 2, 3, 3, 4, 4, 5)]),
        (ops(0, b"\x04", 1, 1, 1, 1, 1, 1, 1, 2, b"\x18", b"\x0e"), [("M", 0, 0), ("C", 1, 1, 2, 2, 3, 3), ("L", 4, 5)]),
        (ops(1, 2, b"\x12", 3, 4, b"\x13\xff", 6, b"\x16", 7, b"\x07", b"\x0e"), [("M", 6, 0), ("L", 6, 7)]),  # stems, mask
        (ops(0, b"\x16", 1, 2, 3, 4, 5, 6, 7, b"\x0c\x22", b"\x0e"), [("M", 0, 0), ("C", 1, 0, 3, 3, 7, 3), ("C", 12, 3, 18, 0, 25, 0)]),
        (ops(6, 2, b"\x0c\x0c", b"\x16", 2, 3, b"\x0c\x18", b"\x07", b"\x0e"), [("M", 3, 0), ("L", 3, 6)]),  # div, mul
    ],
)
def test_operators(code, steps):
    assert cff.Compact(font([NOTDEF, code], charset=(34,))).outline(1) == (*steps, ("Z",))


def test_subroutines_strings_encoding_and_matrix():
    own, general = ops(4, b"\x06", b"\x0b"), ops(-107, b"\x0a", 3, b"\x07", b"\x0b")
    code = ops(1, b"\x16", -107, b"\x1d", b"\x0e")
    matrix = b"\x1e\x0a\x00\x05\xff" + ops(0, 0) + b"\x1e\x5c\x4f" + ops(0, 0, b"\x0c\x07")  # 0.0005 and 5E-4
    face = cff.Compact(font([NOTDEF, code], charset=(391,), encoding=(200,), subrs=[own], general=[general], strings=["g7"], extra=matrix))
    assert face.outline(1) == (("M", 1, 0), ("L", 5, 0), ("L", 5, 3), ("Z",))
    assert face.names == [".notdef", "g7"] and face.codes == {200: 1} and face.units == 2000 and face.advance(1) == 250


def test_accents():
    accent = ops(10, 20, 65, 66, b"\x0e")  # A, and B moved by (10, 20)
    face = cff.Compact(font([NOTDEF, SQUARE, SQUARE, accent], charset=(34, 35, 36)))
    assert face.outline(3)[:5] == face.outline(1) and face.outline(3)[5] == ("M", 110, 20)


def test_fonts_by_cid():
    face = cff.Compact(font([NOTDEF, SQUARE, WIDE], charset=(40, 7), strings=["Adobe", "Identity"], cid=True))
    assert face.by_cid and face.glyph_of_id(40) == 1 and face.glyph_of_id(7) == 2 and face.glyph_of_id(8) == 0
    assert face.advance(2) == 500


@pytest.mark.parametrize("data", [b"", b"\x02\0\x04\x01", b"OTTO\0\0\0\0\0\0\0\0", font([NOTDEF], ())[:30]])
def test_faults(data):
    with pytest.raises((FontFault, struct.error)):
        cff.Compact(data)


def test_endless_charstring_is_a_fault():
    loop = ops(-107, b"\x0a")
    with pytest.raises(FontFault):
        cff.Compact(font([NOTDEF, loop], charset=(34,), subrs=[loop])).outline(1)


def test_pages_with_compact_fonts_become_outlines():
    data = font([NOTDEF, SQUARE, WIDE], charset=(34, 391), strings=["curl"], encoding=(65, 1))
    descriptor = {"Type": Name("FontDescriptor"), "FontFile3": Stream({"Subtype": Name("Type1C")}, data)}
    shown = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("NoSuchFace"), "FontDescriptor": descriptor}
    shown["Encoding"] = {"Type": Name("Encoding"), "Differences": [66, Name("curl")]}
    doc = read_document(sample([b"BT /F1 10 Tf 100 700 Td (AB\x01C) Tj ET"], {"F1": DEJAVU}))
    doc.get(doc.inherited(doc.objects[doc.pages()[0]], "Resources"))["Font"]["F1"] = shown
    found = fonts.page_fonts(doc, doc.objects[doc.pages()[0]])["F1"]
    assert [found.glyph(c) for c in (65, 66, 1, 67)] == [1, 2, 2, None] and found.width(66) == 500
    from palimpsest.functions import compose

    out = compose.text_outlines(doc, pdf_pages.page_content(doc, doc.objects[doc.pages()[0]]), {"F1": found}, {}, "rgb")
    assert b" c\n" in out["content"] and b"Tj" not in out["content"]
