"""Compact (CFF) outlines, widths and character maps, in plain Python.

A face is a bare CFF font set or the ``CFF `` table of an OpenType file. It offers
what ``truetype.TrueType`` does: ``units``, ``glyphs``, ``glyph_of`` (by Unicode),
``glyph_of_code`` (by the font's own encoding), ``advance`` and ``outline``, whose
steps are ("M", x, y), ("L", x, y), ("C", x1, y1, x2, y2, x, y) and ("Z",).
"""

from __future__ import annotations

import struct
from functools import lru_cache

from palimpsest.functions.names import GLYPH_NAMES, glyph_name_code_point
from palimpsest.functions.truetype import FontFault, TrueType

#: Standard string ids 96 to 149, the upper half of the standard encoding.
STANDARD_UPPER = (
    "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright "
    "fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis "
    "perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash "
    "AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls"
).split()
#: Codes of those in the standard encoding.
STANDARD_UPPER_CODES = [
    *range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, *range(0xCD, 0xD1),
    0xE1, 0xE3, *range(0xE8, 0xEC), 0xF1, 0xF5, *range(0xF8, 0xFC),
]
#: Standard string ids 150 to 228.
STANDARD_LATIN = (
    "onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior "
    "registered minus eth multiply threesuperior copyright Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex "
    "Edieresis Egrave Iacute Icircumflex Idieresis Igrave Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex "
    "Udieresis Ugrave Yacute Ydieresis Zcaron aacute acircumflex adieresis agrave aring atilde ccedilla eacute ecircumflex edieresis "
    "egrave iacute icircumflex idieresis igrave ntilde oacute ocircumflex odieresis ograve otilde scaron uacute ucircumflex udieresis "
    "ugrave yacute ydieresis zcaron"
).split()
#: Characters of the standard strings 96 to 228, in their order.
STANDARD_POINTS = (
    "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß"
    "¹¬µ™Ð½±Þ¼÷¦°þ¾²®−ð×³©ÁÂÄÀÅÃÇÉÊËÈÍÎÏÌÑÓÔÖÒÕŠÚÛÜÙÝŸŽáâäàåãçéêëèíîïìñóôöòõšúûüùýÿž"
)
_LETTERS_OF = {c: name for name, c in GLYPH_NAMES.items() if name != "minus"}
_ASCII = {
    **_LETTERS_OF, "'": "quoteright", "[": "bracketleft", "\\": "backslash", "]": "bracketright", "^": "asciicircum", "_": "underscore",
    "`": "quoteleft", "{": "braceleft", "|": "bar", "}": "braceright", "~": "asciitilde",
}
#: Names by standard string id; those of expert sets (229 to 390) are left out.
STANDARD_STRINGS = [".notdef", *(_ASCII.get(chr(c), chr(c)) for c in range(0x20, 0x7F)), *STANDARD_UPPER, *STANDARD_LATIN]
CUSTOM_STRINGS = 391
_POINTS = {
    **{name: ord(c) for c, name in _ASCII.items()}, "quoteright": 0x2019, "quoteleft": 0x2018,
    **{name: ord(c) for name, c in zip([*STANDARD_UPPER, *STANDARD_LATIN], STANDARD_POINTS, strict=True)},
}
DEEPEST, MOST_OPERATORS = 10, 200_000


def _index(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The objects of an INDEX and where it ends."""
    (count,) = struct.unpack_from(">H", data, at)
    if not count:
        return [], at + 2
    wide = data[at + 2]
    if not 1 <= wide <= 4:
        raise FontFault("bad index")
    at += 3
    ends = [int.from_bytes(data[at + wide * i : at + wide * (i + 1)], "big") for i in range(count + 1)]
    base = at + wide * (count + 1) - 1
    return [data[base + a : base + b] for a, b in zip(ends, ends[1:], strict=False)], base + ends[-1]


def _real(data: bytes, at: int) -> tuple[float, int]:
    text = ""
    while True:
        for nibble in (data[at] >> 4, data[at] & 15):
            if nibble == 15:
                return float(text or 0), at + 1
            text += "0123456789.EE -"[nibble] + ("-" if nibble == 12 else "")
        at += 1


def _dict(data: bytes) -> dict[int, list[float]]:
    """Operands by operator; two-byte operators are 1200 and up."""
    out: dict[int, list[float]] = {}
    operands: list[float] = []
    at = 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12:
                b = 1200 + data[at]
                at += 1
            out[b] = operands
            operands = []
        elif b == 28:
            operands.append(struct.unpack_from(">h", data, at)[0])
            at += 2
        elif b == 29:
            operands.append(struct.unpack_from(">i", data, at)[0])
            at += 4
        elif b == 30:
            value, at = _real(data, at)
            operands.append(value)
        elif b <= 246:
            operands.append(b - 139)
        else:
            operands.append((b - 247) * 256 + data[at] + 108 if b <= 250 else -(b - 251) * 256 - data[at] - 108)
            at += 1
    return out


class Compact:
    """The first font of a CFF font set."""

    def __init__(self, data: bytes):
        self.sfnt = None
        if data[:4] == b"OTTO":
            tables = {}
            for i in range(struct.unpack_from(">H", data, 4)[0]):
                tag, _, offset, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
                tables[tag] = (offset, size)
            if b"CFF " not in tables:
                raise FontFault("no CFF table")
            if b"cmap" in tables:
                self.sfnt = TrueType.__new__(TrueType)
                self.sfnt.data, self.sfnt.tables = data, {"cmap": tables[b"cmap"]}
                self.sfnt.cmaps = self.sfnt._cmaps()
            offset, size = tables[b"CFF "]
            data = data[offset : offset + size]
        try:
            self._read(data)
        except (IndexError, struct.error, KeyError) as fault:
            raise FontFault(f"bad CFF font: {fault}") from fault

    def _read(self, data: bytes) -> None:
        if len(data) < 4 or data[0] != 1:
            raise FontFault("not a CFF font")
        self.data = data
        _, at = _index(data, data[2])
        tops, at = _index(data, at)
        self.strings, at = _index(data, at)
        self.globals, _ = _index(data, at)
        top = _dict(tops[0])
        if top.get(1206, [2])[-1] != 2:
            raise FontFault("charstrings of another kind")
        self.charstrings, _ = _index(data, int(top[17][-1]))
        self.glyphs = len(self.charstrings)
        self.by_cid = 1230 in top
        matrix = top.get(1207)
        if self.by_cid:
            fonts = [_dict(d) for d in _index(data, int(top[1236][-1]))[0]]
            self.privates = [self._private(f) for f in fonts]
            self.font_of = self._selected(int(top[1237][-1]))
            matrix = matrix or next((f[1207] for f in fonts if 1207 in f), None)
        else:
            self.privates = [self._private(top)]
            self.font_of = [0] * self.glyphs
        self.units = round(1 / matrix[0]) if matrix and matrix[0] else 1000
        ids = self._charset(int(top.get(15, [0])[-1]))
        if self.by_cid:
            self.glyph_of_cid = {cid: g for g, cid in reversed(list(enumerate(ids)))}
            self.names: list[str] = []
        else:
            self.glyph_of_cid = {}
            self.names = [self._string(i) for i in ids]
        self.points: dict[int, int] = {}
        for g, name in reversed(list(enumerate(self.names))):
            point = _POINTS.get(name) or glyph_name_code_point(name)
            if point is not None and g:
                self.points[point] = g
        self.codes = {} if self.by_cid else self._encoding(int(top.get(16, [0])[-1]))

    def _private(self, d: dict) -> tuple[list[bytes], float, float]:
        """(subroutines, default width, nominal width)."""
        if 18 not in d:
            return [], 0.0, 0.0
        size, at = (int(x) for x in d[18])
        own = _dict(self.data[at : at + size])
        subrs = _index(self.data, at + int(own[19][-1]))[0] if 19 in own else []
        return subrs, float(own.get(20, [0])[-1]), float(own.get(21, [0])[-1])

    def _selected(self, at: int) -> list[int]:
        d = self.data
        if d[at] == 0:
            return list(d[at + 1 : at + 1 + self.glyphs])
        out: list[int] = []
        (ranges,) = struct.unpack_from(">H", d, at + 1)
        for i in range(ranges):
            _, font, end = struct.unpack_from(">HBH", d, at + 3 + 3 * i)
            out += [font] * (min(end, self.glyphs) - len(out))
        return out

    def _charset(self, at: int) -> list[int]:
        """String ids (or CIDs) by glyph."""
        if at <= 2:
            return list(range(self.glyphs))
        d, kind, ids = self.data, self.data[at], [0]
        at += 1
        while len(ids) < self.glyphs:
            (first,) = struct.unpack_from(">H", d, at)
            left = 0 if kind == 0 else d[at + 2] if kind == 1 else struct.unpack_from(">H", d, at + 2)[0]
            at += 2 + min(kind, 2)
            ids += range(first, first + left + 1)
        return ids[: self.glyphs]

    def _string(self, i: int) -> str:
        if i < len(STANDARD_STRINGS):
            return STANDARD_STRINGS[i]
        own = i - CUSTOM_STRINGS
        return self.strings[own].decode("latin-1") if 0 <= own < len(self.strings) else ""

    def _encoding(self, at: int) -> dict[int, int]:
        """Glyphs by the font's own codes."""
        by_name = {name: g for g, name in reversed(list(enumerate(self.names)))}
        if at <= 1:
            codes = [*range(0x20, 0x7F), *STANDARD_UPPER_CODES]
            return {c: by_name[n] for c, n in zip(codes, STANDARD_STRINGS[1:], strict=False) if n in by_name}
        d, kind, out = self.data, self.data[at], {}
        count, at = d[at + 1], at + 2
        g = 1
        for _ in range(count):
            left = d[at + 1] if kind & 127 else 0
            for c in range(d[at], d[at] + left + 1):
                out[c] = g
                g += 1
            at += 2 if kind & 127 else 1
        if kind & 128:
            for i in range(d[at]):
                code, name = struct.unpack_from(">BH", d, at + 1 + 3 * i)
                if (found := by_name.get(self._string(name))) is not None:
                    out[code] = found
        return {c: g for c, g in out.items() if g < self.glyphs}

    def glyph_of(self, code_point: int) -> int | None:
        if self.sfnt is not None and (found := self.sfnt.glyph_of(code_point)):
            return found
        return self.points.get(code_point)

    def glyph_of_code(self, code: int) -> int | None:
        return self.codes.get(code)

    def glyph_of_id(self, cid: int) -> int:
        """The glyph of a CID: by the charset of a CID font, else the same number."""
        return self.glyph_of_cid.get(cid, 0) if self.by_cid else cid

    def advance(self, glyph: int) -> float:
        """Advance width in thousandths of the em."""
        return self._drawn(min(glyph, self.glyphs - 1))[1] * 1000.0 / self.units if self.glyphs else 0.0

    def outline(self, glyph: int) -> tuple:
        return self._drawn(glyph)[0] if 0 <= glyph < self.glyphs else ()

    @lru_cache(maxsize=4096)  # noqa: B019  faces are cached a process anyway
    def _drawn(self, glyph: int) -> tuple[tuple, float]:
        subrs, default, nominal = self.privates[self.font_of[glyph]]
        pen = _Pen(self.globals, subrs)
        try:
            pen.run(self.charstrings[glyph], 0)
            steps = pen.closed()
            if pen.accent:
                steps = self._accented(*pen.accent)
        except (IndexError, struct.error, ValueError) as fault:
            raise FontFault(f"bad charstring: {fault}") from fault
        return tuple(steps), default if pen.width is None else nominal + pen.width

    def _accented(self, dx: float, dy: float, base: float, accent: float) -> list:
        """Two glyphs of the standard encoding, the second moved."""
        by_name = {name: g for g, name in reversed(list(enumerate(self.names)))}
        standard = dict(zip([*range(0x20, 0x7F), *STANDARD_UPPER_CODES], STANDARD_STRINGS[1:], strict=False))
        out: list = []
        for code, x, y in ((base, 0, 0), (accent, dx, dy)):
            for step, *p in self.outline(by_name.get(standard.get(int(code), ""), 0)):
                out.append((step, *(v + (y if i % 2 else x) for i, v in enumerate(p))))
        return out


class _Pen:
    """Runs a Type 2 charstring."""

    def __init__(self, general: list[bytes], own: list[bytes]):
        self.subrs = {10: own, 29: general}
        self.stack: list[float] = []
        self.steps: list[tuple] = []
        self.x = self.y = 0.0
        self.width: float | None = None
        self.first = True
        self.hints = 0
        self.open = self.done = False
        self.accent: tuple | None = None
        self.stored: dict[int, float] = {}
        self.ran = 0

    def closed(self) -> list[tuple]:
        if self.open:
            self.steps.append(("Z",))
            self.open = False
        return self.steps

    def _take_width(self, wanted: int | None) -> None:
        """The first operator that clears the stack may have a width below its operands."""
        extra = len(self.stack) % 2 if wanted is None else len(self.stack) > wanted
        if self.first and extra:
            self.width = self.stack.pop(0)
        self.first = False

    def _move(self, dx: float, dy: float) -> None:
        self.closed()
        self.x += dx
        self.y += dy
        self.steps.append(("M", self.x, self.y))
        self.open = True

    def _line(self, dx: float, dy: float) -> None:
        self.x += dx
        self.y += dy
        self.steps.append(("L", self.x, self.y))

    def _curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        x1, y1 = self.x + a, self.y + b
        x2, y2 = x1 + c, y1 + d
        self.x, self.y = x2 + e, y2 + f
        self.steps.append(("C", x1, y1, x2, y2, self.x, self.y))

    def run(self, code: bytes, depth: int) -> None:
        if depth > DEEPEST:
            raise ValueError("subroutines too deep")
        at, s = 0, self.stack
        while at < len(code) and not self.done:
            b = code[at]
            at += 1
            if b >= 32 or b == 28:
                if b == 28:
                    s.append(struct.unpack_from(">h", code, at)[0])
                    at += 2
                elif b <= 246:
                    s.append(b - 139)
                elif b == 255:
                    s.append(struct.unpack_from(">i", code, at)[0] / 65536)
                    at += 4
                else:
                    s.append((b - 247) * 256 + code[at] + 108 if b <= 250 else -(b - 251) * 256 - code[at] - 108)
                    at += 1
                continue
            self.ran += 1
            if self.ran > MOST_OPERATORS:
                raise ValueError("charstring too long")
            if b in (10, 29):
                subrs = self.subrs[b]
                i = int(s.pop()) + (107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768)
                if not 0 <= i < len(subrs):
                    raise ValueError("no such subroutine")
                self.run(subrs[i], depth + 1)
            elif b == 11:
                return
            elif b in (19, 20):  # masks: operands left are vertical stems
                self._take_width(None)
                self.hints += len(s) // 2
                s.clear()
                at += (self.hints + 7) // 8
            elif b == 12:
                self._escaped(code[at])
                at += 1
            else:
                self._plain(b)

    def _plain(self, b: int) -> None:
        s = self.stack
        if b in (1, 3, 18, 23):
            self._take_width(None)
            self.hints += len(s) // 2
        elif b == 14:
            self._take_width(4 if len(s) >= 4 else 0)
            if len(s) >= 4:
                self.accent = tuple(s[:4])
            self.done = True
        elif b == 21:
            self._take_width(2)
            self._move(s[0], s[1])
        elif b == 22:
            self._take_width(1)
            self._move(s[0], 0)
        elif b == 4:
            self._take_width(1)
            self._move(0, s[0])
        elif b == 5:
            for i in range(0, len(s) - 1, 2):
                self._line(s[i], s[i + 1])
        elif b in (6, 7):
            for i, v in enumerate(s):
                self._line(v, 0) if (i % 2 == 0) == (b == 6) else self._line(0, v)
        elif b in (8, 24):
            n = len(s) // 6 * 6
            for i in range(0, n, 6):
                self._curve(*s[i : i + 6])
            if b == 24:
                self._line(s[n], s[n + 1])
        elif b == 25:
            n = len(s) - 6
            for i in range(0, n - 1, 2):
                self._line(s[i], s[i + 1])
            self._curve(*s[n:])
        elif b in (26, 27):
            odd, rest = (s[0], s[1:]) if len(s) % 4 else (0, s)
            for i in range(0, len(rest) - 3, 4):
                p, q, r, t = rest[i : i + 4]
                self._curve(odd, p, q, r, 0, t) if b == 26 else self._curve(p, odd, q, r, t, 0)
                odd = 0
        elif b in (30, 31):
            flat, n = b == 31, len(s) // 4
            for k in range(n):
                p, q, r, t = s[4 * k : 4 * k + 4]
                last = s[-1] if k == n - 1 and len(s) % 4 else 0
                self._curve(p, 0, q, r, last, t) if flat else self._curve(0, p, q, r, t, last)
                flat = not flat
        s.clear()

    def _escaped(self, b: int) -> None:
        s = self.stack
        if b in (34, 35, 36, 37):
            if b == 35:
                self._curve(*s[:6])
                self._curve(*s[6:12])
            elif b == 34:
                a, c, d, e, f, g, h = s[:7]
                self._curve(a, 0, c, d, e, 0)
                self._curve(f, 0, g, -d, h, 0)
            elif b == 36:
                a, c, d, e, f, g, h, i, j = s[:9]
                self._curve(a, c, d, e, f, 0)
                self._curve(g, 0, h, i, j, -(c + e + i))
            else:
                dx, dy = sum(s[0:10:2]), sum(s[1:10:2])
                self._curve(*s[:6])
                end = (s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])
                self._curve(*s[6:10], *end)
            s.clear()
        elif b in (10, 11, 12, 24, 15, 3, 4):  # of two operands
            q, p = s.pop(), s.pop()
            s.append(
                p + q if b == 10 else p - q if b == 11 else (p / q if q else 0) if b == 12 else p * q if b == 24
                else float(p == q) if b == 15 else float(bool(p) and bool(q)) if b == 3 else float(bool(p) or bool(q))
            )
        elif b in (9, 14, 26, 5):  # of one
            p = s.pop()
            s.append(abs(p) if b == 9 else -p if b == 14 else max(p, 0) ** 0.5 if b == 26 else float(not p))
        elif b == 18:
            s.pop()
        elif b == 20:
            i, v = int(s.pop()), s.pop()
            self.stored[i] = v
        elif b == 21:
            s.append(self.stored.get(int(s.pop()), 0))
        elif b == 22:
            second, first = s.pop(), s.pop()
            no, yes = s.pop(), s.pop()
            s.append(yes if first <= second else no)
        elif b == 23:
            s.append(0.5)
        elif b == 27:
            s.append(s[-1])
        elif b == 28:
            s[-1], s[-2] = s[-2], s[-1]
        elif b == 29:
            i = int(s.pop())
            s.append(s[-1 - max(0, i)])
        elif b == 30:
            j, n = int(s.pop()), int(s.pop())
            if n > 0:
                top = s[-n:]
                s[-n:] = top[-j % n :] + top[: -j % n]
        else:
            s.clear()
