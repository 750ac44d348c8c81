"""TrueType outlines, widths and character maps, in plain Python."""

from __future__ import annotations

import struct
from functools import lru_cache


class FontFault(ValueError):
    """A font that can't be used; ``skippable`` ones leave the page's others."""

    def __init__(self, message: str, skippable: bool = False):
        super().__init__(message)
        self.skippable = skippable


class TrueType:
    """One face of a TrueType file or collection."""

    def __init__(self, data: bytes, face: int = 0):
        start = 0
        if data[:4] == b"ttcf":
            start = struct.unpack_from(">I", data, 12 + 4 * face)[0]
        if data[start : start + 4] not in (b"\x00\x01\x00\x00", b"true"):
            raise FontFault("not a TrueType font")
        count = struct.unpack_from(">H", data, start + 4)[0]
        self.data, self.tables = data, {}
        for i in range(count):
            tag, _, offset, size = struct.unpack_from(">4sIII", data, start + 12 + 16 * i)
            self.tables[tag.decode("latin-1")] = (offset, size)
        head = self._at("head")
        self.units = struct.unpack_from(">H", data, head + 18)[0]
        self.long_loca = struct.unpack_from(">h", data, head + 50)[0] == 1
        self.glyphs = struct.unpack_from(">H", data, self._at("maxp") + 4)[0]
        self.h_metrics = struct.unpack_from(">H", data, self._at("hhea") + 34)[0]
        self.cmaps = self._cmaps() if "cmap" in self.tables else {}

    def _at(self, tag: str) -> int:
        if tag not in self.tables:
            raise FontFault(f"no {tag} table")
        return self.tables[tag][0]

    def _cmaps(self) -> dict[tuple[int, int], int]:
        at = self._at("cmap")
        found = {}
        for i in range(struct.unpack_from(">H", self.data, at + 2)[0]):
            platform, encoding, offset = struct.unpack_from(">HHI", self.data, at + 4 + 8 * i)
            found[platform, encoding] = at + offset
        return found

    def glyph_of(self, code_point: int) -> int | None:
        """Glyph of a Unicode code point, by the first map that has it."""
        order = sorted(self.cmaps, key=lambda k: (k not in ((3, 10), (0, 4), (0, 6)), k[0] not in (0, 3), k))
        for key in order:
            if key[0] == 1:
                continue
            g = self._lookup(self.cmaps[key], code_point)
            if not g and key == (3, 0) and code_point < 256:
                g = self._lookup(self.cmaps[key], 0xF000 + code_point)
            if g:
                return g
        return None

    def _lookup(self, at: int, c: int) -> int:
        d = self.data
        kind = struct.unpack_from(">H", d, at)[0]
        if kind == 0:
            return d[at + 6 + c] if c < 256 else 0
        if kind == 4:
            n = struct.unpack_from(">H", d, at + 6)[0] // 2
            ends = struct.unpack_from(f">{n}H", d, at + 14)
            for i, end in enumerate(ends):
                if c <= end:
                    start, delta, offset = (struct.unpack_from(">H", d, at + 16 + 2 * (k * n + i))[0] for k in (1, 2, 3))
                    if c < start:
                        return 0
                    if not offset:
                        return (c + delta) & 0xFFFF
                    g = struct.unpack_from(">H", d, at + 16 + 2 * (3 * n + i) + offset + 2 * (c - start))[0]
                    return (g + delta) & 0xFFFF if g else 0
        if kind == 6:
            first, n = struct.unpack_from(">HH", d, at + 6)
            return struct.unpack_from(">H", d, at + 10 + 2 * (c - first))[0] if first <= c < first + n else 0
        if kind == 12:
            for i in range(struct.unpack_from(">I", d, at + 12)[0]):
                start, end, glyph = struct.unpack_from(">III", d, at + 16 + 12 * i)
                if start <= c <= end:
                    return glyph + c - start
        return 0

    def advance(self, glyph: int) -> float:
        """Advance width in thousandths of the em."""
        at = self._at("hmtx") + 4 * min(glyph, self.h_metrics - 1)
        return struct.unpack_from(">H", self.data, at)[0] * 1000.0 / self.units

    @lru_cache(maxsize=4096)  # noqa: B019  faces are cached a process anyway
    def outline(self, glyph: int, depth: int = 0) -> tuple:
        """Path steps ("M", x, y), ("L", x, y), ("Q", cx, cy, x, y), ("Z",)."""
        if glyph >= self.glyphs or depth > 8:
            return ()
        loca, glyf = self._at("loca"), self._at("glyf")
        if self.long_loca:
            a, b = struct.unpack_from(">II", self.data, loca + 4 * glyph)
        else:
            a, b = (2 * x for x in struct.unpack_from(">HH", self.data, loca + 2 * glyph))
        if a == b:
            return ()
        contours = struct.unpack_from(">h", self.data, glyf + a)[0]
        return self._simple(glyf + a + 10, contours) if contours >= 0 else self._composite(glyf + a + 10, depth)

    def _simple(self, at: int, contours: int) -> tuple:
        d = self.data
        if not contours:
            return ()
        ends = struct.unpack_from(f">{contours}H", d, at)
        at += 2 * contours
        at += 2 + struct.unpack_from(">H", d, at)[0]
        count, flags = ends[-1] + 1, []
        while len(flags) < count:
            f = d[at]
            at += 1
            flags.append(f)
            if f & 8:
                flags += [f] * d[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            values, v = [], 0
            for f in flags[:count]:
                if f & short:
                    v += d[at] if f & same else -d[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack_from(">h", d, at)[0]
                    at += 2
                values.append(v)
            axes.append(values)
        out, first = [], 0
        for end in ends:
            points = [(float(axes[0][i]), float(axes[1][i]), flags[i] & 1) for i in range(first, end + 1)]
            first = end + 1
            out += _contour(points)
        return tuple(out)

    def _composite(self, at: int, depth: int) -> tuple:
        d, out = self.data, []
        while True:
            flags, glyph = struct.unpack_from(">HH", d, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", d, at)
            at += 4 if flags & 1 else 2
            a, b, c, e = 1.0, 0.0, 0.0, 1.0
            if flags & 8:
                a = e = struct.unpack_from(">h", d, at)[0] / 16384
                at += 2
            elif flags & 64:
                a, e = (x / 16384 for x in struct.unpack_from(">hh", d, at))
                at += 4
            elif flags & 128:
                a, b, c, e = (x / 16384 for x in struct.unpack_from(">hhhh", d, at))
                at += 8
            if not flags & 2:
                dx = dy = 0
            for step, *p in self.outline(glyph, depth + 1):
                moved = []
                for i in range(0, len(p), 2):
                    moved += [p[i] * a + p[i + 1] * c + dx, p[i] * b + p[i + 1] * e + dy]
                out.append((step, *moved))
            if not flags & 32:
                return tuple(out)


def _contour(points: list) -> list:
    """Steps of one closed contour; two off-curve points imply one between."""
    if not points:
        return []
    if not points[0][2]:
        last = points[-1]
        points = [last, *points[:-1]] if last[2] else [((points[0][0] + last[0]) / 2, (points[0][1] + last[1]) / 2, 1), *points]
    start = points[0]
    out: list = [("M", start[0], start[1])]
    control = None
    for x, y, on in [*points[1:], start]:
        if on:
            out.append(("L", x, y) if control is None else ("Q", *control, x, y))
            control = None
        else:
            if control is not None:
                out.append(("Q", *control, (control[0] + x) / 2, (control[1] + y) / 2))
            control = (x, y)
    return [*out, ("Z",)]
