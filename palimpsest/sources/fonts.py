"""Fonts of a page: what shows a code, how wide it is, where its outline is."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import lru_cache

from palimpsest.functions.cff import Compact
from palimpsest.functions.names import SUBSTITUTES, glyph_name_code_point, win_ansi_code_point
from palimpsest.functions.truetype import FontFault, TrueType
from palimpsest.sources.pdf_syntax import Document, Ref, Stream

FONT_FOLDERS = ("/usr/share/fonts", "/usr/local/share/fonts", os.path.expanduser("~/.fonts"))


@dataclass
class Font:
    face: TrueType | Compact
    two_byte: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 0.0
    #: Code points of single codes that differ from WinAnsi.
    differences: dict[int, int] = field(default_factory=dict)
    #: Glyphs of single codes that a compact face names itself.
    codes: dict[int, int] = field(default_factory=dict)

    @property
    def units(self) -> int:
        return self.face.units

    def glyph(self, code: int) -> int | None:
        if self.two_byte:
            return self.face.glyph_of_id(code) if isinstance(self.face, Compact) else code
        if code in self.codes:
            return self.codes[code]
        point = self.differences.get(code) or (win_ansi_code_point(code) if code < 256 else None)
        return self.face.glyph_of(point) if point is not None else None

    def outline(self, code: int) -> list:
        glyph = self.glyph(code)
        return list(self.face.outline(glyph)) if glyph is not None else []

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default_width)


def ps_name_parts(name: str) -> tuple[str, bool, bool]:
    """(family, bold, italic) of a PostScript name."""
    core = re.sub(r"(MT)+$", "", name)
    m = re.search(r"-(BoldItalic|Bold|Italic|Oblique)$", core)
    style = m[1] if m else ""
    family = re.sub(r"(PS)+$", "", core[: m.start()] if m else core)
    return re.sub(r"(?<!^)([A-Z])", r" \1", family), "Bold" in style, style in ("BoldItalic", "Italic", "Oblique")


@lru_cache(maxsize=1)
def system_faces() -> tuple[dict, ...]:
    """Installed TrueType faces: path, ps, family, bold, italic."""
    out = []
    for folder in FONT_FOLDERS:
        for root, _, files in sorted(os.walk(folder)):
            for f in sorted(files):
                if not f.lower().endswith(".ttf"):
                    continue
                path = os.path.join(root, f)
                try:
                    with open(path, "rb") as data:
                        names = _names(data.read())
                except (OSError, FontFault, IndexError, ValueError):
                    continue
                style = names.get(2, "")
                out.append({"path": path, "ps": names.get(6, ""), "family": names.get(1, ""), "bold": "Bold" in style, "italic": "Italic" in style or "Oblique" in style})
    return tuple(out)


def _names(data: bytes) -> dict[int, str]:
    import struct

    face = TrueType(data)
    at = face.tables["name"][0]
    count, strings = struct.unpack_from(">HH", data, at + 2)
    out: dict[int, str] = {}
    for i in range(count):
        platform, _, _, name, size, offset = struct.unpack_from(">6H", data, at + 6 + 12 * i)
        raw = data[at + strings + offset : at + strings + offset + size]
        if platform in (0, 3):
            out[name] = raw.decode("utf-16-be", "replace")
        elif platform == 1:
            out.setdefault(name, raw.decode("mac-roman", "replace"))
    return out


def resolve_system_font(name: str, faces: tuple[dict, ...] | None = None) -> dict:
    """The installed face for a PostScript name: by that name, by family and
    style, by the family's substitute and style."""
    faces = system_faces() if faces is None else faces
    for face in faces:
        if face["ps"] == name:
            return face
    family, bold, italic = ps_name_parts(name)
    for wanted in (family, SUBSTITUTES.get(family)):
        for face in faces:
            if wanted and (face["family"], face["bold"], face["italic"]) == (wanted, bold, italic):
                return face
    raise FontFault(f"system font not found: {name}", skippable=True)


@lru_cache(maxsize=32)
def _face_of_file(path: str) -> TrueType:
    with open(path, "rb") as f:
        return TrueType(f.read())


def _embedded(doc: Document, font: dict) -> TrueType | Compact | None:
    descriptor = doc.get(font.get("FontDescriptor"))
    if not isinstance(descriptor, dict):
        return None
    stream = doc.get(descriptor.get("FontFile2"))
    if isinstance(stream, Stream):
        return TrueType(doc.decoded(stream))
    stream = doc.get(descriptor.get("FontFile3"))
    if isinstance(stream, Stream):
        try:
            return Compact(doc.decoded(stream))
        except FontFault:  # an installed face may do
            return None
    return None


def _face(doc: Document, font: dict) -> TrueType | Compact:
    face = _embedded(doc, font)
    if face is None:
        name = str(doc.get(font.get("BaseFont")) or "")
        face = _face_of_file(resolve_system_font(name.split("+", 1)[-1] if re.match(r"[A-Z]{6}\+", name) else name)["path"])
    return face


def cid_widths(doc: Document, entries: list) -> dict[int, float]:
    """A /W array: ``c [w ...]`` and ``first last w``."""
    out: dict[int, float] = {}
    items = [doc.get(x) for x in entries]
    i = 0
    while i < len(items):
        if i + 1 < len(items) and isinstance(items[i + 1], list):
            for k, w in enumerate(items[i + 1]):
                out[int(items[i]) + k] = float(doc.get(w))
            i += 2
        elif i + 2 < len(items):
            for code in range(int(items[i]), int(items[i + 1]) + 1):
                out[code] = float(items[i + 2])
            i += 3
        else:
            raise FontFault("widths end early")
    return out


def _identity(doc: Document, font: dict) -> bool:
    """Identity-H is two-byte; every other encoding is WinAnsi."""
    return doc.get(font.get("Encoding")) == "Identity-H"


def differences(doc: Document, font: dict) -> dict[int, int]:
    """Code points by code of an encoding's differences; unknown names are left."""
    encoding = doc.get(font.get("Encoding"))
    listed = doc.get(encoding.get("Differences")) if isinstance(encoding, dict) else None
    out, code = {}, 0
    for x in listed or ():
        x = doc.get(x)
        if isinstance(x, int):
            code = x
        else:
            if (point := glyph_name_code_point(str(x))) is not None:
                out[code] = point
            code += 1
    return out


def own_codes(doc: Document, font: dict, face: Compact) -> dict[int, int]:
    """Glyphs by code of a compact face: its own encoding where the font names no
    other, and the encoding's differences by glyph name."""
    encoding = doc.get(font.get("Encoding"))
    named = doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
    out = {} if named else dict(face.codes)
    by_name = {name: g for g, name in reversed(list(enumerate(face.names)))}
    code = 0
    for x in (doc.get(encoding.get("Differences")) if isinstance(encoding, dict) else None) or ():
        x = doc.get(x)
        if isinstance(x, int):
            code = x
            continue
        if str(x) in by_name:
            out[code] = by_name[str(x)]
        else:  # the difference's code point decides
            out.pop(code, None)
        code += 1
    return out


def read_font(doc: Document, font: dict) -> Font:
    kind = doc.get(font.get("Subtype"))
    if kind in ("TrueType", "Type1", "MMType1"):
        face = _face(doc, font)
        found = Font(face, _identity(doc, font), differences=differences(doc, font))
        if isinstance(face, Compact):
            found.codes = own_codes(doc, font, face)
        widths = found.widths
        listed = doc.get(font.get("Widths"))
        if isinstance(listed, list):
            first = doc.get(font.get("FirstChar", 0))
            if not isinstance(first, int) or not 0 <= first <= 0xFFFF:
                raise FontFault("FirstChar out of range")
            widths.update({first + k: float(doc.get(w)) for k, w in enumerate(listed)})
        else:
            for code in range(256):
                point = win_ansi_code_point(code)
                glyph = found.codes.get(code, face.glyph_of(point) if point is not None else None)
                if glyph is not None:
                    widths[code] = face.advance(glyph)
        return found
    if kind == "Type0":
        below = doc.get((doc.get(font.get("DescendantFonts")) or [None])[0])
        if not isinstance(below, dict):
            raise FontFault("no descendant font")
        if isinstance(doc.get(below.get("CIDToGIDMap")), Stream):
            raise FontFault("CIDToGIDMap streams are not supported")
        face = _face(doc, below)
        default = float(doc.get(below.get("DW", 1000)))
        listed = doc.get(below.get("W"))
        if isinstance(listed, list):
            widths = cid_widths(doc, listed)
        elif isinstance(face, Compact) and face.by_cid:
            widths = {cid: face.advance(g) for cid, g in face.glyph_of_cid.items()}
        else:
            widths = {g: face.advance(g) for g in range(min(face.glyphs, 65536))}
        return Font(face, _identity(doc, font), widths, default)
    raise FontFault(f"unsupported font subtype: {kind}", skippable=True)


def page_fonts(doc: Document, page: dict) -> dict[str, Font]:
    """Fonts of a page by name; a skippable fault leaves that font out, any other
    is the page's."""
    resources = doc.inherited(page, "Resources") or {}
    fonts = doc.get(resources.get("Font")) or {}
    out = {}
    for name, ref in fonts.items():
        try:
            out[name] = read_font(doc, doc.get(ref) if isinstance(ref, Ref) else ref)
        except FontFault as fault:
            if not fault.skippable:
                raise
    return out


def font_table(spark):
    """The driver's installed faces as a table; as small as the installation."""
    rows = [(f["ps"], f["family"], f["bold"], f["italic"], f["path"]) for f in system_faces()]
    return spark.createDataFrame(rows, "ps string, family string, bold boolean, italic boolean, path string")
