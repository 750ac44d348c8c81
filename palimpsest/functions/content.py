"""What a page's operators do: stripping, placements, masks, outlines.

All of it is one fold over the operators (``walk``) that keeps the graphics state;
each function below picks what it needs from the states. ``parity`` composes
``cm`` as current x new, which existing output relies on; without it the usual
new x current is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from palimpsest.sources.pdf_syntax import Name, SyntaxFault, encoded, number_text, operations

Matrix = tuple[float, float, float, float, float, float]
Box = tuple[float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    return (
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


def hull(m: Matrix, x: float = 0.0, y: float = 0.0, w: float = 1.0, h: float = 1.0) -> Box:
    """Box around the rectangle after m."""
    xs = [px * m[0] + py * m[2] + m[4] for px in (x, x + w) for py in (y, y + h)]
    ys = [px * m[1] + py * m[3] + m[5] for px in (x, x + w) for py in (y, y + h)]
    return min(xs), min(ys), max(xs), max(ys)


def overlap(a: Box, b: Box) -> bool:
    """Strict: touching is no overlap."""
    return a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]


def numbers(operands: list, count: int) -> list[float] | None:
    """The operands as floats if there are count; others than numbers fail."""
    if len(operands) != count:
        return None
    if not all(isinstance(v, int | float) and not isinstance(v, bool) for v in operands):
        raise SyntaxFault("operand is not a number")
    return [float(v) for v in operands]


@dataclass(frozen=True)
class Fill:
    """Fill color: its space is told by the number of components."""

    parts: tuple[float, ...] = (0.0,)

    @property
    def white(self) -> bool:
        want = 0.0 if len(self.parts) == 4 else 1.0
        return all(abs(p - want) < 1e-6 for p in self.parts)

    @property
    def luminance(self) -> float:
        p = self.parts
        if len(p) == 1:
            return p[0]
        if len(p) == 4:
            p = tuple((1 - c) * (1 - p[3]) for c in p[:3])
        return 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]

    def operator(self, force_bw: bool) -> str:
        if force_bw:
            return "1 g" if self.luminance >= 0.5 else "0 g"
        return " ".join(map(number_text, self.parts)) + {1: " g", 3: " rg", 4: " k"}[len(self.parts)]


_FILLS = {"g": 1, "rg": 3, "k": 4}


def fill_after(fill: Fill, operator: str, operands: list) -> Fill:
    """The fill color after an operator; sc and scn by their operand count."""
    want = _FILLS.get(operator, len(operands) if operator in ("sc", "scn") and len(operands) in (1, 3, 4) else None)
    if want is None or len(operands) != want:
        return fill
    if not all(isinstance(v, int | float) for v in operands):
        return fill
    return Fill(tuple(float(v) for v in operands))


@dataclass(frozen=True)
class State:
    ctm: Matrix = IDENTITY
    fill: Fill = field(default_factory=Fill)


def walk(ops: list, parity: bool = True) -> Iterator[tuple[str, list, State]]:
    """Each operator with the state after it. A surplus Q changes nothing."""
    stack = [State()]
    for operator, operands in ops:
        now = stack[-1]
        if operator == "q":
            stack.append(now)
        elif operator == "Q":
            if len(stack) > 1:
                stack.pop()
        elif operator == "cm":
            m = numbers(operands, 6)
            if m:
                stack[-1] = replace(now, ctm=times(now.ctm, tuple(m)) if parity else times(tuple(m), now.ctm))
        elif operator in ("g", "rg", "k", "sc", "scn"):
            stack[-1] = replace(now, fill=fill_after(now.fill, operator, operands))
        yield operator, operands, stack[-1]


def strip_text(data: bytes) -> bytes:
    """The stream without its text blocks, nested ones included."""
    depth, kept = 0, []
    for operator, operands in operations(data):
        if operator == "BT":
            depth += 1
        elif operator == "ET":
            depth = max(0, depth - 1)
        elif not depth:
            kept.append((operator, operands))
    return encoded(kept)


def placements(data: bytes, parity: bool = True) -> list[tuple[str, Matrix, Box]]:
    """(name, matrix, box) of every XObject drawn."""
    return [
        (str(operands[0]), state.ctm, hull(state.ctm))
        for operator, operands, state in walk(operations(data), parity)
        if operator == "Do" and operands and isinstance(operands[0], Name)
    ]


_FILLING = ("f", "F", "f*")
_PATH_ENDS = ("S", "s", "B", "B*", "b", "b*", "n", "W", "W*")
_PATH_STEPS = ("m", "l", "c", "v", "y", "h")


def white_rects(data: bytes, parity: bool = True) -> list[Box]:
    """Boxes of the rectangles that are filled while the color is white. Any
    other path step drops the rectangles gathered so far."""
    out: list[Box] = []
    waiting: list[list[float]] = []
    for operator, operands, state in walk(operations(data), parity):
        if operator == "re":
            r = numbers(operands, 4)
            if r:
                waiting.append(r)
        elif operator in _FILLING:
            if state.fill.white:
                out += [hull(state.ctm, *r) for r in waiting]
            waiting = []
        elif operator in _PATH_ENDS or operator in _PATH_STEPS:
            waiting = []
    return out


def char_codes(data: bytes, two_byte: bool) -> list[int]:
    """Codes of a shown string: bytes, or big-endian pairs (an odd last byte is
    dropped)."""
    if two_byte:
        return [data[i] << 8 | data[i + 1] for i in range(0, len(data) - 1, 2)]
    return list(data)


def tj_entries(items: list, two_byte: bool) -> list:
    """A TJ array as code lists and adjustments; anything else is dropped."""
    out = []
    for x in items:
        if isinstance(x, bytes):
            out.append(char_codes(x, two_byte))
        elif isinstance(x, int | float) and not isinstance(x, bool):
            out.append(float(x))
    return out


@dataclass
class Text:
    """Text state within one block."""

    font: str = ""
    size: float = 0.0
    matrix: Matrix = IDENTITY
    line: Matrix = IDENTITY
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    rise: float = 0.0

    def shift(self, x: float) -> None:
        self.matrix = times((1.0, 0.0, 0.0, 1.0, x, 0.0), self.matrix)

    def next_line(self, x: float, y: float) -> None:
        self.line = self.matrix = times((1.0, 0.0, 0.0, 1.0, x, y), self.line)

    def apply(self, operator: str, operands: list) -> None:
        if operator == "Tf":
            if len(operands) == 2:
                if isinstance(operands[0], Name):
                    self.font = str(operands[0])
                if isinstance(operands[1], int | float):
                    self.size = float(operands[1])
        elif operator == "Tm":
            if m := numbers(operands, 6):
                self.matrix = self.line = tuple(m)
        elif operator in ("Td", "TD"):
            if v := numbers(operands, 2):
                if operator == "TD":
                    self.leading = -v[1]
                self.next_line(*v)
        elif operator == "T*":
            self.next_line(0.0, -self.leading)
        elif operator in _SCALARS:
            if v := numbers(operands, 1):
                setattr(self, _SCALARS[operator], v[0])

    def advance(self, width: float) -> None:
        self.shift((width / 1000.0 * self.size + self.char_space) * self.scale / 100.0)

    def adjust(self, amount: float) -> None:
        self.shift(-amount / 1000.0 * self.size * self.scale / 100.0)


_SCALARS = {"TL": "leading", "Tc": "char_space", "Tw": "word_space", "Tz": "scale", "Ts": "rise"}
_TEXT_STATE = {"Tf", "Tm", "Td", "TD", "T*", "Tr", *_SCALARS}


def shows(ops: list, two_byte, parity: bool = True) -> Iterator[tuple[str, list, State, Text | None, list | None]]:
    """The fold with text: (operator, operands, state, text, entries). text is None
    outside blocks; entries (code lists and adjustments) where text is shown.
    two_byte(font) tells how a font's strings are read."""
    text: Text | None = None
    for operator, operands, state in walk(ops, parity):
        entries = None
        if operator == "BT":
            text = Text()
        elif operator == "ET":
            text = None
            yield operator, operands, state, Text(), None
            continue
        elif text is not None:
            if operator in _TEXT_STATE:
                text.apply(operator, operands)
            elif operator == "Tj" and operands:
                entries = tj_entries(operands[:1], two_byte(text.font))
            elif operator == "TJ" and operands and isinstance(operands[0], list):
                entries = tj_entries(operands[0], two_byte(text.font))
            elif operator == "'":
                text.apply("T*", [])
                entries = tj_entries(operands[:1], two_byte(text.font))
            elif operator == '"' and len(operands) == 3:
                for name, v in zip(("word_space", "char_space"), operands, strict=False):
                    if isinstance(v, int | float):
                        setattr(text, name, float(v))
                text.apply("T*", [])
                entries = tj_entries(operands[2:], two_byte(text.font))
        yield operator, operands, state, text, entries


def text_commands(data: bytes, two_byte=lambda font: False, parity: bool = True) -> list[dict]:
    """What is shown where: font, size, codes, entries, matrices, spacing, fill."""
    out = []
    for _, _, state, text, entries in shows(operations(data), two_byte, parity):
        if entries is not None and text is not None:
            codes = [c for e in entries if isinstance(e, list) for c in e]
            out.append(
                {
                    "font": text.font, "size": text.size, "codes": codes, "entries": entries, "text_matrix": text.matrix, "ctm": state.ctm, "fill": state.fill,
                    "char_space": text.char_space, "word_space": text.word_space, "scale": text.scale, "rise": text.rise,
                }
            )
    return out


def split_operations(data: bytes, two_byte=lambda font: False) -> tuple[list[dict], list[tuple[str, list]]]:
    """(text commands, the operators outside text blocks)."""
    kept, inside = [], False
    for operator, operands in operations(data):
        if operator in ("BT", "ET"):
            inside = operator == "BT"
        elif not inside:
            kept.append((operator, operands))
    return text_commands(data, two_byte), kept


def glyph_path(outline: list, units: int, text: Text, state: State, force_bw: bool) -> str:
    """A glyph's outline as filled path operators in page space."""
    if not outline:
        return ""
    m = times(text.matrix, state.ctm)
    scale, stretch = text.size / units, text.scale / 100.0

    def at(x: float, y: float) -> str:
        x, y = x * scale * stretch, y * scale + text.rise
        return f"{number_text(m[0] * x + m[2] * y + m[4])} {number_text(m[1] * x + m[3] * y + m[5])}"

    lines = ["q", state.fill.operator(force_bw)]
    here = (0.0, 0.0)
    for step, *p in outline:
        if step in ("M", "L"):
            lines.append(f"{at(*p)} {'m' if step == 'M' else 'l'}")
        elif step == "Q":  # the same curve as a cubic
            (cx, cy), (ex, ey) = p[:2], p[2:]
            one = here[0] + 2 / 3 * (cx - here[0]), here[1] + 2 / 3 * (cy - here[1])
            two = ex + 2 / 3 * (cx - ex), ey + 2 / 3 * (cy - ey)
            lines.append(f"{at(*one)} {at(*two)} {at(ex, ey)} c")
        elif step == "C":
            lines.append(f"{at(*p[:2])} {at(*p[2:4])} {at(*p[4:])} c")
        else:
            lines.append("h")
            continue
        here = tuple(p[-2:])
    return "\n".join([*lines, "f", "Q", ""])


def outlines(data: bytes, fonts: dict, force_bw: bool = False, parity: bool = True) -> bytes:
    """The stream with its text as filled outlines, after all other operators.

    KeyError where a font that shows text is not in fonts."""
    if not data:
        return b""
    kept: list = []
    paths: list[str] = []
    two_byte = lambda font: font in fonts and fonts[font].two_byte
    inside = False
    for operator, operands, state, text, entries in shows(operations(data), two_byte, parity):
        if operator == "BT":
            inside = True
        elif operator == "ET":
            inside = False
        elif not inside:
            kept.append((operator, operands))
        if entries is None or text is None:
            continue
        font = fonts[text.font]
        for entry in entries:
            if not isinstance(entry, list):
                text.adjust(entry)
                continue
            for code in entry:
                paths.append(glyph_path(font.outline(code), font.units, text, state, force_bw))
                text.advance(font.width(code))
                if code == 0x20:
                    text.shift(text.word_space * text.scale / 100.0)
    body = encoded(kept)
    drawn = "".join(paths).encode()
    return body + (b"\n" if body and drawn else b"") + drawn
