"""Reading and writing the syntax of paged documents: objects, streams, operators.

Objects are Python values: numbers, bool, None, ``Name``, ``bytes`` (strings),
lists, dicts (by key text), ``Ref`` and ``Stream``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from typing import Any, NamedTuple


class Name(str):
    """A name object, without its slash."""


class Ref(NamedTuple):
    id: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict[str, Any]
    raw: bytes


class SyntaxFault(ValueError):
    """What can't be read as the syntax says."""


_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Keyword(str):
    """A bare word: an operator, or obj, R, stream."""


class Lexer:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def value(self) -> Any:
        """The next value or Keyword; EOFError at the end."""
        self.skip()
        data, pos = self.data, self.pos
        if pos >= len(data):
            raise EOFError
        c = data[pos : pos + 1]
        if c == b"/":
            m = _REGULAR.match(data, pos + 1)
            self.pos = m.end() if m else pos + 1
            raw = m.group() if m else b""
            raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw)
            return Name(raw.decode("utf-8", "surrogateescape"))
        if c == b"(":
            return self._string()
        if data[pos : pos + 2] == b"<<":
            self.pos += 2
            return self._dict()
        if c == b"<":
            end = data.find(b">", pos)
            if end < 0:
                raise SyntaxFault("hex string without end")
            self.pos = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[pos + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.pos += 1
            out = []
            while True:
                self.skip()
                if self.data[self.pos : self.pos + 1] == b"]":
                    self.pos += 1
                    return out
                out.append(self._operand())
        if c in (b"{", b"}", b"]", b")") or data[pos : pos + 2] == b">>":
            raise SyntaxFault(f"unexpected {c!r} at {pos}")
        m = _REGULAR.match(data, pos)
        if not m:
            raise SyntaxFault(f"unexpected {c!r} at {pos}")
        self.pos = m.end()
        word = m.group()
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        if word in (b"true", b"false"):
            return word == b"true"
        if word == b"null":
            return None
        return Keyword(word.decode("latin-1"))

    def _operand(self) -> Any:
        """A value, where ``n g R`` is a reference."""
        value = self.value()
        if type(value) is int and value >= 0:
            m = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(self.data, self.pos)
            if m:
                self.pos = m.end()
                return Ref(value, int(m[1]))
        if isinstance(value, Keyword):
            raise SyntaxFault(f"unexpected word {value}")
        return value

    def _dict(self) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.data[self.pos : self.pos + 2] == b">>":
                self.pos += 2
                return out
            key = self.value()
            if not isinstance(key, Name):
                raise SyntaxFault("a dictionary key must be a name")
            out[str(key)] = self._operand()

    def _string(self) -> bytes:
        data, i, depth, out = self.data, self.pos + 1, 1, bytearray()
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                n = data[i + 1 : i + 2]
                octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
                if octal:
                    out.append(int(octal.group(), 8) & 255)
                    i = octal.end()
                    continue
                if n in (b"\r", b"\n"):
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += _ESCAPES.get(n, n)
                i += 2
                continue
            depth += (c == b"(") - (c == b")")
            i += 1
            if not depth:
                self.pos = i
                return bytes(out)
            out += c
        raise SyntaxFault("string without end")


def operations(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) of a content stream; an inline image is one
    operation, ``BI``, with its dictionary and data."""
    lexer, out, operands = Lexer(data), [], []
    while True:
        lexer.skip()
        if lexer.pos >= len(data):
            if operands:
                raise SyntaxFault("operands without an operator")
            return out
        try:
            value = lexer.value()
        except EOFError:
            raise SyntaxFault("value without end") from None
        if not isinstance(value, Keyword):
            operands.append(value)
            continue
        if value == "BI":
            d: dict = {}
            while (key := lexer.value()) != "ID":
                d[str(key)] = lexer._operand()
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(data, lexer.pos + 1)
            if not end:
                raise SyntaxFault("inline image without end")
            out.append(("BI", [d, data[lexer.pos + 1 : end.start()]]))
            lexer.pos = end.end()
        else:
            out.append((str(value), operands))
        operands = []


def escaped_name(name: str) -> bytes:
    out = bytearray(b"/")
    for b in name.encode("utf-8", "surrogateescape"):
        out += bytes([b]) if 0x21 <= b <= 0x7E and b not in b"#%()/<>[]{}" else b"#%02X" % b
    return bytes(out)


def number_text(v: float) -> str:
    """At most four decimals, no trailing zeros, no minus zero."""
    text = f"{v:.4f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def written(value: Any) -> bytes:
    """A value in the syntax."""
    if isinstance(value, Name):
        return escaped_name(value)
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        text = f"{value:.6f}".rstrip("0").rstrip(".")
        return (text if text not in ("-0", "") else "0").encode()
    if isinstance(value, bytes | bytearray):
        return b"(" + re.sub(rb"([\\()])", rb"\\\1", bytes(value)).replace(b"\r", b"\\r") + b")"
    if isinstance(value, dict):
        return b"<<" + b" ".join(escaped_name(k) + b" " + written(v) for k, v in value.items()) + b">>"
    if isinstance(value, list | tuple):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, Stream):
        d = value.dict | {"Length": len(value.raw)}
        return written(d) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(type(value))


def encoded(ops: list[tuple[str, list]]) -> bytes:
    """A content stream of operations, one a line."""
    lines = []
    for operator, operands in ops:
        if operator == "BI":
            d, data = operands
            head = b" ".join(escaped_name(k) + b" " + written(v) for k, v in d.items())
            lines.append(b"BI " + head + b" ID " + data + b" EI")
        else:
            lines.append(b" ".join([*map(written, operands), operator.encode("latin-1")]))
    return b"\n".join(lines)


def _unpredicted(data: bytes, parms: dict) -> bytes:
    predictor = parms.get("Predictor", 1)
    if predictor < 10:
        if predictor == 1:
            return data
        raise SyntaxFault("unsupported predictor")
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            left = row[i - step] if i >= step else 0
            corner = above[i - step] if i >= step else 0
            up = above[i]
            if kind == 1:
                add = left
            elif kind == 2:
                add = up
            elif kind == 3:
                add = (left + up) // 2
            elif kind == 4:
                p = left + up - corner
                add = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            else:
                add = 0
            row[i] = (row[i] + add) & 255
        out += row
        above = row
    return bytes(out)


@dataclass
class Document:
    """Objects by number, and the trailer."""

    objects: dict[int, Any] = field(default_factory=dict)
    trailer: dict[str, Any] = field(default_factory=dict)

    def get(self, value: Any) -> Any:
        """value, or what it refers to."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.id)
        return None

    def decoded(self, stream: Stream) -> bytes:
        """The stream's data after its filters; image filters stay."""
        data = stream.raw
        filters = self.get(stream.dict.get("Filter"))
        parms = self.get(stream.dict.get("DecodeParms"))
        filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        for name, parm in zip(filters, parms, strict=False):
            if self.get(name) in ("FlateDecode", "Fl"):
                worker = zlib.decompressobj()
                data = worker.decompress(data) + worker.flush()
                data = _unpredicted(data, self.get(parm) or {})
            elif self.get(name) == "ASCIIHexDecode":
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                break
        return data

    def pages(self) -> list[int]:
        """Object numbers of the pages, in order."""
        out: list[int] = []
        seen: set[int] = set()

        def walk(ref: Any) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref.id in seen:
                return
            seen.add(ref.id)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid)
            else:
                out.append(ref.id)

        root = self.get(self.trailer.get("Root"))
        if isinstance(root, dict):
            walk(root.get("Pages"))
        return out

    def inherited(self, page: dict, key: str) -> Any:
        """A page's entry, or that of its nearest ancestor that has it."""
        seen = 0
        while isinstance(page, dict) and seen < 64:
            if key in page:
                return self.get(page[key])
            page, seen = self.get(page.get("Parent")), seen + 1
        return None


_OBJECT = re.compile(rb"(?<![0-9])(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")


def read_document(data: bytes) -> Document:
    """A document from its bytes. Objects are found by scanning, so damaged
    cross-reference tables do not matter; of one number the last wins."""
    if not data.startswith(b"%PDF-"):
        raise SyntaxFault("not a paged document: no header")
    doc, at = Document(), 0
    packed: list[Stream] = []
    while m := _OBJECT.search(data, at):
        lexer = Lexer(data, m.end())
        try:
            value = lexer._operand()
        except (SyntaxFault, EOFError):
            at = m.end()
            continue
        at = lexer.pos
        lexer.skip()
        if isinstance(value, dict) and data.startswith(b"stream", lexer.pos):
            start = lexer.pos + 6
            start += 2 if data[start : start + 2] == b"\r\n" else 1
            length = value.get("Length")
            end = start + length if isinstance(length, int) else -1
            if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                end = data.find(b"endstream", start)
                if end < 0:
                    raise SyntaxFault("stream without end")
                tail = end
                while tail > start and data[tail - 1 : tail] in (b"\n", b"\r") and end - tail < 2:
                    tail -= 1
                at, end = end, tail
            else:
                at = end
            value = Stream(value, data[start:end])
            if value.dict.get("Type") == "ObjStm":
                packed.append(value)
            if value.dict.get("Type") == "XRef":
                doc.trailer |= {k: v for k, v in value.dict.items() if k in ("Root", "Info", "ID", "Encrypt")}
        doc.objects[int(m[1])] = value
    for stream in packed:
        body = doc.decoded(stream)
        head = Lexer(body)
        numbers = [(head.value(), head.value()) for _ in range(doc.get(stream.dict["N"]))]
        first = doc.get(stream.dict["First"])
        for number, offset in numbers:
            doc.objects.setdefault(number, Lexer(body, first + offset)._operand())
    for m in re.finditer(rb"trailer(?=[\x00\t\n\x0c\r <])", data):
        try:
            found = Lexer(data, m.end())._operand()
        except (SyntaxFault, EOFError):
            continue
        if isinstance(found, dict):
            doc.trailer |= found
    if "Root" not in doc.trailer:
        roots = [k for k, v in doc.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        if not roots:
            raise SyntaxFault("no catalog")
        doc.trailer["Root"] = Ref(roots[-1])
    if "Encrypt" in doc.trailer:
        raise SyntaxFault("encrypted documents are not supported")
    return doc


def write_document(doc: Document) -> bytes:
    """The document's bytes, with a cross-reference table; its chain from root to
    pages must be whole."""
    root = doc.get(doc.trailer.get("Root"))
    pages = doc.get(root.get("Pages")) if isinstance(root, dict) else None
    if not isinstance(pages, dict) or "Kids" not in pages:
        raise SyntaxFault("no pages to write")
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    places = {}
    for number in sorted(doc.objects):
        places[number] = len(out)
        out += b"%d 0 obj\n" % number + written(doc.objects[number]) + b"\nendobj\n"
    size, start = max(places) + 1, len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for number in range(1, size):
        out += b"%010d 00000 n \n" % places[number] if number in places else b"0000000000 00000 f \n"
    out += b"trailer\n" + written({"Size": size, "Root": doc.trailer["Root"]}) + b"\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)
