"""A baseline JPEG encoder in numpy."""

from __future__ import annotations

import struct

import numpy as np

#: The example quantisation tables of the JPEG standard, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def _zigzag() -> list[int]:
    """Places of an 8 x 8 block in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))
    return [8 * r + c for r, c in cells]


ZIGZAG = np.array(_zigzag())
_K = np.arange(8)
DCT = np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16))


def quantisers(base: tuple, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _code_lengths(counts: np.ndarray) -> list[int]:
    """Code lengths, at most 16, for symbols of these counts; one code of all
    ones stays free."""
    import heapq

    symbols = [int(s) for s in np.flatnonzero(counts)]
    heap = [(int(counts[s]), i, (s,)) for i, s in enumerate(symbols)] + [(0, -1, (256,))]
    heapq.heapify(heap)
    depth = dict.fromkeys([*symbols, 256], 0)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
        serial += 1
    bits = [0] * 64
    for d in depth.values():
        bits[max(1, d)] += 1
    for size in range(63, 16, -1):  # shorten over-long codes, pair by pair
        while bits[size] > 0:
            shorter = size - 2
            while not bits[shorter]:
                shorter -= 1
            bits[size] -= 2
            bits[size - 1] += 1
            bits[shorter + 1] += 2
            bits[shorter] -= 1
    longest = max(i for i in range(17) if bits[i])
    bits[longest] -= 1  # the free code
    ordered = sorted(symbols, key=lambda s: (depth[s], s))
    return [bits[1:17], ordered]


def _codes(bits: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    value = at = 0
    for size, n in enumerate(bits, 1):
        for _ in range(n):
            code[symbols[at]], length[symbols[at]] = value, size
            value, at = value + 1, at + 1
        value <<= 1
    return code, length


def _category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, order, is DC, symbol, extra bits, their number) of all blocks."""
    n = len(blocks)
    dc = np.diff(blocks[:, 0], prepend=0)
    size = _category(dc)
    rows = [np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), size, dc, size]
    b, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], b[1:] != b[:-1]]), 0, np.concatenate([[0], k[:-1]])) if len(b) else k
    run, value = k - before - 1, blocks[b, k]
    size = _category(value)
    parts = [rows, [b, 2 * k, np.zeros(len(b), dtype=bool), (run % 16) * 16 + size, value, size]]
    long = np.repeat(np.arange(len(b)), run // 16)  # runs of 16 zeros
    none = np.zeros(len(long), dtype=np.int64)
    parts.append([b[long], 2 * k[long] - 1, np.zeros(len(long), dtype=bool), none + 0xF0, none, none])
    last = np.zeros(n, dtype=np.int64)
    np.maximum.at(last, b, k)
    short = np.flatnonzero(last < 63)
    none = np.zeros(len(short), dtype=np.int64)
    parts.append([short, none + 999, np.zeros(len(short), dtype=bool), none, none, none])
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode_jpeg(pixels: np.ndarray, quality: int) -> bytes:
    """A baseline JPEG of 8-bit gray (h x w) or RGB (h x w x 3) pixels."""
    if not 1 <= quality <= 100:
        raise ValueError("quality must be 1 to 100")
    h, w = pixels.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError("image size out of range")
    if pixels.ndim == 2:
        planes = [pixels.astype(np.float64)]
    else:
        r, g, b = (pixels[..., i].astype(np.float64) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    tables = [quantisers(LUMA, quality), quantisers(CHROMA, quality)]
    all_blocks = []
    for i, plane in enumerate(planes):
        padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        tiles = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        coefficients = DCT @ tiles @ DCT.T
        all_blocks.append(np.round(coefficients.reshape(-1, 64) / tables[min(i, 1)]).astype(np.int64)[:, ZIGZAG])
    streams = [_symbols(b) for b in all_blocks]
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00")
    for i in range(min(2, len(planes))):
        head += _segment(0xDB, bytes([i]) + bytes(tables[i][ZIGZAG].astype(np.uint8)))
    frame = struct.pack(">BHHB", 8, h, w, len(planes))
    for i in range(len(planes)):
        frame += bytes([i + 1, 0x11, min(i, 1)])
    head += _segment(0xC0, frame)
    books: dict[tuple[int, bool], tuple] = {}
    for t in range(min(2, len(planes))):
        own = streams[:1] if t == 0 else streams[1:]
        for is_dc in (True, False):
            counts = sum(np.bincount(s[3][s[2] == is_dc], minlength=256) for s in own)
            bits, symbols = _code_lengths(counts)
            books[t, is_dc] = _codes(bits, symbols)
            head += _segment(0xC4, bytes([(0 if is_dc else 16) + t]) + bytes(bits) + bytes(symbols))
    scan = bytes([len(planes)]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(len(planes))) + b"\x00\x3f\x00"
    head += _segment(0xDA, scan)

    parts = []
    for i, (block, order, is_dc, symbol, value, size) in enumerate(streams):
        code, length = np.zeros(len(symbol), dtype=np.int64), np.zeros(len(symbol), dtype=np.int64)
        for flag in (True, False):
            book, at = books[min(i, 1), flag], is_dc == flag
            code[at], length[at] = book[0][symbol[at]], book[1][symbol[at]]
        extra = np.where(value < 0, value + (1 << size) - 1, value)
        parts.append((block, np.full(len(block), i), order, (code << size) | extra, length + size))
    block, plane, order, bits, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.lexsort((order, plane, block))
    bits, size = bits[at], size[at]
    width = int(size.max())
    places = np.arange(width - 1, -1, -1)
    grid = (bits[:, None] >> places) & 1
    flat = grid[places[None, :] < size[:, None]].astype(np.uint8)
    flat = np.concatenate([flat, np.ones(-len(flat) % 8, dtype=np.uint8)])
    data = np.packbits(flat).tobytes().replace(b"\xff", b"\xff\x00")
    return head + data + b"\xff\xd9"


class JpegFault(ValueError):
    """A JPEG that can't be decoded here."""


class _Bits:
    """Entropy-coded data as bits; stuffed zeros and restart marks are out."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.held = (self.held << 8 | byte) & 0xFFFFFFFFFF
            self.n += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, book: list) -> int:
        """By a table over the next 16 bits: (symbol, length)."""
        self.need(16)
        found = book[self.held >> self.n - 16 & 0xFFFF]
        if not found[1]:
            raise JpegFault("bad code")
        self.n -= found[1]
        return found[0]

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> size - 1 else v - (1 << size) + 1


def _book(counts: bytes, symbols: bytes) -> list:
    table, code, at = [(0, 0)] * 65536, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << 16 - size
            table[first : first + (1 << 16 - size)] = [(symbols[at], size)] * (1 << 16 - size)
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_jpeg(data: bytes) -> np.ndarray:
    """Gray or RGB pixels of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise JpegFault("not a JPEG")
    quant, books, parts, at, interval, transform = {}, {}, [], 2, 0, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                kind = ">u2" if wide else "u1"
                count = 128 if wide else 64
                table = np.zeros(64)
                table[ZIGZAG] = np.frombuffer(body[i + 1 : i + 1 + count], dtype=kind)
                quant[name] = table
                i += 1 + count
        elif mark == 0xC4:
            i = 0
            while i < len(body):
                counts = body[i + 1 : i + 17]
                n = sum(counts)
                books[body[i]] = _book(counts, body[i + 17 : i + 17 + n])
                i += 17 + n
        elif mark in (0xC0, 0xC1):
            depth, height, width, count = struct.unpack_from(">BHHB", body)
            if depth != 8 or count not in (1, 3):
                raise JpegFault("unsupported JPEG")
            parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(count)]
        elif 0xC0 < mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise JpegFault("only baseline JPEGs are supported")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif mark == 0xDA:
            if not parts or body[0] != len(parts):
                raise JpegFault("unsupported scan")
            for k in range(body[0]):
                part = next(p for p in parts if p["id"] == body[1 + 2 * k])
                part["dc"], part["ac"] = body[2 + 2 * k] >> 4, 16 | body[2 + 2 * k] & 15
            return _decode_scan(data[at:], parts, quant, books, interval, height, width, transform)
    raise JpegFault("no image in JPEG")


def _decode_scan(data, parts, quant, books, interval, height, width, transform) -> np.ndarray:
    import re

    end = re.search(rb"\xff[^\x00\xd0-\xd7\xff]", data)
    data = data[: end.start()] if end else data
    runs = [r.replace(b"\xff\x00", b"\xff") for r in re.split(rb"\xff[\xd0-\xd7]", data)]
    most_h, most_v = max(p["h"] for p in parts), max(p["v"] for p in parts)
    if len(parts) == 1:
        parts[0]["h"] = parts[0]["v"] = most_h = most_v = 1
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for p in parts:
        p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64))
    bits, before = None, {}
    for unit in range(across * down):
        if unit == 0 or interval and unit % interval == 0:
            bits, before = _Bits(runs[unit // interval if interval else 0]), dict.fromkeys(range(len(parts)), 0)
        for k, p in enumerate(parts):
            dc_book, ac_book = books[p["dc"]], books[p["ac"]]
            for v in range(p["v"]):
                for h in range(p["h"]):
                    block = p["blocks"][unit // across * p["v"] + v, unit % across * p["h"] + h]
                    before[k] += bits.value(bits.symbol(dc_book))
                    block[0] = before[k]
                    i = 1
                    while i < 64:
                        s = bits.symbol(ac_book)
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15:
                            if i > 63:
                                raise JpegFault("bad run")
                            block[ZIGZAG[i]] = bits.value(s & 15)
                        i += 1
    planes = []
    for p in parts:
        tiles = DCT.T @ (p["blocks"] * quant[p["q"]]).reshape(*p["blocks"].shape[:2], 8, 8) @ DCT + 128
        plane = tiles.swapaxes(1, 2).reshape(tiles.shape[0] * 8, tiles.shape[1] * 8)
        planes.append(plane.repeat(most_v // p["v"], axis=0).repeat(most_h // p["h"], axis=1)[:height, :width])
    if len(planes) == 1:
        return np.clip(np.round(planes[0]), 0, 255).astype(np.uint8)
    a, b, c = planes
    if transform != 0:
        a, b, c = a + 1.402 * (c - 128), a - 0.344136 * (b - 128) - 0.714136 * (c - 128), a + 1.772 * (b - 128)
    return np.clip(np.round(np.stack([a, b, c], axis=2)), 0, 255).astype(np.uint8)
