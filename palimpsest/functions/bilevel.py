"""Bilevel (JBIG2) generic regions by arithmetic coding, as embedded in documents:
a page segment and one generic region, template 0, with typical prediction."""

from __future__ import annotations

import struct

import numpy as np

#: The standard's probability states: Qe, next if more probable,
#: next if less probable, whether the sense switches.
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)
#: Fixed value: the context of the typical-prediction bit in template 0.
TYPICAL = 0x9B25


class Encoder:
    """The arithmetic encoder; contexts are (state, sense) held by number."""

    def __init__(self):
        self.state: dict[int, int] = {}
        self.a, self.c, self.ct = 0x8000, 0, 12
        self.out = bytearray(b"\x00")

    def put(self, context: int, bit: int) -> None:
        held = self.state.get(context, 0)
        index, sense = held >> 1, held & 1
        qe, more, less, switch = STATES[index]
        self.a -= qe
        if bit == sense:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            index = more
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            sense ^= switch
            index = less
        self.state[context] = index << 1 | sense
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c &= 0xFFFFF
            self.ct = 7
        else:
            self.out.append(self.c >> 19)
            self.c &= 0x7FFFF
            self.ct = 8

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        if self.out[-1] != 0xFF:
            self.out.append(0xFF)
        self.out.append(0xAC)
        return bytes(self.out[1:])


class Decoder:
    """The encoder's inverse."""

    def __init__(self, data: bytes):
        self.data, self.at, self.state = data + b"\xff\xff", 0, {}
        self.c = self.data[0] << 16
        self.ct = 0
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        if self.data[self.at] == 0xFF:
            if self.at + 1 >= len(self.data) or self.data[self.at + 1] > 0x8F:
                self.c += 0xFF00
                self.ct = 8
                return
            self.at += 1
            self.c += self.data[self.at] << 9
            self.ct = 7
        else:
            self.at += 1
            self.c += (self.data[self.at] if self.at < len(self.data) else 0xFF) << 8
            self.ct = 8

    def get(self, context: int) -> int:
        held = self.state.get(context, 0)
        index, sense = held >> 1, held & 1
        qe, more, less, switch = STATES[index]
        self.a -= qe
        if (self.c >> 16) < qe:
            likely = self.a < qe
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return sense
            likely = self.a >= qe
        bit = sense if likely else 1 - sense
        if likely:
            index = more
        else:
            sense ^= switch
            index = less
        self.state[context] = index << 1 | sense
        while not self.a & 0x8000:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c = (self.c << 1) & 0xFFFFFFFF
            self.ct -= 1
        return bit


def _contexts(up2: list[int], up1: list[int]):
    """Windows of the two rows above, without the current row's bits."""
    w = len(up1)
    high, low = [0, *up2, 0], [0, 0, *up1, 0, 0]
    # template 0 with its usual adaptive pixels: 4 + 7 + 4 bits with one each of
    # (3,-1), (-3,-1), (2,-2), (-2,-2)
    high2, low3 = [0, *high, 0], [0, *low, 0]
    return [
        (
            high2[x] << 15 | high2[x + 1] << 14 | high2[x + 2] << 13 | high2[x + 3] << 12 | high2[x + 4] << 11
            | low3[x] << 10 | low3[x + 1] << 9 | low3[x + 2] << 8 | low3[x + 3] << 7 | low3[x + 4] << 6 | low3[x + 5] << 5 | low3[x + 6] << 4
        )
        for x in range(w)
    ]


def _coded_rows(mask: np.ndarray) -> bytes:
    enc = Encoder()
    h, w = mask.shape
    zero = [0] * w
    up2, up1, typical = zero, zero, 0
    for y in range(h):
        row = mask[y].astype(int).tolist()
        same = int(row == up1)
        enc.put(TYPICAL, same ^ typical)
        typical = same
        if not same:
            past = 0
            for bit, above in zip(row, _contexts(up2, up1), strict=True):
                enc.put(above | past, bit)
                past = (past << 1 | bit) & 0xF
        up2, up1 = up1, row
    return enc.finish()


def decode_generic(data: bytes) -> np.ndarray:
    """The mask of a stream of ``encode_generic``."""
    w, h = struct.unpack_from(">II", data, 11)
    start = 11 + 19 + 11
    body = data[start:]
    dec = Decoder(body[26:])
    out = np.zeros((h, w), dtype=bool)
    zero = [0] * w
    up2, up1, typical = zero, zero, 0
    for y in range(h):
        typical ^= dec.get(TYPICAL)
        if typical:
            row = up1
        else:
            row, past = [], 0
            for above in _contexts(up2, up1):
                bit = dec.get(above | past)
                row.append(bit)
                past = (past << 1 | bit) & 0xF
        out[y] = row
        up2, up1 = up1, row
    return out


def encode_generic(mask: np.ndarray) -> bytes:
    """Embedded stream of a boolean mask, True is black."""
    if mask.ndim != 2 or mask.dtype != bool:
        raise ValueError("a mask of one bit a pixel is needed")
    h, w = mask.shape
    if not h or not w:
        raise ValueError("empty mask")
    page = struct.pack(">IIIIBH", w, h, 0, 0, 0, 0)
    region = struct.pack(">IIIIB", w, h, 0, 0, 0) + bytes([0x08]) + struct.pack(">8b", 3, -1, -3, -1, 2, -2, -2, -2) + _coded_rows(mask)
    head = lambda number, kind, size: struct.pack(">IBBBI", number, kind, 0, 1, size)
    return head(0, 48, len(page)) + page + head(1, 38, len(region)) + region
