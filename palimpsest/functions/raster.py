"""Segmentation of rendered pages in numpy: gray, threshold, text mask, boxes."""

from __future__ import annotations

import numpy as np

from palimpsest.operators.boxes import merge_near

LEAST_SIDE = 4
MERGE_DISTANCE = 5


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """8-bit gray of RGB(A) pixels."""
    rgb = pixels[..., :3].astype(np.float64)
    return np.round(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def otsu_threshold(gray: np.ndarray) -> int:
    """The threshold with the largest variance between the two sides."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(counts)
    above = below[-1] - below
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    spread = np.nan_to_num(spread)
    if not spread.any():  # one gray level alone: split at mid-gray
        return 127
    return int(spread.argmax())


def otsu_mask(gray: np.ndarray, tile: int = 2000) -> np.ndarray:
    """True where dark, thresholded tile by tile (sides 16 to 2000)."""
    tile = min(max(tile, 16), 2000)
    out = np.zeros(gray.shape, dtype=bool)
    for y in range(0, gray.shape[0], tile):
        for x in range(0, gray.shape[1], tile):
            part = gray[y : y + tile, x : x + tile]
            out[y : y + tile, x : x + tile] = part <= otsu_threshold(part)
    return out


def components(mask: np.ndarray, eight: bool = False) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the connected components, by union of runs."""
    parent: list[int] = []
    box: list[list[int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if eight else 0
    above: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        here, k = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            label = len(parent)
            parent.append(label)
            box.append([a, y, b, y + 1])
            while k < len(above) and above[k][1] + reach <= a:
                k += 1
            i = k
            while i < len(above) and above[i][0] < b + reach:
                r, s = find(above[i][2]), find(label)
                if r != s:
                    parent[s] = r
                    box[r] = [min(box[r][0], box[s][0]), min(box[r][1], box[s][1]), max(box[r][2], box[s][2]), max(box[r][3], box[s][3])]
                i += 1
            here.append((a, b, label))
        above = here
    return [(b[0], b[1], b[2] - b[0], b[3] - b[1]) for i, b in enumerate(box) if parent[i] == i]


def text_boxes(mask: np.ndarray, distance: int = MERGE_DISTANCE) -> list[tuple[int, int, int, int]]:
    """Component boxes of at least LEAST_SIDE a side, near ones merged."""
    return merge_near([b for b in components(mask) if b[2] >= LEAST_SIDE and b[3] >= LEAST_SIDE], distance)


def text_mask(pixels: np.ndarray) -> np.ndarray:
    """Dark pixels that look like text lines: components no taller than a tenth
    of the page and not filling it as halftones do."""
    dark = otsu_mask(to_gray(pixels))
    out = np.zeros_like(dark)
    tall = max(64, dark.shape[0] // 10)
    for x, y, w, h in components(dark, eight=True):
        if h <= tall and not (w > 4 * tall and h > tall // 2):
            out[y : y + h, x : x + w] |= dark[y : y + h, x : x + w]
    return out


def crop(mask: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of the mask inside the box, clipped."""
    return mask[max(y, 0) : y + h, max(x, 0) : x + w]


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    err = ((a.astype(np.float64) - b.astype(np.float64)) ** 2).mean()
    return float("inf") if err == 0 else 10 * np.log10(255**2 / err)
