"""Page outputs from a stream and, on the raster path, a rendered bitmap.

A bitmap is a height x width x 3 or 4 array of 8-bit pixels.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np

from palimpsest.functions import bilevel, content, images, jpeg, raster
from palimpsest.sources.pdf_syntax import Document, Stream, SyntaxFault

#: (page document, page index, dpi) -> bitmap
Renderer = Callable[[bytes, int, int], np.ndarray]


def redacted_images(doc: Document, data: bytes, streams: dict[str, Stream], parity: bool = False) -> dict[str, dict]:
    """Images that white rectangles cover, whitened there.

    An image drawn several times is whitened under the rectangles of all its
    placements; with parity only the last one's count."""
    masks = content.white_rects(data)
    out: dict[str, tuple] = {}
    for name, _, placed in content.placements(data) if masks else ():
        if name not in streams:
            continue
        before = None if parity or name not in out else out[name][0]
        found = images.redact(doc, streams[name], masks, placed, before)
        if found:
            out[name] = found
    return {name: images.encode_image(*found) for name, found in out.items()}


def text_outlines(doc: Document, data: bytes, fonts: dict, streams: dict[str, Stream], mode: str, parity: bool = False) -> dict[str, Any]:
    """The page with its text as outlines; bw forces black or white."""
    return {
        "kind": "text_masked", "content": content.outlines(data, fonts, mode == "bw"),
        "images": redacted_images(doc, data, streams, parity), "regions": [],
    }


def text_masked(doc: Document, data: bytes, streams: dict[str, Stream], bitmap: np.ndarray, width: float, height: float, parity: bool = False) -> dict[str, Any]:
    """The page without its text, and the text's bilevel regions."""
    mask = raster.text_mask(bitmap)
    regions = []
    for x, y, w, h in raster.text_boxes(mask):
        part = raster.crop(mask, x, y, w, h)
        if part.size:
            sx, sy = width / bitmap.shape[1], height / bitmap.shape[0]
            box = (x * sx, height - (y + h) * sy, (x + w) * sx, height - y * sy)
            regions.append({"data": bilevel.encode_generic(part), "box": box, "w": part.shape[1], "h": part.shape[0]})
    return {"kind": "text_masked", "content": content.strip_text(data), "images": redacted_images(doc, data, streams, parity), "regions": regions}


def bw_mask(bitmap: np.ndarray) -> dict[str, Any]:
    """The whole page as one bilevel mask."""
    return {"kind": "bw_mask", "mask": bilevel.encode_generic(raster.text_mask(bitmap)), "w": bitmap.shape[1], "h": bitmap.shape[0]}


def layered(bitmap: np.ndarray, mode: str, bg_quality: int, fg_quality: int) -> dict[str, Any]:
    """Mask, foreground and background of the whole page, both at full size."""
    pixels = raster.to_gray(bitmap) if mode == "grayscale" else np.ascontiguousarray(bitmap[..., :3])
    return {
        "kind": "mrc", "mask": bilevel.encode_generic(raster.text_mask(bitmap)), "fg": jpeg.encode_jpeg(pixels, fg_quality),
        "bg": jpeg.encode_jpeg(pixels, bg_quality), "w": bitmap.shape[1], "h": bitmap.shape[0], "space": "DeviceGray" if mode == "grayscale" else "DeviceRGB",
    }


def from_bitmap(doc: Document, data: bytes, streams: dict[str, Stream], bitmap: np.ndarray, width: float, height: float, mode: str, settings: dict) -> dict[str, Any]:
    """The raster path: bw one mask; else masked text, or layers if that fails."""
    if mode == "bw":
        return bw_mask(bitmap)
    try:
        return text_masked(doc, data, streams, bitmap, width, height)
    except SyntaxFault:
        return layered(bitmap, mode, settings["bg_quality"], settings["fg_quality"])
