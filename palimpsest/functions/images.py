"""Images of a page: decode, redact, encode. numpy arrays are height x width
(gray) or height x width x 3."""

from __future__ import annotations

import math
import zlib

import numpy as np

from palimpsest.functions.content import Box, overlap
from palimpsest.functions.jpeg import decode_jpeg, encode_jpeg
from palimpsest.sources.pdf_syntax import Document, Name, Stream, SyntaxFault

REDACTED_QUALITY = 85


def image_meta(doc: Document, stream: Stream) -> dict:
    """width, height, bits (8), space (DeviceRGB unless a name), first filter."""
    d = {k: doc.get(v) for k, v in stream.dict.items()}
    for key in ("Width", "Height"):
        if not isinstance(d.get(key), int) or d[key] < 0:
            raise SyntaxFault(f"image without {key}")
    space, filters = d.get("ColorSpace"), d.get("Filter")
    first = filters[0] if isinstance(filters, list) and filters else filters
    return {
        "width": d["Width"], "height": d["Height"], "bits": d.get("BitsPerComponent", 8),
        "space": str(space) if isinstance(space, Name) else "DeviceRGB", "filter": str(doc.get(first)) if first else None,
    }


def decode_image(doc: Document, stream: Stream, meta: dict) -> np.ndarray:
    """8-bit gray or RGB pixels of a raw, deflated or JPEG image."""
    if meta["filter"] == "DCTDecode":
        return decode_jpeg(doc.decoded(stream))
    if meta["filter"] == "FlateDecode":
        data = doc.decoded(stream)
    elif meta["filter"] is None:
        data = stream.raw
    else:
        raise SyntaxFault(f"unsupported image filter: {meta['filter']}")
    parts = {"DeviceRGB": 3, "DeviceGray": 1}.get(meta["space"])
    if parts is None or meta["bits"] != 8:
        raise SyntaxFault("unsupported image format")
    size = meta["width"] * meta["height"] * parts
    if len(data) < size:
        raise SyntaxFault("image data too short")
    shape = (meta["height"], meta["width"], 3) if parts == 3 else (meta["height"], meta["width"])
    return np.frombuffer(data[:size], dtype=np.uint8).reshape(shape).copy()


def covered_pixels(target: Box, placed: Box, width: int, height: int) -> tuple[int, int, int, int] | None:
    """Pixels (x, y, w, h) of an image that a page box covers, outwards."""
    pw, ph = placed[2] - placed[0], placed[3] - placed[1]
    if pw <= 0 or ph <= 0:
        return None
    clamp = lambda v, n: min(max(v, 0.0), float(n))
    left = math.floor(clamp((target[0] - placed[0]) / pw * width, width))
    right = math.ceil(clamp((target[2] - placed[0]) / pw * width, width))
    top = math.floor(clamp((placed[3] - target[3]) / ph * height, height))
    bottom = math.ceil(clamp((placed[3] - target[1]) / ph * height, height))
    return (left, top, right - left, bottom - top) if right > left and bottom > top else None


def fill_white(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> None:
    pixels[y : y + h, x : x + w] = 255


def redact(doc: Document, stream: Stream, masks: list[Box], placed: Box, pixels: np.ndarray | None = None) -> tuple[np.ndarray, dict] | None:
    """(pixels, meta) with all masks whitened, or None where none covers any;
    pixels go on from an earlier placement's."""
    hits = [m for m in masks if overlap(m, placed)]
    if not hits:
        return None
    meta = image_meta(doc, stream)
    areas = [a for m in hits if (a := covered_pixels(m, placed, meta["width"], meta["height"]))]
    if not areas:
        return None
    if pixels is None:
        pixels = decode_image(doc, stream, meta)
    for area in areas:
        fill_white(pixels, *area)
    return pixels, meta


def encode_image(pixels: np.ndarray, meta: dict) -> dict:
    """The image as it was stored: DCT, Flate or raw."""
    space = "DeviceGray" if pixels.ndim == 2 else "DeviceRGB"
    if meta["filter"] == "DCTDecode":
        data, name = encode_jpeg(pixels, REDACTED_QUALITY), "DCTDecode"
    elif meta["filter"] == "FlateDecode":
        data, name = zlib.compress(pixels.tobytes()), "FlateDecode"
    else:
        data, name = pixels.tobytes(), ""
    return {"data": data, "filter": name, "space": space, "bits": 8}


def smallest_encoding(pixels: np.ndarray, original_size: int, quality: int = 50) -> dict | None:
    """The smallest of the encodings that fit the image, if not larger than it
    was: gray images as bilevel or gray, color ones as gray (if they are) or RGB."""
    from palimpsest.functions.bilevel import encode_generic
    from palimpsest.functions.raster import otsu_mask, to_gray

    made = []
    if pixels.ndim == 2:
        made.append(("JBIG2Decode", "DeviceGray", 1, encode_generic(otsu_mask(pixels))))
        made.append(("DCTDecode", "DeviceGray", 8, encode_jpeg(pixels, quality)))
    else:
        made.append(("DCTDecode", "DeviceGray", 8, encode_jpeg(to_gray(pixels), quality))) if (pixels == pixels[..., :1]).all() else None
        made.append(("DCTDecode", "DeviceRGB", 8, encode_jpeg(pixels, quality)))
    best = min(made, key=lambda m: len(m[3]))
    if len(best[3]) > original_size:
        return None
    return dict(zip(("filter", "space", "bits", "data"), best, strict=True))
