"""Affine matrices and boxes as Column expressions.

A matrix is a struct of six numbers a..f acting on row vectors; a box is a struct
x_min, y_min, x_max, y_max. Pages measure y upwards, bitmaps downwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATRIX = ("a", "b", "c", "d", "e", "f")
WHITE_TOLERANCE = 1e-6


def matrix(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip(MATRIX, values, strict=True)])


def identity(kind: str = "double") -> Column:
    return matrix(*[F.lit(v).cast(kind) for v in (1, 0, 0, 1, 0, 0)])


def multiply(m: Column, n: Column) -> Column:
    """m x n: points go through m first."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"],
        m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"],
        m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"],
        m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def product(matrices: Column, kind: str = "double") -> Column:
    """The ordered product of an array of matrices, from the identity."""
    return F.aggregate(matrices, identity(kind), multiply)


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(x_min.alias("x_min"), y_min.alias("y_min"), x_max.alias("x_max"), y_max.alias("y_max"))


def rect_box(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Hull of the rectangle's four corners after m."""
    xs = [px * m["a"] + py * m["c"] + m["e"] for px in (x, x + w) for py in (y, y + h)]
    ys = [px * m["b"] + py * m["d"] + m["f"] for px in (x, x + w) for py in (y, y + h)]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def unit_box(m: Column) -> Column:
    """Hull of the unit square after m: where an image lands."""
    return rect_box(m, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))


def pixel_to_page(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, bitmap_w: Column, bitmap_h: Column) -> Column:
    """Page box of a pixel rectangle; NULL where a bitmap dimension is 0."""
    sx, sy = page_w / bitmap_w, page_h / bitmap_h
    found = box(x * sx, page_h - (y + h) * sy, (x + w) * sx, page_h - y * sy)
    return F.when((bitmap_w > 0) & (bitmap_h > 0), found)


def page_to_pixels(target: Column, placed: Column, width: Column, height: Column) -> Column:
    """Pixels (x, y, w, h) of an image placed at ``placed`` that a page box
    covers, outwards to whole pixels and clamped; NULL where it covers none."""
    pw, ph = placed["x_max"] - placed["x_min"], placed["y_max"] - placed["y_min"]
    side = lambda v, size: F.least(F.greatest(v, F.lit(0.0)), size.cast("double"))
    left = F.floor(side((target["x_min"] - placed["x_min"]) / pw * width, width))
    right = F.ceil(side((target["x_max"] - placed["x_min"]) / pw * width, width))
    top = F.floor(side((placed["y_max"] - target["y_max"]) / ph * height, height))
    bottom = F.ceil(side((placed["y_max"] - target["y_min"]) / ph * height, height))
    found = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when((pw > 0) & (ph > 0) & (right > left) & (bottom > top), found)


def overlaps(a: Column, b: Column) -> Column:
    """Strict: boxes that only touch do not overlap."""
    return (a["x_min"] < b["x_max"]) & (a["x_max"] > b["x_min"]) & (a["y_min"] < b["y_max"]) & (a["y_max"] > b["y_min"])


def gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(F.lit(0), b_low - a_high, a_low - b_high)


def nearby(a: Column, b: Column, distance) -> Column:
    """Gap at most distance on both axes."""
    gx = gap(a["x_min"], a["x_max"], b["x_min"], b["x_max"])
    gy = gap(a["y_min"], a["y_max"], b["y_min"], b["y_max"])
    return (gx <= distance) & (gy <= distance)


def is_white(space: Column, c: Column) -> Column:
    """White fill within the tolerance: gray 1, rgb 1 1 1, cmyk 0 0 0 0."""
    near = lambda i, v: F.abs(F.get(c, i) - v) < WHITE_TOLERANCE
    return (
        F.when(space == "gray", near(0, 1.0))
        .when(space == "rgb", near(0, 1.0) & near(1, 1.0) & near(2, 1.0))
        .when(space == "cmyk", near(0, 0.0) & near(1, 0.0) & near(2, 0.0) & near(3, 0.0))
        .otherwise(False)
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def black_or_white(lum: Column) -> Column:
    return F.when(lum >= 0.5, 1).otherwise(0)
