"""Pixel and page geometry as column expressions. Rounding is floor(x + 0.5), integer division truncates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def div(a: Column, b: Column) -> Column:
    """Integer division of numbers that are not negative."""
    return F.floor(a / b).cast("long")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer gray (77 R + 150 G + 29 B) >> 8."""
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rounded 0.299 R + 0.587 G + 0.114 B."""
    return rounded(0.299 * r + 0.587 * g + 0.114 * b)


def flattened(gray: Column, background: Column) -> Column:
    """Gray by its background level, 255 at most; a level of 0 changes nothing."""
    return F.when(background == 0, gray).otherwise(F.least(F.lit(255), div(gray * 255, background)))


def page_points(pixels: Column, dpi: Column) -> Column:
    return pixels * 72.0 / dpi


def bilinear(p00: Column, p10: Column, p01: Column, p11: Column, fx: Column, fy: Column) -> Column:
    """Value between four neighbours, rounded."""
    return rounded((p00 * (1 - fx) + p10 * fx) * (1 - fy) + (p01 * (1 - fx) + p11 * fx) * fy)


def unclip_pad(area: Column, w: Column, h: Column, by: float = 1.5) -> Column:
    return rounded(area * by / (2 * (w + h)))


def detection_side(side: Column, longest: Column, limit: int = 960, step: int = 32) -> Column:
    """A side scaled so that the longest is ``limit`` at most, as a multiple of ``step``, one step at least."""
    scaled = side * F.least(F.lit(1.0), limit / longest)
    return F.greatest(F.lit(step), rounded(scaled / step).cast("int") * step)


def recognition_width(w: Column, h: Column, height: int = 48, least: int = 4, most: int = 3200) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(height * w / h).cast("int")))


def upper_median(values: Column) -> Column:
    """sorted[n / 2] of an array; null of an empty one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def baseline_ratio(bottoms: Column, top: Column, height: Column, cjk: Column) -> Column:
    """Where a word's baseline is in its box: from its glyphs' bottoms, within 0.5 and 1; without glyphs 0.85 if CJK, else 0.75."""
    return F.when(F.size(bottoms) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.5), (upper_median(bottoms) - top) / height))).otherwise(F.when(cjk, 0.85).otherwise(0.75))


def text_matrix(x: Column, y: Column, w: Column, h: Column, length: Column, scale_x: Column, scale_y: Column, page_height: Column, baseline: Column, natural: Column | None = None, least_size: float = 1.0) -> dict[str, Column]:
    """font_size, stretch, tx, ty that place a word of a box invisibly over its picture.

    The natural width, where the font can't measure it, is half the font size a character.
    """
    size = F.greatest(h * scale_y, F.lit(least_size))
    wide = length * size * 0.5 if natural is None else F.coalesce(natural, length * size * 0.5)
    return {
        "font_size": size,
        "stretch": F.when(wide > 0, w * scale_x / wide).otherwise(1.0),
        "tx": x * scale_x,
        "ty": page_height - (y + h * baseline) * scale_y,
    }


def pixel_box(x0: Column, y0: Column, x1: Column, y1: Column, dpi: float) -> dict[str, Column]:
    """Box in pixels of a box in points; its sides are one pixel at least."""
    to = lambda v: rounded(v * (dpi / 72.0)).cast("long")
    return {"x": to(x0), "y": to(y0), "width": F.greatest(F.lit(1), to(x1 - x0)), "height": F.greatest(F.lit(1), to(y1 - y0))}


def polygon_box(xs: Column, ys: Column) -> dict[str, Column]:
    """Bounds of a polygon's corners, both ends counted, and the mean of its corners."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, e: a + e) / F.size(v)
    out = {"x": F.array_min(xs), "y": F.array_min(ys)}
    return out | {"width": F.array_max(xs) - out["x"] + 1, "height": F.array_max(ys) - out["y"] + 1, "centre_x": mean(xs), "centre_y": mean(ys)}


def unclipped(min_x: Column, min_y: Column, max_x: Column, max_y: Column, pad: Column, map_width: int, map_height: int, scale_x: float, scale_y: float) -> dict[str, Column]:
    """A component's extents widened by ``pad`` within the map, as a box of the source picture."""
    left, top = F.greatest(F.lit(0), min_x - pad), F.greatest(F.lit(0), min_y - pad)
    right, bottom = F.least(F.lit(map_width - 1), max_x + pad), F.least(F.lit(map_height - 1), max_y + pad)
    to = lambda v, scale: rounded(v * scale).cast("long")
    return {"x": to(left, scale_x), "y": to(top, scale_y), "width": to(right - left + 1, scale_x), "height": to(bottom - top + 1, scale_y)}
