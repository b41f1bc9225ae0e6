"""Raster kernels in numpy, and their application to pages that are one row each.

A page's picture is one binary value: its size is bounded by the scanner, and
pages are many. Kernels run where the page is; no pixel is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkspan.operators.segment import SHARE, TILE


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of radius ceil(2 sigma), edges clamped, values cut to integers after each pass."""
    r = math.ceil(2 * sigma)
    if r < 1:
        return image
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = image.astype(np.float64)
    for axis in (1, 0):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, mode="edge")
        n = out.shape[axis]
        out = np.floor(sum(w * np.take(wide, range(i, i + n), axis=axis) for i, w in enumerate(k)) + 1e-9)
    return out.astype(image.dtype)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, edges clamped, each channel rounded."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    v = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.floor(v + 0.5).astype(image.dtype)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Sampled at pixel centres."""
    h, w = image.shape[:2]
    x = (np.arange(width) + 0.5) * w / width - 0.5
    y = (np.arange(height) + 0.5) * h / height - 0.5
    return bilinear(image, *np.meshgrid(x, y))


def scale_background(image: np.ndarray, scale: float, masked: bool) -> np.ndarray:
    """Smaller by a scale within 0.1 and 1, only where a mask keeps the text sharp."""
    s = min(1.0, max(0.1, scale))
    return resize(image, max(1, round(image.shape[1] * s)), max(1, round(image.shape[0] * s))) if masked and s < 1 else image


def detection_input(image: np.ndarray, limit: int = 960) -> np.ndarray:
    """Sides of multiples of 32, the longest ``limit`` at most; channels blue, green, red, normalised; channel first."""
    h, w = image.shape[:2]
    s = min(1.0, limit / max(h, w))
    to = [max(32, int(math.floor(v * s / 32 + 0.5)) * 32) for v in (w, h)]
    # fixed values: the detector's channel means and deviations
    mean, deviation = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    return ((resize(image, *to)[..., ::-1] / 255.0 - mean) / deviation).transpose(2, 0, 1).astype(np.float32)


def recognition_input(image: np.ndarray, height: int = 48, most: int = 3200) -> np.ndarray:
    """A line of ``height``, values from -1 to 1, channel first."""
    h, w = image.shape[:2]
    width = min(most, max(4, math.ceil(height * w / h)))
    return (resize(image, width, height)[..., ::-1] / 127.5 - 1).transpose(2, 0, 1).astype(np.float32)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray | None:
    """The part of a box inside the picture; None if there is none."""
    part = image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    return part if part.size else None


def crop_oriented(image: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """A box of four corners turned upright about its centre; white beyond the picture."""
    side = lambda a, b: float(np.hypot(*(polygon[a] - polygon[b])))
    w, h = max(1, round(max(side(0, 1), side(3, 2)))), max(1, round(max(side(0, 3), side(1, 2))))
    along = polygon[1] - polygon[0]
    t = math.atan2(along[1], along[0])
    u, v = np.meshgrid(np.arange(w) - (w - 1) / 2, np.arange(h) - (h - 1) / 2)
    cx, cy = polygon.mean(axis=0)
    x, y = cx + u * math.cos(t) - v * math.sin(t), cy + u * math.sin(t) + v * math.cos(t)
    out = bilinear(image, x, y)
    out[(x < 0) | (y < 0) | (x > image.shape[1] - 1) | (y > image.shape[0] - 1)] = 255
    return out


def label(on: np.ndarray) -> np.ndarray:
    """8-connected components numbered from 1 by first appearance in raster order; 0 where ``on`` is false.

    Labels start as each pixel's place and sink to the least of the
    neighbourhood; every round also follows labels to their labels.
    """
    h, w = on.shape
    far = h * w
    now = np.where(on, np.arange(far).reshape(h, w), far)
    while True:
        wide = np.pad(now, 1, constant_values=far)
        low = np.min([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        low = np.where(on, low, far)
        flat = np.append(low.reshape(-1), far)
        flat = flat[flat]
        low = np.where(on, flat[:-1].reshape(h, w), far)
        if (low == now).all():
            break
        now = low
    names = np.unique(now[on])
    out = np.zeros((h, w), np.int64)
    out[on] = np.searchsorted(names, now[on]) + 1
    return out


def levels(gray: np.ndarray, tile: int = TILE, share: float = SHARE) -> np.ndarray:
    """Background level of each tile."""
    ny, nx = -(-gray.shape[0] // tile), -(-gray.shape[1] // tile)
    out = np.zeros((ny, nx), np.int64)
    for j in range(ny):
        for i in range(nx):
            part = gray[j * tile : (j + 1) * tile, i * tile : (i + 1) * tile]
            target = int(part.size * share)
            out[j, i] = int(np.searchsorted(np.cumsum(np.bincount(part.reshape(-1), minlength=256)), target)) if target else 0
    return out


def background_surface(gray: np.ndarray, tile: int = TILE, share: float = SHARE) -> np.ndarray:
    """Background level of each pixel, between its own tile's level and the next ones'."""
    b = levels(gray, tile, share)

    def ends(n: int, m: int):
        s = np.arange(n) + tile // 2
        t0 = np.minimum(s // tile, m - 1)
        return t0, np.minimum(t0 + 1, m - 1), np.minimum(s - t0 * tile, tile - 1)

    (x0, x1, fx), (y0, y1, fy) = ends(gray.shape[1], b.shape[1]), ends(gray.shape[0], b.shape[0])
    y0, y1, fy = y0[:, None], y1[:, None], fy[:, None]
    top = b[y0, x0] * (tile - fx) + b[y0, x1] * fx
    bottom = b[y1, x0] * (tile - fx) + b[y1, x1] * fx
    return (top * (tile - fy) + bottom * fy) // (tile * tile)


def flatten_background(gray: np.ndarray, tile: int = TILE, share: float = SHARE) -> np.ndarray:
    """Each pixel by its background level, 255 at most; a level of 0 changes nothing."""
    surface = background_surface(gray, tile, share)
    return np.where(surface == 0, gray, np.minimum(255, gray * 255 // np.maximum(1, surface)))


def otsu(gray: np.ndarray) -> int:
    """The first threshold of the largest between-side variance; 0 of a page of one value."""
    n = np.bincount(gray.reshape(-1), minlength=256).astype(np.float64)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where((wb > 0) & (wf > 0), wb * wf * (sb / wb - (sb[-1] - sb) / wf) ** 2, 0.0)
    return int(var.argmax()) if var.max() > 0 else 0


def nearest_background(gray: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance (city blocks) and value of the nearest pixel that isn't ink, by two sweeps.

    Each sweep looks along columns first and rows second, forward then backward.
    Along a row what reaches a pixel is a running minimum of distance less place;
    its source is the last place at which that minimum is its own.
    """
    h, w = gray.shape
    far = 1 << 29
    dist = np.where(ink, far, 0).astype(np.int64)
    color = gray.copy()
    places = np.arange(w)
    for ys, step, turn in ((range(h), -1, slice(None)), (range(h - 1, -1, -1), 1, slice(None, None, -1))):
        for y in ys:
            if 0 <= y + step < h:
                better = dist[y + step] + 1 < dist[y]
                dist[y][better] = dist[y + step][better] + 1
                color[y][better] = color[y + step][better]
            d, c = dist[y][turn], color[y][turn]
            lead = d - places
            least = np.minimum.accumulate(lead)
            source = np.maximum.accumulate(np.where(lead <= least, places, 0))
            dist[y][turn], color[y][turn] = least + places, c[source]
    return dist, color


def inpaint(gray: np.ndarray, ink: np.ndarray, radius: int = 3) -> np.ndarray:
    """Ink replaced by the nearest background value; white beyond ``radius`` (0: no bound)."""
    dist, color = nearest_background(gray, ink)
    return np.where(dist == 0, gray, np.where((radius > 0) & (dist > radius), 255, color))


def changed_share(before: np.ndarray, after: np.ndarray, mask: np.ndarray) -> float:
    """Share of the mask's pixels that differ; 0 of no mask."""
    return float((before != after)[mask].mean()) if mask.any() else 0.0


def to_rgb(image: np.ndarray) -> np.ndarray:
    """Gray and three-channel pictures as they are; of four channels the first three over black by the fourth; else the first three times."""
    if image.ndim == 2 or image.shape[2] in (1, 3):
        return image
    if image.shape[2] == 4:
        return (image[..., :3].astype(np.int64) * image[..., 3:] // 255).astype(image.dtype)
    return np.repeat(image[..., :1], 3, axis=2)


def to_gray(image: np.ndarray) -> np.ndarray:
    """Gray by rounded luminance 0.299, 0.587, 0.114 (other than the integer luma of segmentation); a gray picture as it is."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return np.floor(to_rgb(image)[..., :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(image.dtype)


def draw_pages(rows: DataFrame, page: str, draw: Callable[[int], np.ndarray]) -> DataFrame:
    """page, width, height, gray (bytes by rows): a picture for each key."""
    kind = dict(rows.dtypes)[page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, key in enumerate(b[page].to_pylist()):
                g = draw(key)
                yield pa.RecordBatch.from_arrays([b[page].slice(i, 1), pa.array([g.shape[1]], pa.int32()), pa.array([g.shape[0]], pa.int32()), pa.array([g.astype(np.uint8).tobytes()], pa.binary())], names=[page, "width", "height", "gray"])

    return rows.select(page).mapInArrow(run, f"{page} {kind}, width int, height int, gray binary")


def map_pages(pages: DataFrame, page: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], out: str) -> DataFrame:
    """page and what ``kernel`` gives for each picture, as columns ``out``; a page is one row, so nothing is shuffled.

    Pictures are read one at a time; how many cross to Python at once is the
    session's ``spark.sql.execution.arrow.maxRecordsPerBatch``, to be set by
    their size.
    """
    kind = dict(pages.dtypes)[page]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (w, h) in enumerate(zip(b["width"].to_pylist(), b["height"].to_pylist())):
                found = kernel(np.frombuffer(b["gray"][i].as_buffer(), np.uint8).reshape(h, w).astype(np.int64))
                n = len(next(iter(found.values())))
                yield pa.RecordBatch.from_arrays([b[page].take(pa.array(np.full(n, i))), *(pa.array(v) for v in found.values())], names=[page, *found])

    return pages.select(page, "width", "height", "gray").mapInArrow(run, f"{page} {kind}, {out}")


def tile_kernel(gray: np.ndarray) -> dict[str, np.ndarray]:
    found = levels(gray)
    ty, tx = np.indices(found.shape, np.int32)
    return {"tx": tx.reshape(-1), "ty": ty.reshape(-1), "level": found.reshape(-1).astype(np.int32)}


def tile_levels(pages: DataFrame, page: str) -> DataFrame:
    """page, tx, ty, level of each tile."""
    return map_pages(pages, page, tile_kernel, "tx int, ty int, level int")


def label_pages(pages: DataFrame, page: str, threshold: int) -> DataFrame:
    """page, label, area, min_x, min_y of the components of pixels up to ``threshold``."""

    def kernel(gray: np.ndarray) -> dict[str, np.ndarray]:
        found = label(gray <= threshold)
        y, x = np.nonzero(found)
        of = found[y, x] - 1
        n = int(of.max(initial=-1)) + 1
        low = [np.full(n, 1 << 40), np.full(n, 1 << 40)]
        np.minimum.at(low[0], of, x), np.minimum.at(low[1], of, y)
        return {"label": np.arange(1, n + 1), "area": np.bincount(of, minlength=n), "min_x": low[0], "min_y": low[1]}

    return map_pages(pages, page, kernel, "label long, area long, min_x long, min_y long")


def segment_pages(pages: DataFrame, page: str, *, radius: int = 3) -> DataFrame:
    """page, threshold, foreground (pixels), background_sum, changed: threshold of the flattened page applied to the raw one, then ink inpainted; ``changed`` is the share of ink that differs after."""

    def kernel(gray: np.ndarray) -> dict[str, np.ndarray]:
        at = otsu(flatten_background(gray))
        ink = gray <= at
        clean = inpaint(gray, ink, radius)
        return {"threshold": np.array([at]), "foreground": np.array([ink.sum()]), "background_sum": np.array([clean.sum()]), "changed": np.array([changed_share(gray, clean, ink)])}

    return map_pages(pages, page, kernel, "threshold long, foreground long, background_sum long, changed double")
