"""Separable resampling of images by tables of weights, and the small grey signals that motion is measured on.

A table has, for each output cell, the weights of the input cells under a filter as wide as the reduction, in units of
2^-22. Rows are resampled first, then columns, each rounded to 0..255, so results are whole numbers that don't depend on the machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framequill.operators.images import grey, lists_of, pieces, stacks
from framequill.session import ship, small_batches

ship(__name__)

UNIT = 1 << 22
#: Side of a motion signal at most; how much larger than its result an image stays when it is first averaged in whole blocks.
SIDE, GAP = 160, 2.0


def triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


FILTERS = {"bilinear": (triangle, 1.0), "lanczos": (lanczos, 3.0)}


@lru_cache(maxsize=256)
def table(size: int, low: float, high: float, out: int, kind: str) -> np.ndarray:
    """Weights [out, size] with which the stretch low..high of ``size`` cells becomes ``out`` cells."""
    shape, reach = FILTERS[kind]
    scale = (high - low) / out
    wide = max(scale, 1.0)
    weights = np.zeros((out, size))
    for i in range(out):
        centre = low + (i + 0.5) * scale
        first, last = max(int(centre - reach * wide + 0.5), 0), min(int(centre + reach * wide + 0.5), size)
        at = np.arange(first, last)
        own = shape((at + 0.5 - centre) / wide)
        weights[i, first:last] = own / own.sum()
    return np.sign(weights) * np.floor(np.abs(weights) * UNIT + 0.5)


def resampled(images: np.ndarray, height: int, width: int, kind: str = "bilinear", box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """Integer images [n, h, w] as [n, height, width]; ``box`` (left, top, right, bottom) is the part shown."""
    h, w = images.shape[1:]
    left, top, right, bottom = box or (0.0, 0.0, float(w), float(h))
    whole = lambda x: np.clip((x.astype(np.int64) + UNIT // 2) >> 22, 0, 255)
    if (left, right, width) != (0, w, w):
        images = whole(images.astype(float) @ table(w, left, right, width, kind).T)
    if (top, bottom, height) != (0, h, h):
        images = whole(np.einsum("oh,nhw->now", table(h, top, bottom, height, kind), images.astype(float)))
    return images.astype(np.int64)


def averaged(images: np.ndarray, across: int, down: int) -> np.ndarray:
    """Means of whole blocks, rounded half up; what is left at the right and the bottom has blocks of its own."""
    h, w = images.shape[1:]
    sums = np.add.reduceat(np.add.reduceat(images.astype(np.int64), np.arange(0, h, down), axis=1), np.arange(0, w, across), axis=2)
    n = np.minimum(down, h - np.arange(0, h, down))[:, None] * np.minimum(across, w - np.arange(0, w, across))[None, :]
    return (sums + n // 2) // n


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """The size with both sides at most ``most`` whose ratio is closest to the image's; smaller images keep theirs."""
    if max(width, height) <= most:
        return width, height
    ratio = width / height

    def near(x: float, off) -> int:
        return max(min(int(np.floor(x)), int(np.ceil(x)), key=off), 1)

    if ratio <= 1:
        return near(most * ratio, lambda n: abs(ratio - n / most)), most
    return most, near(most / ratio, lambda n: 0 if n == 0 else abs(ratio - most / n))


def thumbnails(images: np.ndarray, most: int = SIDE) -> np.ndarray:
    """Images [n, h, w] reduced to at most ``most`` a side, first by whole blocks as long as ``GAP`` times the result is left."""
    h, w = images.shape[1:]
    width, height = fitted(w, h, most)
    if (width, height) == (w, h):
        return images.astype(np.int64)
    across, down = int(w / width / GAP) or 1, int(h / height / GAP) or 1
    box = (0.0, 0.0, w / across, h / down)
    return resampled(averaged(images, across, down) if across * down > 1 else images, height, width, "bilinear", box)


def signals(
    frames: DataFrame, width: str, px: str, box: tuple[int, int, int, int] | None = None, channels: int = 1, most: int = SIDE,
    name: str = "signal", scale: str | None = None, enlarge: bool = False, blocks: int | None = None,
) -> DataFrame:
    """Adds ``name`` (array<int>) and ``<name>_width``: the grey frame's box (x, y, width, height), reduced to at most ``most`` a side.

    ``scale`` names a filter ("lanczos", "bilinear") that resamples at once to the rounded size by most / longer side,
    as for contact sheets, instead of the block means of a motion signal; with ``enlarge`` also beyond the frame's own size. ``blocks``
    takes means of blocks of so many cells a side and nothing else. A frame that is null, has nulls, or doesn't hold the
    box, gives null.
    """
    kind = f"{name} array<int>, {name}_width int"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", " + kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, px):
            shown: list[np.ndarray | None] = [None] * batch.num_rows
            wide: list[int | None] = [None] * batch.num_rows
            for rows, held in stacks(batch, width, {px: channels}):
                images = held[px]
                if images is None:
                    continue
                images = grey(images) if channels > 1 else images.astype(np.int64)
                x, y, w, h = box or (0, 0, images.shape[2], images.shape[1])
                if min(x, y) < 0 or min(w, h) < 1 or x + w > images.shape[2] or y + h > images.shape[1]:
                    continue
                images = images[:, y : y + h, x : x + w]
                if blocks:
                    images = averaged(images, blocks, blocks)
                elif scale:
                    ratio = most / max(w, h) if enlarge else min(1.0, most / max(w, h))
                    images = resampled(images, max(1, round(h * ratio)), max(1, round(w * ratio)), scale)
                else:
                    images = thumbnails(images, most)
                for r, image in zip(rows, images):
                    shown[r], wide[r] = image, image.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(shown, pa.int32()), pa.array(wide, pa.int32())], [*batch.schema.names, name, f"{name}_width"])

    small_batches(frames.sparkSession)
    return frames.mapInArrow(run, schema)


def displaced(images: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Integer images [n, h, w], each moved by its own way, between pixels by their distance; edges go on outwards."""
    n, h, w = images.shape
    x, y = np.arange(w) - dx[:, None], np.arange(h) - dy[:, None]
    left, top = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = (x - left)[:, None, :], (y - top)[:, :, None]

    def corner(a: int, b: int) -> np.ndarray:
        return images[np.arange(n)[:, None, None], np.clip(top + b, 0, h - 1)[:, :, None], np.clip(left + a, 0, w - 1)[:, None, :]]

    return np.rint((corner(0, 0) * (1 - fx) + corner(1, 0) * fx) * (1 - fy) + (corner(0, 1) * (1 - fx) + corner(1, 1) * fx) * fy).astype(np.int64)


def moved(frames: DataFrame, width: str, px: str, dx: str, dy: str, name: str = "moved") -> DataFrame:
    """Adds ``name`` (array<int>): the grey frame moved by the doubles ``dx`` and ``dy``; null for a frame or a way that is null or has nulls."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + f", {name} array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, px):
            shown: list[np.ndarray | None] = [None] * batch.num_rows
            way_x, way_y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in (dx, dy))
            for rows, held in stacks(batch, width, {px: 1}):
                if held[px] is None:
                    continue
                known = np.isfinite(way_x[rows]) & np.isfinite(way_y[rows])
                for r, image in zip(rows[known], displaced(held[px][known].astype(np.int64), way_x[rows[known]], way_y[rows[known]])):
                    shown[r] = image
            yield pa.RecordBatch.from_arrays([*batch.columns, lists_of(shown, pa.int32())], [*batch.schema.names, name])

    small_batches(frames.sparkSession)
    return frames.mapInArrow(run, schema)
