"""Batches of equally large images as numpy arrays, and what kernels over them share: sampling, smoothing, grey values.

Images are row-major arrays in a column with their width beside them, channels interleaved. Rows of one shape are worked on
together, in groups of a bounded number of pixels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from framequill.session import ship, tidy

ship(__name__)

#: Pixels that one step of a kernel holds.
PIXELS = 1 << 20
#: Weights of red, green and blue in a grey value, of 2^16.
GREY = (19595, 38470, 7471)


def stacks(batch: pa.RecordBatch, width: str, columns: dict[str, int], pixels: int = PIXELS) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray | None]]]:
    """(row numbers, name -> array [n, h, w] or [n, h, w, channels]) for rows whose columns (name -> channels) have one size.

    Rows with a null, an element that is null, a width below one or sizes that don't go together come with None for all columns.
    """
    names = list(columns)
    lists = [batch.column(batch.schema.get_field_index(n)) for n in names]
    widths = np.asarray(batch.column(batch.schema.get_field_index(width)).fill_null(0)).astype(np.int64)
    sizes = np.stack([np.asarray(c.value_lengths().fill_null(-1)).astype(np.int64) for c in lists])
    area = sizes[0] // columns[names[0]]
    fits = (widths > 0) & (area > 0) & (area % np.maximum(widths, 1) == 0)
    for own, name in zip(sizes, names):
        fits &= own == area * columns[name]
    starts = []
    for i, c in enumerate(lists):
        flat = c.flatten()
        starts.append(np.cumsum(np.maximum(sizes[i], 0)) - np.maximum(sizes[i], 0))
        if flat.null_count:
            hole = np.asarray(flat.is_null()).cumsum()
            hole = np.concatenate([[0], hole])
            fits &= hole[starts[i] + np.maximum(sizes[i], 0)] == hole[starts[i]]
    if not fits.all():
        yield np.flatnonzero(~fits), dict.fromkeys(names)
    values = [pa.compute.fill_null(f, pa.scalar(0).cast(f.type)).to_numpy(zero_copy_only=False) for f in (c.flatten() for c in lists)]
    shape = widths * (1 << 32) + area
    for kind in np.unique(shape[fits]):
        rows = np.flatnonzero(fits & (shape == kind))
        w, n = int(kind >> 32), int(kind & ((1 << 32) - 1))
        step = max(1, pixels // n)
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            held = {}
            for name, flat, begin in zip(names, values, starts):
                c = columns[name]
                held[name] = np.stack([flat[begin[r] : begin[r] + n * c] for r in own]).reshape((len(own), n // w, w) + ((c,) if c > 1 else ()))
            yield own, held


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIXELS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the arrays of a piece have about ``most`` values in ``column`` together, however many rows a batch has."""
    try:
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(column)).value_lengths().fill_null(0)
            group = np.cumsum(np.asarray(lengths, dtype=np.int64)) // most
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
    finally:
        tidy()


def lists_of(rows: Sequence[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """A column of flattened arrays, null for None."""
    flat = [np.zeros(0) if r is None else r.ravel() for r in rows]
    ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0)).cast(kind, safe=False)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.array([*(r is None for r in rows), False])), values)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Grey values 0..255 of integer colours, rounded."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return (r * GREY[0] + g * GREY[1] + b * GREY[2] + (1 << 15)) >> 16


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond an edge come back from it, the edge itself not repeated."""
    if n == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * (n - 1))
    return np.where(at >= n, 2 * (n - 1) - at, at)


def sampled(images: np.ndarray, x: np.ndarray, y: np.ndarray, border: str = "mirror") -> np.ndarray:
    """Images [n, h, w(, c)] at places [n, h', w'], between pixels by their distance; outside mirrored or zero."""
    n, h, w = images.shape[:3]
    left, top = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - left, y - top
    which = np.arange(n).reshape((n,) + (1,) * (x.ndim - 1))
    total = 0.0
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            col, row, weight = left + dx, top + dy, wx * wy
            if border == "zero":
                weight = weight * ((col >= 0) & (col < w) & (row >= 0) & (row < h))
                col, row = np.clip(col, 0, w - 1), np.clip(row, 0, h - 1)
            else:
                col, row = mirrored(col, w), mirrored(row, h)
            part = images[which, row, col]
            total = total + part * (weight[..., None] if part.ndim > weight.ndim else weight)
    return total


def filtered(images: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Images [n, h, w] under a row kernel and a column kernel of odd lengths, edges mirrored."""
    for kernel, axis in ((across, 2), (down, 1)):
        r, n = len(kernel) // 2, images.shape[axis]
        at = mirrored(np.arange(-r, n + r), n)
        wide = np.take(images, at, axis=axis)
        images = sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))
    return images


def bell(radius: int, sigma: float) -> np.ndarray:
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    return kernel / kernel.sum()
