"""Dense two-way optical flow and the frames of a bridge made from it.

Flow comes from polynomial expansion (Farneback, 2003): around each pixel the image is a quadratic x'Ax + b'x + c by weighted
least squares, a shift d turns b into b - 2Ad, and d is solved for over a window, from coarse to fine. A bridge's frame takes
its colours from one side only, the nearer one, so that nothing is faded over something else: its map m satisfies
m(x) = x - t f(m(x)), found by fixed-point steps.

Refusals: ``input`` (a null, sizes that don't go together), ``count`` (not 1 to 8 frames), ``covered`` (motion cells of either end that are not
fully covered), ``trip`` (95th percentile of the way there and back above 1.5 pixels), ``residual`` (mean difference after warping above
12), ``far`` (95th percentile of displacement above 8 % of the shorter side), ``map`` (a fold or a place outside), ``exposed``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framequill.operators.images import bell, filtered, grey, lists_of, mirrored, pieces, sampled, stacks
from framequill.session import ship, small_batches

ship(__name__)

LEVELS, WINDOW, ROUNDS, RADIUS, SIGMA, FIXED_POINT = 4, 21, 5, 3, 1.5, 5
#: The limits of a bridge.
MOST_FRAMES, OPAQUE, TRIP, RESIDUAL, FAR = 8, 250, 1.5, 12.0, 0.08


@lru_cache(maxsize=8)
def basis(radius: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """The one-dimensional weight, and the inverse Gram matrix of 1, x, y, x^2, y^2, xy under the two-dimensional one."""
    weight, at = bell(radius, sigma), np.arange(-radius, radius + 1.0)
    y, x = np.meshgrid(at, at, indexing="ij")
    rows = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y]).reshape(6, -1)
    return weight, np.linalg.inv((rows * np.outer(weight, weight).ravel()) @ rows.T)


def expansion(images: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """(A [n, h, w, 2, 2], b [n, h, w, 2]) of images [n, h, w]."""
    weight, inverse = basis(radius, sigma)
    at = np.arange(-radius, radius + 1.0)
    zero, one, two = weight, weight * at, weight * at * at
    sums = np.stack([filtered(images, a, d) for a, d in ((zero, zero), (one, zero), (zero, one), (two, zero), (zero, two), (one, one))], axis=-1)
    c = sums @ inverse.T
    quadratic = np.stack([c[..., 3], c[..., 5] / 2, c[..., 5] / 2, c[..., 4]], axis=-1).reshape(*c.shape[:-1], 2, 2)
    return quadratic, c[..., 1:3]


def boxed(values: np.ndarray, size: int) -> np.ndarray:
    """Sums over a window of [n, h, w, k], edges mirrored."""
    r = size // 2
    for axis in (1, 2):
        n = values.shape[axis]
        wide = np.take(values, mirrored(np.arange(-r - 1, n + r), n), axis=axis)
        total = np.cumsum(wide, axis=axis)
        values = np.take(total, np.arange(2 * r + 1, n + 2 * r + 1), axis=axis) - np.take(total, np.arange(n), axis=axis)
    return values


def refined(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], flow: np.ndarray, window: int) -> np.ndarray:
    """A better displacement [n, h, w, 2] (x, y) from the expansions of both images and a first one."""
    h, w = flow.shape[1:3]
    y, x = np.mgrid[:h, :w].astype(float)
    there_x, there_y = x + flow[..., 0], y + flow[..., 1]
    n = flow.shape[0]
    other = sampled(np.concatenate([two[0].reshape(n, h, w, 4), two[1]], axis=-1), there_x, there_y)
    a = (one[0] + other[..., :4].reshape(n, h, w, 2, 2)) / 2
    b = (one[1] - other[..., 4:]) / 2 + np.einsum("nhwij,nhwj->nhwi", a, flow)
    inside = ((there_x >= 0) & (there_x <= w - 1) & (there_y >= 0) & (there_y <= h - 1))[..., None] * 1.0 + 1e-3
    gram = np.einsum("nhwki,nhwkj->nhwij", a, a).reshape(n, h, w, 4) * inside
    side = np.einsum("nhwki,nhwk->nhwi", a, b) * inside
    g = boxed(np.concatenate([gram[..., [0, 1, 3]], side], axis=-1), window)
    xx, xy, yy, px, py = (g[..., i] for i in range(5))
    ridge = 1e-9 + 1e-6 * (xx + yy)
    xx, yy = xx + ridge, yy + ridge
    det = xx * yy - xy * xy
    return np.stack([(yy * px - xy * py) / det, (xx * py - xy * px) / det], axis=-1)


def halved(images: np.ndarray) -> np.ndarray:
    h, w = images.shape[1:]
    smooth = filtered(images, bell(2, 1.0), bell(2, 1.0))
    height, width = (h + 1) // 2, (w + 1) // 2
    y, x = np.meshgrid((np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5, indexing="ij")
    n = len(images)
    return sampled(smooth, np.broadcast_to(x, (n, height, width)), np.broadcast_to(y, (n, height, width)))


def flow(one: np.ndarray, two: np.ndarray, levels: int = LEVELS, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """Displacements [n, h, w, 2] such that two(x + d(x)) is like one(x), for grey images [n, h, w]."""
    pyramid = [(one.astype(float), two.astype(float))]
    while len(pyramid) <= levels and min(pyramid[-1][0].shape[1:]) >= 32:
        pyramid.append(tuple(halved(a) for a in pyramid[-1]))
    found = None
    for a, b in reversed(pyramid):
        n, h, w = a.shape
        if found is None:
            found = np.zeros((n, h, w, 2))
        else:
            low_h, low_w = found.shape[1:3]
            y, x = np.meshgrid((np.arange(h) + 0.5) * low_h / h - 0.5, (np.arange(w) + 0.5) * low_w / w - 0.5, indexing="ij")
            place = lambda p: np.broadcast_to(p, (n, h, w))
            found = sampled(found, place(np.clip(x, 0, low_w - 1)), place(np.clip(y, 0, low_h - 1))) * np.array([w / low_w, h / low_h])
        both = expansion(a), expansion(b)
        for _ in range(rounds):
            found = refined(*both, found, min(window, 2 * (min(h, w) // 2) - 1))
    return found


def percentile(values: np.ndarray, mask: np.ndarray, share: float) -> float:
    return float(np.percentile(values[mask], 100 * share)) if mask.any() else 0.0


def inspected(map_x: np.ndarray, map_y: np.ndarray, region: np.ndarray, least_det: float = 0.2) -> tuple[int, int] | None:
    """(folded, outside) cells of a region of one inverse map [h, w], as ``pixels.map_inspection`` counts them; None for its error rows."""
    h, w = map_x.shape
    if min(h, w) < 2 or not region.any() or not (np.isfinite(map_x).all() and np.isfinite(map_y).all()):
        return None
    (down_x, across_x), (down_y, across_y) = np.gradient(map_x), np.gradient(map_y)
    off = (map_x < 0) | (map_x > w - 1) | (map_y < 0) | (map_y > h - 1)
    return int((region & (across_x * down_y - down_x * across_y <= least_det)).sum()), int((region & off).sum())


FIGURES = {"step": pa.int32(), "share": pa.float64(), "trip": pa.float64(), "residual": pa.float64(), "moved": pa.float64(), "exposed": pa.int64(), "folded": pa.int64(), "outside": pa.int64(),
           "problem": pa.string()}


def refusal(step: dict, uncovered: int, side: int) -> str | None:
    """The first limit that a step of a bridge breaks; what is not a number breaks its limit."""
    within = {"covered": uncovered <= 0, "trip": step["trip"] <= TRIP, "residual": step["residual"] <= RESIDUAL, "far": step["moved"] <= FAR * side,
              "map": step["folded"] == 0 and step["outside"] == 0, "exposed": step["exposed"] <= 0}
    return next((name for name, ok in within.items() if not ok), None)


def bridges(pairs: DataFrame, key: list[str], count: int, width: str = "w", left: str = "left", right: str = "right", motion: str = "motion") -> DataFrame:
    """(key, step, share, trip, residual, moved, exposed, folded, outside, problem, px): ``count`` frames between RGBA ``left`` and ``right``.

    A row for each step 1..count, refused ones with their figures and null pixels. One refused step refuses the whole bridge of its pair,
    by the first step's reason. All of a pair is made in one place: nothing is shuffled.
    """
    if isinstance(count, bool) or not 1 <= count <= MOST_FRAMES:
        raise ValueError(f"a bridge has 1 to {MOST_FRAMES} frames")
    names = list(FIGURES)
    kinds = ["step int", "share double", "trip double", "residual double", "moved double", "exposed long", "folded long", "outside long", "problem string", "px array<int>"]
    schema = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key), *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, left):
            for rows, held in stacks(batch, width, {left: 4, right: 4, motion: 1}, pixels=1 << 18):
                steps, shown = made(held, len(rows))
                keys = [batch.column(batch.schema.get_field_index(k)).take(pa.array(np.repeat(rows, count))) for k in key]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array([s.get(n) for s in steps], FIGURES[n]) for n in names), lists_of(shown, pa.int32())], [*key, *names, "px"])

    def made(held: dict, n: int) -> tuple[list[dict], list]:
        """The figures and the pixels of ``count`` steps of each of n pairs, in order."""
        steps: list[dict] = [{"step": j + 1, "share": (j + 1) / (count + 1), "problem": "input"} for _ in range(n) for j in range(count)]
        pixels: list = [None] * (n * count)
        if held[left] is None:
            return steps, pixels
        ends, moving = (held[left].astype(float), held[right].astype(float)), held[motion].astype(bool)
        uncovered = (moving & ((ends[0][..., 3] < OPAQUE) | (ends[1][..., 3] < OPAQUE))).sum(axis=(1, 2))
        h, w = moving.shape[1:]
        y, x = np.mgrid[:h, :w].astype(float)
        shade = [grey(e[..., :3].astype(np.int64)) for e in ends]
        there, back = flow(*shade), flow(*shade[::-1])
        trip = np.linalg.norm(there + sampled(back, x + there[..., 0], y + there[..., 1]), axis=-1)
        warped = sampled(ends[1][..., :3], x + there[..., 0], y + there[..., 1])
        gap, way = np.abs(ends[0][..., :3] - warped).mean(axis=-1), np.linalg.norm(there, axis=-1)
        whole = [{"trip": percentile(trip[i], own, 0.95), "moved": percentile(way[i], own, 0.95), "residual": float(gap[i][own].mean()) if own.any() else 0.0} for i, own in enumerate(moving)]
        for j in range(count):
            share = (j + 1) / (count + 1)
            source, field, part = (ends[0], there, share) if share <= 0.5 else (ends[1], back, 1 - share)
            map_x, map_y = np.broadcast_to(x, moving.shape), np.broadcast_to(y, moving.shape)
            for _ in range(FIXED_POINT):
                step = sampled(field, map_x, map_y)
                map_x, map_y = x - part * step[..., 0], y - part * step[..., 1]
            shown = np.clip(np.rint(sampled(source, map_x, map_y)), 0, 255).astype(np.int32)
            for i, own in enumerate(moving):
                folded, outside = inspected(map_x[i], map_y[i], own) or (None, None)
                at = steps[i * count + j]
                at |= whole[i] | {"exposed": int((own & (shown[i, ..., 3] < OPAQUE)).sum()), "folded": folded, "outside": outside}
                at["problem"], pixels[i * count + j] = refusal(at, int(uncovered[i]), min(h, w)), shown[i]
        for i in range(n):
            own = range(i * count, (i + 1) * count)
            problem = next((steps[k]["problem"] for k in own if steps[k]["problem"]), None)
            for k in own:
                steps[k]["problem"] = problem
                pixels[k] = None if problem else pixels[k]
        return steps, pixels

    small_batches(pairs.sparkSession)
    return pairs.select(*key, width, left, right, motion).mapInArrow(run, schema)
