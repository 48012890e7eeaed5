"""Sub-pixel translation of a frame onto a reference, by Gauss-Newton steps on the enhanced correlation coefficient.

With t the reference's and w the warped frame's grey values over the samples, both without their mean, and J the warped gradient, each
step takes the multiple of t that raises the correlation most to first order and moves the frame by the least squares
solution of J d = lambda t - w (Evangelidis and Psarakis, 2008). Frames of one size are moved together.

The samples are static cells that the frame covers fully. A frame is refused, with the reason, if
    samples   there are fewer than 32 of them
    texture   the reference is flat there: standard deviation of grey values below 1/100
    diverged  the steps don't settle, or the correlation has no rise
    far       it would move by more than ``most`` pixels
    exposed   cells of the motion mask would be less than fully covered
    worse     the mean error to the reference over static cells grows by more than 1/20
    input     a null, or sizes that don't go together
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framequill.operators.images import bell, filtered, grey, lists_of, pieces, sampled, stacks
from framequill.session import ship, small_batches

ship(__name__)

#: Limits of the accept rules.
OPAQUE, LEAST_SAMPLES, LEAST_TEXTURE, KEPT_ALPHA, MAY_WORSEN = 254, 32, 0.01, 250, 0.05
STEPS, SETTLED, SMOOTH = 80, 1e-6, bell(1, 0.8)


def shifts(reference: np.ndarray, moved: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, settled) such that moved(x + dx, y + dy) is like reference(x, y), for grey images [n, h, w] of 0..1."""
    n, h, w = reference.shape
    reference, moved = filtered(reference, SMOOTH, SMOOTH), filtered(moved, SMOOTH, SMOOTH)
    slope, flat = np.array([-0.5, 0, 0.5]), np.array([1.0])
    layers = np.stack([moved, filtered(moved, slope, flat), filtered(moved, flat, slope)], axis=3)
    grid_y, grid_x = np.mgrid[:h, :w].astype(float)
    at, last = np.zeros((n, 2)), np.full(n, -2.0)
    active, settled = np.ones(n, bool), np.zeros(n, bool)
    for _ in range(STEPS):
        own = np.flatnonzero(active)
        if not len(own):
            break
        x, y = grid_x + at[own, 0, None, None], grid_y + at[own, 1, None, None]
        warped = sampled(layers[own], x, y)
        valid = samples[own] & (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
        count = np.maximum(valid.sum(axis=(1, 2)), 1)

        def centred(a: np.ndarray) -> np.ndarray:
            mean = (a * valid).sum(axis=(1, 2)) / count
            return (a - mean[:, None, None]) * valid

        t, f = centred(reference[own]), centred(warped[..., 0])
        jac = warped[..., 1:] * valid[..., None]
        hess = np.einsum("nhwi,nhwj->nij", jac, jac)
        along_f, along_t = np.einsum("nhwi,nhw->ni", jac, f), np.einsum("nhwi,nhw->ni", jac, t)
        sizes = (t * t).sum(axis=(1, 2)), (f * f).sum(axis=(1, 2))
        joint = (t * f).sum(axis=(1, 2))
        rho = joint / np.sqrt(np.maximum(sizes[0] * sizes[1], 1e-30))
        solid = np.linalg.det(hess) > 1e-12
        inverse = np.linalg.inv(np.where(solid[:, None, None], hess, np.eye(2)))
        step_f = np.einsum("nij,nj->ni", inverse, along_f)
        above, below = sizes[1] - (along_f * step_f).sum(axis=1), joint - (along_t * step_f).sum(axis=1)
        rising = solid & (below > 0)
        scale = above / np.where(rising, below, 1.0)
        step = np.einsum("nij,nj->ni", inverse, scale[:, None] * along_t - along_f)
        still = np.abs(rho - last[own]) < SETTLED
        fine = rising & np.isfinite(step).all(axis=1) & (np.abs(at[own] + step) < max(h, w)).all(axis=1)
        at[own[fine & ~still]] += step[fine & ~still]
        last[own] = rho
        settled[own[still]] = True
        active[own] = fine & ~still
    settled |= active  # out of steps while still rising
    return at[:, 0], at[:, 1], settled


def moved_by(frames: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """RGBA frames [n, h, w, 4] at (x + dx, y + dy), colours weighted by alpha; nothing outside."""
    h, w = frames.shape[1:3]
    y, x = np.mgrid[:h, :w].astype(float)
    held = frames.astype(float) / 255
    held[..., :3] *= held[..., 3:]
    held = sampled(held, x + dx[:, None, None], y + dy[:, None, None], "zero")
    held[..., :3] /= np.maximum(held[..., 3:], 1e-6)
    return np.clip(np.rint(held * 255), 0, 255).astype(np.int64)


def error_over(frames: np.ndarray, reference: np.ndarray, static: np.ndarray) -> np.ndarray:
    """Mean absolute error to the reference of frames laid over it, over static cells and channels."""
    alpha = frames[..., 3:] / 255
    shown = np.clip(np.rint(frames[..., :3] * alpha + reference * (1 - alpha)), 0, 255)
    return (np.abs(shown - reference) * static[..., None]).sum(axis=(1, 2, 3)) / np.maximum(3 * static.sum(axis=(1, 2)), 1)


def aligned(
    pairs: DataFrame, key: list[str], width: str = "w", frame: str = "px", reference: str = "reference", static: str = "static", motion: str = "motion", most: float = 3.0,
) -> DataFrame:
    """(key, samples, texture, dx, dy, settled, exposed, before, after, aligned): RGBA ``frame`` onto RGB ``reference``, masks of booleans.

    The figures are those ``accepted`` decides by; ``aligned`` is the moved frame where it may be moved at all, else null.
    """
    if isinstance(most, bool) or not 0 < most <= 3:
        raise ValueError("a translation of more than 0 and at most 3 pixels can be asked for")
    kinds = ["samples long", "texture double", "dx double", "dy double", "settled boolean", "exposed long", "before double", "after double", "aligned array<int>"]
    names = [k.split()[0] for k in kinds]
    schema = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key), *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, frame):
            out: dict[str, list] = {name: [None] * batch.num_rows for name in names}
            for rows, held in stacks(batch, width, {frame: 4, reference: 3, static: 1, motion: 1}):
                if held[frame] is None:
                    continue
                frames, target = held[frame].astype(np.int64), held[reference].astype(np.int64)
                still, moving = held[static].astype(bool), held[motion].astype(bool)
                samples = still & (frames[..., 3] >= OPAQUE)
                n, base = samples.sum(axis=(1, 2)), grey(target) / 255
                mean = (base * samples).sum(axis=(1, 2)) / np.maximum(n, 1)
                texture = np.sqrt((((base - mean[:, None, None]) ** 2) * samples).sum(axis=(1, 2)) / np.maximum(n, 1))
                dx, dy, settled = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), bool)
                fit = np.flatnonzero((n >= LEAST_SAMPLES) & (texture >= LEAST_TEXTURE))
                if len(fit):
                    dx[fit], dy[fit], settled[fit] = shifts(base[fit], grey(frames[fit, ..., :3]) / 255, samples[fit])
                shown = moved_by(frames, dx, dy)
                exposed = (moving & (shown[..., 3] < KEPT_ALPHA)).sum(axis=(1, 2))
                before, after = error_over(frames, target, still), error_over(shown, target, still)
                near = settled & (np.maximum(np.abs(dx), np.abs(dy)) <= most)
                for name, values in (("samples", n), ("texture", texture), ("settled", settled), ("before", before)):
                    for r, v in zip(rows, values.tolist()):
                        out[name][r] = v
                for i in np.flatnonzero(settled):
                    out["dx"][rows[i]], out["dy"][rows[i]] = float(dx[i]), float(dy[i])
                for i in np.flatnonzero(near):
                    out["exposed"][rows[i]], out["after"][rows[i]], out["aligned"][rows[i]] = int(exposed[i]), float(after[i]), shown[i]
            columns = [batch.column(batch.schema.get_field_index(k)) for k in key]
            types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[name], t) for name, t in zip(names, types)), lists_of(out["aligned"], pa.int32())], [*key, *names])

    small_batches(pairs.sparkSession)
    return accepted(pairs.select(*key, width, frame, reference, static, motion).mapInArrow(run, schema), F.lit(float(most)))


def accepted(found: DataFrame, most: Column) -> DataFrame:
    """Adds ``problem``, the first rule that refuses a frame by its figures, null for none, and takes a refused frame away."""
    problem = (F.when(F.col("samples").isNull(), "input").when(F.col("samples") < LEAST_SAMPLES, "samples").when(F.col("texture") < LEAST_TEXTURE, "texture")
               .when(~F.col("settled"), "diverged").when(F.greatest(F.abs("dx"), F.abs("dy")) > most, "far").when(F.col("exposed") > 0, "exposed")
               .when(F.col("after") > F.col("before") + MAY_WORSEN, "worse"))
    found = found.withColumn("problem", problem)
    return found.withColumn("aligned", F.when(F.col("problem").isNull(), F.col("aligned"))) if "aligned" in found.columns else found
