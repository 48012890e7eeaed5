"""Per-frame measurements: residuals, stability, planes as aggregates; fills and maps as numpy kernels over Arrow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framequill.functions.pixels import is_light, key_channels
from framequill.operators.images import pieces, stacks
from framequill.session import ship, small_batches

ship(__name__)


def residuals(pixels: DataFrame, key: Sequence[str], x: str, y: str, value: str, reference: str, static: str, width: int, channel: str | None = None) -> DataFrame:
    """(key, mae, p95, edge_error, edge_cells, passed) over the static pixels of complete frames; limits 5, 15 and 5.

    ``edge_error`` compares local gradients, the sum of the absolute steps to the right and lower neighbour, of frame and reference, over
    cells that are static together with both neighbours: shifted texture shows there, whatever the mean colour. Fewer
    than 8 such cells decide nothing, and the frame does not pass.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*key).orderBy(*[c for c in (channel, y, x) if c])  # the aggregate below reuses its partitioning

    def near(c: str, step: int) -> Column:
        return F.lead(c, step).over(order)

    def gradient(c: str) -> Column:
        return F.abs(near(c, width) - F.col(c)) + F.abs(near(c, 1) - F.col(c))

    last = F.max(y).over(Window.partitionBy(*key))
    inner = (F.col(x) < width - 1) & (F.col(y) < last) & F.col(static) & near(static, 1) & near(static, width)
    rows = pixels.select(*key, F.col(static).alias("__static"), F.abs(F.col(value) - F.col(reference)).cast("double").alias("__gap"),
                         F.when(inner, F.abs(gradient(value) - gradient(reference))).cast("double").alias("__edge"))
    gap = F.when(F.col("__static"), F.col("__gap"))
    found = rows.groupBy(*key).agg(F.avg(gap).alias("mae"), F.percentile(gap, F.lit(0.95)).alias("p95"), F.avg("__edge").alias("edge_error"), F.count("__edge").alias("edge_cells"))
    passed = (F.col("mae") <= 5) & (F.col("p95") <= 15) & (F.col("edge_error") <= 5) & (F.col("edge_cells") >= 8)
    return found.withColumn("passed", F.coalesce(passed, F.lit(False)))


def background_masks(pixels: DataFrame, key: Sequence[str], x: str, y: str, static: str, motion: str, width: int, padding: int = 2) -> DataFrame:
    """(key, covered, overlap, edge_cells, moving, usable): may a static mask certify the background beside a motion mask?

    It has to keep off the motion grown by ``padding`` on all sides, cover max(16, 2 %), and hold 8 cells together with
    their right and lower neighbours; the motion mask may not be empty.
    """
    at = F.col(y) * width + F.col(x)
    grids = pixels.groupBy(*key).agg(*[F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(c).alias("on")))), lambda p: p["on"]).alias(name) for c, name in ((static, "s"), (motion, "m"))])
    grids = dilated(grids.withColumn("w", F.lit(width)), "w", "m", padding, "grown")
    n = lambda cells: F.size(F.filter(cells, lambda c: c))
    edge = F.transform("s", lambda s, i: s & (i % width < width - 1) & F.coalesce(F.get("s", i + 1), F.lit(False)) & F.coalesce(F.get("s", i + width), F.lit(False)))
    found = grids.select(*key, F.size("s").alias("cells"), n(F.col("s")).alias("covered"), n(F.zip_with("s", "grown", lambda s, g: s & g)).alias("overlap"), n(edge).alias("edge_cells"), n(F.col("m")).alias("moving"))
    usable = (F.col("overlap") == 0) & (F.col("covered") >= F.greatest(F.lit(16.0), F.col("cells") * 0.02)) & (F.col("edge_cells") >= 8) & (F.col("moving") > 0)
    return found.withColumn("usable", usable).drop("cells")


def matches_source(pixels: DataFrame, key: Sequence[str], gap: str) -> DataFrame:
    """Whether a frame is its source's: mean difference at most 2 and 95th percentile at most 8."""
    found = pixels.groupBy(*key).agg(F.avg(gap).alias("mean"), F.percentile(gap, F.lit(0.95)).alias("p95"))
    return found.withColumn("matches", (F.col("mean") <= 2) & (F.col("p95") <= 8))


def border_stability(pixels: DataFrame, clip: Sequence[str], frame: str, distance: str, tolerance: float, least: float = 0.9) -> DataFrame:
    """(clip, stability, stable): the least share over frames of border pixels near the key colour."""
    shares = pixels.groupBy(*clip, frame).agg(F.avg(F.when(F.col(distance) <= tolerance, 1.0).otherwise(0.0)).alias("share"))
    return shares.groupBy(*clip).agg(F.min("share").alias("stability")).withColumn("stable", F.col("stability") >= least)


def channel_offset(pixels: DataFrame, key: Sequence[str], reference: str, value: str, sample: str, most: float = 12, worse: float = 0.05, least: int = 16) -> DataFrame:
    """(key, shift, samples, before, after, accepted): median shift of a channel over its sample pixels (static and opaque).

    The corrected value is rounded half to even and held within 0..255 before its error is taken again. Refused with fewer than ``least``
    samples, beyond ``most``, or if it makes things worse.
    """
    from pyspark.sql import Window

    taken = F.when(F.col(sample), (F.col(reference) - F.col(value)).cast("double"))
    joined = pixels.withColumn("shift", F.percentile(taken, F.lit(0.5)).over(Window.partitionBy(*key)))  # the aggregate below reuses the window's partitioning
    fixed = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.col(value) + F.col("shift"))))
    off = lambda c: F.avg(F.when(F.col(sample), F.abs(F.col(reference) - c)))
    found = joined.groupBy(*key).agg(F.min("shift").alias("shift"), F.count_if(F.col(sample)).alias("samples"), off(F.col(value)).alias("before"), off(fixed).alias("after"))
    accepted = (F.col("samples") >= least) & (F.abs("shift") <= most) & (F.col("after") <= F.col("before") + worse)
    return found.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def plane(points: DataFrame, key: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """(key, c0, c1, c2): least-squares plane c0 + c1 x + c2 y from nine sums; null where the points don't span a plane."""
    sums = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "z": F.col(z), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y), "yy": F.col(y) * F.col(y), "xz": F.col(x) * F.col(z), "yz": F.col(y) * F.col(z)}
    s = points.groupBy(*key).agg(*[F.sum(c.cast("double")).alias(f"s_{n}") for n, c in sums.items()])
    c = lambda n: F.col(f"s_{n}")
    # Centred second moments keep the 2 x 2 system well scaled.
    xx, xy, yy = c("xx") - c("x") * c("x") / c("n"), c("xy") - c("x") * c("y") / c("n"), c("yy") - c("y") * c("y") / c("n")
    xz, yz = c("xz") - c("x") * c("z") / c("n"), c("yz") - c("y") * c("z") / c("n")
    det = xx * yy - xy * xy
    solved = s.withColumn("det", det).withColumn("c1", F.when(det > 1e-9, (xz * yy - yz * xy) / det)).withColumn("c2", F.when(det > 1e-9, (yz * xx - xz * xy) / det))
    return solved.withColumn("c0", (c("z") - F.col("c1") * c("x") - F.col("c2") * c("y")) / c("n")).select(*key, "c0", "c1", "c2")


def mask_problems(masks: DataFrame, key: Sequence[str], mask: str) -> DataFrame:
    """(key, n, covered, binary, enough): a mask holds 0 and 255 only and covers at least max(16, 2 %)."""
    covered = F.size(F.filter(mask, lambda v: v == 255))
    return masks.select(
        *key, F.size(mask).alias("n"), covered.alias("covered"), F.forall(mask, lambda v: v.isin(0, 255)).alias("binary"),
        (covered >= F.greatest(F.lit(16.0), F.size(mask) * 0.02)).alias("enough"))


def mask_metrics(masks: DataFrame, key: Sequence[str], width: str, mask: str, solid: int = 128) -> DataFrame:
    """(key, area, edge_pixels, clipped) of row-major mattes: solid pixels, those of the four border lines (corners count for both), and
    whether any touches the top or a side; the bottom may be cut."""
    w, on = F.col(width), F.transform(mask, lambda v: v > solid)
    masks = masks.withColumn("__on", on).withColumn("__rows", F.expr(f"size(`{mask}`) div `{width}`"))
    count = lambda where: F.size(F.filter(F.transform("__on", lambda v, i: v & where(i)), lambda v: v))
    top, bottom = count(lambda i: i < w), count(lambda i: i >= (F.col("__rows") - 1) * w)
    left, right = count(lambda i: i % w == 0), count(lambda i: i % w == w - 1)
    return masks.select(*key, count(lambda i: F.lit(True)).alias("area"), (top + bottom + left + right).alias("edge_pixels"), (top + left + right > 0).alias("clipped"))


def cell_problems(cells: DataFrame, key: Sequence[str], alpha: str, page: Column) -> DataFrame:
    """(key, low, high, problem) of active cells by the extrema of their alpha: empty ones, and opaque ones on a page."""
    found = cells.select(*key, F.array_min(alpha).alias("low"), F.array_max(alpha).alias("high"), page.alias("__page"))
    return found.withColumn("problem", F.when(~F.coalesce(F.col("high") > 0, F.lit(False)), "empty").when(F.col("__page") & (F.col("low") >= 255), "opaque")).drop("__page")


def composite_problems(front_alpha: Column, matte: Column, entered: int = 16, opaque: int = 250) -> dict[str, Column]:
    """Rules of a composite over a clean plate: the matte has both foreground and background, and stays off what its source feathers or lacks."""
    pairs = F.zip_with(front_alpha, matte, lambda a, m: (m > entered) & (a < opaque))
    return {"matte-both": (F.array_max(matte) > 0) & (F.array_min(matte) < 255), "matte-size": F.size(front_alpha) == F.size(matte), "matte-source": ~F.exists(pairs, lambda p: F.coalesce(p, F.lit(True)))}


def _grid(values, width: int) -> np.ndarray:
    return np.asarray(values).reshape(-1, width)


def reached(masks: np.ndarray) -> np.ndarray:
    """Which true cells of masks [n, h, w] are connected to the border of their own through four neighbours."""
    # A frame of closed cells, so that steps never leave a grid; each cell joins the frontier once.
    open_ = np.pad(masks.astype(bool), ((0, 0), (1, 1), (1, 1)))
    wide, todo, seen = open_.shape[2], open_.ravel().copy(), np.zeros(open_.size, bool)
    border = np.zeros_like(open_)
    border[:, [1, -2], 1:-1], border[:, 1:-1, [1, -2]] = True, True
    front = np.flatnonzero(border.ravel() & todo)
    while len(front):
        seen[front], todo[front] = True, False
        front = np.unique(np.concatenate([front - 1, front + 1, front - wide, front + wide]))
        front = front[todo[front]]
    return seen.reshape(open_.shape)[:, 1:-1, 1:-1]


def flood(frames: DataFrame, width: str, mask: str, name: str = "reached") -> DataFrame:
    """Adds, per frame, which true cells of a row-major mask are connected to its border through four neighbours."""

    @F.pandas_udf("array<boolean>")
    def reach(widths: pd.Series, masks: pd.Series) -> pd.Series:
        return pd.Series([reached(_grid(m, int(w))[None])[0].ravel().tolist() for w, m in zip(widths, masks)])

    return frames.withColumn(name, reach(F.col(width), F.col(mask)))


def dilated(frames: DataFrame, width: str, mask: str, radius: int = 2, name: str = "dilated") -> DataFrame:
    """Adds a row-major mask grown by a square of ``2 * radius + 1``."""

    @F.pandas_udf("array<boolean>")
    def grow(widths: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for w, m in zip(widths, masks):
            padded = np.pad(_grid(m, int(w)).astype(bool), radius)
            views = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1))
            out.append(views.any(axis=(2, 3)).ravel().tolist())
        return pd.Series(out)

    return frames.withColumn(name, grow(F.col(width), F.col(mask)))


def map_inspection(maps: DataFrame, key: str, width: str, map_x: str, map_y: str, region: str, protected: str | None = None, least_det: float = 0.2) -> DataFrame:
    """(key, folded, outside, least_det, most_moved, protected_moved, passed) of inverse pixel maps given as row-major arrays.

    ``folded`` counts the cells of the boolean array ``region`` whose Jacobian determinant, from central differences, one-sided at the border, is at most
    ``least_det``; ``outside`` those that read beyond the frame. Protected cells may not move by more than 1e-5. A map that is
    empty, not finite, of another size than its masks, or narrower than two cells, and an empty region, give an error row: null figures, not passed.
    """
    w, n = F.col(width), F.size(map_x)
    rows = F.expr(f"size(`{map_x}`) div `{width}`")
    fits = (n > 0) & (n == F.size(map_y)) & (n == F.size(region)) & (w >= 2) & (rows >= 2) & (n == rows * w)
    if protected:
        fits = fits & (n == F.size(protected))
    finite = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fits = fits & finite(map_x) & finite(map_y) & F.exists(region, lambda c: c)

    def slope(c: str, i: Column, step: Column, first: Column, last: Column) -> Column:
        at = lambda j: F.get(F.col(c), j)
        return (F.when(first, at(i + step) - at(i)).when(last, at(i) - at(i - step)).otherwise((at(i + step) - at(i - step)) / 2.0))

    def cell(px: Column, i: Column) -> Column:
        col, row, one = i % w, F.floor(i / w).cast("int"), F.lit(1)
        py = F.get(F.col(map_y), i)
        across, down = (one, col == 0, col == w - 1), (w, row == 0, row == rows - 1)
        det = slope(map_x, i, *across) * slope(map_y, i, *down) - slope(map_x, i, *down) * slope(map_y, i, *across)
        off = (px < 0) | (px > w - 1) | (py < 0) | (py > rows - 1)
        return F.struct(det.alias("det"), off.alias("off"), F.hypot(px - col, py - row).alias("moved"), F.get(F.col(region), i).alias("inside"),
                        (F.get(F.col(protected), i) if protected else F.lit(False)).alias("held"))

    found = maps.withColumn("__cells", F.when(fits, F.transform(map_x, cell)))
    inside = F.filter("__cells", lambda c: c["inside"])
    most = lambda cells, name: F.array_max(F.transform(cells, lambda c: c[name]))
    found = found.select(
        key, F.size(F.filter(inside, lambda c: c["det"] <= least_det)).cast("long").alias("folded"), F.size(F.filter(inside, lambda c: c["off"])).cast("long").alias("outside"),
        F.array_min(F.transform(inside, lambda c: c["det"])).alias("least_det"), most(inside, "moved").alias("most_moved"),
        F.when(F.col("__cells").isNotNull(), F.coalesce(most(F.filter("__cells", lambda c: c["held"]), "moved"), F.lit(0.0))).alias("protected_moved"))
    passed = (F.col("folded") == 0) & (F.col("outside") == 0) & (F.col("protected_moved") <= 1e-5)
    return found.withColumn("folded", F.when(F.col("folded") >= 0, F.col("folded"))).withColumn("outside", F.when(F.col("outside") >= 0, F.col("outside"))).withColumn("passed", F.coalesce(passed, F.lit(False)))


def registration(pairs: DataFrame, key: str, width: str, reference: str, moved: str, most: int = 3, texture: float = 1.0) -> DataFrame:
    """(key, dx, dy, accepted): whole-pixel translation by phase correlation, refused beyond ``most`` or without texture.

    This gives whole pixels only, however far; ``alignment.aligned`` finds parts of a pixel.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dx, dy, accepted = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for rows, held in stacks(batch, width, {reference: 1, moved: 1}):
                if held[reference] is None:
                    continue
                a, b = held[reference].astype(float), held[moved].astype(float)
                cross = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
                peak = np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-9)).real
                h, w = a.shape[1:]
                down, across = np.divmod(peak.reshape(len(a), -1).argmax(axis=1), w)
                down, across = down - h * (down > h // 2), across - w * (across > w // 2)
                rough = (a.std(axis=(1, 2)) >= texture) & (b.std(axis=(1, 2)) >= texture)
                dx[rows], dy[rows] = np.where(rough, across, 0), np.where(rough, down, 0)
                accepted[rows] = rough & (np.maximum(np.abs(across), np.abs(down)) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dx), pa.array(dy), pa.array(accepted)], ["key", "dx", "dy", "accepted"])

    return pairs.select(key, width, reference, moved).mapInArrow(run, f"key {kind}, dx long, dy long, accepted boolean").withColumnRenamed("key", key)


def flow_gate(flows: DataFrame, key: Sequence[str], roundtrip: str, residual: str, moved: str, least_side: Column) -> DataFrame:
    """(key, p95, residual, moved, passed): limits of an interpolated bridge on its own flow figures, 95th percentiles of round trip and displacement."""
    found = flows.groupBy(*key).agg(F.percentile(roundtrip, F.lit(0.95)).alias("p95"), F.avg(residual).alias("residual"), F.percentile(moved, F.lit(0.95)).alias("moved"), F.min(least_side).alias("side"))
    return found.withColumn("passed", (F.col("p95") <= 1.5) & (F.col("residual") <= 12) & (F.col("moved") <= F.col("side") * 0.08)).drop("side")


def cropped(px: Column, width: int, x: int, y: int, w: int, h: int) -> Column:
    """A rectangle of a row-major array."""
    return F.flatten(F.transform(F.sequence(F.lit(y), F.lit(y + h - 1)), lambda r: F.slice(px, r * width + F.lit(x + 1), F.lit(w))))


def composite(front: Column, back: Column, matte: Column) -> Column:
    """Frame over clean plate by a reviewed matte 0..255, element by element, rounded half to even."""
    both = F.zip_with(front, back, lambda f, b: F.struct(f.alias("f"), b.alias("b")))
    return F.zip_with(both, matte, lambda p, m: F.rint(p["f"] * (m / 255) + p["b"] * (1 - m / 255)).cast("int"))


MODES = ("preserve", "replace-edge-light", "fit-edge-light", "chroma-key")


def patched(front: Column, base: Column, fitted: Column, mode: Column, edge: Column, light: Column, keyed: Column, alpha: Column) -> Column:
    """One channel of a frame's patch: kept as it is; edge-connected light replaced by the base image, or by the plane fitted to its light
    backdrop; or the despilled value ``keyed`` over the base by alpha 0..255. Null for a mode that is none of ``MODES``."""
    lit = edge & light
    plane_ = F.least(F.lit(255), F.greatest(F.lit(0), fitted.cast("int")))
    return (F.when(mode == "preserve", front).when(mode == "replace-edge-light", F.when(lit, base).otherwise(front)).when(mode == "fit-edge-light", F.when(lit, plane_).otherwise(front))
            .when(mode == "chroma-key", F.rint(keyed * (alpha / 255) + base * (1 - alpha / 255))).cast("int"))


def keyed_cells(rgb: np.ndarray, key: Sequence[int], low: float = 12, high: float = 220) -> tuple[np.ndarray, np.ndarray]:
    """(alpha [...], channels [..., 3]) of keyed pixels, as ``functions.pixels.keyed`` has them."""
    t = np.clip((np.abs(rgb - np.array(key)).max(axis=-1) - float(low)) / float(high - low), 0.0, 1.0)
    alpha, channels = np.trunc(t * t * (3.0 - 2.0 * t) * 255).astype(np.int64), key_channels(key)
    if not 0 < len(channels) < 3:
        return alpha, rgb
    rest = rgb[..., [i for i in range(3) if i not in channels]].max(axis=-1)
    above = np.maximum(0, rgb[..., channels].min(axis=-1) - rest)
    alpha = np.minimum(alpha, np.trunc((1.0 - np.minimum(1.0, above / np.maximum(1, max(key) - rest))) * 255).astype(np.int64))
    held = rgb.copy()
    for i in channels:
        held[..., i] = np.where(alpha < 252, np.minimum(rgb[..., i], rest), rgb[..., i])
    return alpha, held


def patches(frames: DataFrame, width: str, px: str, base: str, mode: str, key_color: Sequence[int], fitted: str | None = None, name: str = "patch") -> DataFrame:
    """Adds ``name``: the RGBA frame ``px`` made a patch over the RGB array ``base`` by the mode in column ``mode``.

    ``preserve`` keeps it; ``replace-edge-light`` and ``fit-edge-light`` put the base, or the array ``fitted`` of a plane, where light
    cells are connected to the border, null where that has none; both keep the frame's alpha. ``chroma-key`` keys and despills by ``key_color``,
    its alpha times the frame's in whole 255ths. Null for a mode that is none of ``MODES``, and for a frame that is null, has nulls or doesn't fit its width.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + f", `{name}` array<int>"
    unders = {"replace-edge-light": base, "fit-edge-light": fitted or base}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, px):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            how, out, absent = np.array(column(mode).to_pylist(), object), [None] * batch.num_rows, [None] * batch.num_rows
            for rows, held in stacks(batch, width, {px: 4}):
                if held[px] is None:
                    continue
                shown = held[px].astype(np.int64)
                lost = np.zeros(shown.shape, bool)
                own = how[rows]
                key = own == "chroma-key"
                if key.any():
                    alpha, channels = keyed_cells(shown[key][..., :3], key_color)
                    product = alpha * shown[key][..., 3]
                    shown[key] = np.concatenate([channels, ((product - np.fmod(product, 255)) // 255)[..., None]], axis=-1)
                edged = np.flatnonzero(np.isin(own, list(unders)))
                rgb = shown[edged][..., :3]
                lit = reached((rgb.min(axis=-1) > 210) & (rgb.max(axis=-1) - rgb.min(axis=-1) < 30))
                for i, cells in zip(edged, lit):
                    at = np.flatnonzero(cells.ravel())
                    under = column(unders[own[i]]).slice(rows[i], 1).flatten()
                    want = (at[:, None] * 3 + np.arange(3)).ravel()
                    values = under.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    gone = np.asarray(under.is_null())
                    there = want < len(values)
                    got, lack = np.zeros(len(want), np.int64), np.ones(len(want), bool)
                    got[there], lack[there] = values[want[there]], gone[want[there]]
                    shown[i].reshape(-1, 4)[at, :3], lost[i].reshape(-1, 4)[at, :3] = got.reshape(-1, 3), lack.reshape(-1, 3)
                for i, r in enumerate(rows):
                    if own[i] in MODES:
                        out[r], absent[r] = shown[i].ravel(), lost[i].ravel()
            ends = np.concatenate([[0], np.cumsum([0 if o is None else len(o) for o in out])]).astype(np.int32)
            flat, nulls = ([x for x in a if x is not None] for a in (out, absent))
            values = pa.array(np.concatenate(flat).astype(np.int32), mask=np.concatenate(nulls)) if flat else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.array([*(o is None for o in out), False])), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, name])

    small_batches(frames.sparkSession)
    return frames.mapInArrow(run, schema)


def backdrop(pixels: DataFrame, key: Sequence[str], x: str, y: str, channels: Sequence[str], light: Column | None = None) -> DataFrame:
    """(key, channel, c0, c1, c2): planes through a base image's light cells; null where they span none.

    Light by default is a least of three channels above 215 with a spread below 30.
    """
    cells = pixels.where(is_light(*[F.col(c) for c in channels], above=215) if light is None else light)
    cells = cells.select(*key, x, y, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in channels])).alias("__c"))
    return plane(cells.select(*key, "__c.channel", x, y, "__c.value"), [*key, "channel"], x, y, "value")


def matte_motion(df: DataFrame, key: Sequence[str], order: str, matte: str, px: str, solid: int = 192, least: int = 64) -> DataFrame:
    """(key, order, edge_motion): mean difference to the frame before where both mattes are solid; null with less than ``least`` such pixels."""
    from pyspark.sql import Window

    before = Window.partitionBy(*key).orderBy(order)
    paired = df.withColumn("__m", F.lag(matte).over(before)).withColumn("__p", F.lag(px).over(before))
    gaps = F.zip_with(F.zip_with(px, "__p", lambda a, b: F.abs(a - b)), F.zip_with(matte, "__m", lambda a, b: (a > solid) & (b > solid)), lambda g, s: F.when(s, g.cast("double")))
    solid_gaps = F.filter(gaps, lambda g: g.isNotNull())
    mean = F.when(F.size(solid_gaps) >= least, F.aggregate(solid_gaps, F.lit(0.0), lambda s, g: s + g) / F.size(solid_gaps))
    return paired.select(*key, order, mean.alias("edge_motion"))
