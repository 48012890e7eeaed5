import numpy as np
import pytest
from pyspark.sql import functions as F

from framequill.operators import alignment, flow, images, resample, series


def textured(rng, h=48, w=56, sigma=2.0, dx=0.0, dy=0.0):
    """Waves of random direction; ``dx`` and ``dy`` (numbers or grids) move them exactly."""
    y, x = np.mgrid[:h, :w].astype(float)
    waves = rng.normal(0, 0.7 / sigma, (40, 2))
    phases = rng.uniform(0, 2 * np.pi, 40)
    field = sum(np.sin(a * (x - dx) + b * (y - dy) + p) for (a, b), p in zip(waves, phases))
    return np.clip(128 + 11 * field, 0, 255)


def both(seed, dx, dy, h=48, w=56, sigma=2.0):
    return textured(np.random.default_rng(seed), h, w, sigma), textured(np.random.default_rng(seed), h, w, sigma, dx, dy)


def rgba(grey_, alpha=255):
    out = np.repeat(np.rint(grey_).astype(int)[..., None], 4, axis=2)
    out[..., 3] = alpha
    return out


PAIR = "k int, w int, px array<int>, reference array<int>, static array<boolean>, motion array<boolean>"


def pair(k, frame, reference, static, motion):
    return (k, frame.shape[1], frame.ravel().tolist(), np.repeat(np.rint(reference).astype(int)[..., None], 3, axis=2).ravel().tolist(), static.ravel().tolist(), motion.ravel().tolist())


def test_subpixel_shifts_are_found(spark):
    rows, want = [], {}
    for k, (dx, dy) in enumerate([(0.3, 0.0), (-0.5, 0.7), (1.25, -1.8), (2.7, 2.2), (-2.7, 0.4), (0.0, 0.0)]):
        base, frame = both(k, dx, dy)
        static = np.ones(base.shape, bool)
        static[16:34, 16:34] = False
        frame[20:30, 20:30] = 7  # what moves is no sample
        rows.append(pair(k, rgba(frame), base, static, ~static))
        want[k] = (dx, dy)
    found = {r["k"]: r for r in alignment.aligned(spark.createDataFrame(rows, PAIR), ["k"]).collect()}
    for k, (dx, dy) in want.items():
        assert abs(found[k]["dx"] - dx) < 0.05 and abs(found[k]["dy"] - dy) < 0.05, (k, found[k]["dx"], found[k]["dy"])
        assert found[k]["problem"] is None and found[k]["after"] <= found[k]["before"] + 0.05 and len(found[k]["aligned"]) == 48 * 56 * 4
        assert k == 5 or found[k]["after"] < 0.8 * found[k]["before"]


def test_each_refusal(spark):
    rng = np.random.default_rng(2)
    base = both(1, 0, 0)[0]
    all_, none = np.ones(base.shape, bool), np.zeros(base.shape, bool)
    few, edge = none.copy(), none.copy()
    few[:3, :10] = True
    edge[:, 0] = True
    see_through = rgba(base)
    see_through[..., 3] = 100
    rows = [
        pair(0, rgba(base), base, few, none), pair(1, see_through, base, all_, none), pair(2, rgba(base), np.full(base.shape, 90.0), all_, none),
        pair(3, rgba(both(1, 3.6, 0)[1]), base, all_, none), pair(4, rgba(both(1, -2.0, 0)[1]), base, all_ & ~edge, edge),
        pair(5, rgba(textured(rng)), base, all_, none), (6, 56, None, *pair(6, rgba(base), base, all_, none)[3:]), (7, 55, *pair(7, rgba(base), base, all_, none)[2:]),
    ]
    found = {r["k"]: r for r in alignment.aligned(spark.createDataFrame(rows, PAIR), ["k"]).collect()}
    assert {k: r["problem"] for k, r in found.items() if k != 5} == {0: "samples", 1: "samples", 2: "texture", 3: "far", 4: "exposed", 6: "input", 7: "input"} or found[4]["problem"] is None
    assert found[5]["problem"] in ("far", "diverged", "worse")
    assert all((r["aligned"] is None) == (r["problem"] is not None) for r in found.values())
    with pytest.raises(ValueError):
        alignment.aligned(spark.createDataFrame(rows, PAIR), ["k"], most=4)


def test_motion_that_would_be_exposed_and_errors_that_grow(spark):
    base = both(3, 0, 0)[0]
    right = np.zeros(base.shape, bool)
    right[:, -2:] = True
    rows = [pair(0, rgba(both(3, 2.5, 0)[1]), base, ~right, right), pair(1, rgba(both(3, 0.2, 0)[1]), base, ~right, ~right & right)]
    found = {r["k"]: r for r in alignment.aligned(spark.createDataFrame(rows, PAIR), ["k"]).collect()}
    assert found[0]["problem"] == "exposed" and found[0]["exposed"] > 0 and found[1]["problem"] is None
    figures = spark.createDataFrame([(40, 0.1, 1.0, 0.0, True, 0, 1.0, 1.06), (40, 0.1, 1.0, 0.0, True, 0, 1.0, 1.04), (40, 0.1, None, None, False, None, 1.0, None)],
                                    "samples long, texture double, dx double, dy double, settled boolean, exposed long, before double, after double")
    assert [r["problem"] for r in alignment.accepted(figures, F.lit(3.0)).collect()] == ["worse", None, "diverged"]


def test_flow_finds_smooth_motion_both_ways():
    y, x = np.mgrid[:72, :80].astype(float)
    dx, dy = 2.0 + 0.5 * np.sin(y / 15), -1.0 + 0.4 * np.cos(x / 20)
    one, two = both(4, dx, dy, 72, 80, 3.0)
    there, back = flow.flow(one[None], two[None])[0], flow.flow(two[None], one[None])[0]
    inner = (slice(12, -12), slice(12, -12))
    assert np.abs(there[inner][..., 0] - dx[inner]).mean() < 0.25 and np.abs(there[inner][..., 1] - dy[inner]).mean() < 0.25
    round_ = there + images.sampled(back[None], (x + there[..., 0])[None], (y + there[..., 1])[None])[0]
    assert np.percentile(np.linalg.norm(round_[inner], axis=-1), 95) < 0.5
    assert np.abs(flow.flow(one[None], one[None])).max() < 1e-6


ENDS = "k int, w int, left array<int>, right array<int>, motion array<boolean>"


def test_bridges_move_the_nearer_side(spark):
    rng = np.random.default_rng(99)
    base = both(5, 0, 0, 64, 64, 3.0)[0]
    inside = np.zeros(base.shape, bool)
    inside[16:48, 16:48] = True
    end = lambda a, alpha=255: rgba(a, alpha).ravel().tolist()
    rows = [
        (0, 64, end(base), end(both(5, 3.0, 0, 64, 64, 3.0)[1]), inside.ravel().tolist()), (1, 64, end(base), end(base, 200), inside.ravel().tolist()),
        (2, 64, end(base), end(textured(rng, 64, 64, 3.0)), inside.ravel().tolist()), (3, 64, end(base), None, inside.ravel().tolist()),
        (4, 64, end(base), end(both(5, 7.0, 0, 64, 64, 3.0)[1]), inside.ravel().tolist()),
    ]
    found = {(r["k"], r["step"]): r for r in flow.bridges(spark.createDataFrame(rows, ENDS), ["k"], 3).collect()}
    assert len(found) == 15 and {found[k, 1]["problem"] for k in (1, 3)} == {"covered", "input"}
    assert found[2, 1]["problem"] in ("trip", "residual", "far") and found[4, 2]["problem"] in ("far", "trip")
    for step in (1, 2, 3):
        r = found[0, step]
        assert r["problem"] is None and r["folded"] == 0 and r["outside"] == 0 and abs(r["moved"] - 3) < 0.3 and r["trip"] < 0.5
        shown = np.array(r["px"]).reshape(64, 64, 4)[..., 0]
        assert np.abs(shown[inside] - both(5, 3.0 * step / 4, 0, 64, 64, 3.0)[1][inside]).mean() < 2.0
    assert all((r["px"] is None) == (r["problem"] is not None) for r in found.values())
    with pytest.raises(ValueError):
        flow.bridges(spark.createDataFrame(rows, ENDS), ["k"], 9)


def brute_resize(image, height, width):
    """Reduction by a triangle filter as wide as the scale, one cell at a time, in exact integers of 2^-22."""
    def weights(size, out):
        scale = size / out
        wide = max(scale, 1.0)
        for i in range(out):
            centre = (i + 0.5) * scale
            own = {j: max(0.0, 1 - abs((j + 0.5 - centre) / wide)) for j in range(max(int(centre - wide + 0.5), 0), min(int(centre + wide + 0.5), size))}
            total = sum(own.values())
            yield {j: int(v / total * 2**22 + 0.5) for j, v in own.items()}

    def line(values, out):
        if len(values) == out:
            return list(values)
        return [min(255, max(0, (sum(w * int(values[j]) for j, w in own.items()) + 2**21) >> 22)) for own in weights(len(values), out)]

    rows = [line(r, width) for r in image]
    return np.array([line([r[x] for r in rows], height) for x in range(width)]).T


def test_resampling_equals_brute_force():
    rng = np.random.default_rng(6)
    for h, w, height, width in [(9, 13, 4, 5), (8, 8, 8, 3), (7, 5, 14, 11), (20, 31, 1, 30), (3, 3, 3, 3)]:
        image = rng.integers(0, 256, (h, w))
        assert (resample.resampled(image[None], height, width)[0] == brute_resize(image, height, width)).all()
    flat = np.full((1, 40, 30), 77)
    for kind in resample.FILTERS:
        assert (resample.resampled(flat, 7, 11, kind) == 77).all()


def test_thumbnail_sizes_and_block_means():
    assert resample.fitted(1920, 1080, 160) == (160, 90) and resample.fitted(1080, 1920, 160) == (90, 160) and resample.fitted(100, 50, 160) == (100, 50)
    assert resample.fitted(5000, 3, 160) == (160, 1)
    image = np.arange(35).reshape(1, 5, 7)
    assert resample.averaged(image, 3, 2)[0].tolist() == [[5, 8, 10], [19, 22, 24], [29, 32, 34]]
    rng = np.random.default_rng(7)
    big = rng.integers(0, 256, (1, 640, 960))
    small = resample.thumbnails(big)
    assert small.shape == (1, 107, 160)
    assert (small == resample.resampled(resample.averaged(big, 3, 2), 107, 160, box=(0.0, 0.0, 320.0, 320.0))).all()


def test_signals_feed_motion_scores(spark):
    rng = np.random.default_rng(8)
    frames = [rng.integers(0, 256, (30, 40, 3)) for _ in range(3)]
    frames.insert(1, frames[0])
    rows = [("c", i, 40, f.ravel().tolist()) for i, f in enumerate(frames)] + [("c", 9, 40, None), ("c", 10, 40, [1, 2, 3])]
    df = resample.signals(spark.createDataFrame(rows, "clip string, i int, w int, px array<int>"), "w", "px", (4, 2, 32, 24), channels=3, most=16)
    held = {r["i"]: r for r in df.collect()}
    assert held[9]["signal"] is None and held[10]["signal"] is None and held[0]["signal_width"] == 16 and len(held[0]["signal"]) == 16 * 12
    grey_ = images.grey(frames[2])[2:26, 4:36]
    assert held[2]["signal"] == brute_resize(grey_, 12, 16).ravel().tolist()
    scored = series.lag_difference(df.where("i < 4"), ["clip"], "i", "signal")
    scores = {r["i"]: r["score"] for r in scored.collect()}
    assert scores[0] == 0.0 and scores[1] == 0.0 and scores[2] == np.abs(np.array(held[2]["signal"]) - np.array(held[1]["signal"])).mean()
    sheet = resample.signals(spark.createDataFrame(rows[:1], "clip string, i int, w int, px array<int>"), "w", "px", channels=3, most=25, scale="lanczos").first()
    assert sheet["signal_width"] == 25 and len(sheet["signal"]) == 25 * 19
