"""Rings and routes, against plain Python over small sequences."""

import bisect
import math
import statistics

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from framequill.operators import ring, route

STOPS = (0, 7, 19, 25, 38, 51, 57, 69)
WHOLE = 77


def looked_up(spark, degrees, column):
    rows = spark.createDataFrame([(i, float(d)) for i, d in enumerate(degrees)], "i int, d double")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("d"))).collect()]


def by_hand(degrees, points, count):
    """Half-up frame between the two points around an angle."""
    at = degrees % 360
    marks = [*points, (count, 360.0)]
    i = bisect.bisect_right([d for _, d in marks], at) - 1
    (f, d), (g, e) = marks[i], marks[i + 1]
    return math.floor(f + (g - f) * (at - d) / (e - d) + 0.5) % count


def test_directions_go_round_without_a_jump(spark):
    degrees = [k * 0.7 - 500 for k in range(1500)]
    found = looked_up(spark, degrees, lambda d: ring.frame_at(ring.radians(d), STOPS, WHOLE))
    assert found == [by_hand(d, [(f, 45.0 * i) for i, f in enumerate(STOPS)], WHOLE) for d in degrees]
    assert {(b - a) % WHOLE for a, b in zip(found, found[1:])} <= {0, 1}


def test_phases_and_arcs(spark):
    points = [(0, 0.0), (4, 15.0), (7, 45.0), (40, 200.0)]
    degrees = [0, 14.9, 15, 33, 199, 201, 359, 359.99]
    assert looked_up(spark, degrees, lambda d: ring.frame_at_phase(d, points, WHOLE)) == [by_hand(d, points, WHOLE) for d in degrees]
    arc = ((280.0, 0), (330.0, 9), (400.0, 15))
    want = {280: 0, 305: 5, 330: 9, 365: 12, 5: 12, 40: 15, -80: 0, 41: None, 279: None, 100: None}
    assert looked_up(spark, want, lambda d: ring.frame_at_arc(d, arc)) == list(want.values())


def by_sector(anchors, motion):
    """Phases of a list of motions that begins at the first anchor, sector by sector."""
    out = {anchors[-1]: 45.0 * 7}
    for k, (a, b) in enumerate(zip(anchors, anchors[1:])):
        own = motion[a - anchors[0] : b - anchors[0]]
        steps = [max(m, 0.1 * statistics.median(own), 1e-6) for m in own]
        for j in range(len(own)):
            out[a + j] = 45 * k + 45 * sum(steps[:j]) / sum(steps)
    return out


def test_phases_share_a_sector_by_motion(spark):
    anchors = (3, 6, 12, 13, 20, 24, 31, 33)
    motion = [(k * 7919 % 101) / 10 * (0 if k % 6 == 1 else 1) for k in range(30)]
    df = spark.createDataFrame([("a", 3 + k, m) for k, m in enumerate(motion)] + [("a", 33, 1.0), ("a", 0, 9.0)], "k string, f int, m double")
    found = {r["frame"]: r["phase"] for r in ring.retime(df, ["k"], "f", "m", anchors).collect()}
    want = by_sector(anchors, motion)
    assert found.keys() == want.keys() and all(math.isclose(found[f], want[f], abs_tol=1e-9) for f in want)
    assert [found[a] for a in anchors] == pytest.approx([45 * k for k in range(8)]) and sorted(found.values()) == [found[f] for f in sorted(found)]


def test_what_cannot_be_retimed_is_refused(spark):
    anchors, frames = (0, 2, 4, 6, 8, 10, 12, 14), range(15)
    odd = {"nan": math.nan, "endless": math.inf, "negative": -0.1, "missing": None}
    rows = [(k, f, v if f == 5 else 1.0) for k, v in odd.items() for f in frames] + [("gap", f, 1.0) for f in frames if f != 7] + [("sound", f, 0.0) for f in frames]
    found = ring.retime(spark.createDataFrame(rows, "k string, f int, m double"), ["k"], "f", "m", anchors).where("frame < 14").groupBy("k").agg(F.count("phase").alias("n")).collect()
    assert {r["k"]: r["n"] for r in found} == {**dict.fromkeys([*odd, "gap"], 0), "sound": 14}
    for wrong in ((0, 2, 4, 6, 8, 10, 12), (0, 2, 2, 6, 8, 10, 12, 14), (0, 2, 1, 6, 8, 10, 12, 14), (0, 2.0, 4, 6, 8, 10, 12, 14)):
        with pytest.raises(ValueError, match="rising"):
            ring.retime(spark.createDataFrame(rows, "k string, f int, m double"), ["k"], "f", "m", wrong)


def test_an_upper_arc_is_spliced_around_the_main_one(spark):
    stops = (1, 5, 7, 9, 13, 14, 18, 21)
    main, upper = (spark.createDataFrame([("k", i) for i in range(n)], "k string, frame int") for n in (24, 12))
    rows = route.spliced(main, upper, ["k"], stops, 12, 5, 3).orderBy("position").collect()
    anchors = route.spliced_anchors(stops, 12, 5)
    assert {r["part"] for r in rows} == {"main", "upper"} and rows[0]["part"] == rows[-1]["part"] == "upper"
    assert [r["position"] for r in rows] == list(range(len(rows))) and anchors == sorted(set(anchors)) and len(anchors) == 8
    assert [(rows[anchors[i]]["part"], rows[anchors[i]]["origin"]) for i in (1, 7)] == [("main", stops[1]), ("main", stops[7])]


def test_densified_frames_stand_between_their_parents(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("x", 5), ("y", 1)) for i in range(n)], "k string, f int")
    rows = route.densified(df, ["k"], "f").orderBy("k", "index").collect()
    assert [(r["k"], list(r["parents"])) for r in rows] == [("x", [i // 2] if i % 2 == 0 else [i // 2, i // 2 + 1]) for i in range(9)] + [("y", [0])]
    mid = route.midpoints(df.withColumn("v", F.array((F.col("f") * F.col("f")).cast("double"))), ["k"], "f", "v").where("k = 'x'").orderBy("index").collect()
    assert [r["v"][0] for r in mid] == [0, 0.5, 1, 2.5, 4, 6.5, 9, 12.5, 16]


def test_trims_renumber_and_bridges_insert(spark):
    df = spark.createDataFrame([("k", i, 11.0 * i) for i in range(12)], "k string, f int, p double")
    gone = {2, 5, 6}
    kept = {r["f"]: r["new_frame"] for r in route.trimmed(df, ["k"], "f", ~F.col("f").isin(*gone)).collect()}
    assert kept == {f: i for i, f in enumerate(f for f in range(12) if f not in gone)}
    wanted = {0: 2, 4: 1, 7: 9}  # nine are too many
    rows = route.bridged(df, ["k"], "f", "p", F.coalesce(*[F.when(F.col("f") == f, n) for f, n in wanted.items()], F.lit(0))).orderBy("new_frame").collect()
    want = [(f, j) for f in range(12) for j in range(1 + (wanted.get(f, 0) if wanted.get(f, 0) <= 8 else 0))]
    assert [(r["from_frame"], r["synthesized"]) for r in rows] == [(f, j > 0) for f, j in want]
    assert [r["phase_raw"] for r in rows if r["synthesized"]] == pytest.approx([11 / 3, 22 / 3, 49.5])
    assert route.bridged(df.withColumn("p", F.col("p") * 3), ["k"], "f", "p", F.lit(2)).count() == 12  # gaps over 30


def test_suspects_join_the_edges_to_look_at(spark):
    df = spark.createDataFrame([("k", i, "a" if i < 4 else "b") for i in range(9)], "k string, f int, s string")
    suspects = spark.createDataFrame([("k", 1), ("k", 3)], "k string, edge int")
    found = route.boundaries(df, ["k"], "f", "s", suspects)
    assert sorted(r["edge"] for r in found.collect()) == [1, 3, 8] and sorted(r["edge"] for r in route.boundaries(df, ["k"], "f", "s").collect()) == [3, 8]
    counts = spark.createDataFrame([("k", 9)], "k string, n long")
    assert sorted(r["frame"] for r in route.neighbours(found, ["k"], counts).collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 60), st.integers(2, 24))
def test_an_overview_is_spread_and_keeps_both_ends(spark, n, k):
    rows = sorted(r["frame"] for r in ring.overview(spark.range(n).withColumn("k", F.lit(1)), ["k"], k).collect())
    assert rows == sorted({round(i * (n - 1) / (min(n, k) - 1)) if min(n, k) > 1 else 0 for i in range(min(n, k))})


def test_sweeps(spark):
    row = spark.range(1).select(*[ring.sweep(F.lit(5), k).alias(k) for k in ("ring", "arc", "source")], ring.sweep(F.lit(1), "source").alias("one")).first()
    up, down = list(range(5)), list(range(4, -1, -1))
    assert row["ring"] == up * 2 + [0] + down * 2 and row["arc"] == up + down and row["source"] == up + down[1:-1] and row["one"] == [0]


def test_distance_along_a_ray_keeps_the_direction(spark):
    from framequill.functions.angles import pointer_angle

    rows = spark.createDataFrame([(math.sin(a) * r, -math.cos(a) * r, a) for a in (0.2, 1.7, 4.4) for r in (40.0, 90.0, 700.0)], "x double, y double, a double")
    found = rows.groupBy("a").agg(F.count_distinct(F.round(pointer_angle(F.col("x"), F.col("y")), 9)).alias("n")).collect()
    assert all(r["n"] == 1 for r in found)
