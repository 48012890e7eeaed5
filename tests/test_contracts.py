from pyspark.sql import functions as F

from framequill.operators import contracts, pixels, rules
from framequill.sources import frames
from framequill.streaming import pointer

GOOD = [(0, 0.0), (3, 45.0), (6, 90.0), (9, 135.0), (12, 180.0), (15, 225.0), (18, 270.0), (21, 315.0)]


def broken(spark, rules_of, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id int, {schema}")
    found = {}
    for r in rules.violations(df, ["id"], rules_of).collect():
        found.setdefault(r["id"], set()).add(r["rule"])
    return [found.get(i, set()) for i in range(len(rows))]


def test_anchors(spark):
    base = list(range(0, 24, 3))
    found = broken(spark, contracts.anchors(F.col("d"), F.lit(24)), [(base,), ([0] + base[:-1],), (base[:-1] + [24],), (base[1:] + [23],), (base[:-1],), (base[:-1] + [None],)], "d array<int>")
    assert found[0] == set() and found[1] == {"anchors-increasing"} and found[2] == {"anchors-range"} and found[3] == {"anchors-first"}
    assert "anchors-eight" in found[4] and {"anchors-increasing", "anchors-range"} <= found[5]


def test_phases(spark):
    anchors = [f for f, _ in GOOD]
    cases = [GOOD, GOOD + [(22, 330.0)], GOOD[:-1], [(0, 1.0)] + GOOD[1:], GOOD[:7] + [(21, 300.0)], GOOD[:7] + [(21, 360.0)], GOOD[:3] + [(5, 100.0)] + GOOD[3:]]
    found = broken(spark, contracts.phases(F.col("s"), F.col("d")), [(c, anchors) for c in cases], "s array<struct<frame:int,deg:double>>, d array<int>")
    assert found[0] == found[1] == set() and {"phases-count", "phases-anchors"} <= found[2] and "phases-start" in found[3]
    assert found[4] == {"phases-anchors"} and "phases-finite" in found[5] and found[6] == {"phases-increasing"}


def test_preview(spark):
    schema = "mode string, s array<struct<deg:double,frame:int>>, notes string, certified boolean"
    arc, phase = [(315.0, 0), (360.0, 3), (405.0, 7)], [(0.0, 0), (180.0, 3), (360.0, 7)]
    rows = [("arc", arc, "n", False), ("phase", phase, "n", False), ("phase", arc, "n", False), ("arc", phase, "n", False), ("ring", arc, " ", True), ("arc", arc[::-1], "n", False)]
    found = broken(spark, contracts.preview(F.col("mode"), F.col("s"), F.col("notes"), F.col("certified")), rows, schema)
    assert found[0] == found[1] == set() and found[2] == found[3] == {"preview-span"}
    assert {"preview-mode", "preview-notes", "preview-uncertified"} <= found[4] and "preview-increasing" in found[5]


def test_selection_fields_sheets_seams_and_bridges(spark):
    assert broken(spark, contracts.selection(F.col("i")), [([1, 2],), ([],), ([1, 1],), (list(range(13)),)], "i array<int>") == [set(), {"selection-size"}, {"selection-unique"}, {"selection-size"}]
    assert broken(spark, contracts.spec_fields(F.col("k"), ["a"]), [(["a"],), (["a", "token"],), (["b"],)], "k array<string>") == [set(), {"fields-forbidden"}, {"fields-unknown"}]
    assert broken(spark, contracts.sheets(F.col("n"), F.col("c"), F.lit(4)), [(["a", "b"], 5), (["a", "a"], 8), (["a"], 5)], "n array<string>, c int") == [set(), {"sheets-unique"}, {"sheets-count"}]
    assert broken(spark, contracts.seam(F.col("s"), F.col("f")), [(["u", "m", "u"], [8, 4, 6]), (["u", "m"], [2, 3])], "s array<string>, f array<int>") == [set(), {"seam-source", "seam-order"}]
    assert broken(spark, contracts.bridges(F.col("c"), F.col("g")), [(1, 30.0), (9, 10.0), (2, 31.0), (2, 0.0)], "c int, g double") == [set(), {"bridge-count"}, {"bridge-gap"}, {"bridge-gap"}]
    assert broken(spark, contracts.background(F.col("o"), F.lit("m"), F.col("c"), F.col("c")), [("page", "x"), ("page", None), ("base", None)], "o string, c string") == [set(), {"background-page"}, set()]


def test_patch_modes_and_motion(spark):
    df = spark.createDataFrame([("preserve",), ("replace-edge-light",), ("fit-edge-light",), ("chroma-key",), ("none of these",)], "mode string")
    found = df.select(pixels.patched(F.lit(240), F.lit(10), F.lit(300.7), F.col("mode"), F.lit(True), F.lit(True), F.lit(200), F.lit(51)), pixels.patched(F.lit(9), F.lit(1), F.lit(7.9), F.col("mode"), F.lit(True), F.lit(False), F.lit(9), F.lit(255)))
    assert [tuple(r) for r in found.collect()] == [(240, 9), (10, 9), (255, 9), (48, 9), (None, None)]
    rows = [("k", i, [255] * 80, [10 * i] * 80) for i in range(3)] + [("t", i, [255] * 8, [i] * 8) for i in range(2)]
    found = pixels.matte_motion(spark.createDataFrame(rows, "k string, i int, m array<int>, p array<int>"), ["k"], "i", "m", "p").collect()
    assert sorted((r["k"], r["i"], r["edge_motion"]) for r in found if r["edge_motion"] is not None) == [("k", 1, 10.0), ("k", 2, 10.0)]


def test_source_helpers(spark, tmp_path):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "source string, frame int")
    assert frames.selected(df, [4, 1, 1]).count() == 2 and frames.missing_selected(df, [0, 1]).collect()[0]["source"] == "b"
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(frames.frame_number(F.lit("clip-000012.png"))) == 12 and one(frames.first_listed(F.array(F.lit("720P"), F.lit("1080p")), F.lit("1080P"))) == "1080p"
    assert one(frames.matte_of(F.create_map(F.lit(3), F.lit("m")), F.lit(4))) is None
    content = spark.createDataFrame([(b"x",), (b"y",), (b"x",)], "content binary")
    for _ in range(2):
        frames.archive(content, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2


def test_an_arc_rests_outside_and_measures_along_itself():
    gate = pointer.Gate(arc=(315.0, 405.0), hysteresis=0.2)
    state, seen = pointer.REST, []
    for dx, dy in ((0.0, -100.0), (100.0, 0.0), (10.0, -100.0), (60.0, -100.0), (0.0, 100.0)):
        state, action = pointer.point(state, dx, dy, gate)
        seen.append(action)
    assert seen == ["snap", "rest", "snap", "move", "rest"]
