from pyspark.sql import functions as F

from framequill.operators import motion, rules

PLAN = {
    "kind": "closed-orbit", "subjects": ["cat"], "coordinate_system": "screen", "path": "clockwise", "seam_direction": "up", "seam_verified": True, "first_pose": "neutral", "cycle_start": "up",
    "cycle_end": "up", "exclude_entry": True, "start_direction": "upper-left", "end_direction": "upper-right", "via": "up", "assembly": "a", "reference_roles": "r", "evidence": "e.json",
    "duration_reason": "covers a turn", "duration": 6, "frames": None,
}
KIND = "struct<" + ",".join(f"{k}:{'array<string>' if k == 'subjects' else 'boolean' if k in ('seam_verified', 'exclude_entry') else 'int' if k in ('duration', 'frames') else 'string'}" for k in PLAN) + ">"
BOTH = {"first_frame": "x", "last_frame": "x"}


def broken(spark, cases):
    df = spark.createDataFrame([(i, tuple((PLAN | change).values()), roles) for i, (change, roles) in enumerate(cases)], f"id int, p {KIND}, roles map<string,string>")
    found = [set() for _ in cases]
    for r in rules.violations(df, ["id"], motion.plan_contract(F.col("p"), F.col("roles"))).collect():
        found[r["id"]].add(r["rule"])
    return found


def test_each_kind_has_its_contract(spark):
    assert broken(spark, [({}, BOTH), ({"kind": "entry-orbit"}, BOTH), ({"kind": "upper-arc"}, BOTH), ({"kind": "segment"}, BOTH), ({"kind": "diagnostic"}, {}), ({"kind": "reference-motion"}, {"reference_video": "v"})]) == [set()] * 6
    found = broken(spark, [
        ({"kind": "spin"}, BOTH), ({"subjects": ["a", "b"]}, BOTH), ({"subjects": [" "]}, BOTH), ({"duration": None}, BOTH), ({"path": "left"}, BOTH), ({"seam_verified": None}, BOTH),
        ({}, {"first_frame": "x", "last_frame": "y"}), ({}, {}), ({"kind": "entry-orbit", "exclude_entry": False}, BOTH), ({"kind": "upper-arc", "end_direction": "up"}, BOTH),
        ({"kind": "reference-motion", "reference_roles": ""}, BOTH | {"reference_video": "v"}), ({"kind": "segment", "via": None}, {"first_frame": "x"}), ({"evidence": None, "duration_reason": " "}, BOTH)])
    assert found == [{"plan-kind"}, {"plan-subject"}, {"plan-subject"}, {"plan-duration"}, {"plan-screen"}, {"orbit-seam"}, {"orbit-same-ends"}, {"plan-first-frame", "orbit-same-ends"}, {"entry-cycle"}, {"arc-ends"},
                     {"reference-video", "reference-roles"}, {"segment-frames", "segment-route"}, {"plan-evidence", "plan-reason"}]


def test_entry_timing(spark):
    points = motion.checkpoints(F.lit("entry-orbit"), *[F.lit(None).cast("string")] * 3, F.lit(0.2), F.lit(1.0))
    row = spark.range(1).select(points.alias("p"), motion.path_text(points).alias("t")).first()
    assert [p["direction"] for p in row["p"]] == ["neutral", *motion.CYCLE] and row["p"][-1]["fraction"] == 1.0
    assert row["t"].startswith("0% neutral -> 20% up -> 30% upper-right") and row["t"].endswith("100% up")


def test_prompt_source_and_options(spark):
    df = spark.createDataFrame([(0, True, 0), (1, True, 1), (2, False, 1), (3, False, 0), (4, False, 2)], "id int, s boolean, m int")
    assert sorted(r["id"] for r in rules.violations(df, ["id"], motion.prompt_source(F.col("s"), F.col("m"))).collect()) == [1, 3, 4]
    rows = [(0, "768P", ["480p", "768p"], 6, 5, 15, "quality", True), (1, "2K", ["768p"], 3, 4, 15, None, False), (2, "768p", None, 6, None, None, None, None), (3, "768p", ["768p"], 6, 4, 15, "quality", False)]
    df = spark.createDataFrame(rows, "id int, r string, rs array<string>, d int, lo int, hi int, e string, x boolean")
    found = {}
    for r in rules.violations(df, ["id"], motion.option_contract(*[F.col(c) for c in ("r", "rs", "d", "lo", "hi", "e", "x")])).collect():
        found.setdefault(r["id"], set()).add(r["rule"])
    assert found == {1: {"resolution", "duration"}, 2: {"resolution", "duration", "expansion"}, 3: {"expansion"}}
