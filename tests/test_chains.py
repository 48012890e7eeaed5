import random

import pytest
from pyspark.sql import functions as F

from framequill.operators import lineage, motion


def test_chains_of_any_length_and_cycles(spark):
    rng = random.Random(1)
    up = {i: (i - 1 if i % 40 else None) if i < 120 else rng.randrange(i) if i < 200 else {200: 202, 201: 200, 202: 201, 203: 203, 204: 202, 205: 204, 206: 999, 207: None, 208: 207}[i] for i in range(209)}
    rows = [(i, f"s{i}", None if p is None else f"s{p}") for i, p in up.items()]
    chains, bad = lineage.ancestors(spark.createDataFrame(rows, "k int, sha string, parent string").repartition(3), "k", "sha", "parent")
    want, refused = set(), set()
    for i in up:
        at, d, seen = i, 0, []
        while at is not None and at in up and at not in seen:
            seen.append(at)
            at, d = up[at], d + 1
        if at in seen:
            refused.add(i)
        else:
            want |= {(i, a, n) for n, a in enumerate(seen)}
    assert {r["k"] for r in bad.collect()} == refused == {200, 201, 202, 203, 204, 205}
    assert {(r["k"], r["ancestor"], r["distance"]) for r in chains.collect()} == want
    entries = spark.createDataFrame([(0, "a", "old"), (1, "a", "new"), (0, "b", "kept"), (3, "c", "own")], "k int, path string, sha256 string")
    found = {(r["k"], r["path"]): (r["sha256"], r["distance"]) for r in lineage.inherited(chains, entries, "k").where("k in (0, 2, 3)").collect()}
    assert found == {(0, "a"): ("old", 0), (0, "b"): ("kept", 0), (2, "a"): ("new", 1), (2, "b"): ("kept", 2), (3, "a"): ("new", 2), (3, "b"): ("kept", 3), (3, "c"): ("own", 0)}
    empty = spark.createDataFrame([], "k int, sha string, parent string")
    assert [d.count() for d in lineage.ancestors(empty, "k", "sha", "parent")] == [0, 0]


SPEC = ("kind string, subject string, start_pose string, end_pose string, allowed_motion string, framing string, background struct<mode: string, description: string, key_color: string>, static_context string,"
        " reference_roles string, entry_end double, cycle_end double, requirements array<struct<name: string, expected: string, controls: array<string>>>")
GOOD = {"kind": "closed-orbit", "subject": " the cat ", "start_pose": "looks up", "end_pose": "looks up", "allowed_motion": "turns", "framing": "whole", "background": ("scene-preserve", "a wall", None), "static_context": None,
        "reference_roles": None, "entry_end": None, "cycle_end": None, "requirements": [("tail", "still", ["prompt"]), ("gaze", "leads", ["image"]), ("x", "y", ["runtime", "prompt"])]}


def one(spark, **changes):
    spec = GOOD | changes
    df = spark.createDataFrame([tuple(spec.values())], SPEC).select(F.struct("*").alias("s"))
    s = F.col("s")
    points = motion.checkpoints(s["kind"], F.lit("left"), F.lit("up"), F.lit("right"), s["entry_end"], s["cycle_end"])
    return df.select(motion.assembled(s, points).alias("p")).first()["p"]


def test_prompts_say_what_is_asked_in_order(spark):
    p = one(spark)
    lines = p["prompt"].split("\n")
    assert p["problem"] is None and p["included"] == ["tail", "x"] and p["not_sent"] == ["gaze"]
    assert lines[0].endswith("only the cat moves.") and "0% up -> 12.5% upper-right" in lines[3] and lines.index("tail: still.") < lines.index("x: y.") and "leads" not in p["prompt"]
    assert one(spark, requirements=[("tail", "wags", ["prompt"])])["prompt"] != p["prompt"] and one(spark, requirements=None)["included"] == []
    entry = one(spark, kind="entry-orbit", entry_end=0.25, cycle_end=1.0)
    assert "0% neutral -> 25% up" in entry["prompt"] and "100% neutral" not in entry["prompt"]
    assert "100% neutral" in one(spark, kind="entry-orbit")["prompt"] and "->" not in one(spark, kind="diagnostic")["prompt"]
    assert "Image 1 is who" in one(spark, kind="reference-motion", reference_roles="Image 1 is who.")["prompt"]
    assert "#00FF00" in one(spark, background=("chroma-key", "a wall", "#00FF00"))["prompt"]


@pytest.mark.parametrize("changes,problem", [
    ({"start_pose": "[ACTUAL START POSE]"}, "start_pose"), ({"subject": " "}, "subject"), ({"framing": None}, "framing"), ({"background": ("blur", "x", None)}, "background-mode"), ({"background": ("alpha-matte", "", None)}, "background-description"),
    ({"background": ("chroma-key", "x", "green")}, "key-color"), ({"background": ("chroma-key", "x", None)}, "key-color"), ({"background": ("scene-preserve", "x", "#00ff00")}, "key-color"), ({"kind": "spin"}, "kind"), ({"kind": None}, "kind"),
    ({"kind": "entry-orbit", "entry_end": 0.9, "cycle_end": 0.5}, "timing-order"), ({"kind": "entry-orbit", "entry_end": 0.0}, "timing-order"), ({"kind": "entry-orbit", "cycle_end": 1.1}, "timing-order"), ({"entry_end": 0.2}, "timing-kind"),
    ({"kind": "reference-motion"}, "reference_roles"), ({"requirements": [("a", "{{todo}}", ["prompt"])]}, "expected"), ({"requirements": [("a", "x", None)]}, "controls"), ({"static_context": "replace-with-x"}, "static_context"),
])
def test_unfinished_prompts_are_refused(spark, changes, problem):
    p = one(spark, **changes)
    assert p["prompt"] is None and p["problem"] == problem
