import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from framequill.functions import text
from framequill.operators import contracts, requests, rules
from framequill.streaming import pointer


def nested(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 6)
    if kind == 6:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 7:
        return {"".join(rng.choice("aZé_ \"\\/\u0001😀￮9") for _ in range(rng.randrange(5))): nested(rng, depth + 1) for _ in range(rng.randrange(5))}
    return [None, True, rng.randrange(-10**20, 10**20), rng.choice([1.0, 0.1, 1e22, 1e-7, -0.0, 2.5]), "tëxt \n", ""][kind]


def test_documents_of_any_shape_hash_as_their_sorted_form(spark):
    rng = random.Random(1)
    docs = [json.dumps(nested(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(200)] + ["{broken", "", None]
    found = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", text.document_sha256(F.col("d")).alias("h")).collect()
    for r in found:
        want = hashlib.sha256(json.dumps(json.loads(docs[r["i"]]), sort_keys=True, separators=(",", ":")).encode()).hexdigest() if r["i"] < 200 else None
        assert r["h"] == want
    keys = spark.range(1).select(text.unknown_keys(F.lit('{"a": 1, "zz": {"q": 2}, "b": 3}'), ["a", "b"])).first()[0]
    assert keys == ["zz"]


def reviewed(status=None, notes="seen", without=()):
    return [(c, (status or {}).get(c, "pass"), notes) for c in requests.CHECKS if c not in without]


@pytest.mark.parametrize("rows,accepted", [
    (reviewed(), True), (reviewed({"framing": "limited", "motionReference": "not-applicable"}), True), (reviewed({"subjectIsolation": "limited"}), False),
    (reviewed({"subjectIsolation": "not-applicable"}), False), (reviewed({"identity": "fail"}), False), (reviewed({"identity": "unreviewed"}), False),
    (reviewed({"identity": None}), False), (reviewed(notes=" "), False), (reviewed(notes=None), False), (reviewed(without=("framing",)), False), ([], False),
])
def test_reviews_need_all_ten_observed(spark, rows, accepted):
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, check string, status string, notes string")
    bound = spark.createDataFrame([(1, "a", "a", "b", "b", "c", "c", "d", "d")], "k int, request string, request_now string, plan string, plan_now string, identity string, identity_now string, media string, media_now string")
    assert requests.review_decision(df, bound, "k").first()["accepted"] is accepted
    for name in ("request", "plan", "identity", "media"):
        for other in ("x", None):
            r = requests.review_decision(df, bound.withColumn(name, F.lit(other)), "k").first()
            assert r["stale"] == name and r["accepted"] is False


def test_requirements_name_what_can_control_them(spark):
    schema = "k int, r map<string, struct<expected: string, verify: string, controls: array<string>>>"
    whole = {n: ("moves", "look", ["image"]) for n in requests.REQUIREMENTS}
    plans = [(1, whole), (2, whole | {"gaze": ("moves", "look", ["prompt"]), "loop": ("", "look", ["runtime", "seed"]), "rest": ("moves", None, [])}), (3, {k: v for k, v in whole.items() if k != "range"} | {"tail": ("x", "y", ["video"])}), (4, None)]
    media = spark.createDataFrame([(1, "image"), (2, "image"), (3, "audio")], "k int, role string")
    found = sorted((r["k"], r["name"], r["rule"], r["detail"]) for r in requests.requirement_problems(spark.createDataFrame(plans, schema), "k", "r", media, "role").collect())
    assert [f for f in found if f[0] == 1] == []
    assert [f[1:] for f in found if f[0] == 2] == [("gaze", "text-only", None), ("loop", "expected", None), ("loop", "unavailable", "seed"), ("rest", "controls", None), ("rest", "verify", None)]
    assert {f[1:3] for f in found if f[0] == 3} == {("range", "missing"), ("tail", "unknown")} | {(n, "unavailable") for n in requests.REQUIREMENTS if n != "range"}
    assert {f[1:3] for f in found if f[0] == 4} == {(n, "missing") for n in requests.REQUIREMENTS}


def test_observations_agree_in_frame_head_and_gaze(spark):
    anchors = spark.createDataFrame([(k, o, 10 * o, d) for k in (1, 2, 3) for o, d in enumerate(("up", "right"))], "k int, ord int, frame int, direction string")
    seen = [(1, 0, 0, "up", "up", True), (1, 1, 10, "right", "right", True), (2, 0, 1, "up", "up", True), (2, 1, 10, "right", "up", True), (3, 0, 0, "up", "up", True)]
    df = spark.createDataFrame(seen, "k int, ord int, frame int, head string, gaze string, evidence boolean")
    assert sorted((r["k"], r["ord"], r["problem"]) for r in rules.observation_problems(df, anchors, ["k"]).fillna(-1).collect()) == [(2, 0, "frame"), (2, 1, "gaze"), (3, -1, "count")]


def test_plates_are_there_and_unchanged(spark):
    assets = spark.createDataFrame([("p", "h", 4, 3), ("c", "i", 9, 9)], "path string, sha256 string, width int, height int")
    rows = [(1, "page", "p", "h", 4, 3, "c"), (2, "page", "q", "h", 4, 3, "c"), (3, "page", "p", "x", 4, 3, None), (4, "page", "p", "h", 4, 4, "z"), (5, "scene", None, None, 0, 0, None), (6, "page", None, None, 4, 3, "c")]
    df = spark.createDataFrame(rows, "k int, owner string, plate string, plate_sha256 string, width int, height int, contact string")
    assert sorted(tuple(r) for r in contracts.plate_problems(df, assets, "k").collect()) == [(2, "plate-missing"), (3, "contact-missing"), (3, "plate-changed"), (4, "contact-missing"), (4, "plate-size"), (6, "plate-missing")]


def test_a_fast_position_is_not_at_rest_beside_its_goal():
    w = 2 / 0.14
    speed, dt = -742.9, 1 / 60
    e = 1 / (1 + w * dt + 0.48 * (w * dt) ** 2 + 0.235 * (w * dt) ** 3)
    way = 0.001 / e - speed * dt  # whence the goal is missed by a thousandth, at speed
    way /= 1 + w * dt
    position, after = pointer.follow(((500.0 + way) % 3600, speed), 500.0, dt, 3600, 0.14)
    assert abs(position - 500.001) < 1e-6 and abs(after) > 100
    assert pointer.follow((500.0001, 0.0001), 500.0, dt, 3600, 0.14) == (pytest.approx(500.0, abs=1e-9), 0.0)


@pytest.mark.parametrize("text_,broken", [
    ('{"duration": 5, "resolution": "768P"}', set()), ('{"duration": 5.0, "resolution": "768p"}', {"duration"}), ('{"duration": true, "resolution": "768p"}', {"duration"}), ('{"duration": 99, "resolution": "768p"}', {"duration"}),
    ('{"resolution": 768}', {"duration", "resolution"}), ('{"duration": 5, "resolution": "768p", "frames": 0, "seed": 1.5}', {"frames", "seed"}), ('{"duration": 5, "resolution": "768p", "frames": null, "seed": null}', set()),
    ('{"duration": 5, "resolution": "768p", "extra": {"prompt_expansion_mode": "quality"}}', {"expansion"}), ('{"duration": 5, "resolution": "768p", "extra": {"a": 1}}', {"extra", "expansion"}), ('{"duration": 5, "resolution": "768p", "extra": null}', {"extra"}),
    ("{oops", {"frames", "duration", "seed", "resolution", "extra", "expansion"}),
])
def test_options_keep_their_types(spark, text_, broken):
    from framequill.operators import motion

    found = motion.spec_options(F.lit(text_), F.array(F.lit("768p")), F.lit(4), F.lit(15), F.lit(False))
    row = spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first()
    assert {n for n in found if not row[n]} == broken
