import pytest
from pyspark.sql import functions as F

from framequill.functions import text
from framequill.operators import ledger, lineage, requests, rules


def test_unknown_is_a_violation_and_blocks(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, n int")
    found = rules.violations(df, ["id"], {"positive": F.col("n") > 0})
    assert sorted(r["id"] for r in found.collect()) == [2, 3]
    states = {r["id"]: (r["status"], r["circular"]) for r in rules.status(df, found, ["id"]).collect()}
    assert states == {1: ("reviewed", True), 2: ("blocked", False), 3: ("blocked", False)}


def test_a_failed_or_erring_recheck_revokes(spark):
    df = spark.createDataFrame([("a", 1, "pass"), ("a", 2, "fail"), ("b", 1, "fail"), ("b", 2, "pass"), ("c", 1, "error")], "k string, seq int, outcome string")
    assert {r["k"]: r["state"] for r in rules.current(df, ["k"], "seq").collect()} == {"a": "revoked", "b": "approved", "c": "revoked"}


def admit(spark, rows, **limits):
    df = spark.createDataFrame([(1, i, s, f) for i, (s, f) in enumerate(rows)], "k int, i int, s double, f string")
    found = ledger.admitted(df, "k", ["i"], "s", "f", **({"most": 3, "total": 8, "per_request": 5} | limits)).orderBy("id").collect()
    return [(r["accepted"], r["reason"], r["used"]) for r in found]


def test_refused_requests_consume_nothing(spark):
    assert admit(spark, [(5.0, "a"), (5.0, "b"), (3.0, "c")]) == [(True, "", 5.0), (False, "total", 5.0), (True, "", 8.0)]
    assert [r[1] for r in admit(spark, [(1.0, "a"), (1.0, "a"), (6.0, "b"), (None, "c"), (float("nan"), "d"), (1.0, "e"), (1.0, "f"), (1.0, "g")])] == [
        "", "duplicate", "per-request", "invalid", "invalid", "", "", "count"]


def test_stages_follow_the_ledger(spark):
    rows = [("a", 1, "pilot", "p", None), ("a", 2, "segment", "s", None), ("a", 3, "expansion", "e", "p"), ("a", 4, "expansion", "f", "q"), ("b", 1, "repair", "r", None), ("b", 2, "pilot", "p", None),
            ("c", 1, "expansion", "e", "p"), ("c", 2, "else", "x", None)]
    found = ledger.stage_problems(spark.createDataFrame(rows, "k string, n int, stage string, request string, pilot_request string"), "k", "n").collect()
    assert sorted((r["k"], r["seq"], r["problem"]) for r in found) == [("a", 4, "no-single-pilot"), ("b", 2, "pilot-not-first"), ("c", 1, "no-single-pilot"), ("c", 2, "unknown-stage")]


def test_requests_outside_the_recorded_models_are_refused(spark):
    df = spark.createDataFrame([(1, i, 1.0, f"f{i}", m) for i, m in enumerate(["a", "b", None])], "k int, i int, s double, f string, m string")
    found = ledger.admitted(df, "k", ["i"], "s", "f", most=3, total=8, per_request=5, allowed=F.col("m") == "a").orderBy("id").collect()
    assert [r["reason"] for r in found] == ["", "not-allowed", "not-allowed"]


def test_overlap_reports_each_pair_once(spark):
    df = spark.createDataFrame([("g", 1, 0, 0, 200, 200), ("g", 2, 10, 10, 150, 150), ("g", 3, 200, 0, 10, 10), ("h", 4, 0, 0, 9, 9)], "g string, id int, x int, y int, w int, h int")
    assert [(r["a"], r["b"]) for r in rules.overlapping(df, ["g"], 32).collect()] == [(1, 2)]


def test_nearest_ties_go_to_the_first(spark):
    assert spark.range(1).select(rules.nearest(F.lit(2.0), [("a", 1.0), ("b", 3.0), ("c", 2.5)])).first()[0] == "c"
    assert spark.range(1).select(rules.nearest(F.lit(2.0), [("a", 1.0), ("b", 3.0)])).first()[0] == "a"


def test_bindings(spark):
    bound = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "c", "3")], "scope string, path string, sha256 string")
    now = spark.createDataFrame([("s", "a", "1"), ("s", "b", "9")], "scope string, path string, sha256 string")
    assert sorted((r["path"], r["problem"]) for r in lineage.stale(bound, now).collect()) == [("b", "changed"), ("c", "missing")]
    assert lineage.same_records(bound, bound).count() == 0
    assert lineage.same_records(bound.union(bound), bound).count() == 3


def test_lineage_mismatch_is_null_safe(spark):
    a = spark.createDataFrame([(0, None), (1, 0.5), (2, None)], "index int, fraction double")
    b = spark.createDataFrame([(0, None), (1, None), (3, None)], "index int, fraction double")
    assert sorted((r["index"], r["problem"]) for r in lineage.mismatches(a, b, ["index"], ["fraction"]).collect()) == [(1, "differs"), (2, "unexpected"), (3, "missing")]


@pytest.mark.parametrize("value,expected", [("25/1", 25.0), ("30000/1001", 30000 / 1001), ("0/0", None), ("N/A", None), ("12.5", 12.5)])
def test_rational(spark, value, expected):
    assert spark.range(1).select(text.rational(F.lit(value))).first()[0] == expected


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.hex_colour(F.lit("#0f8"))) == [0, 255, 136] and one(text.hex_colour(F.lit("#12345"))) is None
    assert one(text.short_number(F.lit(2.50))) == "2.5" and one(text.short_number(F.lit(10.0))) == "10"
    assert not one(text.is_confined(F.lit("/a"))) and not one(text.is_confined(F.lit("a/../b"))) and one(text.is_confined(F.lit("a..b/c")))
    assert not one(text.is_prose(F.lit(None).cast("string"))) and not one(text.is_prose(F.lit("a {{pose}}")))
    assert one(text.masked(F.lit("see https://x.y/z?q=1 ok"))) == "see [url] ok"
    assert one(text.canonical({"b": F.lit(1), "a": F.lit("x")})) == '{"a":"x","b":1}'


def test_limited_is_surfaced_and_isolation_must_pass(spark):
    df = spark.createDataFrame([(1, "isolation", "pass"), (1, "timing", "limited"), (2, "isolation", "limited"), (3, "timing", "pass"), (4, "isolation", "pass"), (4, "timing", "unknown")], "k int, check string, status string")
    assert {r["k"]: r["accepted"] for r in requests.review_outcome(df, "k", "isolation").collect()} == {1: True, 2: False, 3: False, 4: False}
