from pyspark.sql import functions as F

from framequill.operators import series


def table(spark, values, name="x"):
    return spark.createDataFrame([("k", i, None if v is None else float(v)) for i, v in enumerate(values)], f"k string, i int, {name} double")


def vectors(spark, values):
    return spark.createDataFrame([("k", i, [float(v)] * 48) for i, v in enumerate(values)], "k string, i int, v array<double>")


def test_seam_of_a_rising_ring(spark):
    rows = series.seam_report(vectors(spark, range(0, 100, 10)), ["k"], ["i"], "v").orderBy("i").collect()
    assert rows[9]["diff"] == 90 and rows[9]["is_boundary"] and rows[9]["suspect"]
    assert [r["i"] for r in rows if r["suspect"]] == [9] and rows[0]["median_diff"] == 10


def test_still_ring_has_no_suspects_and_a_lone_frame_meets_itself(spark):
    assert not any(r["suspect"] for r in series.seam_report(vectors(spark, [0] * 8), ["k"], ["i"], "v").collect())
    (lone,) = series.seam_report(vectors(spark, [7]), ["k"], ["i"], "v").collect()
    assert lone["diff"] == 0 and lone["median_diff"] == 0 and not lone["suspect"]


def spans(spark, values):
    found = series.segments(table(spark, values), ["k"], ["i"], "x", 2, 4, 0.15, 0.25).orderBy("start_i")
    return [(r["start_i"], r["end_i"]) for r in found.collect()]


def test_segments(spark):
    assert spans(spark, [0, 3, 4, 5]) == [(1, 3)]
    assert spans(spark, [0, 3, 4, 0]) == [(1, 2)]
    assert spans(spark, [0, 0, 0]) == []
    assert spans(spark, [3, 0, 3, 0, 0, 3]) == [(0, 2), (5, 5)]


def test_rolling_median_is_cut_at_the_ends(spark):
    rows = series.rolling_median(table(spark, [1, 9, 2, 8]), ["k"], ["i"], "x", 1).orderBy("i").collect()
    assert [r["smooth"] for r in rows] == [5, 2, 8, 5]
    assert series.median_radius(25) == 2 and series.median_radius(1) == 1


def test_rate_check_refuses_uneven_short_and_unknown_times(spark):
    def constant(times):
        return series.rate_check(table(spark, times), ["k"], ["i"], F.col("x"), 25).first()["constant"]

    assert constant([0.0, 0.04, 0.08])
    assert not constant([0.0, 0.04, 0.12])
    assert not constant([0.0, 0.0, 0.04])
    assert not constant([0.0, float("nan"), 0.08])
    assert not constant([0.0, 0.04])


def test_changes_only_counts_null_as_a_value(spark):
    rows = series.changes_only(table(spark, [None, None, 1.0, 1.0, None]), ["k"], ["i"], "x").orderBy("i").collect()
    assert [r["i"] for r in rows] == [0, 2, 4]


def test_empty_tables(spark):
    empty = table(spark, []).limit(0)
    assert series.segments(empty, ["k"], ["i"], "x", 2, 4, 0.15, 0.25).count() == 0
    assert series.robust(empty, ["k"], "x").count() == 0
