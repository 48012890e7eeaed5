from pyspark.sql import functions as F

from framequill.operators import rules


def crowd(spark, n):
    """Rectangles of one scene that all meet in one grid cell."""
    return spark.range(n).select(F.lit(1).alias("scene"), "id", (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"), F.lit(9).alias("w"), (F.col("id") % 3 + 1).alias("h"))


def expected(n):
    held = [(i, i % 7, i % 5, i % 3 + 1) for i in range(n)]
    return sorted((a[0], b[0]) for a in held for b in held if a[0] < b[0] and max(a[1], b[1]) < min(a[1], b[1]) + 9 and max(a[2], b[2]) < min(a[2] + a[3], b[2] + b[3]))


def test_a_crowded_cell_is_spread_and_loses_no_pair(spark):
    found = rules.overlapping(crowd(spark, 300), ["scene"], 64, block=32, pairs=2000)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == expected(300)
    tasks = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4  # before: a single one


def test_pieces_bound_what_a_kernel_holds(spark):
    import numpy as np
    import pyarrow as pa

    from framequill.operators import images

    batch = pa.RecordBatch.from_arrays([pa.array([list(range(8))] * 100 + [None])], ["px"])
    cut = list(images.pieces(iter([batch]), "px", most=64))
    assert sum(b.num_rows for b in cut) == 101 and max(b.num_rows for b in cut) <= 9
    assert np.array_equal(np.concatenate([np.asarray(b.column(0).flatten()) for b in cut]), np.tile(np.arange(8), 100))


def test_bridges_shuffle_and_spool_nothing(spark, sf_dir):
    from framequill.plans import registry

    found = registry.QUERIES["flow_bridges"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "bridges" not in plan  # before: a spool, a join and a window over all pixels


def test_registration_yields_by_pieces(spark):
    """The kernel's own batches stay small for a batch of many frames; before, one as large as the input."""
    from framequill.operators import alignment

    side = 16
    rows = spark.range(3000).select("id", F.lit(side).alias("w"), F.array_repeat(F.lit(9), side * side * 4).alias("px"), F.array_repeat(F.lit(9), side * side * 3).alias("reference"),
                                    F.array_repeat(F.lit(True), side * side).alias("static"), F.array_repeat(F.lit(False), side * side).alias("motion"))
    alignment.aligned(rows.coalesce(1), ["id"]).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_patches_are_made_in_many_tasks(spark, sf_dir):
    from framequill.plans import registry

    found = registry.QUERIES["patch_modes"](spark, sf_dir)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= 4  # before: as few as the bytes of the join asked for
