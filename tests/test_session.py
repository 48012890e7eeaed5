import os

from framequill.session import scratch_mark, shared_dir, spool, spool_counted, sweep


def test_spooled_tables_are_read_back_and_swept(spark):
    df = spool(spark.range(5), "numbers")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert shared_dir(spark) != shared_dir(spark)
    assert sweep(spark) >= 1 and not os.path.exists(path)


def test_sweeping_spares_what_was_there_and_what_is_kept(spark):
    paths = lambda df: df.inputFiles()[0].removeprefix("file://")
    before = paths(spool(spark.range(3), "before"))
    mark = scratch_mark()
    on_the_way, result = paths(spool(spark.range(3), "way")), paths(spool(spark.range(3), "result"))
    assert sweep(spark, mark, keep=1) == 1
    assert os.path.exists(before) and not os.path.exists(on_the_way) and os.path.exists(result)


def test_rows_are_counted_as_they_are_written(spark):
    from pyspark.sql import functions as F

    table, n = spool_counted(spark.range(10).repartition(5), "counted", 2, even=F.col("id") % 2 == 0)
    assert n == {"n": 10, "even": 5} and table.count() == 10 and len(table.inputFiles()) <= 2
    table, n = spool_counted(spark.range(10).where("id < 0"), "none")
    assert n == {"n": 0} and table.count() == 0


def test_library_does_not_need_the_corpus_part():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for path in (root / "framequill").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"framequill\.llm|corpus_pipeline", path.read_text()), path
