import math
import random

import pytest
from pyspark.sql import functions as F

from framequill.operators import ledger
from framequill.streaming import budget

SCHEMA = "key long, id long, seconds double, fingerprint string, allowed boolean"


def asked(rng, n):
    return [(rng.randrange(4), i, rng.choice([1.0, 2.5, 4.0, 9.0, 0.0, None, float("inf")]), f"f{rng.randrange(12)}", rng.random() < 0.9) for i in range(n)]


def plain(rows):
    return {(r["key"], r["id"]): (None if r["seconds"] is None or math.isnan(r["seconds"]) else r["seconds"], r["accepted"], r["reason"], r["used"]) for r in rows}


@pytest.mark.parametrize("cuts", [[60], [1, 2, 7, 30, 60], [10, 10, 20, 35, 60]])
def test_a_stream_decides_as_the_batch_does(spark, tmp_path, cuts):
    rows = asked(random.Random(3), 60)
    want = plain(ledger.admitted(spark.createDataFrame(rows, SCHEMA), "key", ["id"], "seconds", "fingerprint", 5, 12.0, 8.0, F.col("allowed")).collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.ROCKSDB)
    try:
        at, name = 0, f"budget{len(cuts)}{cuts[0]}"
        for n, to in enumerate(cuts):
            part = rows[max(0, at - 5) : to]  # the end of the batch before comes again
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            decided = budget.admitted_stream(stream, 5, 12.0, 8.0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
            decided.foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination()
            at = to
        found = spark.read.parquet(str(tmp_path / "out")).collect()
        assert len(found) == len(rows) and plain(found) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
