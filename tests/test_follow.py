import math
import random

import pytest
from pyspark.sql import functions as F

from framequill.streaming import budget, follow, pointer

SCHEMA = "session string, subject string, seconds double, id long, dx double, dy double, pointer_type string, left boolean"


def walk(rng, n):
    rows, at, angle = [], 1000.0, 0.0
    for i in range(n):
        at += rng.choice([0.01, 0.05, 0.4])
        angle += rng.uniform(-1, 1)
        far = rng.choice([5, 80, 80, 80])
        rows.append((rng.choice("st"), rng.choice("ab"), round(at, 3), i, far * math.sin(angle), -far * math.cos(angle), rng.choice(["mouse", "mouse", "touch", None]), rng.random() < 0.05))
    return rows


@pytest.mark.parametrize("gate", [pointer.Gate(), pointer.Gate(hysteresis=0.3, arc=(300.0, 420.0))])
@pytest.mark.parametrize("cuts", [[90], [20, 45, 90]])
def test_streams_follow_each_subject_whatever_the_batches(spark, tmp_path, gate, cuts):
    rows = walk(random.Random(5), 90)
    heads, want = {}, {}
    for session, subject, at, i, dx, dy, kind, left in rows:
        if kind != "touch":
            key = (session, subject)
            heads[key], action = follow.moved(heads.get(key, follow.Head()), at, dx, dy, left, gate, 3600, 0.14)
            want[i] = (*key, action, heads[key].resting, heads[key].position)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.ROCKSDB)
    try:
        at = 0
        for to in cuts:
            df = spark.createDataFrame(rows[at:to], SCHEMA).select("*", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")).alias("ts")).drop("seconds")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = follow.followed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), gate).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
            stream.foreachBatch(lambda out, i: out.write.mode("append").parquet(str(tmp_path / "out"))).trigger(availableNow=True).start().awaitTermination()
            at = to
        found = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    value = lambda p: None if p is None or math.isnan(p) else round(p, 6)
    events = {r["id"]: (r["session"], r["subject"], r["action"], r["resting"], value(r["position"])) for r in found if r["id"] >= 0}
    assert events == {i: (*w[:4], value(w[4])) for i, w in want.items()}
    ticks = [r for r in found if r["id"] < 0]
    assert (ticks or len(cuts) == 1) and all(r["action"] == "tick" and 0 <= r["position"] <= 3600 for r in ticks)


def test_springs_move_between_events_and_arrive():
    gate = pointer.Gate()
    head, action = follow.moved(follow.Head(), 0.0, 0.0, -80.0, False, gate, 3600, 0.14)
    assert action == "snap" and head.position == 0.0 and not head.moving
    head, action = follow.moved(head, 1.0, 80.0, 0.0, False, gate, 3600, 0.14)
    assert action == "move" and head.moving and head.target == 900.0
    way = [follow.advanced(head, 1.0 + t / 20, gate, 3600, 0.14) for t in range(60)]
    assert [h.position for h in way] == sorted(h.position for h in way) and abs(way[-1].position - 900) < 0.003 and not way[-1].moving
    in_steps = head
    for t in range(1, 60):
        in_steps = follow.advanced(in_steps, 1.0 + t / 20, gate, 3600, 0.14)
    assert in_steps == way[-1]


def test_arcs_have_ends():
    gate = pointer.Gate(arc=(300.0, 420.0))
    assert follow.step_of(math.radians(300), gate, 3600) == 0.0 and follow.step_of(math.radians(60), gate, 3600) == 3599.0 and follow.step_of(0.0, gate, 3600) == pytest.approx(1799.5)
    position, speed = pointer.follow((3500.0, 0.0), 5000.0, 1 / 60, 3600, 0.14, ring=False)
    for _ in range(300):
        position, speed = pointer.follow((position, speed), 5000.0, 1 / 60, 3600, 0.14, ring=False)
    assert position == 3599.0
    assert pointer.follow((100.0, 0.0), 3500.0, 1 / 60, 3600, 0.14, ring=False)[0] > 100.0 > 0  # never the short way over the gap
