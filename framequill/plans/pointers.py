"""Queries over pointer events: value - 250 and event_id % 97 - 48 are the offsets of a user's pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framequill.plans.catalog import query
from framequill.session import load
from framequill.streaming import pointer

NUMBERED = "(select user_id, event_id, value - 250 as dx, event_id % 97 - 48.0 as dy, row_number() over (partition by user_id order by ts, event_id) as nth from events)"


@query(f"""
with recursive e as (
  select user_id, event_id, nth, dx, dy, atan2(dx, -dy * 1.15) - floor(atan2(dx, -dy * 1.15) / (2 * pi())) * (2 * pi()) as angle from {NUMBERED}),
r as (
  select distinct user_id, cast(0 as bigint) as event_id, cast(0 as bigint) as nth, true as resting, cast(null as double) as last, 'rest' as action from e
  union all
  select e.user_id, e.event_id, e.nth, x.action = 'rest', case x.action when 'rest' then null when 'hold' then r.last else e.angle end, x.action
  from r join e on e.user_id = r.user_id and e.nth = r.nth + 1,
  lateral (select case
    when e.dy >= -6 and (e.dx / (20 * case when r.resting then 1.35 else 1 end)) * (e.dx / (20 * case when r.resting then 1.35 else 1 end))
       + (e.dy / (10 * case when r.resting then 1.35 else 1 end)) * (e.dy / (10 * case when r.resting then 1.35 else 1 end)) < 1 then 'rest'
    when r.resting then 'snap'
    when abs(atan2(sin(e.angle - r.last), cos(e.angle - r.last))) < 0.5 then 'hold' else 'move' end as action) x)
select user_id, event_id, action, resting, round(last, 6) as angle from r where nth > 0""")
def pointer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") - 250).alias("dx"), (F.col("event_id") % 97 - F.lit(48.0)).alias("dy"))
    found = pointer.pointer_batch(events, "user_id", ["ts", "event_id"], pointer.Gate(hysteresis=0.5))
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "action", "resting", F.round("angle", 6).alias("angle"))


@query("""
with recursive e as (
  select user_id, event_id, value * 7.2 as target, row_number() over w as nth,
    case when lag(1) over w is null then 1 / 60.0::double else greatest(0.0, least((epoch_us(ts::timestamp) - lag(epoch_us(ts::timestamp)) over w) / 1e6, 1 / 30.0::double)) end as dt
  from events window w as (partition by user_id order by ts, event_id)),
r as (
  select distinct user_id, cast(0 as bigint) as event_id, cast(0 as bigint) as nth, cast(0 as double) as pos, cast(0 as double) as vel from e
  union all
  select g.user_id, g.event_id, g.nth, p.goal + p.rest - floor((p.goal + p.rest) / 3600) * 3600, p.speed
  from (select e.user_id, e.event_id, e.nth, e.dt, r.vel, r.pos, e.target - r.pos - floor((e.target - r.pos) / 3600) * 3600 as ahead from r join e on e.user_id = r.user_id and e.nth = r.nth + 1) g,
  lateral (select case when g.ahead <= 1800 then g.ahead else g.ahead - 3600 end as d) d,
  lateral (select greatest(-1008.0, least(1008.0, -d.d)) as x, 2 / 0.14::double * g.dt as y) x,
  lateral (select 1 / (1 + x.y + 0.48 * x.y * x.y + 0.235 * x.y * x.y * x.y) as decay, (g.vel + 2 / 0.14::double * x.x) * g.dt as push) k,
  lateral (select -d.d - x.x + (x.x + k.push) * k.decay as rest0) q,
  lateral (select (-d.d >= 0 and q.rest0 <= 0) or (-d.d < 0 and q.rest0 > 0) or (abs(q.rest0) <= 0.002 and abs((g.vel - 2 / 0.14::double * k.push) * k.decay) <= 0.002) as there) t,
  lateral (select g.pos + d.d as goal, case when t.there then 0 else q.rest0 end as rest, case when t.there then 0 else (g.vel - 2 / 0.14::double * k.push) * k.decay end as speed) p)
select user_id, event_id, round(pos, 4) as position, round(vel, 3) as velocity from r where nth > 0""")
def smooth_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position on a ring of 3600 steps that follows its target on a damped spring."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = load(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", (F.col("value") * 7.2).alias("target"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).cast("double").alias("micros"))
    events = events.withColumn("seconds", F.col("micros") / 1e6)
    found = pointer.smooth_batch(events, "user_id", ["ts", "event_id"], 3600)
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.round("position", 4).alias("position"), F.round("velocity", 3).alias("velocity"))
