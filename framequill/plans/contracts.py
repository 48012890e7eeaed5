"""Queries over contracts and per-row pixel work.

Roles: users' first events give anchors, phases and kept frames; orders are scenes whose line items are layers; embeddings are 8 x 8 frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framequill.operators import contracts, pixels, rules
from framequill.plans.catalog import query
from framequill.plans.sequences import steps
from framequill.session import load
from framequill.sources import frames as sources

STEPS = "(select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)"


@query(f"""
with a as (select user_id, list(cast(floor(value / 40) as bigint) + i * 8 * (case when user_id % 3 = 0 then 0 else 1 end) - case when i = 0 then cast(floor(value / 40) as bigint) else 0 end order by i) as d from {STEPS} where i < 8 - (case when user_id % 7 = 0 then 1 else 0 end) group by user_id),
s as (select user_id, d, unnest(range(2, len(d) + 1)) as j from a),
u as (select user_id, bool_and(d[j] > d[j - 1]) as up from s group by user_id),
c as (select a.user_id, a.d, u.up, a.d[1] as first, len(a.d) as n, list_min(a.d) as low, list_max(a.d) as high from a join u on u.user_id = a.user_id)
select user_id, 'anchors-eight' as rule from c where n <> 8
union all select user_id, 'anchors-first' from c where first <> 0
union all select user_id, 'anchors-increasing' from c where not up
union all select user_id, 'anchors-range' from c where low < 0 or high >= 64""")
def anchor_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.col("value") / 40) + F.col("i") * 8 * F.when(F.col("user_id") % 3 == 0, 0).otherwise(1)
    rows = steps(spark, sf_dir).where(F.col("i") < 8 - F.when(F.col("user_id") % 7 == 0, 1).otherwise(0))
    rows = rows.withColumn("at", at - F.when(F.col("i") == 0, F.floor(F.col("value") / 40)).otherwise(0))
    held = rows.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "at"))), lambda x: x["at"]).alias("d"))
    return rules.violations(held, ["user_id"], contracts.anchors(F.col("d"), F.lit(64)))


@query(f"""
with k as (select user_id, list(i order by i) as keep from {STEPS} where value >= 60 or i = 1 group by user_id)
select user_id, 'keep-first' as rule from k where not list_contains(keep, 0)
union all select user_id, 'keep-anchors' from k where not (list_contains(keep, 0) and list_contains(keep, 4) and list_contains(keep, 8) and list_contains(keep, 12))""")
def keep_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that keep: those whose score reaches 60, and the second in any case."""
    rows = steps(spark, sf_dir).where("value >= 60 or i = 1")
    held = rows.groupBy("user_id").agg(F.sort_array(F.collect_list("i")).alias("keep"))
    anchors = F.array(*[F.lit(a).cast("long") for a in (0, 4, 8, 12)])
    return rules.violations(held, ["user_id"], contracts.trims(F.col("keep"), anchors))


@query("""
with l as (select l_orderkey as scene, l_linenumber as z, case when l_quantity > 25 then 'subject' else 'underlay' end as kind, case when l_partkey % 50 = 0 then 'Bad' else 'layer-' || l_partkey || '-' || l_linenumber end as id,
  l_partkey % 60 as x, l_suppkey % 40 as y, l_partkey % 30 as w, 20 as h from lineitem),
g as (select scene, max(case when kind = 'underlay' then z end) as top, min(case when kind = 'subject' then z end) as low, count(*) filter (where kind = 'subject') as subjects, count(distinct id) = count(*) as uniq from l group by scene)
select distinct scene, 'layer-id' as rule from l where id = 'Bad'
union all select distinct scene, 'layer-rect' from l where not (w > 0 and x + w <= 80 and y + h <= 50)
union all select scene, 'scene-subject' from g where subjects = 0
union all select scene, 'scene-order' from g where top is not null and not coalesce(top < low, false)
union all select scene, 'scene-unique' from g where not uniq""")
def scene_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    layers = load(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("scene"), c("l_linenumber").alias("z"), F.when(c("l_quantity") > 25, "subject").otherwise("underlay").alias("kind"),
        F.when(c("l_partkey") % 50 == 0, "Bad").otherwise(F.concat(F.lit("layer-"), c("l_partkey").cast("string"), F.lit("-"), c("l_linenumber").cast("string"))).alias("id"),
        (c("l_partkey") % 60).alias("x"), (c("l_suppkey") % 40).alias("y"), (c("l_partkey") % 30).alias("w"), F.lit(20).alias("h"), F.lit(80).alias("width"), F.lit(50).alias("height"))
    return contracts.scene_layers(layers, "scene")


@query("""
with n as (select label as source, count(*) as frame_count from embeddings where label <> 3 group by label)
select e.vec_id, e.label as source, e.vec_id % 70 - 2 as frame from embeddings e left join n on n.source = e.label
where n.frame_count is null or not (e.vec_id % 70 - 2 >= 0 and e.vec_id % 70 - 2 < n.frame_count)""")
def provenance_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("source"), (F.col("vec_id") % 70 - 2).alias("frame"))
    counts = rows.where("source <> 3").groupBy("source").agg(F.count(F.lit(1)).alias("frame_count"))
    return contracts.provenance_range(rows, counts, "source", "frame").select("vec_id", "source", "frame")


PIXELS = "(select label as clip, vec_id, list_transform(embedding, lambda e: cast(floor(abs(cast(e as double)) * 1000) as bigint) % 256) as px from embeddings)"


def eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256)
    return load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", px.alias("px"))


@query(f"""
select clip, vec_id, cast(list_sum(list_concat(list_concat(px[19:21], px[27:29]), px[35:37])) as bigint) as inside, len(px) as n from {PIXELS}""")
def cropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = pixels.cropped(F.col("px"), 8, 2, 2, 3, 3)
    return eight(spark, sf_dir).select("clip", "vec_id", F.aggregate(crop, F.lit(0).cast("long"), lambda s, v: s + v).alias("inside"), F.size("px").cast("long").alias("n"))


@query(f"""
with p as (select clip, vec_id, px, lag(px) over (partition by clip order by vec_id) as before from {PIXELS}),
x as (select clip, vec_id, unnest(range(1, 65)) as j, px, before from p where before is not null),
v as (select clip, vec_id, cast(round_even(px[j] * (before[j] / 255) + 30 * (1 - before[j] / 255), 0) as bigint) as c from x)
select clip, vec_id, cast(sum(c) as bigint) as shown from v group by clip, vec_id""")
def matted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("px").over(Window.partitionBy("clip").orderBy("vec_id"))
    rows = eight(spark, sf_dir).withColumn("matte", before).where("matte is not null").withColumn("plate", F.array_repeat(F.lit(30), 64))
    shown = pixels.composite(F.col("px"), F.col("plate"), F.col("matte"))
    return rows.select("clip", "vec_id", F.aggregate(shown, F.lit(0).cast("long"), lambda s, v: s + v).alias("shown"))


@query(f"""
with p as (select clip, vec_id, px, lag(px) over w as before from {PIXELS} window w as (partition by clip order by vec_id)),
x as (select clip, vec_id, px, before, unnest(range(1, 65)) as j from p),
g as (select clip, vec_id, sum(abs(px[j] - before[j])) filter (where px[j] > 120 and before[j] > 120) as s, count(*) filter (where px[j] > 120 and before[j] > 120) as n from x group by clip, vec_id)
select clip, vec_id, case when n >= 12 then round(s / n::double, 6) end as edge_motion from g""")
def matte_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels.matte_motion(eight(spark, sf_dir), ["clip"], "vec_id", "px", "px", solid=120, least=12)
    return found.withColumn("edge_motion", F.round("edge_motion", 6))


@query("""
with e as (select user_id, event_id, value / 100.0 as ts, lead(value / 100.0) over w as nxt from events window w as (partition by user_id order by value, event_id)),
s as (select user_id, event_id, cast(ceil(ts * 4 - 1e-9) as bigint) as a, coalesce(cast(ceil(nxt * 4 - 1e-9) as bigint) - 1, cast(ceil(ts * 4 - 1e-9) as bigint)) as b from e)
select user_id as source, event_id as frame, unnest(range(a, b + 1)) as sample from s where b >= a""")
def sampled_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("frame"), (F.col("value") / 100.0).alias("ts"))
    return sources.nearest_samples(rows, 4).select("source", "frame", "sample")
