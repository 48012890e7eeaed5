"""Queries over ordered sequences: seams, series, rings and routes.

Roles: embeddings are frames (label = clip, vec_id = order); events are score, angle and phase series per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framequill.functions import angles
from framequill.operators import ring, route, series
from framequill.plans.catalog import query
from framequill.session import load

ANCHORS = (0, 9, 22, 30, 44, 53, 61, 78)
COUNT = 90
PHASES = ((0, 0.0), (5, 20.0), (9, 45.0), (22, 90.0), (30, 135.0), (44, 180.0), (53, 225.0), (61, 270.0), (78, 315.0))
ARC = ((300.0, 0), (350.0, 6), (420.0, 11))
FRAMES = "(select label as clip, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 as frame from embeddings)"
STEPS = "(select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events)"
GAP = "list_avg(list_transform(list_zip({a}, {b}), lambda z: abs(cast(z[1] as double) - cast(z[2] as double))))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, vec_id, embedding, frame) with frame counted from 0 in each clip."""
    order = Window.partitionBy("clip").orderBy("vec_id")
    return load(spark, sf_dir, "embeddings").withColumnRenamed("label", "clip").withColumn("frame", (F.row_number().over(order) - 1).cast("long"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, value, i) with i counted from 0 for each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").withColumn("i", (F.row_number().over(order) - 1).cast("long")).select("user_id", "event_id", "value", "i")


@query(f"""
with f as (select clip, vec_id, embedding, lead(embedding) over w as nxt, first_value(embedding) over w as fst, lead(1) over w is null as is_boundary
           from {FRAMES} window w as (partition by clip order by vec_id)),
d as (select clip, vec_id, is_boundary, {GAP.format(a='embedding', b='coalesce(nxt, fst)')} as diff from f),
m as (select clip, median(diff) filter (where not is_boundary) as m from d group by clip)
select d.clip, d.vec_id, d.is_boundary, round(d.diff, 6) as diff, round(coalesce(m.m, 0), 6) as median_diff,
       d.diff > greatest(coalesce(m.m, 0) * 1.2, 0.05) as suspect
from d join m on m.clip = d.clip""")
def ring_seam_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.seam_report(frames(spark, sf_dir), ["clip"], ["vec_id"], "embedding", 1.2, 0.05)
    return found.select("clip", "vec_id", "is_boundary", F.round("diff", 6).alias("diff"), F.round("median_diff", 6).alias("median_diff"), "suspect")


@query(f"""
with f as (select clip, vec_id, embedding, lag(embedding) over (partition by clip order by vec_id) as before from {FRAMES})
select clip, vec_id, case when before is null then 0.0 else round({GAP.format(a='embedding', b='before')}, 6) end as score from f""")
def motion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.lag_difference(frames(spark, sf_dir), ["clip"], ["vec_id"], "embedding")
    return found.select("clip", "vec_id", F.round("score", 6).alias("score"))


@query("""
select user_id, event_id, median(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following) as smooth from events""")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return series.rolling_median(events, ["user_id"], ["ts", "event_id"], "value", series.median_radius(25)).select("user_id", "event_id", "smooth")


@query(f"""
with a as (select *, i - lag(i) over (partition by user_id order by i) - 1 as gap from {STEPS} where value >= 50),
s as (select *, sum(case when gap <= 1 then 0 else 1 end) over (partition by user_id order by i) as seg from a),
g as (select user_id, seg, min(i) as start_i, max(i) as end_i, max(value) as max_score from s group by user_id, seg)
select user_id, start_i, end_i, end_i - start_i + 1 as n, start_i / 4.0 as start_t, (end_i + 1) / 4.0 as end_t, max_score
from g where (end_i - start_i + 1) / 4.0 >= 0.5""")
def motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.segments(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 50, 4, 0.25, 0.5)
    return found.select("user_id", F.col("start_i").cast("long").alias("start_i"), F.col("end_i").cast("long").alias("end_i"), F.col("n").cast("long").alias("n"), "start_t", "end_t", "max_score")


@query("""
select user_id, event_type, count(value) as n, median(value) as median, round(quantile_cont(value, 0.95), 6) as p95, min(value) as low, max(value) as high,
       round(stddev_pop(value), 6) as spread, cast(trunc(median(value)) as integer) as median_cut
from events group by user_id, event_type""")
def robust_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.robust(load(spark, sf_dir, "events"), ["user_id", "event_type"], "value").withColumn("spread", F.round("spread", 6)).withColumn("p95", F.round("p95", 6))


@query("""
with t as (select c.conv_id, c.turn, c.turn * 0.04 + case when c.conv_id % 3 = 0 and c.turn % 5 = 4 then 0.01 else 0 end as s from conversations c),
g as (select *, s - lag(s) over (partition by conv_id order by turn) as step from t)
select conv_id, count(*) as n, bool_and(coalesce(abs(step - 0.04) <= 0.0002, true)) and count(*) >= 3 as constant from g group by conv_id""")
def rate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    seconds = F.col("turn") * 0.04 + F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 5 == 4), 0.01).otherwise(0)
    return series.rate_check(turns, ["conv_id"], ["turn"], seconds, 25)


@query("""select user_id, event_id, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as change from events""")
def coverage_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.step_change(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "change")


@query("""
with e as (select user_id, event_id, ts, cast(floor(value / 100) as bigint) as shown from events),
p as (select *, lag(shown) over w as before, row_number() over w as nth from e window w as (partition by user_id order by ts, event_id))
select user_id, event_id, shown from p where nth = 1 or shown is distinct from before""")
def drawn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = load(spark, sf_dir, "events").withColumn("shown", F.floor(F.col("value") / 100).cast("long"))
    return series.changes_only(shown, ["user_id"], ["ts", "event_id"], "shown").select("user_id", "event_id", "shown")


@query("""
with p as (select *, lag(value) over w as before, row_number() over w as nth from events window w as (partition by user_id order by ts, event_id))
select user_id, count(*) as n, min(case when nth = 1 then value end) as first, bool_and(coalesce(value > before, true)) as increasing from p group by user_id""")
def anchor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.strictly_increasing(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query(f"""
with a as (select event_id, value * 3.0 as deg from events),
u as (select event_id, deg, (deg * (pi() / 180)) as rad from a),
w as (select event_id, deg, (rad - floor(rad / (2 * pi())) * (2 * pi())) / (2 * pi() / 8) as u from u),
i as (select *, least(cast(floor(u) as integer), 7) as i from w),
e as (select event_id, u - i as t, [{', '.join(map(str, [*ANCHORS, COUNT]))}][i + 1] as a, [{', '.join(map(str, [*ANCHORS, COUNT]))}][i + 2] as b from i)
select event_id, cast(floor(a + (b - a) * t + 0.5) as bigint) % {COUNT} as frame from e""")
def direction_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select("event_id", ring.frame_at(ring.radians(F.col("value") * 3.0), ANCHORS, COUNT).alias("frame"))


@query(f"""
with p(f, d) as (values {', '.join(f'({f}.0, {d})' for f, d in [*PHASES, (COUNT, 360.0)])}),
s as (select cast(f as double) as f, cast(d as double) as d, cast(lead(f) over (order by d) as double) as g, cast(lead(d) over (order by d) as double) as e from p),
v as (select event_id, value * 3.0 - floor(value * 3.0 / 360.0) * 360.0 as deg from events)
select v.event_id, cast(floor(s.f + (s.g - s.f) * ((v.deg - s.d) / (s.e - s.d)) + 0.5) as bigint) % {COUNT} as frame
from v join s on v.deg >= s.d and v.deg < s.e""")
def phase_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return events.select("event_id", ring.frame_at_phase(angles.wrap(F.col("value") * 3.0, 360.0), PHASES, COUNT).alias("frame"))


@query("""
with v as (select event_id, value - floor(value / 360.0) * 360.0 as d from events),
a as (select event_id, case when d < 300 - 1e-7 then d + 360.0 else d end as d from v),
c as (select event_id, d <= 420 + 1e-7 as inside, least(greatest(d, 300.0), 420.0) as d from a)
select event_id, case when inside then cast(floor(case when d <= 350 then 0 + 6 * ((d - 300.0) / 50.0) else 6 + 5 * ((d - 350.0) / 70.0) end + 0.5) as double) end as frame from c""")
def arc_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", ring.frame_at_arc(F.col("value"), ARC).cast("double").alias("frame"))


@query("""
with v as (select event_id, value - 250 as dx, event_id % 97 - 48.0 as dy from events),
a as (select *, atan2(dx, -dy * 1.15) as r from v)
select event_id, round(r - floor(r / (2 * pi())) * (2 * pi()), 6) as angle,
       dy >= -6 and (dx / 20) * (dx / 20) + (dy / 10) * (dy / 10) < 1 as resting,
       dy >= -6 and (dx / 27.0) * (dx / 27.0) + (dy / 13.5) * (dy / 13.5) < 1 as resting_wide,
       case when pmod > 1800 then pmod - 3600 else pmod end as way
from (select *, dx * 30 - floor(dx * 30 / 3600) * 3600 as pmod from a)""")
def pointer_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.col("value") - 250, F.col("event_id") % 97 - F.lit(48.0)
    return load(spark, sf_dir, "events").select(
        "event_id", F.round(angles.pointer_angle(dx, dy), 6).alias("angle"), angles.neutral(dx, dy, F.lit(1.0)).alias("resting"),
        angles.neutral(dx, dy, F.lit(1.35)).alias("resting_wide"), angles.shortest_delta(dx * 30, 3600).alias("way"))


@query(f"""
with s as (select user_id, i, value, case when i >= 35 then null when i >= 30 then 6 when i >= 25 then 5 when i >= 20 then 4 when i >= 15 then 3 when i >= 10 then 2 when i >= 5 then 1 else 0 end as sector from {STEPS}),
m as (select *, greatest(value, greatest(0.1 * median(value) over (partition by user_id, sector), 1e-6)) as step from s where sector is not null)
select user_id, i as frame, cast(sector as integer) as sector,
       case when count(*) over (partition by user_id) = 35 then round(45.0 * sector + 45.0 * (coalesce(sum(step) over (partition by user_id, sector order by i rows between unbounded preceding and 1 preceding), 0)
       / sum(step) over (partition by user_id, sector)), 6) end as phase from m
union all select user_id, i, 7, 315.0 from {STEPS} where i = 35""")
def phase_retiming(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ring.retime(steps(spark, sf_dir), ["user_id"], "i", "value", tuple(range(0, 40, 5)))
    return found.withColumn("phase", F.round("phase", 6))


@query("""
with n as (select label as clip, count(*) as n, least(24, count(*)) as k from embeddings group by label),
j as (select clip, n, k, unnest(range(0, k)) as j from n)
select distinct clip, cast(case when k = 1 then 0 else round_even(j * (n - 1) / (k - 1)::double, 0) end as bigint) as frame from j""")
def overview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.overview(frames(spark, sf_dir), ["clip"])


@query("""
with c as (select conv_id, cast(count(*) as bigint) as n from conversations group by conv_id),
o as (
  select conv_id, 'ring' as kind, list_concat(list_concat(list_concat(range(0, n), range(0, n)), [0]), list_concat(list_reverse(range(0, n)), list_reverse(range(0, n)))) as l from c
  union all select conv_id, 'arc', list_concat(range(0, n), list_reverse(range(0, n))) from c
  union all select conv_id, 'source', list_concat(range(0, n), list_reverse(range(1, greatest(n - 1, 1)))) from c)
select conv_id, kind, cast(p - 1 as bigint) as position, cast(l[p] as bigint) as frame from (select conv_id, kind, l, unnest(range(1, len(l) + 1)) as p from o)""")
def sweep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    orders = F.create_map(*[x for kind in ("ring", "arc", "source") for x in (F.lit(kind), ring.sweep(F.col("n"), kind))])
    kinds = n.select("conv_id", F.explode(orders).alias("kind", "order"))
    return kinds.select("conv_id", "kind", F.posexplode("order").alias("position", "frame")).select(
        "conv_id", "kind", F.col("position").cast("long").alias("position"), F.col("frame").cast("long").alias("frame"))


@query("""
with f as (select label as clip, row_number() over (partition by label order by vec_id) - 1 as frame from embeddings),
u as (select clip, frame as ord, case when frame in (0, 9) then 'main' else 'upper' end as part, case when frame = 0 then 16 when frame = 9 then 4 else frame * 2 end as origin from f where frame < 10),
r as (select clip, 0 as leg, ord, part, origin from u where ord >= 4
      union all select clip, 1, frame, 'main', frame from f where frame > 4 and frame <= 16
      union all select clip, 2, ord, part, origin from u where ord >= 1 and ord < 4)
select clip, row_number() over (partition by clip order by leg, ord) - 1 as position, part, cast(origin as bigint) as origin from r""")
def route_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    clip = frames(spark, sf_dir).select("clip", "frame")
    found = route.spliced(clip, clip, ["clip"], (2, 4, 6, 8, 10, 12, 14, 16), 10, 4, 2)
    return found.withColumn("position", F.col("position").cast("long"))


@query(f"""
with k as (select clip, vec_id, frame, row_number() over (partition by clip order by frame) - 1 as new_frame from {FRAMES} where frame = 0 or frame % 2 = 0 or frame % 7 <> 3)
select clip, vec_id, frame, new_frame, frame % 2 = 0 and frame < 16 as is_anchor from k""")
def trim_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = (F.col("frame") == 0) | (F.col("frame") % 2 == 0) | (F.col("frame") % 7 != 3)
    found = route.trimmed(frames(spark, sf_dir), ["clip"], "frame", kept)
    return found.select("clip", "vec_id", "frame", F.col("new_frame").cast("long").alias("new_frame"), ((F.col("frame") % 2 == 0) & (F.col("frame") < 16)).alias("is_anchor"))


@query(f"""
with d as (select clip, frame, o.odd, lead(1) over (partition by clip, o.odd order by frame) as more from {FRAMES}, (values (0), (1)) o(odd))
select clip, frame * 2 + odd as index, case when odd = 0 then 'native' else 'interpolated' end as kind, frame as parent,
       cast(case when odd = 1 then frame + 1 end as double) as other_parent, case when odd = 1 then 0.5 end as fraction
from d where odd = 0 or more is not null""")
def densify_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = route.densified(frames(spark, sf_dir).select("clip", "frame"), ["clip"], "frame")
    return found.select("clip", "index", "kind", F.get("parents", F.lit(0)).cast("long").alias("parent"), F.get("parents", F.lit(1)).cast("double").alias("other_parent"), "fraction")


@query(f"""
with p as (select user_id, i, i * 7.5 + (value - floor(value)) as phase, case when event_id % 4 = 0 then event_id % 11 else 0 end as k from {STEPS}),
g as (select *, lead(i) over w as t, lead(phase) over w - phase as gap from p window w as (partition by user_id order by i)),
a as (select *, case when gap > 0 and gap <= 30 and k between 1 and 8 then k else 0 end as kk from g),
j as (select *, unnest(range(0, kk + 1)) as j from a)
select user_id, row_number() over (partition by user_id order by i, j) - 1 as new_frame, i as from_frame, cast(case when j > 0 then t end as double) as to_frame,
       j > 0 as synthesized, case when j > 0 then j / (kk + 1)::double end as fraction, round(case when j > 0 then phase + gap * (j / (kk + 1)::double) else phase end, 6) as phase from j""")
def bridge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("phase", F.col("i") * 7.5 + (F.col("value") - F.floor("value")))
    found = route.bridged(rows, ["user_id"], "i", "phase", F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 11).otherwise(0))
    return found.select("user_id", F.col("new_frame").cast("long").alias("new_frame"), "from_frame", F.col("to_frame").cast("double").alias("to_frame"), "synthesized", "fraction",
                        F.round(F.when(F.col("synthesized"), F.col("phase_raw")).otherwise(F.col("own_phase")), 6).alias("phase"))


@query(f"""
with s as (select user_id, i, event_id % 3 as src, lead(event_id % 3) over w as nxt, lead(1) over w is null as final from {STEPS} window w as (partition by user_id order by i)),
e as (select user_id, i as edge from s where final or src <> nxt union select user_id, i from {STEPS} where value > 480),
n as (select user_id, count(*) as n from events group by user_id)
select distinct e.user_id, ((e.edge + d.d) % n.n + n.n) % n.n as frame from e, (values (-1), (0), (1), (2)) d(d), n where n.user_id = e.user_id""")
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = steps(spark, sf_dir).withColumn("src", F.col("event_id") % 3)
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return route.neighbours(route.boundaries(rows, ["user_id"], "i", "src", rows.where("value > 480").withColumnRenamed("i", "edge")), ["user_id"], counts)


@query(f"""select user_id, i // 12 as page, count(*) as n, min(i) as first, max(i) as last from {STEPS} group by user_id, i // 12""")
def contact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.pages(steps(spark, sf_dir), ["user_id"], "i")


@query(f"""
select clip, vec_id, frame // 16 as sheet, frame % 16 as cell, frame % 16 % 4 * 64 as x, frame % 16 // 4 * 48 as y, list_max(embedding) > 0 as filled from {FRAMES}""")
def atlas_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = route.cells(F.col("frame"), 4, 16, 64, 48)
    return frames(spark, sf_dir).select("clip", "vec_id", *[c.alias(n) for n, c in place.items()], (F.array_max("embedding") > 0).alias("filled"))


@query(f"""select clip, vec_id, frame // 3 - 2 as frame from {FRAMES} where frame % 3 = 0 and frame // 3 >= 2 and frame // 3 < 60""")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.sliced(route.strided(frames(spark, sf_dir), "frame", 3), "frame", 2, 60).select("clip", "vec_id", "frame")


@query("""select clip, 4 * clip + 1.0 as duration, round((4 * clip + 1.0) * (0.88 - 0.12), 6) as turning from (select distinct label as clip from embeddings)""")
def orbit_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip")).distinct().withColumn("duration", 4 * F.col("clip") + 1.0)
    return clips.withColumn("turning", F.round(ring.effective_seconds(F.col("duration"), F.lit(0.12), F.lit(0.88)), 6))
