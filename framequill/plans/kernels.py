"""Queries over pixels: each embedding is an 8 x 8 frame of one channel, line items are colour samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.functions import pixels as px
from framequill.operators import alignment, flow, pixels, resample, series
from framequill.plans.catalog import query
from framequill.session import load

CELLS = """(select label as clip, vec_id, p - 1 as pos, cast(floor(abs(cast(embedding[p] as double)) * 1000) as bigint) % 256 as v, (p - 1) % 8 as x, (p - 1) // 8 as y
  from (select label, vec_id, embedding, unnest(range(1, 65)) as p from embeddings))"""
SAMPLES = "(select l_orderkey, l_linenumber, l_partkey % 256 as r, l_suppkey * 7 % 256 as g, l_orderkey % 256 as b from lineitem)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, vec_id, pos, v, x, y): a row per pixel."""
    spread = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.posexplode("embedding").alias("pos", "e"))
    return spread.select("clip", "vec_id", "pos", (F.floor(F.abs(F.col("e").cast("double")) * 1000) % 256).alias("v"), (F.col("pos") % 8).alias("x"), F.expr("pos div 8").alias("y"))


def against_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with ``ref``, the same pixel in the first frame of the clip."""
    order = Window.partitionBy("clip", "pos").orderBy("vec_id")
    return cells(spark, sf_dir).withColumn("ref", F.first_value("v").over(order))


REF = f"(select *, first_value(v) over (partition by clip, pos order by vec_id) as ref from {CELLS})"


@query(f"""
with p as (select *, x < 5 as static, abs(v - ref) as gap from {REF}),
e as (select p.clip, p.vec_id, abs((abs(d.v - p.v) + abs(r.v - p.v)) - (abs(d.ref - p.ref) + abs(r.ref - p.ref))) as edge
  from p join p r on r.vec_id = p.vec_id and r.y = p.y and r.x = p.x + 1 join p d on d.vec_id = p.vec_id and d.x = p.x and d.y = p.y + 1 where p.static and r.static and d.static),
m as (select clip, vec_id, avg(gap) as mae, quantile_cont(gap, 0.95) as p95 from p where static group by clip, vec_id),
n as (select clip, vec_id, avg(edge) as edge_error, count(*) as edge_cells from e group by clip, vec_id)
select m.clip, m.vec_id, round(mae, 6) as mae, round(p95, 6) as p95, round(edge_error, 6) as edge_error, edge_cells, mae <= 5 and p95 <= 15 and edge_error <= 5 and edge_cells >= 8 as passed
from m join n on n.vec_id = m.vec_id""")
def residual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = against_first(spark, sf_dir).withColumn("static", F.col("x") < 5)
    found = pixels.residuals(rows, ["clip", "vec_id"], "x", "y", "v", "ref", "static", 8)
    return found.select("clip", "vec_id", *[F.round(c, 6).alias(c) for c in ("mae", "p95", "edge_error")], "edge_cells", "passed")


@query(f"""
with p as (select *, v < 200 and x < 6 as static, v > 220 and x > 5 as motion from {CELLS}),
g as (select s.vec_id, s.pos from p s join p m on m.vec_id = s.vec_id and m.motion and abs(m.x - s.x) <= 2 and abs(m.y - s.y) <= 2 where s.static group by s.vec_id, s.pos),
e as (select p.vec_id, p.pos from p join p r on r.vec_id = p.vec_id and r.y = p.y and r.x = p.x + 1 join p d on d.vec_id = p.vec_id and d.x = p.x and d.y = p.y + 1 where p.static and r.static and d.static),
n as (select clip, vec_id, count(*) filter (where static) as covered, count(*) filter (where motion) as moving, count(*) as cells from p group by clip, vec_id),
k as (select n.*, (select count(*) from g where g.vec_id = n.vec_id) as overlap, (select count(*) from e where e.vec_id = n.vec_id) as edge_cells from n)
select clip, vec_id, cast(covered as integer) as covered, cast(overlap as integer) as overlap, cast(edge_cells as integer) as edge_cells, cast(moving as integer) as moving,
       overlap = 0 and covered >= greatest(16.0, cells * 0.02) and edge_cells >= 8 and moving > 0 as usable from k""")
def background_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).withColumn("static", (F.col("v") < 200) & (F.col("x") < 6)).withColumn("motion", (F.col("v") > 220) & (F.col("x") > 5))
    return pixels.background_masks(rows, ["clip", "vec_id"], "x", "y", "static", "motion", 8)


@query(f"""
with m as (select clip, vec_id, avg(abs(v - ref)) as mean, quantile_cont(abs(v - ref), 0.95) as p95 from {REF} group by clip, vec_id)
select clip, vec_id, round(mean, 6) as mean, round(p95, 6) as p95, mean <= 2 and p95 <= 8 as matches from m""")
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = against_first(spark, sf_dir).withColumn("gap", F.abs(F.col("v") - F.col("ref")))
    return pixels.matches_source(rows, ["clip", "vec_id"], "gap").withColumn("mean", F.round("mean", 6)).withColumn("p95", F.round("p95", 6))


@query(f"""
with s as (select clip, vec_id, avg(case when abs(v - 100) <= 60 then 1.0 else 0.0 end) as share from {CELLS} where x in (0, 7) or y in (0, 7) group by clip, vec_id)
select clip, round(min(share), 6) as stability, min(share) >= 0.3 as stable from s group by clip""")
def border_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    border = cells(spark, sf_dir).where("x in (0, 7) or y in (0, 7)").withColumn("far", F.abs(F.col("v") - 100))
    return pixels.border_stability(border, ["clip"], "vec_id", "far", 60, 0.3).withColumn("stability", F.round("stability", 6))


@query(f"""
with p as (select * from {REF} where v < 180),
s as (select clip, vec_id, median(ref - v) as shift, count(*) as samples from p group by clip, vec_id),
j as (select p.*, s.shift, s.samples, least(255.0, greatest(0.0, round_even(p.v + s.shift, 0))) as fixed from p join s on s.clip = p.clip and s.vec_id = p.vec_id),
m as (select clip, vec_id, min(shift) as shift, min(samples) as samples, avg(abs(ref - v)) as before, avg(abs(ref - fixed)) as after from j group by clip, vec_id)
select clip, vec_id, shift, samples, round(before, 6) as before, round(after, 6) as after, samples >= 16 and abs(shift) <= 12 and after <= before + 0.05 as accepted from m""")
def channel_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels.channel_offset(against_first(spark, sf_dir).withColumn("opaque", F.col("v") < 180), ["clip", "vec_id"], "ref", "v", "opaque")
    return found.withColumn("before", F.round("before", 6)).withColumn("after", F.round("after", 6)).where("samples > 0")


@query(f"""
with s as (select clip, vec_id, count(*) as n, sum(x) as sx, sum(y) as sy, sum(v) as sz, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy, sum(x * v) as sxz, sum(y * v) as syz from {CELLS} group by clip, vec_id),
c as (select *, sxx - sx * sx / n::double as xx, sxy - sx * sy / n::double as xy, syy - sy * sy / n::double as yy, sxz - sx * sz / n::double as xz, syz - sy * sz / n::double as yz from s),
k as (select *, (xz * yy - yz * xy) / (xx * yy - xy * xy) as c1, (yz * xx - xz * xy) / (xx * yy - xy * xy) as c2 from c)
select clip, vec_id, round((sz - c1 * sx - c2 * sy) / n, 5) as c0, round(c1, 5) as c1, round(c2, 5) as c2 from k""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pixels.plane(cells(spark, sf_dir), ["clip", "vec_id"], "x", "y", "v")
    return found.select("clip", "vec_id", *[F.round(c, 5).alias(c) for c in ("c0", "c1", "c2")])


@query(f"""
with t as (select *, greatest(0.0, least(1.0, (greatest(abs(r - 0), abs(g - 255), abs(b - 0)) - 12.0) / 208.0)) as t, greatest(r, b) as other from {SAMPLES}),
a as (select *, least(cast(trunc(t * t * (3.0 - 2.0 * t) * 255) as integer), cast(trunc((1.0 - least(1.0, greatest(0, g - other) / greatest(1, 255 - other)::double)) * 255) as integer)) as alpha from t)
select l_orderkey, l_linenumber, alpha, case when alpha < 252 then least(g, other) else g end as despilled, least(r, g, b) > 210 and greatest(r, g, b) - least(r, g, b) < 30 as light,
       cast(round_even(r * (b / 255.0) + 40 * (1.0 - b / 255.0), 0) as integer) as blended from a""")
def key_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 256).alias("r"), (F.col("l_suppkey") * 7 % 256).alias("g"), (F.col("l_orderkey") % 256).alias("b"))
    rgb = [F.col(c) for c in "rgb"]
    alpha, held = px.keyed(rgb, (0, 255, 0))
    return rows.select("l_orderkey", "l_linenumber", alpha.alias("alpha"), held[1].alias("despilled"), px.is_light(*rgb).alias("light"), px.over(F.col("r"), F.lit(40), F.col("b") / 255.0).alias("blended"))


@query(f"""
with recursive c as (select *, v as r, least(255, v + v % 3 * 20) as g, v - v % 7 as b, 255 - v % 5 * 20 as a, 216 + v % 40 as base, ['preserve', 'replace-edge-light', 'fit-edge-light', 'chroma-key', 'other'][1 + vec_id % 5] as mode from {CELLS}),
l as (select vec_id, x, y from c where least(r, g, b) > 210 and greatest(r, g, b) - least(r, g, b) < 30),
e as (select vec_id, x, y from l where x in (0, 7) or y in (0, 7) union select l.vec_id, l.x, l.y from e join l on l.vec_id = e.vec_id and abs(l.x - e.x) + abs(l.y - e.y) = 1),
s as (select clip, vec_id, count(*)::double as n, sum(x)::double as sx, sum(y)::double as sy, sum(base)::double as sz, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy, sum(x * base) as sxz, sum(y * base) as syz from c group by clip, vec_id),
k as (select *, sxx - sx * sx / n as xx, sxy - sx * sy / n as xy, syy - sy * sy / n as yy, sxz - sx * sz / n as xz, syz - sy * sz / n as yz from s),
f as (select vec_id, (xz * yy - yz * xy) / (xx * yy - xy * xy) as c1, (yz * xx - xz * xy) / (xx * yy - xy * xy) as c2, sx, sy, sz, n from k),
q as (select c.*, e.x is not null as edge, cast(least(255, greatest(0, trunc(round((sz - c1 * sx - c2 * sy) / n + c1 * c.x + c2 * c.y, 6)))) as integer) as fitted
  from c join f on f.vec_id = c.vec_id left join e on e.vec_id = c.vec_id and e.x = c.x and e.y = c.y),
t as (select *, greatest(0.0, least(1.0, (greatest(r, 255 - g, b) - 12.0) / 208.0)) as t from q),
h as (select *, least(cast(trunc(t * t * (3.0 - 2.0 * t) * 255) as integer), cast(trunc((1.0 - least(1.0, greatest(0, g - greatest(r, b)) / greatest(1, 255 - greatest(r, b))::double)) * 255) as integer)) as cover from t)
select clip, vec_id, cast(pos as bigint) as pos, mode,
  cast(case when mode like '%edge-light' and edge then case when mode like 'fit%' then fitted else base end else r end as integer) as r,
  cast(case when mode = 'chroma-key' then case when cover < 252 then least(g, greatest(r, b)) else g end when mode like '%edge-light' and edge then case when mode like 'fit%' then fitted else base end else g end as integer) as g,
  cast(case when mode like '%edge-light' and edge then case when mode like 'fit%' then fitted else base end else b end as integer) as b,
  cast(case when mode = 'chroma-key' then cover * a // 255 else a end as integer) as a from h where mode <> 'other'""")
def patch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode of a patch: edge-connected light found by its flood, keyed values by the key; a mode that is none shows nothing."""
    modes = F.array(*[F.lit(m) for m in (*pixels.MODES, "other")])
    base = cells(spark, sf_dir).withColumn("base", F.lit(216) + F.col("v") % 40)
    planes = pixels.backdrop(base, ["clip", "vec_id"], "x", "y", ["base"], F.col("base") > 215).drop("channel")
    value = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("int"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # much work for few bytes, done where the join is
    rows = load(spark, sf_dir, "embeddings").withColumnRenamed("label", "clip").repartition(tasks, "clip", "vec_id").select("clip", "vec_id", F.lit(8).alias("w"), value.alias("v"), F.get(modes, (F.col("vec_id") % 5).cast("int")).alias("mode"))
    plane = F.transform("v", lambda v, i: F.least(F.lit(255), F.greatest(F.lit(0), F.round(F.col("c0") + F.col("c1") * (i % 8) + F.col("c2") * F.floor(i / 8), 6).cast("int"))))
    thrice = lambda c: F.flatten(F.transform(c, lambda v: F.array(v, v, v)))
    rows = rows.join(planes, ["clip", "vec_id"]).select(
        "clip", "vec_id", "w", "mode", thrice(F.transform("v", lambda v: F.lit(216) + v % 40)).alias("base"), thrice(plane).alias("fitted"),
        F.flatten(F.transform("v", lambda v: F.array(v, F.least(F.lit(255), v + v % 3 * 20), v - v % 7, F.lit(255) - v % 5 * 20))).alias("px"))
    shown = pixels.patches(rows, "w", "px", "base", "mode", (0, 255, 0), "fitted").where("patch is not null")
    shown = shown.select("clip", "vec_id", "mode", "patch", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    return shown.select("clip", "vec_id", F.col("pos").cast("long").alias("pos"), "mode", *[F.get("patch", F.col("pos") * 4 + c).alias(n) for c, n in enumerate("rgba")])


@query(f"""
select clip, vec_id, cast(pos as bigint) as pos, v, cast(trunc(greatest(0.0, least(1.0, x / 2.0, (7 - x) / 3.0, (7 - y) / 1.0)) * 255) as integer) as alpha from {CELLS}""")
def feather_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames' cells with the alpha of a feathered edge."""
    grid = cells(spark, sf_dir)
    return grid.select("clip", "vec_id", F.col("pos").cast("long").alias("pos"), "v", px.feather_alpha(F.col("x"), F.col("y"), 8, 8, 2, 0, 3, 1).alias("alpha"))


@query(f"""
with l as (select clip, vec_id, pos, v, lag(v) over w as one, lead(v) over w as two from {CELLS} window w as (partition by clip, vec_id order by pos))
select clip, vec_id, pos, cast(round_even(coalesce(two, 0) * 0.5 + round_even(coalesce(one, 0) * 0.25 + v * 0.75, 0) * 0.5, 0) as double) as shown from l""")
def layered_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("clip", "vec_id").orderBy("pos")
    layer = lambda z, c, a: F.struct(F.lit(z).alias("z"), F.coalesce(c, F.lit(0)).cast("double").alias("value"), F.lit(a).alias("alpha"))
    rows = cells(spark, sf_dir).withColumn("layers", F.array(layer(2, F.lead("v").over(order), 0.5), layer(1, F.lag("v").over(order), 0.25)))
    return rows.select("clip", "vec_id", F.col("pos").cast("long").alias("pos"), px.layered(F.col("v"), F.col("layers")).alias("shown"))


@query(f"""
select clip, vec_id, cast(count(*) as integer) as n, cast(count(*) filter (where v > 200) as integer) as covered, true as "binary", count(*) filter (where v > 200) >= 16 as enough from {CELLS} group by clip, vec_id""")
def mask_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.transform("embedding", lambda e: F.when(F.floor(F.abs(e.cast("double")) * 1000) % 256 > 200, 255).otherwise(0))
    masks = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", value.alias("mask"))
    return pixels.mask_problems(masks, ["clip", "vec_id"], "mask")


@query(f"""
with d as (select a.clip, a.vec_id, a.pos, bool_or(b.v > 230) as grown from {CELLS} a join {CELLS} b on b.vec_id = a.vec_id and abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 group by a.clip, a.vec_id, a.pos)
select clip, vec_id, count(*) filter (where grown) as grown from d group by clip, vec_id""")
def dilated_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256 > 230)
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.lit(8).alias("w"), mask.alias("m"))
    return pixels.dilated(rows, "w", "m").select("clip", "vec_id", F.size(F.filter("dilated", lambda b: b)).cast("long").alias("grown"))


@query(f"""
with recursive o as (select vec_id, clip, x, y from {CELLS} where v > 90),
r as (select vec_id, clip, x, y from o where x in (0, 7) or y in (0, 7) union select o.vec_id, o.clip, o.x, o.y from r join o on o.vec_id = r.vec_id and abs(o.x - r.x) + abs(o.y - r.y) = 1),
n as (select vec_id, count(*) as n from r group by vec_id)
select e.label as clip, e.vec_id, coalesce(n.n, 0) as reached from embeddings e left join n on n.vec_id = e.vec_id""")
def edge_flood(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256 > 90)
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.lit(8).alias("w"), mask.alias("m"))
    return pixels.flood(rows, "w", "m").select("clip", "vec_id", F.size(F.filter("reached", lambda b: b)).cast("long").alias("reached"))


@query(f"""
with m as (select clip, vec_id, quantile_cont(v / 100.0, 0.95) as p95, avg(v) as residual, quantile_cont((v + x) / 100.0, 0.95) as moved from {CELLS} group by clip, vec_id)
select clip, vec_id, round(p95, 6) as p95, residual, round(moved, 6) as moved, p95 <= 1.5 and residual <= 12 and moved <= 30 * 0.08 as passed from m""")
def bridge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).select("clip", "vec_id", (F.col("v") / 100.0).alias("trip"), F.col("v").alias("residual"), ((F.col("v") + F.col("x")) / 100.0).alias("moved"))
    found = pixels.flow_gate(rows, ["clip", "vec_id"], "trip", "residual", "moved", F.lit(30.0))
    return found.select("clip", "vec_id", F.round("p95", 6).alias("p95"), "residual", F.round("moved", 6).alias("moved"), "passed")


@query("""
with c as (select vec_id, p - 1 as i, (p - 1) % 8 as x, (p - 1) // 8 as y, (p - 1) % 8 + embedding[p]::double * 0.5 as mx, (p - 1) // 8 + embedding[p]::double * 0.5 as my, embedding[p]::double as e from (select vec_id, embedding, unnest(range(1, 65)) as p from embeddings)),
g as (select vec_id, i, x, y, mx, my, e,
  case x when 0 then lead(mx) over r - mx when 7 then mx - lag(mx) over r else (lead(mx) over r - lag(mx) over r) / 2 end as xx, case x when 0 then lead(my) over r - my when 7 then my - lag(my) over r else (lead(my) over r - lag(my) over r) / 2 end as yx,
  case y when 0 then lead(mx) over d - mx when 7 then mx - lag(mx) over d else (lead(mx) over d - lag(mx) over d) / 2 end as xy, case y when 0 then lead(my) over d - my when 7 then my - lag(my) over d else (lead(my) over d - lag(my) over d) / 2 end as yy
  from c window r as (partition by vec_id, y order by x), d as (partition by vec_id, x order by y)),
k as (select *, xx * yy - xy * yx as det, x between 1 and 6 and y between 1 and 6 as inside, sqrt((mx - x) * (mx - x) + (my - y) * (my - y)) as moved from g),
f as (select vec_id, count(*) filter (where inside and det <= 0.2) as folded, count(*) filter (where inside and (mx < 0 or mx > 7 or my < 0 or my > 7)) as outside, min(det) filter (where inside) as least_det,
  max(moved) filter (where inside) as most_moved, coalesce(max(moved) filter (where i < vec_id % 3), 0) as protected_moved from k group by vec_id)
select vec_id, folded, outside, round(least_det, 6) as least_det, round(most_moved, 6) as most_moved, round(protected_moved, 6) as protected_moved, folded = 0 and outside = 0 and protected_moved <= 1e-5 as passed from f""")
def map_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse maps made of a frame's values, inspected inside their border, with none to two protected cells."""
    at = lambda f: F.transform("embedding", lambda e, i: f(i).cast("double") + e.cast("double") * 0.5)
    maps = load(spark, sf_dir, "embeddings").select(
        "vec_id", F.lit(8).alias("w"), at(lambda i: i % 8).alias("mx"), at(lambda i: F.floor(i / 8)).alias("my"),
        F.transform("embedding", lambda e, i: (i % 8).between(1, 6) & F.floor(i / 8).between(1, 6)).alias("inside"), F.transform("embedding", lambda e, i: i < F.col("vec_id") % 3).alias("held"))
    found = pixels.map_inspection(maps, "vec_id", "w", "mx", "my", "inside", "held")
    return found.select("vec_id", "folded", "outside", *[F.round(c, 6).alias(c) for c in ("least_det", "most_moved", "protected_moved")], "passed")


def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, vec_id, w, grey, dx, dy, moved): each embedding as a smooth 32 x 32 frame, and the same frame moved by a known way."""
    side = 32
    value = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("int"))
    rows = load(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")  # much work for few bytes
    rows = rows.select(F.col("label").alias("clip"), "vec_id", F.lit(8).alias("w"), value.alias("px"))
    rows = resample.signals(rows, "w", "px", most=side, scale="bilinear", enlarge=True, name="grey")
    rows = rows.select("clip", "vec_id", F.col("grey_width").alias("w"), "grey", ((F.col("vec_id") % 9 - 4) * 0.6).alias("dx"), ((F.col("vec_id") % 5 - 2) * 0.7).alias("dy"))
    return resample.moved(rows, "w", "grey", "dx", "dy")


def channels(grey: str, alpha: int | None = None) -> Column:
    return F.flatten(F.transform(grey, lambda v: F.array(*[v] * 3, *([F.lit(alpha)] if alpha else []))))


@query()
def frame_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way by which each frame was moved, found again, and whether it may be taken back; a kernel without SQL form, tested on exactly moved frames."""
    inner = F.transform("grey", lambda v, i: (i % 32).between(12, 19) & F.floor(i / 32).between(12, 19))
    pairs = enlarged(spark, sf_dir).select("clip", "vec_id", "w", "dx", "dy", channels("moved", 255).alias("px"), channels("grey").alias("reference"), inner.alias("motion"))
    pairs = pairs.withColumn("static", F.transform("motion", lambda m: ~m)).withColumnsRenamed({"dx": "way_x", "dy": "way_y"})
    return alignment.aligned(pairs, ["clip", "vec_id", "way_x", "way_y"]).drop("aligned")


@query("""
with f as (select l_orderkey, l_linenumber, case when l_partkey % 11 > 0 then l_orderkey % 300 end as samples, l_suppkey % 50 / 1000.0 as texture, l_partkey % 13 > 0 as settled,
  (l_partkey % 81 - 40) / 10.0 as dx, (l_suppkey % 71 - 35) / 10.0 as dy, greatest(0, l_orderkey % 9 - 6) as exposed, l_quantity / 10.0 as "before", (l_quantity + l_linenumber - 4) / 10.0 as "after" from lineitem)
select l_orderkey, l_linenumber, case when samples is null then 'input' when samples < 32 then 'samples' when texture < 0.01 then 'texture' when not settled then 'diverged'
  when greatest(abs(dx), abs(dy)) > 3 then 'far' when exposed > 0 then 'exposed' when "after" > "before" + 0.05 then 'worse' end as problem from f""")
def registration_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accept rules of an alignment over figures of any source."""
    figures = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 11 > 0, F.col("l_orderkey") % 300).alias("samples"), (F.col("l_suppkey") % 50 / 1000.0).alias("texture"),
        (F.col("l_partkey") % 13 > 0).alias("settled"), ((F.col("l_partkey") % 81 - 40) / 10.0).alias("dx"), ((F.col("l_suppkey") % 71 - 35) / 10.0).alias("dy"),
        F.greatest(F.lit(0), F.col("l_orderkey") % 9 - 6).alias("exposed"), (F.col("l_quantity") / 10.0).alias("before"), ((F.col("l_quantity") + F.col("l_linenumber") - 4) / 10.0).alias("after"))
    return alignment.accepted(figures, F.lit(3.0)).select("l_orderkey", "l_linenumber", "problem")


@query()
def flow_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames between each frame and its moved copy, by dense flow; without SQL form, tested on exactly moved frames."""
    inner = F.transform("grey", lambda v, i: (i % 32).between(8, 23) & F.floor(i / 32).between(8, 23))
    pairs = enlarged(spark, sf_dir).select("clip", "vec_id", "w", channels("grey", 255).alias("left"), channels("moved", 255).alias("right"), inner.alias("motion"))
    found = flow.bridges(pairs, ["clip", "vec_id"], 3)
    shown = F.aggregate("px", F.lit(0).cast("long"), lambda s, v: s + v)
    return found.select("clip", "vec_id", "step", "share", *[F.round(c, 6).alias(c) for c in ("trip", "residual", "moved")], "folded", "outside", "problem", shown.alias("shown"))


@query(f"""
with w as (select i, j, greatest(0.0::double, 1.0 - abs((j + 0.5 - (i + 0.5) * 1.6::double) / 1.6::double)) as u from range(0, 5) a(i), range(0, 8) b(j)
  where j >= greatest(cast(trunc((i + 0.5) * 1.6::double - 1.1) as bigint), 0) and j < least(cast(trunc((i + 0.5) * 1.6::double + 2.1) as bigint), 8)),
k as (select i, j, cast(floor(u / sum(u) over (partition by i) * 4194304 + 0.5) as bigint) as w from w),
c as (select * from {CELLS}),
r as (select clip, vec_id, y, i as x, (sum(w * v) + 2097152) // 4194304 as v from c join k on k.j = c.x group by clip, vec_id, y, i)
select clip, vec_id, cast(k.i * 5 + r.x as bigint) as pos, cast((sum(w * v) + 2097152) // 4194304 as bigint) as v from r join k on k.j = r.y group by clip, vec_id, k.i, r.x""")
def thumbnail_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame reduced to five cells a side."""
    value = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("int"))
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.lit(8).alias("w"), value.alias("px"))
    found = resample.signals(rows, "w", "px", most=5).select("clip", "vec_id", F.posexplode("signal").alias("pos", "v"))
    return found.select("clip", "vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v"))


@query(f"""
with v as (select clip, vec_id, y // 2 as y, x // 2 as x, (sum(v) + 2) // 4 as v from {CELLS} group by clip, vec_id, y // 2, x // 2),
p as (select *, lag(v) over (partition by clip, y, x order by vec_id) as before from v)
select clip, vec_id, round(coalesce(avg(abs(v - before)), 0.0), 6) as score from p group by clip, vec_id""")
def thumbnail_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion between the frames of a clip, measured on block means."""
    value = F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("int"))
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.lit(8).alias("w"), value.alias("px"))
    small = resample.signals(rows, "w", "px", most=4, blocks=2)
    return series.lag_difference(small, ["clip"], ["vec_id"], "signal").select("clip", "vec_id", F.round("score", 6).alias("score"))
