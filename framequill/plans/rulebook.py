"""Queries over rules of manifests, previews, plans, requests and attempts, made of part and customer rows; and over sheets of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framequill.functions import angles, text
from framequill.operators import contracts, ledger, motion, pixels, requests, rules
from framequill.plans.catalog import query
from framequill.plans.sequences import FRAMES, frames
from framequill.session import load
from framequill.sources import frames as sources

def key() -> Column:
    return F.col("p_partkey")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part")


def points(n: Column, at: Callable) -> Column:
    """array of at(j) for j = 0 .. n-1."""
    return F.transform(F.sequence(F.lit(0), n - 1), at)


@query("""
with n as (select p_partkey, cast(8 - case when p_partkey % 4 = 0 then 1 else 0 end as integer) as n from part),
j as (select p_partkey, n, unnest(range(0, n)) as j from n),
s as (select p_partkey, n, j, j * 10 + case when p_partkey % 11 = 0 and j = 2 then 20 else 0 end as f,
  j * 45.0 + case when p_partkey % 3 = 0 and j = 5 then 1 else 0 end + case when p_partkey % 5 = 0 and j = 0 then 5 else 0 end + case when p_partkey % 7 = 0 and j = n - 1 then 400 else 0 end as d from j),
l as (select *, lag(f) over w as pf, lag(d) over w as pd from s window w as (partition by p_partkey order by j)),
g as (select p_partkey, min(n) as n, bool_and(j > 0 or (f = 0 and d = 0)) as start, bool_and(j = 0 or (f > pf and d > pd)) as up, bool_and(d < 360) as below,
  count(*) filter (where f % 10 = 0 and f < 80 and d = f / 10 * 45) as agreed from l group by p_partkey)
select p_partkey, 'phases-count' as rule from g where n < 8 union all select p_partkey, 'phases-start' from g where not start union all select p_partkey, 'phases-increasing' from g where not up
union all select p_partkey, 'phases-finite' from g where not below union all select p_partkey, 'phases-anchors' from g where agreed < 8""")
def phase_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed phases of a ring with anchors at frames 0, 10, ... 70."""
    n = F.lit(8) - F.when(key() % 4 == 0, 1).otherwise(0)
    extra = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    samples = points(n, lambda j: F.struct(
        (j * 10 + extra((key() % 11 == 0) & (j == 2), 20)).alias("frame"),
        (j * 45 + extra((key() % 3 == 0) & (j == 5), 1) + extra((key() % 5 == 0) & (j == 0), 5) + extra((key() % 7 == 0) & (j == n - 1), 400)).cast("double").alias("deg")))
    anchors = F.array(*[F.lit(10 * i) for i in range(8)])
    return rules.violations(parts(spark, sf_dir).withColumn("samples", samples), ["p_partkey"], contracts.phases(F.col("samples"), anchors))


@query("""
with n as (select p_partkey, p_size, ['phase', 'arc', 'ring'][1 + p_partkey % 3] as mode, cast(1 + p_partkey % 5 as integer) as n, case when p_partkey % 7 = 0 then 100 else 120 end as step, case when p_partkey % 13 = 0 then 360 else 0 end as base from part),
l as (select p_partkey, base as first, base + (n - 1) * step as last, * exclude (p_partkey) from n)
select p_partkey, 'preview-mode' as rule from l where mode = 'ring' union all select p_partkey, 'preview-count' from l where n < 2
union all select p_partkey, 'preview-increasing' from l where n > 3 and p_partkey % 17 = 0 union all select p_partkey, 'preview-frames' from l where p_size + 3 * (n - 1) >= 50
union all select p_partkey, 'preview-start' from l where first >= 360
union all select p_partkey, 'preview-span' from l where not case when mode = 'phase' then first = 0 and last = 360 else last - first > 0 and last - first < 360 end
union all select p_partkey, 'preview-notes' from l where p_partkey % 19 = 0 union all select p_partkey, 'preview-uncertified' from l where p_partkey % 23 = 0""")
def preview_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, step = (F.lit(1) + key() % 5).cast("int"), F.when(key() % 7 == 0, 100).otherwise(120)
    samples = points(n, lambda j: F.struct(
        (F.when(key() % 13 == 0, 360).otherwise(0) + j * step).cast("double").alias("deg"), (F.col("p_size") + 3 * j - F.when((key() % 17 == 0) & (n > 3) & (j == 2), 3).otherwise(0)).cast("int").alias("frame")))
    rows = parts(spark, sf_dir).withColumn("samples", samples).withColumn("mode", F.get(F.array(F.lit("phase"), F.lit("arc"), F.lit("ring")), (key() % 3).cast("int")))
    return rules.violations(rows, ["p_partkey"], contracts.preview(F.col("mode"), F.col("samples"), F.when(key() % 19 == 0, " ").otherwise("moves"), key() % 23 == 0, F.lit(50)))


@query("""
select p_partkey, 'background-page' as rule from part where p_partkey % 2 = 0 and (p_partkey % 3 = 0 or p_partkey % 5 = 0)
union all select p_partkey, 'background-mode' from part where p_partkey % 7 = 0
union all select p_partkey, 'seam-source' from part where p_partkey % 4 = 1 union all select p_partkey, 'seam-order' from part where p_size <= p_partkey % 50
union all select p_partkey, 'sheets-count' from part where p_partkey % 6 <> ceil(p_size / 16.0) union all select p_partkey, 'sheets-unique' from part where p_partkey % 6 > 1 and p_partkey % 9 = 0
union all select p_partkey, 'bridge-count' from part where p_partkey % 11 not between 1 and 8 union all select p_partkey, 'bridge-gap' from part where not (p_size - 5 > 0 and p_size - 5 <= 30)""")
def manifest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds of pages, upper seams, sheets and bridges of manifests."""
    owner = F.when(key() % 2 == 0, "page").otherwise("atlas")
    n = (key() % 6).cast("int")
    names = F.when(n > 0, points(n, lambda j: F.concat(F.lit("sheet-"), F.when(key() % 9 == 0, F.lit(0)).otherwise(j).cast("string")))).otherwise(F.array().cast("array<string>"))
    return rules.violations(parts(spark, sf_dir), ["p_partkey"], {
        **contracts.background(owner, F.when(key() % 7 != 0, "scene-preserve"), F.when(key() % 3 != 0, "plate.png"), F.when(key() % 5 != 0, "contact.png")),
        **contracts.seam(F.array(F.lit("main"), F.lit("any"), F.when(key() % 4 == 1, "other").otherwise("main")), F.array(F.col("p_size").cast("long"), key() % 50)),
        **contracts.sheets(names, F.col("p_size"), F.lit(16)), **contracts.bridges(key() % 11, (F.col("p_size") - 5).cast("double"))})


@query("""
with k as (select p_partkey, case when p_partkey % 4 = 0 then ['columns', 'fps'] when p_partkey % 4 = 1 then ['columns', 'token'] when p_partkey % 4 = 2 then ['columns', 'colour', 'apiKey'] else ['fps'] end as keys from part)
select p_partkey, 'fields-forbidden' as rule from k where list_has_any(keys, ['apiKey', 'certified', 'quality', 'token'])
union all select p_partkey, 'fields-unknown' from k where not list_has_all(['columns', 'fps', 'framesPerSheet', 'apiKey', 'certified', 'quality', 'token'], keys)
union all select p_partkey, 'prompt-source' from part where not ((p_size % 3 = 0 and p_partkey % 3 = 0) or (p_size % 3 <> 0 and p_partkey % 3 = 1))
union all select p_partkey, 'selection-size' from part where p_partkey % 15 not between 1 and 12
union all select p_partkey, 'selection-unique' from part where p_partkey % 15 > 4 and p_size % 5 = 0""")
def spec_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of compile specs, sources of prompts, and chosen frames."""
    of = lambda *names: F.array(*[F.lit(n) for n in names])
    keys = F.when(key() % 4 == 0, of("columns", "fps")).when(key() % 4 == 1, of("columns", "token")).when(key() % 4 == 2, of("columns", "colour", "apiKey")).otherwise(of("fps"))
    n = (key() % 15).cast("int")
    chosen = F.when(n > 0, points(n, lambda j: F.when(F.col("p_size") % 5 == 0, j % 4).otherwise(j))).otherwise(F.array().cast("array<int>"))
    rows = parts(spark, sf_dir).withColumn("chosen", chosen)
    return rules.violations(rows, ["p_partkey"], {
        **contracts.spec_fields(keys, ["columns", "fps", "framesPerSheet"]), **motion.prompt_source(F.col("p_size") % 3 == 0, key() % 3), **contracts.selection(F.col("chosen"))})


PLAN = ("kind string, subjects array<string>, coordinate_system string, path string, seam_direction string, seam_verified boolean, first_pose string, cycle_start string, cycle_end string,"
        " exclude_entry boolean, start_direction string, end_direction string, via string, assembly string, reference_roles string, evidence string, duration_reason string, duration double, frames int")


@query("""
with p as (select p_partkey, p_size, ['closed-orbit', 'entry-orbit', 'upper-arc', 'diagnostic', 'reference-motion', 'segment', 'spin'][1 + p_partkey % 7] as kind,
  p_partkey % 5 = 0 as two, p_partkey % 11 <> 0 as first, p_partkey % 13 <> 0 as last, p_partkey % 17 = 0 as video, p_size % 4 <> 0 as stated from part),
s as (select *, kind in ('closed-orbit', 'entry-orbit', 'upper-arc') as screen from p)
select p_partkey, 'plan-kind' as rule from s where kind = 'spin' union all select p_partkey, 'plan-subject' from s where two union all select p_partkey, 'plan-duration' from s where p_size % 7 = 0 and p_size % 3 <> 0
union all select p_partkey, 'plan-screen' from s where screen and not stated union all select p_partkey, 'plan-first-frame' from s where screen and not first
union all select p_partkey, 'orbit-seam' from s where kind = 'closed-orbit' and not stated union all select p_partkey, 'orbit-same-ends' from s where kind = 'closed-orbit' and not (first and last and p_size % 2 = 0)
union all select p_partkey, 'entry-cycle' from s where kind = 'entry-orbit' and not stated union all select p_partkey, 'arc-ends' from s where kind = 'upper-arc' and not (last and stated)
union all select p_partkey, 'reference-video' from s where kind = 'reference-motion' and not (video and not first and not last) union all select p_partkey, 'reference-roles' from s where kind = 'reference-motion' and not stated
union all select p_partkey, 'segment-frames' from s where kind = 'segment' and not (first and last) union all select p_partkey, 'segment-route' from s where kind = 'segment' and not stated
union all select p_partkey, 'plan-evidence' from s where p_size % 9 = 0 union all select p_partkey, 'plan-reason' from s where not stated""")
def motion_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of every kind, and one that is none, with and without what their kind asks for."""
    size, stated = F.col("p_size"), F.col("p_size") % 4 != 0
    said = lambda v: F.when(stated, v)
    kind = F.get(F.array(*[F.lit(k) for k in (*motion.KINDS, "spin")]), (key() % 7).cast("int"))
    arc = kind == "upper-arc"
    plan = F.struct(
        kind.alias("kind"), F.when(key() % 5 == 0, F.array(F.lit("cat"), F.lit("dog"))).otherwise(F.array(F.lit("cat"))).alias("subjects"), said("screen").alias("coordinate_system"), F.lit("clockwise").alias("path"),
        F.lit("up").alias("seam_direction"), stated.alias("seam_verified"), F.lit("neutral").alias("first_pose"), F.lit("up").alias("cycle_start"), F.lit("up").alias("cycle_end"), stated.alias("exclude_entry"),
        said(F.when(arc, "upper-left").otherwise("left")).alias("start_direction"), F.when(arc, "upper-right").otherwise("right").alias("end_direction"), F.lit("up").alias("via"), F.lit("cut at up").alias("assembly"), said("video: motion").alias("reference_roles"),
        F.when(size % 9 != 0, "seen").alias("evidence"), said("short").alias("duration_reason"), F.when(size % 7 != 0, 5.0).alias("duration"), F.when(size % 3 == 0, 96).alias("frames"))
    roles = F.map_filter(F.create_map(F.lit("first_frame"), F.when(key() % 11 != 0, "a.png"), F.lit("last_frame"), F.when(key() % 13 != 0, F.when(size % 2 == 0, "a.png").otherwise("b.png")), F.lit("reference_video"), F.when(key() % 17 == 0, "v.mp4")), lambda k, v: v.isNotNull())
    rows = parts(spark, sf_dir).select("p_partkey", plan.cast(f"struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in PLAN.split(', ')))}>").alias("plan"), roles.alias("roles"))
    return rules.violations(rows, ["p_partkey"], motion.plan_contract(F.col("plan"), F.col("roles")))


@query("""
with a as (select p_partkey, p_size, ['pilot', 'repair', 'segment', 'expansion', 'retake'][1 + p_partkey % 5] as stage, p_size % 3 <> 0 as ok, p_size % 4 <> 0 as there, p_partkey % 7 as k from part),
p as (select *, case k when 0 then 'source-frames' when 1 then 'reviewed-replacement' when 2 then 'redraw' end as policy from a)
select p_partkey, 'stage' as rule from p where stage = 'retake'
union all select p_partkey, 'expansion-manifest' from p where stage = 'expansion' and not ok union all select p_partkey, 'expansion-video' from p where stage = 'expansion' and not there
union all select p_partkey, 'expansion-scene' from p where stage = 'expansion' and k <> 3 union all select p_partkey, 'repair-source' from p where stage = 'repair' and not there
union all select p_partkey, 'repair-evidence' from p where stage = 'repair' and p_size - 5 <= 0 union all select p_partkey, 'repair-policy' from p where stage = 'repair' and policy = 'redraw'
union all select p_partkey, 'repair-frames' from p where stage = 'repair' and coalesce(policy, 'source-frames') = 'source-frames' and not ok
union all select p_partkey, 'repair-review' from p where stage = 'repair' and policy = 'reviewed-replacement' and not (p_size % 5 <> 0 and ok)
union all select p_partkey, 'segment-source' from p where stage = 'segment' and not (there and ok) union all select p_partkey, 'segment-frames' from p where stage = 'segment' and not (k < 2 and p_size % 2 = 1 and ok)""")
def attempt_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What attempts of each later stage must show."""
    size, k = F.col("p_size"), key() % 7
    stage = F.get(F.array(*[F.lit(s) for s in (*ledger.STAGES, "retake")]), (key() % 5).cast("int"))
    ok, there = size % 3 != 0, size % 4 != 0
    rows = parts(spark, sf_dir).select(
        "p_partkey", stage.alias("stage"), F.lit("park").alias("scene_id"), F.when(k == 3, "park").otherwise("lake").alias("manifest_scene"), ok.alias("manifest_ready"), F.lit("ab").alias("video_sha256"),
        F.create_map(F.lit("a.mp4"), F.when(there, "ab").otherwise("cd")).alias("source_hashes"), there.alias("source_exists"), (size - 5).alias("evidence_bytes"),
        F.when(k == 0, "source-frames").when(k == 1, "reviewed-replacement").when(k == 2, "redraw").alias("input_policy"), F.when(size % 5 != 0, "worn").alias("change_reason"), ok.alias("reviewed"), ok.alias("frames_match"),
        F.when(k < 2, 1).otherwise(2).alias("first_frames"), (size % 2).alias("last_frames"))
    return ledger.stage_evidence(rows, ["p_partkey"])


@query("""
with r as (select conv_id, turn, case when role = 'user' then 'video' when turn % 3 = 0 then 'audio' else 'image' end as role, 1 + length(text) % 9 as seconds from conversations),
g as (select conv_id, role, count(*) as n, sum(seconds) as s from r group by conv_id, role),
w as (select conv_id, sum(n) as media, coalesce(sum(n) filter (where role = 'audio'), 0) as audio, coalesce(sum(n) filter (where role in ('image', 'video')), 0) as seen,
  bool_and(n <= case role when 'image' then 9 else 3 end and s <= 15.001) as within from g group by conv_id)
select conv_id, 'media-total' as rule from w where media > 12 union all select conv_id, 'media-roles' from w where not within union all select conv_id, 'audio-alone' from w where audio > 0 and seen = 0""")
def media_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of whole requests: turns of a conversation as video, sound and images."""
    role = F.when(F.col("role") == "user", "video").when(F.col("turn") % 3 == 0, "audio").otherwise("image")
    held = load(spark, sf_dir, "conversations").select("conv_id", role.alias("role"), (F.lit(1) + F.length("text") % 9).cast("double").alias("seconds"))
    return requests.request_rules(requests.inventory(held, ["conv_id"], "role", "seconds"), ["conv_id"])


@query("""
with f as (select p_partkey, p_size::bigint * 1048576 as size, ['image', 'video', 'audio', 'text'][1 + p_partkey % 4] as kind, ['image/png', 'VIDEO/MP4', 'audio/mpeg', 'image/gif', 'audio/wav'][1 + p_partkey % 5] as mime from part)
select p_partkey, 'mime' as rule from f where not coalesce((kind = 'image' and mime = 'image/png') or (kind = 'video' and mime = 'VIDEO/MP4') or (kind = 'audio' and mime in ('audio/mpeg', 'audio/wav')), false)
union all select p_partkey, 'bytes' from f where not coalesce(size <= case kind when 'image' then 31457280 when 'video' then 52428800 when 'audio' then 15728640 end, false)""")
def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), (key() % k).cast("int"))
    return rules.violations(parts(spark, sf_dir), ["p_partkey"], requests.file_rules(
        pick(["image", "video", "audio", "text"], 4), pick(["image/png", "VIDEO/MP4", "audio/mpeg", "image/gif", "audio/wav"], 5), F.col("p_size").cast("long") * 1048576))


@query("""
with r as (select p_partkey, p_size, ['768p', '1080P', '480p', null][1 + p_partkey % 4] as resolution, p_partkey % 6 = 0 as expands, ['disabled', 'balanced', 'other', null][1 + p_size % 4] as expansion from part)
select p_partkey, 'resolution' as rule from r where coalesce(lower(resolution) not in ('768p', '1080p'), true) union all select p_partkey, 'duration' from r where not (p_size between 4 and 40)
union all select p_partkey, 'expansion' from r where not (case when expands then coalesce(expansion in ('disabled', 'balanced', 'quality'), false) else expansion is null end)""")
def option_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, of: F.get(F.array(*[F.lit(n) for n in names]), of.cast("int"))
    return rules.violations(parts(spark, sf_dir), ["p_partkey"], motion.option_contract(
        pick(["768p", "1080P", "480p", None], key() % 4), F.array(F.lit("768p"), F.lit("1080p")), F.col("p_size"), F.lit(4), F.lit(40), pick(["disabled", "balanced", "other", None], F.col("p_size") % 4), key() % 6 == 0))


@query(f"""
with f as (select clip, vec_id, frame, frame // 16 as sheet, list_max(embedding) as top from {FRAMES})
select clip, sheet, count(*) as n, cast(ceil(count(*) / 4.0) as integer) as rows, string_agg(cast(frame as varchar), ',' order by frame) as held from f group by clip, sheet""")
def atlas_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames packed into sheets of 16 in four columns; the last one is short."""
    packed = sources.packed(frames(spark, sf_dir).select(F.col("clip").alias("source"), "frame", F.col("embedding").alias("px")), 4, 16)
    held = F.array_join(F.transform("cells", lambda c: c["frame"].cast("string")), ",")
    return packed.select(F.col("source").alias("clip"), F.col("sheet").cast("long").alias("sheet"), F.size("cells").cast("long").alias("n"), "rows", held.alias("held"))


@query(f"""
select clip, vec_id, frame, cast(frame // 16 as bigint) as sheet, cast(frame % 16 % 4 * 64 as bigint) as x, cast(frame % 16 // 4 * 48 as bigint) as y, embedding[1]::double as head,
       case when frame % 3 = 0 then 'clean' else 'base' end as plate from {FRAMES}""")
def sheet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames taken back out of their sheets by sheet and place, each with the plate that its background's owner asks for."""
    held = frames(spark, sf_dir)
    sheets = sources.packed(held.select(F.col("clip").alias("source"), "frame", F.col("embedding").alias("px")), 4, 16)
    cells = sheets.select(F.col("source").alias("clip"), F.col("sheet").cast("long").alias("sheet"), F.posexplode("cells").alias("cell", "c"))
    index = sources.placed_frames(held.select("clip", "vec_id", "frame"), 4, 16, 64, 48)
    back = index.join(cells, ["clip", "sheet", "cell"]).withColumn("owner", F.when(F.col("frame") % 3 == 0, "page").otherwise("atlas")).withColumn("base", F.lit("base")).withColumn("clean", F.lit("clean"))
    return sources.composited(back, "base", "clean").select("clip", "vec_id", "frame", "sheet", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.get("c.px", F.lit(0)).cast("double").alias("head"), "plate")


@query("""
select event_id, round(atan2(sin(value - event_id % 7), cos(value - event_id % 7)), 6) as way from events""")
def angle_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", F.round(angles.angular_distance(F.col("value"), F.col("event_id") % 7), 6).alias("way"))


@query(f"""
with c as (select vec_id, label as clip, p - 1 as i, cast(floor(abs(cast(embedding[p] as double)) * 1000) as bigint) % 256 > 128 as solid from (select vec_id, label, embedding, unnest(range(1, 65)) as p from embeddings))
select clip, vec_id, cast(count(*) filter (where solid) as integer) as area,
  cast(count(*) filter (where solid and i < 8) + count(*) filter (where solid and i >= 56) + count(*) filter (where solid and i % 8 = 0) + count(*) filter (where solid and i % 8 = 7) as integer) as edge_pixels,
  bool_or(solid and (i < 8 or i % 8 in (0, 7))) as clipped from c group by clip, vec_id""")
def mask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256)
    masks = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", F.lit(8).alias("w"), value.alias("mask"))
    return pixels.mask_metrics(masks, ["clip", "vec_id"], "w", "mask")


@query(f"""
with c as (select label as clip, vec_id, list_transform(embedding, lambda e: case when vec_id % 9 = 0 then 0 when vec_id % 10 = 0 then 255 else cast(floor(abs(cast(e as double)) * 1000) as bigint) % 256 end) as a from embeddings)
select clip, vec_id, cast(list_min(a) as bigint) as low, cast(list_max(a) as bigint) as high, case when list_max(a) <= 0 then 'empty' when clip % 2 = 0 and list_min(a) >= 255 then 'opaque' end as problem from c""")
def cell_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extrema of every active cell's alpha; even clips belong to a page."""
    alpha = F.transform("embedding", lambda e: F.when(F.col("vec_id") % 9 == 0, 0).when(F.col("vec_id") % 10 == 0, 255).otherwise(F.floor(F.abs(e.cast("double")) * 1000) % 256).cast("long"))
    cells = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", alpha.alias("alpha"))
    return pixels.cell_problems(cells, ["clip", "vec_id"], "alpha", F.col("clip") % 2 == 0)


@query("""
with p as (select o_custkey as c_custkey, max(o_orderkey) as pilot, count(*) as n from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' group by o_custkey),
s as (select distinct o.o_custkey as c_custkey, sha256(cast(l.l_orderkey as varchar)) as sha from orders o join lineitem l on l.l_orderkey = o.o_orderkey where l.l_returnflag = 'R')
select p.c_custkey, p.pilot from p join customer c on c.c_custkey = p.c_custkey where p.n = 1 and exists (select 1 from s where s.c_custkey = p.c_custkey and s.sha = sha256(cast(p.pilot as varchar)))""")
def pilot_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with exactly one pilot whose file is among the files approved for them."""
    orders = load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    pilots = orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("c_custkey", F.col("o_orderkey").alias("pilot"), sha("o_orderkey").alias("file"))
    approved = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(orders.select("o_orderkey", "c_custkey"), "o_orderkey")
    found = requests.bound_match(load(spark, sf_dir, "customer").select("c_custkey"), pilots, ["c_custkey"], "file", approved.select("c_custkey", sha("o_orderkey").alias("sha256")), ["c_custkey"])
    return found.select("c_custkey", "pilot")


@query("""
select event_id, case event_id % 3 when 0 then true when 1 then value * 3 - 300 - floor((value * 3 - 300) / 360.0) * 360 <= 120 else false end as follows from events""")
def candidate_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which directions a ring, an arc from 300 to 420 degrees and a phase may follow."""
    mode = F.get(F.array(F.lit("ring"), F.lit("arc"), F.lit("phase")), (F.col("event_id") % 3).cast("int"))
    return load(spark, sf_dir, "events").select("event_id", rules.follows(mode, F.col("value") * 3, F.lit(300.0), F.lit(420.0)).alias("follows"))


@query("""
with u as (select page_id, case page_id % 3 when 0 then url when 1 then 'data:text/plain;base64,QQ==' else 'local/' || page_id end as value, case when page_id % 2 = 0 then 'text/html' end as mime, url from pages)
select page_id, case when page_id % 3 < 2 then value else 'data:' || coalesce(mime, 'application/octet-stream') || ';base64,' || to_base64(encode(url)) end as uri from u""")
def media_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    value = F.when(page % 3 == 0, F.col("url")).when(page % 3 == 1, "data:text/plain;base64,QQ==").otherwise(F.concat(F.lit("local/"), page.cast("string")))
    return load(spark, sf_dir, "pages").select("page_id", text.media_uri(value, F.when(page % 2 == 0, "text/html"), F.col("url").cast("binary")).alias("uri"))


@query("""
select p_partkey, sha256('{"a":{"k":' || p_size || ',"z":"\\u00e9\\ud83d\\ude00"},"name":"' || p_brand || '"}') as fingerprint from part""")
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of nested requests in one canonical form: sorted keys at every level, ASCII only."""
    body = text.canonical({"name": F.col("p_brand"), "a": {"z": F.lit("\u00e9\U0001f600"), "k": F.col("p_size")}}, ascii_only=True)
    return load(spark, sf_dir, "part").select("p_partkey", F.sha2(body, 256).alias("fingerprint"))


@query("""
with p as (select label as clip, vec_id, list_transform(embedding, lambda e: cast(floor(abs(cast(e as double)) * 1000) as bigint) % 256) as m from embeddings),
x as (select clip, vec_id, m, unnest(range(1, 65)) as j from p), s as (select vec_id, bool_or(m[j] > 16 and (case when (j - 1) % 8 > 5 and vec_id % 4 = 0 then 200 else 255 end) < 250) as enters from x group by vec_id)
select clip, p.vec_id, 'matte-both' as rule from p where not (list_max(m) > 0 and list_min(m) < 255) union all select clip, p.vec_id, 'matte-source' from p join s on s.vec_id = p.vec_id where enters""")
def composite_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mattes against the alpha of their sources; every fourth frame is feathered in its last two columns."""
    matte = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256)
    alpha = F.transform("embedding", lambda e, i: F.when((i % 8 > 5) & (F.col("vec_id") % 4 == 0), 200).otherwise(255))
    rows = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", matte.alias("matte"), alpha.alias("alpha"))
    return rules.violations(rows, ["clip", "vec_id"], pixels.composite_problems(F.col("alpha"), F.col("matte")))
