"""Queries over media bytes: clips and files that Spark puts together from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.operators import lineage, motion, rules
from framequill.plans.catalog import query
from framequill.session import load
from framequill.sources import clips, frames, headers

CLIP = 64


def hexed(c: Column, digits: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), digits, "0")


@query(f"""
with e as (select label as clip, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 as nth from embeddings),
p as (select clip || '-' || nth // {CLIP} as source, nth % {CLIP} as i, unnest(list_transform(embedding, lambda x: cast(floor(abs(x::double) * 1000) as bigint) % 256)) as v from e where nth % {CLIP} % 3 = 0)
select source, cast(i // 3 as integer) as frame, i / 25.0::double as ts, cast(sum(v) as bigint) as total, cast(count(*) as bigint) as cells from p where i // 3 >= 2 and i // 3 < 17 group by source, i""")
def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames 2 to 16 of each clip at every third native frame; clips are array files of 64 frames of 8 x 8."""
    nth = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    cells = F.array_join(F.transform("embedding", lambda e: hexed(F.floor(F.abs(e.cast("double")) * 1000) % 256, 2)), "")
    rows = load(spark, sf_dir, "embeddings").withColumn("nth", nth).select(
        F.concat(F.col("label").cast("string"), F.lit("-"), F.expr(f"nth div {CLIP}").cast("string")).alias("source"), (F.col("nth") % CLIP).alias("i"), cells.alias("cells"))
    files = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("i", "cells"))).alias("held"))
    head = F.rpad(F.concat(F.lit("{'descr': '|u1', 'fortran_order': False, 'shape': ("), F.col("n").cast("string"), F.lit(", 8, 8, 1), }")), 117, " ")
    content = F.unhex(F.concat(F.lit("934E554D505901007600"), F.hex(head), F.lit("0A"), F.array_join(F.transform("held", lambda x: x["cells"]), "")))
    found = clips.decoded(files.select("source", content.alias("content")), start=2, stop=17, step=3)
    return found.select("source", "frame", "ts", F.aggregate("px", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.size("px").cast("long").alias("cells"))


@query("""
with m as (select p_partkey, p_partkey % 4 as kind, 200 + p_partkey * 7 % 900 as w, 200 + p_size * 40 as h, p_size * 0.25 + 1 as s, p_partkey % 9 = 0 as other from part),
f as (select *, case kind when 0 then 'png' when 1 then 'jpeg' when 2 then 'wav' end as format from m)
select p_partkey, format, case when kind < 2 then w end as width, case when kind < 2 then h end as height, case when kind = 2 then cast(s as double) end as seconds,
  case when kind = 3 then 'format' when other then 'mime' when kind = 2 then case when s not between 2 and 15 then 'seconds' end
    when least(w, h) < 256 or greatest(w, h) > 5760 then 'side' when w / h::double not between 0.4 and 2.5 then 'ratio' end as problem from f""")
def media_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small PNG, JPEG and WAV files with sizes and lengths of the parts, some of a wrong declared type, some of no format."""
    key, size = F.col("p_partkey"), F.col("p_size")
    w, h, n = 200 + key * 7 % 900, 200 + size * 40, size * 25 + 100
    head = F.concat(F.lit("49484452"), hexed(w, 8), hexed(h, 8), F.lit("0802000000"))
    sums = hexed(F.crc32(F.unhex(head)), 8)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D"), head, sums, F.lit("0000000049454E44AE426082"))
    jpeg = F.concat(F.lit("FFD8FFC0000B08"), hexed(h, 4), hexed(w, 4), F.lit("01011100FFD9"))
    turned = lambda c: F.concat(*[F.substring(hexed(c, 8), 7 - 2 * i, 2) for i in range(4)])  # noqa: E731  least byte first
    wav = F.concat(F.lit("524946460000000057415645666D7420100000000100010064000000640000000100080064617461"), turned(n), F.repeat(F.lit("00"), n.cast("int")))
    kind = key % 4
    content = F.unhex(F.when(kind == 0, png).when(kind == 1, jpeg).when(kind == 2, wav).otherwise(F.lit("00112233445566778899AABB")))
    mime = F.when(key % 9 == 0, "text/plain").when(kind == 0, "image/png").when(kind == 1, "image/jpeg").otherwise("audio/wav")
    files = load(spark, sf_dir, "part").select("p_partkey", mime.alias("mime"), content.alias("content"))
    return headers.probed(files).withColumn("problem", headers.problem(F.col("mime"))).select("p_partkey", "format", "width", "height", "seconds", "problem")


@query("""
with r as (select p_partkey as k, p_size as s, p_partkey % 6 = 0 as expands, p_partkey % 5 as d, p_partkey % 7 as seed, p_partkey % 8 as x, p_partkey % 4 as res, p_partkey % 9 = 0 as frames, p_partkey % 31 = 0 as broken from part)
select k as p_partkey, 'frames' as rule from r where broken or frames union all select k, 'duration' from r where broken or d > 1 or s not between 4 and 40 union all select k, 'seed' from r where broken or seed in (1, 2, 3)
union all select k, 'resolution' from r where broken or res > 1 union all select k, 'extra' from r where broken or x in (3, 4, 5, 7)
union all select k, 'expansion' from r where broken or case when expands then x not in (1, 5) else x in (1, 2, 3, 5) end""")
def spec_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as documents whose fields have right and wrong types."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pick = lambda n, *names: F.get(F.array(*[n_ if isinstance(n_, Column) else F.lit(n_) for n_ in names]), (k % n).cast("int"))
    duration = pick(5, size, size, F.concat(size, F.lit(".5")), F.concat(F.lit('"'), size, F.lit('"')), F.lit("true"))
    extra = pick(8, '', ', "extra": {"prompt_expansion_mode": "balanced"}', ', "extra": {"prompt_expansion_mode": 3}', ', "extra": {"other": 1}', ', "extra": [1]', ', "extra": {"other": 1, "prompt_expansion_mode": "quality"}', ', "extra": {}', ', "extra": null')
    body = F.concat(F.lit('{"duration": '), duration, F.lit(', "resolution": '), pick(4, '"768P"', '"1080p"', '"4k"', "768"), F.lit(', "seed": '), pick(7, "null", "1.5", '"a"', "true", "7", "-7", "0"),
                    F.when(k % 9 == 0, ', "frames": 5').otherwise(""), extra, F.when(k % 31 == 0, "").otherwise("}"))
    found = motion.spec_options(body, F.array(F.lit("768p"), F.lit("1080p")), F.lit(4), F.lit(40), k % 6 == 0)
    return rules.violations(load(spark, sf_dir, "part"), ["p_partkey"], found)


@query("""
select p_partkey, case when p_partkey % 3 > 0 then p_partkey % 500 else cast(round_even(p_size * 0.5 * (24 + p_partkey % 7), 0) as bigint) end as frame_count from part""")
def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared counts of frames, or those of duration and rate."""
    k = F.col("p_partkey")
    counted = F.when(k % 3 > 0, k % 500)
    return load(spark, sf_dir, "part").select("p_partkey", frames.frame_count(counted, F.col("p_size") * 0.5, (F.lit(24) + k % 7).cast("double")).alias("frame_count"))


@query("""
with s as (select user_id as sheet, count(*) as held from events group by user_id), f as (select unnest(range(0, 1000)) as frame)
select frame, frame // 12 as sheet, frame % 12 % 4 * 30 as x, frame % 12 // 4 * 20 as y, held from f join s on s.sheet = frame // 12""")
def unpacked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand frames of an atlas with the sheets they lie on; users stand for sheets."""
    sheets = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sheet")).agg(F.count(F.lit(1)).alias("held"))
    found = frames.unpacked(sheets, 1000, 4, 12, 30, 20)
    return found.select("frame", *[F.col(c).cast("long").alias(c) for c in ("sheet", "x", "y")], "held")


@query("""
with n as (select user_id, event_id, 'shot-' || user_id || '/f' || lpad(cast(event_id % 40 as varchar), 1 + cast(event_id % 5 as integer), '0') || '.png' as name from events),
p as (select user_id, event_id, cast(regexp_extract(name, '([0-9]+)[.][A-Za-z0-9]+$', 1) as integer) as frame from n),
g as (select user_id, count(distinct frame) as found from p where frame in (3, 5, 8, 13) group by user_id)
select p.user_id, p.event_id, p.frame, case p.frame when 3 then 'a' when 8 then 'b' end as matte, g.found < 4 as lacking from p join g on g.user_id = p.user_id where p.frame in (3, 5, 8, 13)""")
def selected_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of given numbers, read from file names, with the mattes some have, and whether their clip lacks one."""
    k = F.col("event_id")
    name = F.concat(F.lit("shot-"), F.col("user_id").cast("string"), F.lit("/f"), F.lpad((k % 40).cast("string"), (k % 5 + 1).cast("int"), F.lit("0")), F.lit(".png"))
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("source"), "event_id", frames.frame_number(name).alias("frame"))
    wanted = (3, 5, 8, 13)
    mattes = F.create_map(F.lit(3), F.lit("a"), F.lit(8), F.lit("b"))
    lacking = frames.missing_selected(rows, wanted).select("source", F.lit(True).alias("lacking"))
    found = frames.selected(rows, wanted).join(lacking, "source", "left")
    return found.select(F.col("source").alias("user_id"), "event_id", "frame", frames.matte_of(mattes, F.col("frame")).alias("matte"), F.coalesce("lacking", F.lit(False)).alias("lacking"))


@query("""
select p_partkey, sha256('{"columns":' || p_size || ',"sceneId":"' || p_brand || '"}') as sha256 from part""")
def contract_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a binding covers of a manifest: all but its quality."""
    manifest = F.struct(F.col("p_size").alias("columns"), F.struct(F.lit("reviewed").alias("status"), F.col("p_retailprice").alias("score")).alias("quality"), F.col("p_brand").alias("sceneId"))
    rows = load(spark, sf_dir, "part").select("p_partkey", manifest.alias("manifest"))
    return rows.select("p_partkey", F.sha2(F.to_json(lineage.without_field(F.col("manifest"))), 256).alias("sha256"))
