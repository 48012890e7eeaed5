"""Queries over manifests, lineage, evidence, certificates and ledgers.

Roles: documents are assets with content hashes, labels are checks of some of them, parts are rectangles and ratios,
orders are atlases whose line items are cells, events are ledger requests and rechecks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framequill.operators import contracts, ledger, lineage, route, rules
from framequill.plans.catalog import query
from framequill.plans.sequences import FRAMES, frames, steps
from framequill.session import load

RATIOS = (("16:9", 16 / 9), ("4:3", 4 / 3), ("1:1", 1.0), ("3:4", 3 / 4), ("9:16", 9 / 16), ("21:9", 21 / 9))


@query(f"""
with d as (select clip, frame * 2 + o.odd as index, frame as parent, o.odd, lead(1) over (partition by clip, o.odd order by frame) as more from {FRAMES}, (values (0), (1)) o(odd)),
l as (select clip, index, parent, odd from d where odd = 0 or more is not null),
a as (select label as clip, vec_id, vec_id % 120 as index from embeddings)
select a.clip, a.vec_id, l.index is not null as known, cast(coalesce(l.parent, a.index) as bigint) as native_frame,
       coalesce(l.odd = 1, false) as interpolated
from a left join l on l.clip = a.clip and l.index = a.index""")
def lineage_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = route.densified(frames(spark, sf_dir).select("clip", "frame"), ["clip"], "frame")
    atlas = load(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), "vec_id", (F.col("vec_id") % 120).alias("index"))
    found = lineage.annotated(atlas, dense, ["clip", "index"])
    return found.select("clip", "vec_id", F.col("kind").isNotNull().alias("known"), F.coalesce(F.get("parents", F.lit(0)).cast("long"), F.col("index")).alias("native_frame"),
                        F.coalesce(F.col("kind") == "interpolated", F.lit(False)).alias("interpolated"))


@query("""
select o_orderkey as index, case when o_orderkey % 45 = 0 then 'missing' else 'differs' end as problem from orders where o_orderkey % 45 = 0 or o_orderkey % 40 = 7
union all select -o_orderkey, 'unexpected' from orders where o_orderkey % 97 = 5""")
def lineage_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("parent"))
    extra = expected.where("index % 97 = 5").withColumn("index", -F.col("index"))
    found = expected.where("index % 45 <> 0").withColumn("parent", F.when(F.col("index") % 40 == 7, F.col("parent") + 1).otherwise(F.col("parent")))
    return lineage.mismatches(found.unionByName(extra), expected, ["index"], ["parent"])


@query("""
with h as (select source, doc_id // 256 as block, doc_id, sha256(text) as h from documents)
select source, block, count(*) as n, sha256(string_agg(h, '' order by doc_id)) as digest from h group by source, block""")
def asset_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings of blocks of 256 identifiers, which bounds what one digest gathers."""
    assets = load(spark, sf_dir, "documents").select("source", F.expr("doc_id div 256").alias("block"), "doc_id", F.sha2("text", 256).alias("sha256"))
    return lineage.ordered_digest(assets, ["source", "block"], "doc_id", "sha256")


@query("""
select source as scope, doc_id as path, case when doc_id % 41 = 0 then 'missing' else 'changed' end as problem from documents where doc_id % 41 = 0 or doc_id % 17 = 3""")
def stale_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = load(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "text")
    now = assets.where("path % 41 <> 0").withColumn("sha256", F.when(F.col("path") % 17 == 3, F.sha2(F.concat("text", F.lit("."))  , 256)).otherwise(F.col("sha256")))
    return lineage.stale(assets.drop("text"), now.drop("text"))


@query("""
select o_custkey as owner, o_orderpriority as priority, 'left' as side from orders where o_orderkey % 50 = 1 or o_orderkey % 50 = 2
except all select o_custkey, o_orderpriority, 'left' from orders where o_orderkey % 50 = 2 or o_orderkey % 50 = 3
union all (select o_custkey, o_orderpriority, 'right' from orders where o_orderkey % 50 = 2 or o_orderkey % 50 = 3
except all select o_custkey, o_orderpriority, 'right' from orders where o_orderkey % 50 = 1 or o_orderkey % 50 = 2)""")
def record_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").withColumn("r", F.col("o_orderkey") % 50)
    pick = lambda *r: rows.where(F.col("r").isin(*r)).select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("priority"))
    return lineage.same_records(pick(1, 2), pick(2, 3))


@query("""
with m as (select c_custkey as owner, c_mktsegment as key, c_acctbal as value, 0 as seq from customer
           union all select o_custkey, o_orderpriority, max(o_totalprice), 1 from orders group by o_custkey, o_orderpriority
           union all select c_custkey, 'BUILDING', -1.0, 2 from customer where c_custkey % 3 = 0)
select owner, key, max_by(value, seq) as value from m group by owner, key""")
def merged_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    one = customer.select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("key"), F.col("c_acctbal").alias("value"))
    two = orders.groupBy(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("key")).agg(F.max("o_totalprice").alias("value"))
    three = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("owner"), F.lit("BUILDING").alias("key"), F.lit(-1.0).alias("value"))
    return lineage.latest_entries(one, two, three)


@query("""
select d.source, count(*) as assets, count(l.doc_id) as checked, bool_and(l.doc_id is not null) as complete,
       count(*) filter (where l.doc_id is null) as uncovered
from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id group by d.source""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = load(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(True))
    joined = load(spark, sf_dir, "documents").select("doc_id", "source").join(checked, "doc_id", "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("assets"), F.count("has").alias("checked"), F.bool_and(F.col("has").isNotNull()).alias("complete"),
                                        F.count_if(F.col("has").isNull()).alias("uncovered"))


@query("""
select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1 and l.toxic = 0 and l.doc_id % 7 <> 0)""")
def unresolved_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label does not resolve them: it has to pass, with evidence (none if toxic) and a note."""
    entries = load(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"), F.when(F.col("toxic") == 0, F.array(F.lit("seen.png"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
        F.when(F.col("doc_id") % 7 != 0, "looked at").otherwise(" ").alias("notes"))
    return rules.uncovered(load(spark, sf_dir, "documents").select("doc_id", "source"), rules.resolved(entries, ["doc_id"], "status", "evidence", "notes"), ["doc_id"])


@query("""
with v as (
  select doc_id, 'check-quality' as rule from labels where quality <> 1
  union all select doc_id, 'check-toxic' from labels where toxic <> 0
  union all select doc_id, 'text-length' from documents where n_chars < 200
  union all select d.doc_id, 'unreviewed' from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)),
i as (select doc_id, string_agg(rule, ',' order by rule) as issues from (select distinct * from v) group by doc_id)
select d.doc_id, coalesce(i.issues, '') as issues, case when i.issues is null then 'reviewed' else 'blocked' end as status, i.issues is null as circular
from documents d left join i on i.doc_id = d.doc_id""")
def certificate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = load(spark, sf_dir, "labels")
    checks = rules.violations(labels, ["doc_id"], {"check-quality": F.col("quality") == 1, "check-toxic": F.col("toxic") == 0})
    sizes = rules.violations(docs, ["doc_id"], {"text-length": F.col("n_chars") >= 200})
    missing = rules.uncovered(docs, labels, ["doc_id"]).select("doc_id", F.lit("unreviewed").alias("rule"))
    found = rules.status(docs, checks.unionByName(sizes).unionByName(missing), ["doc_id"])
    return found.select("doc_id", F.array_join("issues", ",").alias("issues"), "status", "circular")


DIRECTIONS = ("up", "up-right", "right", "down-right", "down", "down-left", "left", "up-left")


@query(f"""
with o as (select label as clip, row_number() over (partition by label order by vec_id) - 1 as i, vec_id, embedding from embeddings),
x as (select clip, i // 8 as review, i % 8 as ord, i + cast(vec_id % 9 = 0 as int) as frame, {list(DIRECTIONS)!r} as d, embedding[1] > 0.15 as h, embedding[2] > 0.15 as g, vec_id % 11 > 0 as evidence, i from o),
n as (select clip, review, count(*) as n from x group by clip, review),
p as (select x.clip, x.review, x.ord, case when frame <> i then 'frame' when h then 'head' when g then 'gaze' when not evidence then 'evidence' end as problem from x join n on n.clip = x.clip and n.review = x.review and n.n = 8)
select clip, review, ord, problem from p where problem is not null union all select clip, review, null, 'count' from n where n < 8""")
def direction_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eight frames of a clip as a review of eight directions: frame, head and gaze against the anchors."""
    names = F.array(*[F.lit(d) for d in DIRECTIONS])
    at = frames(spark, sf_dir).select("clip", F.col("frame").cast("long").alias("i"), "vec_id", "embedding")
    at = at.select("*", F.expr("i div 8").alias("review"), (F.col("i") % 8).alias("ord"))
    off = lambda j: F.get(names, ((F.col("ord") + (F.get("embedding", F.lit(j)) > 0.15).cast("int")) % 8).cast("int"))
    seen = at.select("clip", "review", "ord", (F.col("i") + (F.col("vec_id") % 9 == 0).cast("int")).alias("frame"), off(0).alias("head"), off(1).alias("gaze"), (F.col("vec_id") % 11 > 0).alias("evidence"))
    reviews = at.select("clip", "review").distinct().withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(7))))
    anchors = reviews.select("clip", "review", F.col("ord").cast("long").alias("ord"), (F.col("review") * 8 + F.col("ord")).alias("frame"), F.get(names, F.col("ord")).alias("direction"))
    return rules.observation_problems(seen, anchors, ["clip", "review"])


@query("""
with r as (select user_id, event_id as seq, case when value > 400 then 'error' when value > 200 then 'fail' else 'pass' end as outcome from events)
select user_id, max_by(outcome, seq) as outcome, max(seq) as seq, count(*) as rechecks, case when max_by(outcome, seq) = 'pass' then 'approved' else 'revoked' end as state
from r group by user_id""")
def certificate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("value") > 400, "error").when(F.col("value") > 200, "fail").otherwise("pass")
    return rules.current(load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), outcome.alias("outcome")), ["user_id"], "seq")


MANIFEST_SQL = """(select p_partkey as atlas_id, p_partkey % 40 as x, p_partkey % 30 as y, p_size * 4 as w, p_size * 3 as h, 160 as width, 120 as height,
  cast(floor(p_retailprice) as bigint) % 100 as ex, cast(floor(p_retailprice) as bigint) % 70 as ey, p_size % 7 as columns, p_size * 3 as frames, 16 as per_sheet, p_partkey % 6 as sheets from part)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("p_retailprice").cast("long")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("atlas_id"), (F.col("p_partkey") % 40).alias("x"), (F.col("p_partkey") % 30).alias("y"), (F.col("p_size") * 4).alias("w"), (F.col("p_size") * 3).alias("h"),
        F.lit(160).alias("width"), F.lit(120).alias("height"), (price % 100).alias("ex"), (price % 70).alias("ey"), (F.col("p_size") % 7).alias("columns"),
        (F.col("p_size") * 3).alias("frames"), F.lit(16).alias("per_sheet"), (F.col("p_partkey") % 6).alias("sheets"))


@query(f"""
with m as {MANIFEST_SQL}
select atlas_id, 'crop-inside-base' as rule from m where not (x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= width and y + h <= height)
union all select atlas_id, 'eye-inside-crop' from m where not (ex >= x and ex < x + w and ey >= y and ey < y + h)
union all select atlas_id, 'columns-positive' from m where not (columns > 0)
union all select atlas_id, 'sheet-count' from m where sheets <> ceil(frames / 16.0)""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return rules.violations(manifests(spark, sf_dir), ["atlas_id"], {
        "crop-inside-base": rules.rectangle_inside(c("x"), c("y"), c("w"), c("h"), c("width"), c("height")),
        "eye-inside-crop": rules.point_inside(c("ex"), c("ey"), c("x"), c("y"), c("w"), c("h")),
        "columns-positive": c("columns") > 0,
        "sheet-count": c("sheets") == F.ceil(c("frames") / c("per_sheet")),
    })


@query(f"""
with r as (select atlas_id as id, atlas_id % 50 as scene, ex * 7 as x, ey * 5 as y, w / 4 + 1 as w, h / 3 + 1 as h from {MANIFEST_SQL}),
q as (select id, scene, x, y, cast(floor(w) as bigint) as w, cast(floor(h) as bigint) as h from r)
select a.scene, a.id as a, b.id as b from q a join q b on a.scene = b.scene and a.id < b.id
where greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) and greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h)""")
def rect_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = manifests(spark, sf_dir).select(F.col("atlas_id").alias("id"), (F.col("atlas_id") % 50).alias("scene"), (F.col("ex") * 7).alias("x"), (F.col("ey") * 5).alias("y"),
                                            F.floor(F.col("w") / 4 + 1).alias("w"), F.floor(F.col("h") / 3 + 1).alias("h"))
    return rules.overlapping(rects, ["scene"], 64)


@query(f"""
with c(ord, name, v) as (values {', '.join(f"({i}, '{n}', {v!r})" for i, (n, v) in enumerate(RATIOS))}),
p as (select p_partkey, (p_size + 20) / (p_partkey % 37 + 15.0) as ratio from part),
r as (select p.p_partkey, c.name, row_number() over (partition by p.p_partkey order by abs(p.ratio - c.v), c.ord) as nth from p, c)
select p_partkey, name as ratio from r where nth = 1""")
def nearest_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = (F.col("p_size") + 20) / (F.col("p_partkey") % 37 + 15.0)
    return load(spark, sf_dir, "part").select("p_partkey", rules.nearest(ratio, RATIOS).alias("ratio"))


@query("""
with s as (select user_id, count(distinct event_type) as kinds, max(value) - min(value) as width, bool_and(value < 470) as steady from events group by user_id)
select user_id, case when kinds = 8 then 'diagnostic' when width >= 485 then 'arc' when steady then 'phase' else 'playback' end as grade from s""")
def candidate_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_distinct("event_type").alias("kinds"), (F.max("value") - F.min("value")).alias("width"), F.bool_and(F.col("value") < 470).alias("steady"))
    return seen.select("user_id", rules.grade(F.col("kinds"), F.col("width") - 440, F.col("steady")).alias("grade"))


@query("""
with m as (select p_partkey, ['page', 'scene', 'window', null][1 + p_partkey % 4] as owner, ['preserve', 'chroma-key', 'replace-edge-light', 'fit-edge-light', 'blur'][1 + p_size % 5] as mode, p_partkey % 3 <> 0 as keyed, p_partkey % 7 <> 0 as passed from part),
a(owner, mode) as (values ('page', 'preserve'), ('page', 'chroma-key'), ('scene', 'preserve'), ('scene', 'replace-edge-light'), ('scene', 'fit-edge-light'))
select p_partkey, 'background-owner' as rule from m where coalesce(owner, '') not in ('page', 'scene')
union all select p_partkey, 'background-pair' from m where not exists (select 1 from a where a.owner = m.owner and a.mode = m.mode)
union all select p_partkey, 'background-key' from m where mode = 'chroma-key' and not (keyed and passed)""")
def background_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, k: F.get(F.array(*[F.lit(n) for n in names]), k.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    owner, mode = pick(["page", "scene", "window", None], key % 4), pick(["preserve", "chroma-key", "replace-edge-light", "fit-edge-light", "blur"], size % 5)
    return rules.violations(load(spark, sf_dir, "part"), ["p_partkey"], contracts.background_pair(owner, mode, F.when(key % 3 != 0, "#00ff00"), key % 7 != 0))


@query("""
with recursive m as (select p_partkey as k, case when p_partkey = 3 then 6 when p_partkey % 5 > 0 then p_partkey // 2 end as up from part),
r as (select k, k as anc, 0 as d, [k] as way, false as bad from m union all
  select r.k, m.up, r.d + 1, list_append(r.way, m.up), list_contains(r.way, m.up) from r join m on m.k = r.anc where m.up is not null and not r.bad),
c as (select distinct k from r where bad),
e as (select k, 'a' || k % 3 as path, 'x' || k as sha256 from m union all select k, 'b' || k % 4, 'y' || k from m),
h as (select r.k, e.path, e.sha256, r.d from r join e on e.k = r.anc where r.k not in (select k from c))
select k as p_partkey, path, min_by(sha256, d) as sha256, cast(min(d) as bigint) as distance from h group by k, path""")
def inherited_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that a manifest has from itself or the nearest ancestor; each part was made from the one of half its number, but for a cycle."""
    k = F.col("p_partkey")
    up = F.when(k == 3, F.lit(6).cast("long")).when(k % 5 > 0, F.expr("p_partkey div 2"))
    manifests = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("m"), k.cast("string")).alias("sha"), F.concat(F.lit("m"), up.cast("string")).alias("parent"))
    entries = manifests.select("p_partkey", F.explode(F.array(
        F.struct(F.concat(F.lit("a"), (k % 3).cast("string")).alias("path"), F.concat(F.lit("x"), k.cast("string")).alias("sha256")),
        F.struct(F.concat(F.lit("b"), (k % 4).cast("string")).alias("path"), F.concat(F.lit("y"), k.cast("string")).alias("sha256")))).alias("e")).select("p_partkey", "e.*")
    chains, _ = lineage.ancestors(manifests, "p_partkey", "sha", "parent")
    return lineage.inherited(chains, entries, "p_partkey")


@query("""
with recursive e as (
  select user_id, event_id, value / 50.0 as seconds, cast(event_id % 23 as varchar) as fp, row_number() over (partition by user_id order by ts, event_id) as nth from events),
r as (
  select user_id, nth, event_id, seconds, 0 as n, cast(0 as double) as used, cast([] as varchar[]) as seen, '' as reason from e where false
  union all select user_id, 0, cast(0 as bigint), cast(0 as double), 0, cast(0 as double), cast([] as varchar[]), '' from (select distinct user_id from e) k
  union all
  select e.user_id, e.nth, e.event_id, e.seconds,
    case when x.reason = '' then r.n + 1 else r.n end, case when x.reason = '' then r.used + e.seconds else r.used end,
    case when x.reason = '' then list_append(r.seen, e.fp) else r.seen end, x.reason
  from r join e on e.user_id = r.user_id and e.nth = r.nth + 1,
  lateral (select case when not (e.seconds > 0) then 'invalid' when e.seconds > 8 then 'per-request' when r.n >= 6 then 'count'
                       when list_contains(r.seen, e.fp) then 'duplicate' when r.used + e.seconds > 20 then 'total' else '' end as reason) x)
select user_id, event_id, seconds, reason = '' as accepted, reason, used from r where nth > 0""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 50.0).alias("seconds"), (F.col("event_id") % 23).cast("string").alias("fp"))
    found = ledger.admitted(asked, "user_id", ["ts", "event_id"], "seconds", "fp", most=6, total=20, per_request=8)
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "seconds", "accepted", "reason", "used")


@query("""
with s as (select user_id, event_id as seq, case event_type when 'click' then 'pilot' when 'view' then 'segment' else 'expansion' end as stage, event_id % 5 as request, event_id * 3 % 5 as pilot_request from events),
w as (select *, row_number() over (partition by user_id order by seq) as nth from s),
p as (select e.user_id, e.seq, count(*) as pilots from s e join s p on p.user_id = e.user_id and p.stage = 'pilot' and p.request = e.pilot_request and p.seq < e.seq where e.stage = 'expansion' group by e.user_id, e.seq)
select w.user_id, w.seq, stage, case when stage = 'pilot' then 'pilot-not-first' else 'no-single-pilot' end as problem from w left join p on p.user_id = w.user_id and p.seq = w.seq
where (stage = 'pilot' and nth > 1) or (stage = 'expansion' and coalesce(pilots, 0) <> 1)""")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", "pilot").when(F.col("event_type") == "view", "segment").otherwise("expansion")
    attempts = load(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("at"), stage.alias("stage"), (F.col("event_id") % 5).alias("request"), (F.col("event_id") * 3 % 5).alias("pilot_request"))
    return ledger.stage_problems(attempts, "user_id", "at")


@query("""
with l as (select c_custkey, case when c_nationkey % 5 <> 0 then c_nationkey % 9 end as per_request, case when c_custkey % 3 = 0 then c_acctbal end as total, 3 as most,
  case c_nationkey % 3 when 0 then null when 1 then ['minimax/minimax-h3-max'] else ['other/model', 'minimax/minimax-h3-max'] end as models, case when c_custkey % 7 = 0 then ['1080p'] end as resolutions,
  case when c_custkey % 4 = 0 then c_mktsegment else ' ' end as why, c_custkey % 11 = 0 as allow, c_custkey % 8 as seconds, case when c_custkey % 5 = 0 then 'other/model' else 'minimax/minimax-h3-max' end as model,
  '768p' as resolution, c_custkey % 13 as used, c_custkey % 2 as refs from customer),
f as (select *, coalesce(per_request, 5) as per, coalesce(total, 15) as whole, coalesce(models, ['minimax/minimax-h3-max']) as ms, coalesce(resolutions, ['768p']) as rs, trim(why) <> '' as reason from l)
select c_custkey, 'limits-positive' as rule from f where not (per > 0 and whole > 0)
union all select c_custkey, 'seconds' from f where seconds <= 0 union all select c_custkey, 'model' from f where not list_contains(ms, model) union all select c_custkey, 'resolution' from f where not list_contains(rs, resolution)
union all select c_custkey, 'per-request' from f where seconds > per union all select c_custkey, 'total' from f where used + seconds > whole
union all select c_custkey, 'change-reason' from f where (per > 5 or whole > 15 or len(ms) > 1 or rs <> ['768p']) and not reason
union all select c_custkey, 'reference-media' from f where refs > 0 and not (allow and reason)""")
def budget_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    usual, other = (F.lit(m) for m in ("minimax/minimax-h3-max", "other/model"))
    limits = load(spark, sf_dir, "customer").select(
        "c_custkey", F.when(nation % 5 != 0, (nation % 9).cast("double")).alias("per_request"), F.when(key % 3 == 0, F.col("c_acctbal")).alias("total"), F.lit(3).alias("most"),
        F.when(nation % 3 == 1, F.array(usual)).when(nation % 3 == 2, F.array(other, usual)).alias("models"), F.when(key % 7 == 0, F.array(F.lit("1080p"))).alias("resolutions"),
        F.when(key % 4 == 0, F.col("c_mktsegment")).otherwise(" ").alias("change_reason"), (key % 11 == 0).alias("allow_reference_media"), (key % 8).cast("double").alias("seconds"),
        F.when(key % 5 == 0, other).otherwise(usual).alias("model"), F.lit("768p").alias("resolution"), (key % 13).cast("double").alias("used"), (key % 2).alias("reference_media"))
    return ledger.limit_problems(limits, ["c_custkey"])
