"""Rules as named predicates; a violation is a row.

``violations`` evaluates any number of rules in one pass over a table. A rule that comes out null counts as violated:
unknown is never a pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framequill.session import spool


def violations(df: DataFrame, key: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule a row breaks."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def status(subjects: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, issues, status, circular) of each subject from its violations (key, rule)."""
    issues = found.groupBy(*key).agg(F.sort_array(F.collect_set("rule")).alias("issues"))
    joined = subjects.select(*key).join(issues, list(key), "left").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    return joined.withColumn("circular", F.size("issues") == 0).withColumn("status", F.when(F.size("issues") == 0, "reviewed").otherwise("blocked"))


def current(events: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The state after the last event of each subject: approval stands until a later recheck fails or errs."""
    state = F.when(F.col("outcome") == "pass", "approved").otherwise("revoked")
    last = events.groupBy(*key).agg(F.max_by("outcome", seq).alias("outcome"), F.max(seq).alias("seq"), F.count(F.lit(1)).alias("rechecks"))
    return last.withColumn("state", state)


def uncovered(required: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    """Required rows without a match: left anti."""
    return required.join(available, list(on), "left_anti")


def resolved(entries: DataFrame, on: Sequence[str], status: str, evidence: str, notes: str) -> DataFrame:
    """(on...) of entries that resolve something: passed, with evidence and a note on it."""
    sound = (F.col(status) == "pass") & (F.size(evidence) > 0) & (F.trim(F.col(notes)) != "")
    return entries.where(F.coalesce(sound, F.lit(False))).select(*on).distinct()


def rectangle_inside(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def point_inside(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Half-open."""
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def overlapping(rects: DataFrame, group: Sequence[str], cell: int, block: int = 512, pairs: int = 1 << 22) -> DataFrame:
    """Pairs (group, a, b) of rectangles (id, x, y, w, h) of a group that overlap.

    Rectangles are dealt to the grid cells they touch, an equi join finds the pairs in a cell, and the cell of the
    overlap's own corner reports a pair once; far apart rectangles never meet. A cell's rectangles are cut into blocks of about ``block``,
    and each two blocks meet under a key of their own, so no task holds a full cell against itself; there is a task for about
    every ``pairs`` that are looked at, however few bytes they come from.
    """
    span = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size) - 1) / cell))
    spot = [*group, "cx", "cy"]
    placed = rects.where("id is not null").select(*group, "id", "x", "y", "w", "h").withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    held = placed.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block)
    placed = spool(placed.join(held, spot).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "rectangles")
    spark = rects.sparkSession
    looked_at = placed.agg(F.sum(F.col("n") * (F.col("blocks") + 1) / (2 * F.col("blocks")))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(looked_at // pairs) + 1, 1 << 14))
    one = placed.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    two = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block")))).withColumn("j", F.col("block"))
    on = [*spot, "i", "j"]
    a, b = (t.select(*on, *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y", "w", "h")]).repartition(tasks, *on) for s, t in (("a", one), ("b", two)))
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    both = a.join(b, on).where(
        ((F.col("i") < F.col("j")) | (F.col("a_id") < F.col("b_id"))) & (left < F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")))
        & (top < F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h"))) & (F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy")))
    return both.select(*group, F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def nearest(value: Column, choices: Sequence[tuple[str, float]]) -> Column:
    """Name of the choice nearest to a value; ties go to the one declared first."""
    rows = F.array(*[F.struct(F.abs(value - F.lit(float(v))).alias("gap"), F.lit(i).alias("ord"), F.lit(n).alias("name")) for i, (n, v) in enumerate(choices)])
    return F.array_min(rows)["name"]


def grade(ring_covered: Column, arc_width: Column, continuous: Column) -> Column:
    """What a candidate may serve as: unknown coverage is never more than playback."""
    return (F.when(F.coalesce(ring_covered == 8, F.lit(False)), "diagnostic").when(F.coalesce(arc_width >= 45, F.lit(False)), "arc")
            .when(F.coalesce(continuous, F.lit(False)), "phase").otherwise("playback"))


def follows(mode: Column, degrees: Column, start: Column, end: Column) -> Column:
    """Whether a candidate may follow a direction: a ring any, an arc those of its accepted interval, a phase or anything else none."""
    at = F.pmod(degrees - start, F.lit(360.0))
    return F.coalesce(F.when(mode == "ring", F.lit(True)).when(mode == "arc", at <= end - start), F.lit(False))


def observation_problems(seen: DataFrame, anchors: DataFrame, key: Sequence[str], evidence: str = "evidence") -> DataFrame:
    """(key, ord, problem) of reviews' observations (key, ord, frame, head, gaze, evidence) against ``anchors`` (key, ord, frame, direction).

    A review needs exactly as many observations as it has anchors, else its one problem is ``count``; then frame, head and gaze of each must
    be the anchor's frame and direction, with evidence.
    """
    held = seen.select(*key, "ord", F.col("frame").alias("__frame"), "head", "gaze", F.col(evidence).alias("__evidence"))
    sizes = anchors.groupBy(*key).agg(F.count(F.lit(1)).alias("__want")).join(held.groupBy(*key).agg(F.count(F.lit(1)).alias("__have")), list(key), "left")
    sizes = sizes.withColumn("__whole", F.col("__want").eqNullSafe(F.col("__have")))
    count = sizes.where("not __whole").select(*key, F.lit(None).cast("long").alias("ord"), F.lit("count").alias("problem"))
    pairs = anchors.join(sizes.where("__whole").select(*key), list(key), "left_semi").join(held, [*key, "ord"], "left")
    ok = lambda a, b: F.coalesce(a == b, F.lit(False))
    problem = (F.when(~ok(F.col("__frame"), F.col("frame")), "frame").when(~ok(F.col("head"), F.col("direction")), "head").when(~ok(F.col("gaze"), F.col("direction")), "gaze")
               .when(~F.coalesce(F.col("__evidence"), F.lit(False)), "evidence"))
    return count.unionByName(pairs.select(*key, F.col("ord").cast("long").alias("ord"), problem.alias("problem")).where("problem is not null"))
