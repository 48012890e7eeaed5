"""Contracts of manifests, previews, repairs and scenes as named rules over nested columns.

Every function gives {rule: predicate}; ``rules.violations`` turns them into rows. Array predicates stay in the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Fields that a compile spec must not carry.
FORBIDDEN = ("apiKey", "certified", "quality", "token")


def increasing(values: Column) -> Column:
    """Strictly, and without null."""
    steps = F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), lambda a, b: a < b)
    return F.when(F.size(values) < 2, F.forall(values, lambda v: v.isNotNull())).otherwise(F.coalesce(F.forall(steps, lambda s: F.coalesce(s, F.lit(False))), F.lit(False)))


def anchors(directions: Column, count: Column) -> dict[str, Column]:
    return {
        "anchors-eight": F.size(directions) == 8,
        "anchors-first": F.get(directions, F.lit(0)) == 0,
        "anchors-increasing": increasing(directions),
        "anchors-range": F.forall(directions, lambda a: (a >= 0) & (a < count)),
    }


def phases(samples: Column, directions: Column) -> dict[str, Column]:
    """Samples are array<struct<frame, deg>>: eight at least, from (0, 0), both rising, below 360, every anchor among them at its 45 degrees."""
    frames, degrees = F.transform(samples, lambda s: s["frame"].cast("double")), F.transform(samples, lambda s: s["deg"].cast("double"))
    expected = F.transform(directions, lambda d, i: F.struct(d.cast("double").alias("frame"), (i * 45).cast("double").alias("deg")))
    pairs = F.transform(samples, lambda s: F.struct(s["frame"].cast("double").alias("frame"), s["deg"].cast("double").alias("deg")))
    return {
        "phases-count": F.size(samples) >= 8,
        "phases-start": (F.get(frames, F.lit(0)) == 0) & (F.get(degrees, F.lit(0)) == 0),
        "phases-increasing": increasing(frames) & increasing(degrees),
        "phases-finite": F.forall(degrees, lambda d: ~F.isnan(d) & (d < 360)),
        "phases-anchors": F.size(F.array_except(expected, pairs)) == 0,
    }


def preview(mode: Column, samples: Column, notes: Column, certified: Column, count: Column | None = None) -> dict[str, Column]:
    """Samples are array<struct<deg, frame>>. A phase spans exactly 0 to 360, an arc less than a turn; both begin within the first turn and have
    two samples at least, with rising frames (below ``count`` if given); none carries a certificate."""
    degrees = F.transform(samples, lambda s: s["deg"].cast("double"))
    frames = F.transform(samples, lambda s: s["frame"].cast("double"))
    first, last = F.get(degrees, F.lit(0)), F.try_element_at(degrees, F.lit(-1))
    within = F.forall(frames, lambda f: (f >= 0) & (f < count)) if count is not None else F.forall(frames, lambda f: f >= 0)
    return {
        "preview-mode": mode.isin("phase", "arc"),
        "preview-count": F.size(samples) >= 2,
        "preview-increasing": increasing(degrees) & increasing(frames) & F.forall(degrees, lambda d: ~F.isnan(d)),
        "preview-frames": within,
        "preview-start": (first >= 0) & (first < 360),
        "preview-span": F.when(mode == "phase", (first == 0) & (last == 360)).otherwise((last - first > 0) & (last - first < 360)),
        "preview-notes": F.trim(notes) != "",
        "preview-uncertified": ~certified,
    }


def selection(indices: Column, most: int = 12) -> dict[str, Column]:
    """A handful of frame indices: 1 to ``most``, each once."""
    return {"selection-size": F.size(indices).between(1, most), "selection-unique": F.size(F.array_distinct(indices)) == F.size(indices)}


def trims(keep: Column, directions: Column) -> dict[str, Column]:
    """Kept frames rise, hold frame 0 and every anchor."""
    return {
        "keep-increasing": increasing(keep),
        "keep-first": F.array_contains(keep, 0),
        "keep-anchors": F.size(F.array_except(directions, keep)) == 0,
    }


def bridges(count: Column, gap: Column) -> dict[str, Column]:
    return {"bridge-count": count.between(1, 8), "bridge-gap": (gap > 0) & (gap <= 30)}


def spec_fields(keys: Column, allowed: Sequence[str]) -> dict[str, Column]:
    """No forbidden and no unknown keys."""
    return {
        "fields-forbidden": ~F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN])),
        "fields-unknown": F.size(F.array_except(keys, F.array(*[F.lit(k) for k in (*allowed, *FORBIDDEN)]))) == 0,
    }


def sheets(names: Column, count: Column, per_sheet: Column) -> dict[str, Column]:
    return {"sheets-count": F.size(names) == F.ceil(count / per_sheet), "sheets-unique": F.size(F.array_distinct(names)) == F.size(names)}


def background(owner: Column, mode: Column, clean: Column, contact: Column) -> dict[str, Column]:
    """A page needs a clean plate and a contact sheet."""
    return {"background-page": (owner != "page") | (clean.isNotNull() & contact.isNotNull()), "background-mode": mode.isNotNull()}


def plate_problems(manifests: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """(key, problem) of page-owned backgrounds: manifests (key, owner, plate, plate_sha256, width, height, contact) against ``assets`` (path, sha256, width, height)."""
    at = assets.select(F.col("path").alias("plate"), F.col("sha256").alias("__sha"), F.col("width").alias("__w"), F.col("height").alias("__h"))
    pages = manifests.where("owner = 'page'").join(at, "plate", "left").join(assets.select(F.col("path").alias("contact"), F.lit(True).alias("__contact")), "contact", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    problems = F.array_compact(F.array(
        F.when(F.col("__sha").isNull(), "plate-missing").when(~same("__sha", "plate_sha256"), "plate-changed").when(~(same("__w", "width") & same("__h", "height")), "plate-size"),
        F.when(F.col("__contact").isNull(), "contact-missing")))
    return pages.select(key, F.explode(problems).alias("problem"))


#: Owners of a background and the modes each may have.
MODES_OF = {"page": ("preserve", "chroma-key"), "scene": ("preserve", "replace-edge-light", "fit-edge-light")}


def background_pair(owner: Column, mode: Column, key: Column, report_passed: Column) -> dict[str, Column]:
    """Owner and mode go together; keying needs a colour and a report that passed."""
    allowed = F.create_map(*[x for o, modes in MODES_OF.items() for x in (F.lit(o), F.array(*[F.lit(m) for m in modes]))])
    return {
        "background-owner": owner.isin(*MODES_OF),
        "background-pair": F.array_contains(F.try_element_at(allowed, owner), mode),
        "background-key": (mode != "chroma-key") | (F.coalesce(key != "", F.lit(False)) & F.coalesce(report_passed, F.lit(False))),
    }


def seam(sources: Column, frames: Column) -> dict[str, Column]:
    """An upper seam comes from one source at both ends and runs backwards in it."""
    return {"seam-source": F.get(sources, F.lit(0)) == F.element_at(sources, -1), "seam-order": F.get(frames, F.lit(0)) > F.element_at(frames, -1)}


def provenance_range(origins: DataFrame, counts: DataFrame, source: str, frame: str) -> DataFrame:
    """Provenance rows beyond their source: unknown source, or not 0 <= frame < decoded count."""
    joined = origins.join(counts, source, "left")
    return joined.where(F.coalesce(~((F.col(frame) >= 0) & (F.col(frame) < F.col("frame_count"))), F.lit(True)))


def scene_layers(layers: DataFrame, key: str) -> DataFrame:
    """(key, rule) of layered scenes (z, kind, id, x, y, w, h, width, height): underlays below subjects, a subject at least, sound ids, rectangles inside."""
    from framequill.functions.text import is_layer_id
    from framequill.operators.rules import rectangle_inside, violations

    c = F.col
    rows = violations(layers, [key], {
        "layer-id": is_layer_id(c("id")), "layer-kind": c("kind").isin("underlay", "subject"),
        "layer-rect": rectangle_inside(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))})
    scenes = layers.groupBy(key).agg(
        F.max(F.when(c("kind") == "underlay", c("z"))).alias("top"), F.min(F.when(c("kind") == "subject", c("z"))).alias("low"), F.count_if(c("kind") == "subject").alias("subjects"),
        (F.count_distinct("id") == F.count(F.lit(1))).alias("unique"))
    return rows.distinct().unionByName(violations(scenes, [key], {"scene-subject": c("subjects") > 0, "scene-order": c("top").isNull() | (c("top") < c("low")), "scene-unique": c("unique")}))
