"""Motion plans: intended checkpoints, their text, and the contract of each kind of plan, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The directions of a full turn, clockwise from up, and back to up.
CYCLE = ("up", "upper-right", "right", "lower-right", "down", "lower-left", "left", "upper-left", "up")
#: Kinds of plans, and the kinds that move clockwise on the screen.
KINDS = ("closed-orbit", "entry-orbit", "upper-arc", "diagnostic", "reference-motion", "segment")
SCREEN = ("closed-orbit", "entry-orbit", "upper-arc")
#: Where an entry ends and the cycle ends, as shares of the whole, unless given.
ENTRY_END, CYCLE_END = 0.12, 0.88
#: Fixed value: most characters of a prompt.
MOST_PROMPT = 7000

POINT = "array<struct<fraction:double,direction:string>>"


def _points(pairs) -> Column:
    return F.array(*[F.struct(f.alias("fraction"), d.alias("direction")) for f, d in pairs]).cast(POINT)


def checkpoints(kind: Column, start: Column, via: Column, end: Column, entry_end: Column, cycle_end: Column) -> Column:
    """Intended (fraction, direction) points of a plan; empty for kinds without a path. Fractions are pacing, not frames."""
    whole = _points((F.lit(i / 8), F.lit(d)) for i, d in enumerate(CYCLE))
    a, b = F.coalesce(entry_end, F.lit(ENTRY_END)), F.coalesce(cycle_end, F.lit(CYCLE_END))
    inner = _points((a + (b - a) * F.lit(i) / 8, F.lit(d)) for i, d in enumerate(CYCLE))
    neutral = lambda at: _points([(F.lit(float(at)), F.lit("neutral"))])
    entry = F.concat(neutral(0), inner, F.when(b < 1, neutral(1)).otherwise(F.array().cast(POINT)))
    return (F.when(kind == "closed-orbit", whole).when(kind == "entry-orbit", entry)
            .when(kind == "upper-arc", _points([(F.lit(0.0), F.lit("upper-left")), (F.lit(0.5), F.lit("up")), (F.lit(1.0), F.lit("upper-right"))]))
            .when(kind == "segment", _points([(F.lit(0.0), start), (F.lit(0.5), via), (F.lit(1.0), end)]))
            .when(kind.isin("reference-motion", "diagnostic"), F.array().cast(POINT)))


def timing_problem(kind: Column, entry_end: Column, cycle_end: Column) -> Column:
    """Whether a plan's timing contradicts it: only an entry has one, and its ends rise within 0 < entry < cycle <= 1."""
    a, b = F.coalesce(entry_end, F.lit(ENTRY_END)), F.coalesce(cycle_end, F.lit(CYCLE_END))
    given = entry_end.isNotNull() | cycle_end.isNotNull()
    return F.when(given & (kind != "entry-orbit"), "timing-kind").when((kind == "entry-orbit") & ~F.coalesce((a > 0) & (a < b) & (b <= 1), F.lit(False)), "timing-order")


#: The sentences of an assembled prompt, by what they are for; {} is filled in. A caller may give others.
WORDING = {
    "opening": "A single unbroken shot from a fixed camera; only {} moves.", "start": "At the start: {}.", "motion": "Permitted movement: {}. Frame: {}.", "context": "Everything else in view keeps still: {}.",
    "path": "The way of the movement: {}. The marks are approximate and passed without a stop.", "reference": "{} Take over the movement shown, not who shows it.", "requirement": "{}: {}.",
    "scene-preserve": "Background: the given scene and light stay as they are. {}", "alpha-matte": "Background: borders between figure and background stay clean for cutting out. {}",
    "chroma-key": "Background: the even {} screen stays even. {}", "end": "At the end: {}.", "closed-orbit": "One whole turn, from the first pose back to it.", "entry-orbit": "The entry from rest is not part of the turn.",
    "upper-arc": "One sweep over the top, and no way back.", "segment": "This stretch only, in one go.",
}


def assembled(spec: Column, points: Column, wording: dict[str, str] = WORDING) -> Column:
    """struct(prompt, included, not_sent, problem) of a plan: its sentences in order, one a line.

    ``spec`` has kind, subject, start_pose, end_pose, allowed_motion, framing, background struct<mode, description, key_color>,
    static_context, reference_roles, entry_end, cycle_end and requirements, an array of struct<name, expected, controls> in the plan's order.
    Requirements that the prompt is to control are included, the others named as not sent. A text that is blank or holds an unfinished
    placeholder, a key colour that isn't #rrggbb or stands beside another mode, a mode or a timing that is none: the prompt is null and ``problem`` says why.
    """
    from framequill.functions.text import is_prose

    def say(name: str, *values: Column) -> Column:
        parts = wording[name].split("{}")
        return F.concat(*[c for i, p in enumerate(parts) for c in ([F.trim(values[i - 1])] if i else []) + [F.lit(p)]])

    kind, ground = spec["kind"], spec["background"]
    asked = F.coalesce(spec["requirements"], F.array().cast("array<struct<name:string,expected:string,controls:array<string>>>"))
    sent = F.filter(asked, lambda r: F.array_contains(r["controls"], "prompt"))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    mode, colour = ground["mode"], ground["key_color"]
    problem = F.coalesce(
        *[F.when(~F.coalesce(is_prose(spec[f]), F.lit(False)), f) for f in ("subject", "start_pose", "end_pose", "allowed_motion", "framing")],
        F.when(~F.coalesce(mode.isin("scene-preserve", "chroma-key", "alpha-matte"), F.lit(False)), "background-mode"),
        F.when(~F.coalesce(is_prose(ground["description"]), F.lit(False)), "background-description"),
        F.when(F.coalesce(mode == "chroma-key", F.lit(False)) != F.coalesce(colour.rlike("^#[0-9a-fA-F]{6}$"), F.lit(False)), "key-color"),
        F.when((mode != "chroma-key") & colour.isNotNull(), "key-color"),
        F.when(has(spec["static_context"]) & ~is_prose(spec["static_context"]), "static_context"),
        F.when((kind == "reference-motion") & ~F.coalesce(is_prose(spec["reference_roles"]), F.lit(False)), "reference_roles"),
        F.when(F.size(F.filter(asked, lambda r: r["controls"].isNull())) > 0, "controls"),
        F.when(F.size(F.filter(sent, lambda r: ~F.coalesce(is_prose(r["expected"]), F.lit(False)))) > 0, "expected"),
        F.when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind"), timing_problem(kind, spec["entry_end"], spec["cycle_end"]))
    lines = F.concat(
        F.array(say("opening", spec["subject"]), say("start", spec["start_pose"]), say("motion", spec["allowed_motion"], spec["framing"]),
                F.when(has(spec["static_context"]), say("context", spec["static_context"])),
                F.when(kind == "reference-motion", say("reference", spec["reference_roles"])).when(F.size(points) > 0, say("path", path_text(points))),
                *[F.when(kind == k, F.lit(wording[k])) for k in ("closed-orbit", "entry-orbit", "upper-arc", "segment")]),
        F.transform(sent, lambda r: say("requirement", r["name"], r["expected"])),
        F.array(F.when(mode == "chroma-key", say("chroma-key", colour, ground["description"])).when(mode == "alpha-matte", say("alpha-matte", ground["description"])).otherwise(say("scene-preserve", ground["description"])),
                say("end", spec["end_pose"])))
    names = lambda rows: F.transform(rows, lambda r: r["name"])
    return F.struct(F.when(problem.isNull(), F.array_join(F.array_compact(lines), "\n")).alias("prompt"), names(sent).alias("included"),
                    names(F.filter(asked, lambda r: ~F.coalesce(F.array_contains(r["controls"], "prompt"), F.lit(False)))).alias("not_sent"), problem.alias("problem"))


def path_text(points: Column) -> Column:
    """"0% up -> 12.5% upper-right -> ..."; percentages to six digits without trailing zeros."""
    from framequill.functions.text import short_number

    digits = lambda f: F.when(f * 100 >= 10, F.round(f * 100, 4)).otherwise(F.round(f * 100, 5))
    return F.array_join(F.transform(points, lambda p: F.concat(short_number(digits(p["fraction"])), F.lit("% "), p["direction"])), " -> ")


def _said(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def plan_contract(p: Column, roles: Column) -> dict[str, Column]:
    """Rules of a plan struct and its map of content roles to addresses.

    The struct has kind, subjects, coordinate_system, path, seam_direction, seam_verified, first_pose, cycle_start, cycle_end, exclude_entry,
    start_direction, end_direction, via, assembly, reference_roles, evidence, duration_reason, duration and frames.
    """
    kind, has = p["kind"], lambda role: F.coalesce(F.map_contains_key(roles, role), F.lit(False))
    only = lambda of, rule: ~kind.isin(*of) | F.coalesce(rule, F.lit(False))
    first, last = F.try_element_at(roles, F.lit("first_frame")), F.try_element_at(roles, F.lit("last_frame"))
    return {
        "plan-kind": kind.isin(*KINDS),
        "plan-subject": (F.size(p["subjects"]) == 1) & _said(F.get(p["subjects"], F.lit(0))),
        "plan-duration": p["duration"].isNotNull() | p["frames"].isNotNull(),
        "plan-screen": only(SCREEN, (p["coordinate_system"] == "screen") & (p["path"] == "clockwise")),
        "plan-first-frame": only(SCREEN, has("first_frame")),
        "orbit-seam": only(["closed-orbit"], (p["seam_direction"] == "up") & p["seam_verified"]),
        "orbit-same-ends": only(["closed-orbit"], first == last),
        "entry-cycle": only(["entry-orbit"], (p["first_pose"] == "neutral") & (p["cycle_start"] == "up") & (p["cycle_end"] == "up") & p["exclude_entry"]),
        "arc-ends": only(["upper-arc"], has("last_frame") & (p["start_direction"] == "upper-left") & (p["end_direction"] == "upper-right")),
        "reference-video": only(["reference-motion"], has("reference_video") & ~has("first_frame") & ~has("last_frame")),
        "reference-roles": only(["reference-motion"], _said(p["reference_roles"])),
        "segment-frames": only(["segment"], has("first_frame") & has("last_frame")),
        "segment-route": only(["segment"], _said(p["start_direction"]) & _said(p["end_direction"]) & _said(p["via"]) & _said(p["assembly"])),
        "plan-evidence": _said(p["evidence"]),
        "plan-reason": _said(p["duration_reason"]),
    }


def content_contract(prompt: Column, first: Column, last: Column, loop: Column, references: Column) -> dict[str, Column]:
    """Rules of a request's content: prompt length, loop or last frame, frames or references."""
    framed = first.isNotNull() | last.isNotNull()
    return {
        "prompt-length": F.char_length(prompt) <= MOST_PROMPT,
        "loop-needs-first": ~loop | first.isNotNull(),
        "loop-or-last": ~(loop & last.isNotNull()),
        "last-needs-first": last.isNull() | first.isNotNull(),
        "frames-or-references": ~(framed & (F.size(references) > 0)),
    }


def prompt_source(structured: Column, manual: Column) -> dict[str, Column]:
    """Either a structured prompt alone or exactly one manual field."""
    return {"prompt-source": (structured & (manual == 0)) | (~structured & (manual == 1))}


def option_contract(resolution: Column, resolutions: Column, duration: Column, least: Column, most: Column, expansion: Column, expands: Column) -> dict[str, Column]:
    """A request's options against its model's profile; a null profile breaks all."""
    from framequill.sources.frames import first_listed

    return {
        "resolution": first_listed(resolutions, resolution).isNotNull(),
        "duration": duration.between(least, most),
        "expansion": F.when(expands, F.coalesce(expansion.isin("disabled", "balanced", "quality"), F.lit(False))).otherwise(expands.isNotNull() & expansion.isNull()),
    }


#: What a request may choose of prompt expansion, and the one option that ``extra`` may hold.
EXPANSIONS, EXTRA = ("disabled", "balanced", "quality"), "prompt_expansion_mode"


def spec_options(document: Column, resolutions: Column, least: Column, most: Column, expands: Column) -> dict[str, Column]:
    """Option rules of a request as a JSON document, by the types that its fields really have: 5.0, "5" and true are no whole numbers.

    No frames; a duration that is a whole number within the profile's limits; a seed that is one or nothing; a resolution of the profile,
    whatever its case; ``extra`` an object with no key but the expansion, which must be chosen where the profile expands and be absent where it
    doesn't. What is no JSON breaks all rules.
    """
    held = F.try_parse_json(document)
    at = lambda path: F.try_variant_get(held, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(at(path)), F.lit("VOID"))
    number = lambda path: F.try_variant_get(held, path, "long")
    keys = F.json_object_keys(F.get_json_object(document, "$.extra"))
    mode = F.when(kind(f"$.extra.{EXTRA}") == "STRING", F.try_variant_get(held, f"$.extra.{EXTRA}", "string"))
    known = F.coalesce(F.array_contains(F.transform(resolutions, lambda r: F.lower(r)), F.lower(F.when(kind("$.resolution") == "STRING", F.try_variant_get(held, "$.resolution", "string")))), F.lit(False))
    there = held.isNotNull()
    return {
        "frames": there & (kind("$.frames") == "VOID"),
        "duration": there & (kind("$.duration") == "BIGINT") & F.coalesce(number("$.duration").between(least, most), F.lit(False)),
        "seed": there & kind("$.seed").isin("VOID", "BIGINT"),
        "resolution": there & known,
        "extra": there & (at("$.extra").isNull() | F.coalesce(kind("$.extra").startswith("OBJECT") & (F.size(F.array_except(keys, F.array(F.lit(EXTRA)))) == 0), F.lit(False))),
        "expansion": there & F.when(expands, F.coalesce(mode.isin(*EXPANSIONS), F.lit(False))).otherwise(F.coalesce(F.size(keys) == 0, F.lit(True))),
    }
