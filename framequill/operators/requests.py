"""Requests for generated media: inventory, limits, requirements, prompts and audit views, all as projections and small joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from framequill.functions.text import masked

#: Most media of each role, the most references of all together, and the most seconds of timed roles.
ROLE_LIMITS = {"image": 9, "video": 3, "audio": 3}
MOST_MEDIA, MOST_SECONDS = 12, 15.001
#: Types that a medium of each kind may have, and the most bytes of one.
TYPES = {"image": ("image/jpeg", "image/png", "image/webp", "image/heif", "image/heic"), "video": ("video/mp4", "video/quicktime"),
         "audio": ("audio/wav", "audio/x-wav", "audio/vnd.wave", "audio/mpeg", "audio/mp3")}
MOST_BYTES = {"image": 30 << 20, "video": 50 << 20, "audio": 15 << 20}
#: Limits of one medium.
SIDES, RATIOS, SECONDS, RATES = (256, 5760), (0.4, 2.5), (2.0, 15.0), (23.975, 60.0)
#: Controls that need no medium; what a plan must state; what a reviewer must look at, and the states that let a request pass.
CONSTANT_CONTROLS = ("prompt", "compositing", "runtime", "not-requested")
REQUIREMENTS = ("identity", "motion", "range", "gaze", "fixedParts", "loop", "rest")
CHECKS = ("subjectIsolation", "identity", "inputPose", "motionRange", "featureVisibility", "framing", "fixedParts", "promptImageAgreement", "endpointCompatibility", "motionReference")
STATES = ("pass", "limited", "not-applicable")


def role_index(df: DataFrame, key: Sequence[str], role: str, position: str) -> DataFrame:
    """Adds ``role_index``: the how-manieth of its role a row is, from 0."""
    return df.withColumn("role_index", (F.row_number().over(Window.partitionBy(*key, role).orderBy(position)) - 1).cast("long"))


def inventory(media: DataFrame, key: Sequence[str], role: str, seconds: str, limits: dict[str, int] = ROLE_LIMITS) -> DataFrame:
    """(key, role, n, seconds, within) for each role of a request."""
    allowed = F.create_map(*[x for r, n in limits.items() for x in (F.lit(r), F.lit(n))])
    found = media.groupBy(*key, role).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"))
    return found.withColumn("within", F.coalesce(F.col("n") <= F.try_element_at(allowed, F.col(role)), F.lit(False)) & (F.col("seconds") <= MOST_SECONDS))


def medium_rules(width: Column, height: Column, seconds: Column, rate: Column) -> dict[str, Column]:
    """Limits of one medium by name; null figures of untimed media pass."""
    between = lambda c, limits: c.between(*limits)
    return {
        "side": between(F.least(width, height), SIDES) & between(F.greatest(width, height), SIDES),
        "ratio": between(width / height, RATIOS),
        "seconds": seconds.isNull() | between(seconds, SECONDS),
        "rate": rate.isNull() | between(rate, RATES),
    }


def file_rules(kind: Column, mime: Column, size: Column) -> dict[str, Column]:
    """A medium's declared type and bytes against its kind: image, video or audio."""
    table = lambda d, lit: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), lit(v))])
    types = table(TYPES, lambda v: F.array(*[F.lit(t) for t in v]))
    return {
        "mime": F.array_contains(F.try_element_at(types, kind), F.lower(mime)),
        "bytes": size <= F.try_element_at(table(MOST_BYTES, lambda v: F.lit(v).cast("long")), kind),
    }


def request_rules(found: DataFrame, key: Sequence[str], role: str = "role") -> DataFrame:
    """(key, rule) of whole requests from their ``inventory``: at most MOST_MEDIA references together, no sound without a picture."""
    from framequill.operators.rules import violations

    n = lambda *roles: F.coalesce(F.sum(F.when(F.col(role).isin(*roles), F.col("n"))), F.lit(0))
    whole = found.groupBy(*key).agg(F.sum("n").alias("media"), n("audio").alias("audio"), n("image", "video").alias("seen"), F.bool_and("within").alias("within"))
    return violations(whole, key, {"media-total": F.col("media") <= MOST_MEDIA, "media-roles": F.col("within"), "audio-alone": (F.col("audio") == 0) | (F.col("seen") > 0)})


def requirement_gaps(requirements: DataFrame, key: str, controls: str, media: DataFrame, role: str) -> DataFrame:
    """(key, control): required controls that are neither constant nor a role the request has media of."""
    asked = requirements.select(key, F.explode(F.array_distinct(F.array_except(F.col(controls), F.array(*[F.lit(c) for c in CONSTANT_CONTROLS])))).alias("control"))
    return asked.join(media.select(key, F.col(role).alias("control")).distinct(), [key, "control"], "left_anti")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def requirement_problems(plans: DataFrame, key: str, requirements: str, media: DataFrame, role: str) -> DataFrame:
    """(key, name, rule, detail) of what is wrong with plans' ``requirements``, map<name, struct<expected, verify, controls array>>.

    ``missing`` and ``unknown`` names; ``expected`` and ``verify`` without text; no ``controls``; an ``unavailable`` control; and, as a warning
    that refuses nothing, ``text-only`` where the prompt is the one control.
    """
    held = F.coalesce(F.map_keys(requirements), F.array().cast("array<string>"))
    known = F.array(*[F.lit(r) for r in REQUIREMENTS])
    names = plans.select(key, F.explode(F.concat(
        F.transform(F.array_except(known, held), lambda n: F.struct(n.alias("name"), F.lit("missing").alias("rule"))),
        F.transform(F.array_except(held, known), lambda n: F.struct(n.alias("name"), F.lit("unknown").alias("rule"))))).alias("p")).select(key, "p.*", F.lit(None).cast("string").alias("detail"))
    each = plans.select(key, F.explode(requirements).alias("name", "r")).where(F.col("name").isin(*REQUIREMENTS)).select(key, "name", "r.*")
    controls = F.coalesce(F.col("controls"), F.array().cast("array<string>"))
    rule = F.array_compact(F.array(
        F.when(blank(F.col("expected")), "expected"), F.when(blank(F.col("verify")), "verify"), F.when(F.size(controls) == 0, "controls"),
        F.when(F.coalesce(controls == F.array(F.lit("prompt")), F.lit(False)), "text-only")))
    own = each.select(key, "name", F.explode(rule).alias("rule"), F.lit(None).cast("string").alias("detail"))
    gaps = each.select(key, "name", F.explode(F.array_distinct(F.array_except(controls, F.array(*[F.lit(c) for c in CONSTANT_CONTROLS])))).alias("detail"))
    gaps = gaps.join(media.select(key, F.col(role).alias("detail")).distinct(), [key, "detail"], "left_anti").select(key, "name", F.lit("unavailable").alias("rule"), "detail")
    return names.unionByName(own).unionByName(gaps)


def content(roles: DataFrame, key: str, role: str, value: str, order: Sequence[str]) -> DataFrame:
    """(key, content): media in the fixed order of their roles, then by position, as one array."""
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col(role))
    held = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("position"), F.col(value).alias("value"))))
    return roles.groupBy(key).agg(F.transform(held, lambda x: x["value"]).alias("content"))


def prompt(kind: Column, subject: Column, checkpoints: Column, seconds: Column) -> Column:
    """Deterministic text of a motion plan; checkpoints are (fraction, pose)."""
    from framequill.functions.text import short_number

    legs = F.transform(checkpoints, lambda c: F.concat(F.lit("At "), short_number(c["fraction"] * seconds), F.lit(" s: "), c["pose"], F.lit(".")))
    opening = (F.when(kind == "ring", F.lit("One continuous turn through all directions"))
               .when(kind == "arc", F.lit("One continuous turn between two directions")).otherwise(F.lit("One continuous motion")))
    return F.concat_ws(" ", F.concat(subject, F.lit("."), ), F.concat(opening, F.lit(", "), short_number(seconds), F.lit(" s.")), F.array_join(legs, " "))


def audit_view(df: DataFrame, keep: Sequence[str], text: str, payload: str) -> DataFrame:
    """What may be logged: safe columns, the text without addresses and media, the payload as its hash and size."""
    return df.select(*keep, masked(F.col(text)).alias("text"), F.sha2(F.col(payload).cast("binary"), 256).alias("payload_sha256"), F.octet_length(payload).alias("payload_bytes"))


def template(subjects: DataFrame, key: str, checks: Sequence[str]) -> DataFrame:
    """Every check of every subject, unreviewed."""
    return subjects.select(key, F.explode(F.array(*[F.lit(c) for c in checks])).alias("check")).withColumn("status", F.lit("unreviewed"))


def review_outcome(reviews: DataFrame, key: str, must_pass: str, checks: Sequence[str] | None = None) -> DataFrame:
    """(key, checks, passed, limited, accepted): limited is surfaced, never counted as a pass.

    A review is accepted if each of its checks has one of ``STATES`` and, where the column ``notes`` is there, an observation, if ``must_pass``
    is a pass, and if all of ``checks`` are among them.
    """
    state = F.col("status")
    noted = ~blank(F.col("notes")) if "notes" in reviews.columns else F.lit(True)
    found = reviews.groupBy(key).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(state == "pass").alias("passed"), F.count_if(state == "limited").alias("limited"),
        F.bool_and(F.coalesce(state.isin(*STATES), F.lit(False)) & noted).alias("sound"), F.collect_set("check").alias("seen"),
        F.coalesce(F.bool_and(F.when(F.col("check") == must_pass, state == "pass")), F.lit(False)).alias("must"))
    whole = F.size(F.array_except(F.array(*[F.lit(c) for c in checks]), "seen")) == 0 if checks else F.lit(True)
    return found.withColumn("accepted", F.col("must") & F.col("sound") & whole).drop("must", "sound", "seen")


def binding_problem(bound: dict[str, tuple[Column, Column]]) -> Column:
    """The first name whose recorded value isn't the one at hand, null if all are; nulls never agree."""
    return F.coalesce(*[F.when(F.coalesce(a != b, F.lit(True)), F.lit(name)) for name, (a, b) in bound.items()])


def review_decision(reviews: DataFrame, bindings: DataFrame, key: str) -> DataFrame:
    """(key, stale, passed, limited, accepted): the ten checks of a review, which counts only for the request, plan, identity and media it was made for.

    ``bindings`` has for each key what the review recorded and what is there now: request and request_now, plan and plan_now, identity and
    identity_now, media and media_now. A request without a review is not accepted.
    """
    stale = binding_problem({n: (F.col(n), F.col(f"{n}_now")) for n in ("request", "plan", "identity", "media")})
    found = review_outcome(reviews, key, "subjectIsolation", CHECKS)
    joined = bindings.select(key, stale.alias("stale")).join(found, key, "left")
    return joined.select(key, "stale", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("limited", F.lit(0)).alias("limited"),
                         (F.col("stale").isNull() & F.coalesce("accepted", F.lit(False))).alias("accepted"))


def single_match(df: DataFrame, candidates: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that have exactly one candidate, with it."""
    alone = candidates.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*on))).where("__n = 1").drop("__n")
    return df.join(alone, list(on))


def bound_match(df: DataFrame, candidates: DataFrame, on: Sequence[str], sha: str, sources: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Rows of ``single_match`` whose candidate's file is among the approved ``sources`` (owner..., sha256) of the row."""
    return single_match(df, candidates, on).join(sources.select(*owner, F.col("sha256").alias(sha)).distinct(), [*owner, sha], "left_semi")


def repeated(df: DataFrame, key: Sequence[str], fingerprint: str, order: str) -> DataFrame:
    """Requests whose fingerprint an earlier one of the key had."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*key, fingerprint).orderBy(order))).where("__nth > 1").drop("__nth")
