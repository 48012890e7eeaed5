"""An append-only budget ledger. Admission depends on order: what is refused consumes nothing, what is admitted is never refunded."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from framequill.session import ship

ship(__name__)


def refusal(seconds: float | None, allowed: bool, known: Callable[[], bool], count: int, used: float, most: int, total: float, per_request: float) -> str:
    """Why a request is not admitted to a budget that has admitted ``count`` with ``used`` seconds; empty if it is."""
    if seconds is None or not 0 < seconds < float("inf"):
        return "invalid"
    if not allowed:
        return "not-allowed"
    if seconds > per_request:
        return "per-request"
    if count >= most:
        return "count"
    if known():
        return "duplicate"
    return "total" if used + seconds > total else ""


def admitted(requests: DataFrame, key: str, order: Sequence[str], seconds: str, fingerprint: str, most: int, total: float, per_request: float, allowed: Column | None = None) -> DataFrame:
    """Each request with ``accepted``, ``reason`` and ``used`` seconds after it.

    Requests of a budget are sorted by Spark and folded in one pass; a task holds the state of one budget at a time, so neither a
    long ledger nor many budgets need memory beyond the admitted fingerprints (at most ``most``). ``allowed`` says whether a request keeps to
    the recorded models, resolutions and media; null counts as no.
    """
    slim = requests.select(F.col(key).cast("long").alias("key"), *[F.col(c) for c in order], F.col(seconds).cast("double").alias("seconds"), F.col(fingerprint).cast("string").alias("fingerprint"),
                           F.coalesce(allowed, F.lit(False)).alias("allowed") if allowed is not None else F.lit(True).alias("allowed"))
    schema = "key long, id long, seconds double, accepted boolean, reason string, used double"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, used, seen = None, 0, 0.0, set()
        for batch in batches:
            out = []
            for k, i, s, f, ok in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if k != now:
                    now, count, used, seen = k, 0, 0.0, set()
                reason = refusal(s, ok, lambda: f in seen, count, used, most, total, per_request)
                if not reason:
                    count, used = count + 1, used + s
                    seen.add(f)
                out.append((k, i, s, reason == "", reason, used))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.float64()))],
                                             ["key", "id", "seconds", "accepted", "reason", "used"])

    dealt = slim.repartition("key").sortWithinPartitions("key", *order).select("key", F.col(order[-1]).cast("long").alias("id"), "seconds", "fingerprint", "allowed")
    return dealt.mapInArrow(fold, schema)


#: Stages of an attempt.
STAGES = ("pilot", "repair", "segment", "expansion")


def stage_problems(ledger: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, seq, stage, problem) of attempts (stage, request, pilot_request) that their ledger does not allow.

    A pilot may only be the first attempt. An expansion names the request of exactly one earlier pilot: pilots are counted per request
    first, at most two of them with their places, so that a ledger with most of all attempts is no group of its own.
    """
    firsts = ledger.groupBy(key).agg(F.min(seq).alias("__first"))
    pilots = ledger.where("stage = 'pilot'").groupBy(key, F.col("request").alias("pilot_request")).agg(F.min(seq).alias("__one"), F.count(F.lit(1)).alias("__n"))
    later = (ledger.where("stage = 'pilot'").select(key, F.col("request").alias("pilot_request"), F.col(seq).alias("__at")).join(pilots.where("__n > 1"), [key, "pilot_request"])
             .where("__at > __one").groupBy(key, "pilot_request").agg(F.min("__at").alias("__two")))
    pilots = pilots.join(later, [key, "pilot_request"], "left").select(key, "pilot_request", "__one", "__two")
    single = F.coalesce(F.col("__one") < F.col(seq), F.lit(False)) & ~F.coalesce(F.col("__two") < F.col(seq), F.lit(False))
    problem = (F.when(~F.coalesce(F.col("stage").isin(*STAGES), F.lit(False)), "unknown-stage").when((F.col("stage") == "pilot") & (F.col(seq) > F.col("__first")), "pilot-not-first")
               .when((F.col("stage") == "expansion") & ~single, "no-single-pilot"))
    joined = ledger.join(firsts, key).join(pilots, [key, "pilot_request"], "left")
    return joined.withColumn("problem", problem).where("problem is not null").select(key, F.col(seq).alias("seq"), "stage", "problem")


#: Input policies of a repair.
POLICIES = ("source-frames", "reviewed-replacement")


def stage_evidence(attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, rule): what an attempt of each later stage must show and does not.

    Attempts have stage, scene_id, manifest_scene, manifest_ready, video_sha256 (of the recorded pilot's video), source_hashes (map of the
    approved manifest), source_exists, evidence_bytes, input_policy, change_reason, reviewed (an input review bound to the request),
    frames_match (inputs equal the declared source frames), first_frames and last_frames (numbers of such inputs).
    """
    from framequill.operators.rules import violations

    c = F.col
    said = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) != ""
    policy = F.coalesce(c("input_policy"), F.lit(POLICIES[0]))
    only = lambda stage, ok: (c("stage") != stage) | F.coalesce(ok, F.lit(False))
    return violations(attempts, key, {
        "stage": c("stage").isin(*STAGES),
        "expansion-manifest": only("expansion", c("manifest_ready")),
        "expansion-video": only("expansion", F.array_contains(F.map_values("source_hashes"), c("video_sha256"))),
        "expansion-scene": only("expansion", said("scene_id") & (c("scene_id") == c("manifest_scene"))),
        "repair-source": only("repair", c("source_exists")),
        "repair-evidence": only("repair", c("evidence_bytes") > 0),
        "repair-policy": only("repair", policy.isin(*POLICIES)),
        "repair-frames": only("repair", (policy != POLICIES[0]) | c("frames_match")),
        "repair-review": only("repair", (policy != POLICIES[1]) | (said("change_reason") & c("reviewed"))),
        "segment-source": only("segment", c("source_exists") & c("reviewed")),
        "segment-frames": only("segment", (c("first_frames") == 1) & (c("last_frames") >= 1) & c("frames_match")),
    })


#: Models, resolutions and seconds of a request for which no reason need be recorded.
USUAL_MODELS, USUAL_RESOLUTIONS, USUAL_SECONDS = ("minimax/minimax-h3-max",), ("768p",), 5


def limit_problems(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, rule) of budgets with a request: per_request, total, models and resolutions (null: the usual ones), most, change_reason,
    allow_reference_media; seconds, model, resolution, used seconds so far, and reference_media (a count)."""
    from framequill.operators.rules import violations

    c = F.col
    usual = lambda name, values: F.coalesce(c(name), F.array(*[F.lit(v) for v in values]))
    per, total = F.coalesce("per_request", F.lit(USUAL_SECONDS)), F.coalesce("total", USUAL_SECONDS * c("most"))
    models, resolutions = usual("models", USUAL_MODELS), usual("resolutions", USUAL_RESOLUTIONS)
    finite = lambda v: (v > 0) & (v < float("inf"))
    named = lambda v: (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (x != ""))
    same = lambda v, values: F.coalesce(v == F.array(*[F.lit(x) for x in values]), F.lit(False))
    widened = (per > USUAL_SECONDS) | (total > USUAL_SECONDS * c("most")) | ~same(models, USUAL_MODELS) | ~same(resolutions, USUAL_RESOLUTIONS)
    reason = F.trim(F.coalesce("change_reason", F.lit(""))) != ""
    return violations(df, key, {
        "limits-positive": finite(per) & finite(total) & (c("most") > 0),
        "limits-named": named(models) & named(resolutions),
        "seconds": finite(c("seconds")),
        "model": F.array_contains(models, c("model")),
        "resolution": F.array_contains(resolutions, c("resolution")),
        "per-request": c("seconds") <= per,
        "total": c("used") + c("seconds") <= total,
        "change-reason": ~widened | reason,
        "reference-media": (c("reference_media") == 0) | (F.coalesce(c("allow_reference_media"), F.lit(False)) & reason),
    })
