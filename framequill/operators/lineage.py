"""Provenance and content binding: where a frame came from, and whether what it came from is still the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from framequill.session import spool, spool_counted


def annotated(frames: DataFrame, lineage: DataFrame, on: Sequence[str]) -> DataFrame:
    """Frames with the lineage row of their (source, frame); others stay as they are."""
    return frames.join(lineage, list(on), "left")


def mismatches(found: DataFrame, expected: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that one side lacks or whose values differ, null equal to null: (on..., problem)."""
    one = found.select(*on, F.struct(*values).alias("__found"), F.lit(True).alias("__in_found"))
    two = expected.select(*on, F.struct(*values).alias("__expected"), F.lit(True).alias("__in_expected"))
    problem = (F.when(F.col("__in_found").isNull(), "missing").when(F.col("__in_expected").isNull(), "unexpected")
               .when(~F.col("__found").eqNullSafe(F.col("__expected")), "differs"))
    return one.join(two, list(on), "full_outer").withColumn("problem", problem).where("problem is not null").select(*on, "problem")


def ordered_digest(df: DataFrame, key: Sequence[str], order: str, digest: str) -> DataFrame:
    """(key, n, digest): SHA-256 over a group's digests in order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(digest))))
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(held, lambda x: x[digest]), ""), 256).alias("digest"))


def stale(bindings: DataFrame, current: DataFrame, on: Sequence[str] = ("scope", "path")) -> DataFrame:
    """Bound assets that are gone or have other content now: (on..., problem)."""
    now = current.select(*on, F.col("sha256").alias("__now"))
    problem = F.when(F.col("__now").isNull(), "missing").when(F.col("sha256") != F.col("__now"), "changed")
    return bindings.join(now, list(on), "left").withColumn("problem", problem).where("problem is not null").select(*on, "problem")


def same_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records that one side has more often than the other: empty if the multisets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def latest_entries(*tables: DataFrame) -> DataFrame:
    """Maps as (owner, key, value), merged in the given order: later values win."""
    merged = None
    for seq, table in enumerate(tables):
        rows = table.select("owner", "key", "value", F.lit(seq).alias("seq"))
        merged = rows if merged is None else merged.unionByName(rows)
    return merged.groupBy("owner", "key").agg(F.max_by("value", "seq").alias("value"))


def without_field(manifest: Column, field: str = "quality") -> Column:
    """A manifest struct less one field: what a binding covers."""
    return manifest.dropFields(field)


def ancestors(manifests: DataFrame, key: str, sha: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """((key, ancestor, distance) of each manifest's chain, itself included at 0; (key) of manifests whose chain runs into a cycle).

    ``parent`` holds the ``sha`` of the manifest that one was made from; a parent that isn't there ends the chain. Each step joins chains
    of up to 2^i links with themselves, so there are as many steps as the longest chain's length has binary digits; a manifest that is
    its own ancestor is refused with all that lead to it. Of manifests with the same sha one stands for all.
    """
    of = manifests.groupBy(F.col(sha).alias("at")).agg(F.min(key).alias("node"))
    links = manifests.where(F.col(parent).isNotNull()).select(F.col(key).alias("node"), F.col(parent).alias("at")).join(of.withColumnRenamed("node", "ancestor"), "at")
    pairs, n = spool_counted(links.select("node", "ancestor", F.lit(1).cast("long").alias("distance")), "links")
    length, cyclic = 1, spool(pairs.where("node = ancestor").select("node"), "cyclic")
    while n["n"]:
        ends = pairs.where(F.col("distance") == length).join(cyclic.select(F.col("node").alias("ancestor")), "ancestor", "left_anti")
        tail = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more")).where(F.col("more") <= length)
        longer, n = spool_counted(ends.join(tail, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance")), "chains")
        if n["n"]:
            pairs = spool(pairs.unionByName(longer), "links")
            cyclic = spool(pairs.where("node = ancestor").select("node").distinct(), "cyclic")
            length *= 2
    bad = pairs.join(cyclic.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node").distinct()
    own = manifests.select(F.col(key).alias("node"), F.col(key).alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    return own.unionByName(pairs).join(bad, "node", "left_anti").withColumnRenamed("node", key), bad.withColumnRenamed("node", key)


def inherited(chains: DataFrame, entries: DataFrame, key: str, name: str = "path", value: str = "sha256") -> DataFrame:
    """(key, name, value, distance): the entries (key, name, value) of a manifest and of its ancestors; the nearest wins."""
    held = chains.join(entries.select(F.col(key).alias("ancestor"), name, value), "ancestor")
    return held.groupBy(key, name).agg(F.min(F.struct("distance", value)).alias("m")).select(key, name, F.col(f"m.{value}").alias(value), F.col("m.distance").alias("distance"))
