"""Mixing sources to target weights by entropy balancing.

Each source gets a target in words. Within a source the document rates r are the ones nearest to 1 in
generalised relative entropy, sum(r log r - r + 1), with sum(size * r) = target and 0 <= r <= max_rate. The
dual of that problem has one multiplier for each token constraint, is convex, and gives exponentially tilted rates

    r(size) = min(max_rate, exp(lambda * size / mean size of the source)).

A rate depends on source and size alone, so the corpus enters the solver as counted cells (source, size),
and every Newton iteration is one distributed aggregate over them: gradient and curvature of
all sources at once, with a bracket that turns a step leaving it into a bisection. Sums are decimals, which add up to the
same figure in any order, so reruns agree. Rates become whole copies by
systematic rounding along the sizes of a source; what is then left to the target is made up with the largest
sizes that fit. Copies of a cell go to its documents in hash order, in salted parts, so that a
cell with a third of all rows is no task of its own.

Defined results
    null text has size 0 and is never taken; the null source is a source of its own and the last; null or repeated
    identifiers are rows like others; a very long text is one cell of its size, whose words alone are counted, and is taken whole or
    not at all; rows of equal size tie and are taken in the order of their hashes, copies with equal hashes in any order, which gives
    the same counts; a source without words has target 0; an empty table gives an empty result;
    further columns are carried along by ``mix_rows`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framequill.session import load, spool

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A key without null that sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_rate: float) -> DataFrame:
    """(key, source_size, n_docs) with its target: weight shares, stopped at max_rate times the size, excess reshared.

    Resharing until none is above its stop is filling all sources to one level per weight; sorted by
    the level at which each stops, the first that stays below gives the level. One row per source.
    """
    by_key = Window.orderBy("key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_stop = Window.orderBy("stop_level", "key")
    before, rest = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    ranked = (sizes.withColumn("weight", weight)
              .withColumn("stop", max_rate * F.col("source_size"))
              .withColumn("stop_level", F.col("stop") / F.col("weight"))
              .withColumn("total", share * F.sum("source_size").over(everything))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("weight").over(rest)))
    level = F.min(F.when(F.col("level") <= F.col("stop_level"), F.struct("stop_level", "key", "level"))).over(everything)["level"]
    return (ranked.withColumn("common", level)
            .withColumn("target", F.least(F.col("stop"), F.coalesce(F.col("weight") * F.col("common"), F.col("stop"))))
            .select("key", "source_size", "n_docs", "target"))


def solve_dual(cells: DataFrame, targets: DataFrame, max_rate: float, tolerance: float, max_iterations: int) -> DataFrame:
    """(key, ..., lam): the multiplier of each source; null where every document has the highest rate."""
    mean = F.col("source_size") / F.col("n_docs")
    state = spool(targets.select(
        "*", mean.alias("mean"),
        F.when((F.col("target") > 0) & (F.col("target") < max_rate * F.col("source_size")), F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("miss"),
    ), "dual")
    exact = lambda c: F.sum(c.cast("decimal(28,10)")).cast("double")
    for _ in range(max_iterations):
        x, lam = F.col("size") / F.col("mean"), F.col("lam")
        open_ = lam * x < F.log(F.lit(max_rate))
        rate = F.when(open_, F.exp(F.least(lam * x, F.lit(1.0)))).otherwise(F.lit(max_rate))
        sums = (cells.join(state.where("lam is not null").select("key", "mean", "lam"), "key")
                .groupBy("key").agg(exact(F.col("n") * x * rate).alias("tokens"),
                                    exact(F.when(open_, F.col("n") * x * x * rate).otherwise(F.lit(0.0))).alias("curve")))
        gap = F.col("tokens") - F.col("target") / F.col("mean")
        low, high = F.when(gap < 0, lam).otherwise(F.col("low")), F.when(gap > 0, lam).otherwise(F.col("high"))
        newton = F.when(F.col("curve") > 0, lam - gap / F.col("curve"))
        apart = F.when(gap > 0, F.coalesce((low + lam) / 2, lam - F.greatest(F.lit(1.0), F.abs(lam)))).otherwise(
            F.coalesce((high + lam) / 2, lam + F.greatest(F.lit(1.0), F.abs(lam))))
        inside = F.coalesce(newton > low, F.lit(True)) & F.coalesce(newton < high, F.lit(True)) & (F.abs(newton - lam) < 50)
        step = F.when(gap == 0, lam).when(inside, newton).otherwise(apart)
        state = spool(state.join(sums, "key", "left").select(
            "key", "source_size", "n_docs", "target", "mean",
            F.when(F.col("miss") <= tolerance, lam).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"),
            F.when(F.col("miss") <= tolerance, F.col("miss")).otherwise(F.abs(gap) * F.col("mean") / F.col("target")).alias("miss"),
        ), "dual")
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= tolerance:
            break
    return state


def cell_copies(cells: DataFrame, solved: DataFrame, max_rate: float, refine: int = 6) -> DataFrame:
    """(key, size, n, rate, copies, target, source_size): whole copies for each cell of a source."""
    whole = Window.partitionBy("key")
    along = whole.orderBy("size")
    exponent = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), F.lit(max_rate)).otherwise(F.least(F.lit(max_rate), F.exp(F.least(exponent, F.lit(1.0)))))
    rated = (cells.join(solved, "key").withColumn("rate", rate)
             .withColumn("upto", F.sum((F.col("n") * F.col("rate")).cast("decimal(28,10)")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("mark", F.floor(F.col("upto") + F.lit(0.5)).cast("long"))
             .withColumn("copies", F.col("mark") - F.coalesce(F.lag("mark").over(along), F.lit(0))))
    for _ in range(refine):
        rated = rated.withColumn("left", F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(whole))
        spare = F.when(F.col("left") > 0, F.floor(F.col("n") * max_rate).cast("long") - F.col("copies")).otherwise(F.col("copies"))
        rated = rated.withColumn("spare", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("left")), spare).otherwise(F.lit(0)))
        rated = rated.withColumn("pick", F.max(F.when(F.col("spare") > 0, F.col("size"))).over(whole))
        rated = rated.withColumn("copies", F.when(F.col("size") == F.col("pick"), F.col("copies") + F.signum("left").cast("long") * F.least(F.col("spare"), F.expr("abs(left) div size"))).otherwise(F.col("copies")))
    return rated.select("key", "size", "n", "rate", "copies", "target", "source_size")


def mix_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_rate: float = 2.0, keep: Sequence[str] | None = None,
    rows_per_part: int = 1_000_000, tolerance: float = 1e-9, max_iterations: int = 60,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``, default the identifier) as ``row`` with key, size, source_size, target, rate and copies."""
    carried = F.struct(*[F.col(f"`{c}`") for c in (keep or [id_col])]).alias("row")
    size = word_count(F.col(text_col)).alias("size")
    slim = spool(docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), size), "sizes")
    cells = spool(slim.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    parts = max(256, -(-(cells.agg(F.sum("n")).first()[0] or 0) // rows_per_part))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")

    sizes = cells.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    solved = solve_dual(cells, source_targets(sizes, weights, share, max_rate), max_rate, tolerance, max_iterations)
    plan = cell_copies(cells, solved, max_rate)

    in_cell = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    spread = (slim.withColumn("part", part).groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("m"))
              .join(plan, ["key", "size"])
              .withColumn("m_upto", F.sum("m").over(in_cell))
              .withColumn("base", F.expr("copies div n")).withColumn("over", F.expr("copies % n")))
    upto = lambda m: F.floor(F.col("over") * (m / F.col("n"))).cast("long")
    spread = spread.select("key", "size", "part", "base", "rate", "target", "source_size",
                           (upto(F.col("m_upto")) - upto(F.col("m_upto") - F.col("m"))).alias("extra"))

    rows = (slim.withColumn("part", part).withColumn("row", F.struct(F.col("id").alias(id_col))) if keep is None
            else docs.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), size, carried).withColumn("part", part))
    order = Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("id", F.lit(1)), "id")
    return (rows.join(spread, ["key", "size", "part"])
            .withColumn("copies", F.col("base") + (F.row_number().over(order) <= F.col("extra")).cast("long"))
            .select("row", "key", "size", "source_size", "target", "rate", "copies"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it."""
    mixed = mix_rows(docs, keep=docs.columns, **options).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(load(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("copies") * F.col("size")).alias("taken"), "rate")
