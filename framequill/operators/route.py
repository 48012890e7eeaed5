"""Routes of frames: slicing, splicing, trimming, densifying, bridging and laying out, with provenance per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def strided(df: DataFrame, frame: str, step: int) -> DataFrame:
    """Every ``step``-th frame, renumbered; the predicate reaches the scan."""
    return df.where(F.pmod(F.col(frame), F.lit(step)) == 0).withColumn(frame, F.expr(f"`{frame}` div {step}"))


def sliced(df: DataFrame, frame: str, start: int, end: int) -> DataFrame:
    """Frames of [start, end), renumbered from 0."""
    return df.where((F.col(frame) >= start) & (F.col(frame) < end)).withColumn(frame, F.col(frame) - start)


def spliced(main: DataFrame, upper: DataFrame, key: Sequence[str], anchors: Sequence[int], upper_count: int, midpoint: int, step: int) -> DataFrame:
    """(key, position, part, origin): upper from its midpoint, main after the right anchor to the left one, upper up to its midpoint.

    ``main`` and ``upper`` are (key, frame). Upper's first and last rows are main's at the left and right anchor.
    """
    right, left = anchors[1], anchors[7]
    last = upper_count - 1
    replaced = F.when(F.col("frame") == 0, F.lit(left)).when(F.col("frame") == last, F.lit(right))
    up = upper.where(F.col("frame") < upper_count).select(
        *key, F.when(replaced.isNotNull(), "main").otherwise("upper").alias("part"), F.coalesce(replaced, F.col("frame") * step).cast("long").alias("origin"),
        F.col("frame").alias("ord"))
    first = up.where(F.col("ord") >= midpoint).withColumn("leg", F.lit(0))
    final = up.where((F.col("ord") >= 1) & (F.col("ord") < midpoint)).withColumn("leg", F.lit(2))
    middle = main.where((F.col("frame") > right) & (F.col("frame") <= left)).select(
        *key, F.lit("main").alias("part"), F.col("frame").cast("long").alias("origin"), F.col("frame").alias("ord"), F.lit(1).alias("leg"))
    order = Window.partitionBy(*key).orderBy("leg", "ord")
    return (first.unionByName(middle).unionByName(final)
            .withColumn("position", F.row_number().over(order) - 1).select(*key, "position", "part", "origin"))


def spliced_anchors(anchors: Sequence[int], upper_count: int, midpoint: int) -> list[int]:
    at = upper_count - midpoint - 1
    return [0, at, *(at + a - anchors[1] for a in anchors[2:8])]


def trimmed(df: DataFrame, key: Sequence[str], frame: str, kept: Column) -> DataFrame:
    """Rows that are kept, with ``new_frame`` counted from 0 in order."""
    order = Window.partitionBy(*key).orderBy(frame)
    return df.where(kept).withColumn("new_frame", F.row_number().over(order) - 1)


def densified(df: DataFrame, key: Sequence[str], frame: str) -> DataFrame:
    """n rows to 2n-1: natives at even indices, between each two neighbours one interpolated; never around the end."""
    order = Window.partitionBy(*key).orderBy(frame)
    numbered = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__after", F.lead(F.lit(1)).over(order))
    dense = numbered.withColumn("odd", F.explode(F.array(F.lit(0), F.lit(1)))).where("odd = 0 or __after is not null")
    return dense.select(
        *key, (F.col("__i") * 2 + F.col("odd")).cast("long").alias("index"), F.when(F.col("odd") == 0, "native").otherwise("interpolated").alias("kind"),
        F.when(F.col("odd") == 0, F.array(F.col("__i"))).otherwise(F.array(F.col("__i"), F.col("__i") + 1)).alias("parents"),
        F.when(F.col("odd") == 1, F.lit(0.5)).alias("fraction"))


def midpoints(df: DataFrame, key: Sequence[str], frame: str, vector: str) -> DataFrame:
    """Densified vectors: the mean of neighbours stands in for motion interpolation."""
    order = Window.partitionBy(*key).orderBy(frame)
    numbered = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__after", F.lead(vector).over(order))
    dense = numbered.withColumn("odd", F.explode(F.array(F.lit(0), F.lit(1)))).where("odd = 0 or __after is not null")
    mean = F.zip_with(vector, "__after", lambda a, b: (a + b) / 2)
    return dense.select(*key, (F.col("__i") * 2 + F.col("odd")).cast("long").alias("index"), F.when(F.col("odd") == 0, F.col(vector)).otherwise(mean).alias(vector))


def bridged(df: DataFrame, key: Sequence[str], frame: str, phase: str, count: Column, widest: float = 30.0) -> DataFrame:
    """Up to eight synthesized rows after each row that asks for them, phases spread evenly to the next.

    Rows whose gap is not in (0, widest] or whose count is not 1..8 get none. All rows are numbered anew.
    """
    order = Window.partitionBy(*key).orderBy(frame)
    gap = df.withColumn("__to", F.lead(frame).over(order)).withColumn("__gap", F.lead(phase).over(order) - F.col(phase)).withColumn("__k", count)
    allowed = (F.col("__gap") > 0) & (F.col("__gap") <= widest) & F.col("__k").between(1, 8)
    rows = gap.withColumn("__k", F.when(allowed, F.col("__k")).otherwise(0)).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__k").cast("int"))))
    share = F.col("__j") / (F.col("__k") + 1)
    placed = Window.partitionBy(*key).orderBy(frame, "__j")
    return rows.select(
        *key, (F.row_number().over(placed) - 1).alias("new_frame"), F.col(frame).alias("from_frame"), F.when(F.col("__j") > 0, F.col("__to")).alias("to_frame"),
        (F.col("__j") > 0).alias("synthesized"), F.when(F.col("__j") > 0, share).alias("fraction"), (F.col(phase) + F.col("__gap") * share).alias("phase_raw"), F.col(phase).alias("own_phase"))


def boundaries(df: DataFrame, key: Sequence[str], frame: str, source: str, suspects: DataFrame | None = None) -> DataFrame:
    """(key, edge): frames after which the source changes, the last one, and the ``suspects`` (key, edge), each once."""
    order = Window.partitionBy(*key).orderBy(frame)
    after = F.lead(source).over(order)
    found = df.withColumn("__end", F.lead(F.lit(1)).over(order).isNull()).withColumn("__differs", ~F.col(source).eqNullSafe(after)).where("__end or __differs").select(*key, F.col(frame).alias("edge"))
    return found if suspects is None else found.unionByName(suspects.select(*key, "edge")).distinct()


def neighbours(edges: DataFrame, key: Sequence[str], counts: DataFrame, offsets: Sequence[int] = (-1, 0, 1, 2)) -> DataFrame:
    """(key, frame): the ring neighbourhood of each edge, every frame once."""
    spread = edges.withColumn("d", F.explode(F.array(*[F.lit(d) for d in offsets])))
    return spread.join(counts, list(key)).select(*key, F.pmod(F.col("edge") + F.col("d"), F.col("n")).alias("frame")).distinct()


def cells(index: Column, columns: int, per_sheet: int, width: int, height: int) -> dict[str, Column]:
    """Sheet and pixel place of an atlas index."""
    cell = F.pmod(index, F.lit(per_sheet))
    div = lambda a, n: F.floor(a / F.lit(n)).cast("long")
    return {"sheet": div(index, per_sheet), "cell": cell.cast("long"), "x": (F.pmod(cell, F.lit(columns)) * width).cast("long"), "y": div(cell, columns) * height}


def pages(df: DataFrame, key: Sequence[str], index: str, per_page: int = 12) -> DataFrame:
    """(key, page, n, first, last) of contact sheets."""
    return df.groupBy(*key, F.floor(F.col(index) / per_page).cast("long").alias("page")).agg(
        F.count(F.lit(1)).alias("n"), F.min(index).alias("first"), F.max(index).alias("last"))
