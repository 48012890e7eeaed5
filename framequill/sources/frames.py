"""Sources and sinks of decoded frames, manifests and sheets.

A frame is a row (source, frame, ts, h, w, px); codecs stay outside. Pixels live in a table of their own, so that a query over
metadata never reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framequill.sources.clips import FRAME, RawClips  # noqa: F401
from framequill.session import ship

ship(__name__)

#: Schema of a version 3 manifest.
MANIFEST = (
    "schemaVersion int, sceneId string, baseImage string, baseImageSha256 string, sourceSize array<int>, crop array<int>, eye array<double>, frameCount int, columns int,"
    " framesPerSheet int, sheets array<string>, directionFrames array<int>, preview struct<mode: string, notes: string>,"
    " frameSources array<struct<source: string, frame: int, synthesized: boolean>>, sourceHashes map<string, string>,"
    " background struct<owner: string, mode: string, keyColor: string>, quality struct<status: string, circular: boolean>, _corrupt string")


def probe(frames: DataFrame, fps: float) -> DataFrame:
    """(source, w, h, fps, duration, frame_count) of each clip."""
    return frames.groupBy("source").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.count(F.lit(1)).alias("frame_count")).select(
        "source", "w", "h", F.lit(float(fps)).alias("fps"), (F.col("frame_count") / fps).alias("duration"), "frame_count")


def frame_count(counted: Column, duration: Column, fps: Column) -> Column:
    """A declared frame count, else the duration's, rounded half to even."""
    return F.coalesce(counted, F.rint(duration * fps).cast("long"))


def nearest_samples(frames: DataFrame, fps: float) -> DataFrame:
    """Constant-rate samples: for each sample time the last frame at or before it, by bucket rather than by range join.

    Of frames with the same time the one with the highest number is shown.
    """
    from pyspark.sql import Window

    after = F.lead("ts").over(Window.partitionBy("source").orderBy("ts", "frame"))
    first = F.ceil(F.col("ts") * fps - 1e-9)
    last = F.coalesce(F.ceil(F.col("__after") * fps - 1e-9) - 1, first)
    return (frames.withColumn("__after", after).where(last >= first).withColumn("sample", F.explode(F.sequence(first, last))).drop("__after"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """JSON manifests, one document per file; what does not parse keeps its text in ``_corrupt``."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, content) of binary files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


def placed_frames(frames: DataFrame, columns: int, per_sheet: int, width: int, height: int) -> DataFrame:
    """``frames`` with the sheet, cell and place (x, y) at which each frame lies in its atlas."""
    from framequill.operators.route import cells

    return frames.select("*", *[c.alias(n) for n, c in cells(F.col("frame"), columns, per_sheet, width, height).items()])


def unpacked(sheets: DataFrame, count: int, columns: int, per_sheet: int, width: int, height: int) -> DataFrame:
    """Atlas frames with sheet and place, joined to their sheets (sheet, ...)."""
    index = sheets.sparkSession.range(count).withColumnRenamed("id", "frame")
    return placed_frames(index, columns, per_sheet, width, height).join(sheets, "sheet")


def packed(frames: DataFrame, columns: int, per_sheet: int) -> DataFrame:
    """(atlas, sheet, cells): the frames of a sheet in order, bounded by ``per_sheet``; the last sheet is short."""
    held = F.sort_array(F.collect_list(F.struct("frame", "px")))
    return frames.withColumn("sheet", F.floor(F.col("frame") / per_sheet).cast("int")).groupBy("source", "sheet").agg(held.alias("cells")).withColumn("rows", F.ceil(F.size("cells") / columns).cast("int"))


def composited(frames: DataFrame, base: str, clean: str, owner: str = "owner") -> DataFrame:
    """Picks each frame's plate by the owner of its background: the page's is the clean one."""
    return frames.withColumn("plate", F.when(F.col(owner) == "page", F.col(clean)).otherwise(F.col(base)))


def publish(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write to a path that must not exist yet; the committer makes the result visible as a whole."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def publish_manifests(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", True).json(path)


def selected(frames: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Frames of the given native indices; the list is a handful by contract and becomes a pushed-down predicate."""
    return frames.where(F.col("frame").isin(*sorted(set(indices))))


def missing_selected(frames: DataFrame, indices: Sequence[int]) -> DataFrame:
    """(source, found) of clips that lack some of the indices."""
    wanted = len(set(indices))
    return selected(frames, indices).groupBy("source").agg(F.count_distinct("frame").alias("found")).where(F.col("found") < wanted)


def frame_number(name: Column) -> Column:
    """The number a frame file's name ends in: order of frames is order of numbers, not of names."""
    return F.regexp_extract(name, r"(\d+)\.[A-Za-z0-9]+$", 1).cast("int")


def matte_of(mattes: Column, frame: Column) -> Column:
    """A sample's matte from a map keyed by source frame, null where there is none."""
    return F.try_element_at(mattes, frame)


def first_listed(options: Column, wanted: Column) -> Column:
    """The first option that equals a wanted one without regard to case."""
    return F.get(F.filter(options, lambda o: F.lower(o) == F.lower(wanted)), F.lit(0))


def archive(inputs: DataFrame, path: str) -> None:
    """Append exact input bytes under their digest; what is there already is not written again.

    Two that append at once may both write the same bytes; ``archived`` gives each once.
    """
    rows = inputs.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"), "content").dropDuplicates(["sha256"])
    spark = inputs.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select("sha256"), "sha256", "left_anti")
    rows.write.mode("append").parquet(path)


def archived(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, bytes, content) of an archive, each once."""
    return spark.read.schema("sha256 string, bytes int, content binary").parquet(path).dropDuplicates(["sha256"])
