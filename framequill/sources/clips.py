"""Decoded clips as a data source, and packed sheets as a data sink that publishes all or nothing.

A clip is a NumPy array file <source>.npy, uint8 [n, h, w, c]; codecs stay outside. ``raw-clips`` reads clips from a folder that all workers
have mounted, only the frames that filters ask for, several partitions a clip. ``clip_frames`` reads the same files from
any store that Spark can open. Frames are numbered after the stride: frame i is the native one i * step.

``atlas-sheets`` writes frames (frame, h, w, channels, px) as sheets and a manifest. Tasks write into a hidden folder beside the target;
the commit checks that every sheet is there once and whole, writes the manifest, and renames the folder; a target that exists
is refused, and whatever fails leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from framequill.session import ship

ship(__name__)

FRAME = "source string, frame int, ts double, h int, w int, channels int, px array<smallint>"
#: How far width / height of a clip may be from what is asked for; pixels of a batch.
ASPECT, PIXELS = 0.005, 1 << 20


def check_aspect(width: int, height: int, size: tuple[int, int] | None, name: str) -> None:
    if size and abs(width / height - size[0] / size[1]) > ASPECT:
        raise ValueError(f"{name}: {width}x{height} has not the ratio of {size[0]}x{size[1]}; it would be stretched")


def pair(text: str | None) -> tuple[int, int] | None:
    """"640x360" as numbers."""
    return tuple(int(v) for v in text.lower().split("x")) if text else None  # type: ignore[return-value]


def batches(source: str, clip: np.ndarray, frames: range, step: int, fps: float) -> Iterator[pa.RecordBatch]:
    """Rows of FRAME for the renumbered ``frames`` of a clip, a bounded number of pixels at a time."""
    h, w, c = clip.shape[1:]
    each = max(1, PIXELS // (h * w * c))
    for at in range(0, len(frames), each):
        own = np.asarray(frames[at : at + each])
        px = np.ascontiguousarray(clip[own * step]).reshape(-1).astype(np.int16)
        n, whole = len(own), lambda v: pa.array(np.full(len(own), v, np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w * c)), pa.array(px))
        yield pa.RecordBatch.from_arrays(
            [pa.array([source] * n), pa.array(own.astype(np.int32)), pa.array(own * step / fps), whole(h), whole(w), whole(c), lists],
            ["source", "frame", "ts", "h", "w", "channels", "px"])


@dataclass
class Stretch(InputPartition):
    """Frames first..last - 1 of a clip."""

    name: str
    first: int
    last: int


class RawClips(DataSource):
    """``raw-clips``: options path, fps (25), step (1), size ("WxH", whose ratio clips must have), frames (of a partition, 256), pushdown.

    With ``pushdown``, which needs ``spark.sql.python.filterPushdown.enabled`` (``raw_clips`` sets both), comparisons of ``frame`` with
    numbers and of ``source`` with names choose files and frames before anything is read.
    """

    @classmethod
    def name(cls) -> str:
        return "raw-clips"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return (PushedClipReader if self.options.get("pushdown", "").lower() == "true" else RawClipReader)(self.options)


class RawClipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.fps, self.step = options["path"].removeprefix("file://"), float(options.get("fps", 25)), int(options.get("step", 1))
        self.size, self.each = pair(options.get("size")), int(options.get("frames", 256))
        self.low, self.high, self.names = 0, None, None

    def partitions(self) -> Sequence[InputPartition]:
        import os

        found = []
        for file in sorted(os.listdir(self.path)):
            if file.endswith(".npy") and (self.names is None or file[:-4] in self.names):
                n, h, w, _ = np.load(f"{self.path}/{file}", mmap_mode="r").shape
                check_aspect(w, h, self.size, file)
                last = -(-n // self.step) if self.high is None else min(-(-n // self.step), self.high)
                found += [Stretch(file[:-4], at, min(at + self.each, last)) for at in range(self.low, last, self.each)]
        return found

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        clip = np.load(f"{self.path}/{partition.name}.npy", mmap_mode="r")
        yield from batches(partition.name, clip, range(partition.first, partition.last), self.step, self.fps)


class PushedClipReader(RawClipReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if isinstance(f, IsNotNull) and column in {("source",), ("frame",)}:
                continue  # neither ever is
            if column == ("source",) and isinstance(f, (EqualTo, In)):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.names = own if self.names is None else self.names & own
            elif column == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            else:
                yield f


def raw_clips(spark: SparkSession, path: str, **options) -> DataFrame:
    """Clips of a mounted folder, with filters pushed into the reader."""
    spark.dataSource.register(RawClips)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("raw-clips").options(path=path, pushdown="true", **options).load()


def decoded(clips: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, fps: float = 25.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Rows of FRAME of clips (source, content), content the bytes of an array file: frames start..stop - 1 after the stride."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for part in parts:
            for source, content in zip(part.column(0).to_pylist(), part.column(1)):
                raw = content.as_buffer()
                held = io.BytesIO(raw)
                version = np.lib.format.read_magic(held)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, _, kind = read(held)
                clip = np.frombuffer(raw, kind, count=int(np.prod(shape)), offset=held.tell()).reshape(shape)
                check_aspect(shape[2], shape[1], size, source)
                n = -(-shape[0] // step)
                yield from batches(source, clip, range(start, n if stop is None else min(stop, n)), step, fps)

    return clips.select("source", "content").mapInArrow(run, FRAME)


def clip_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """``decoded`` over all clips of a folder in any store that Spark can open; a clip is one row while it is read, 2 GB at most."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return decoded(files.select(F.regexp_extract(F.col("path"), r"([^/]+)\.npy$", 1).alias("source"), "content"), **options)


@dataclass
class Sheets(WriterCommitMessage):
    #: (sheet, sha256, frames)
    written: list


class AtlasSheets(DataSource):
    """``atlas-sheets``: options path, columns, per_sheet, and manifest, a JSON object of further fields. Input: ``laid_out`` rows."""

    @classmethod
    def name(cls) -> str:
        return "atlas-sheets"

    def schema(self) -> str:
        return SHEET

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a published atlas is never overwritten")
        return SheetWriter(self.options)


SHEET = "sheet int, frames int, h int, w int, channels int, cells array<struct<frame: int, px: array<smallint>>>"


def laid_out(frames: DataFrame, per_sheet: int) -> DataFrame:
    """A row for each sheet of one atlas: at most ``per_sheet`` cells, in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col("frame").cast("int").alias("frame"), F.col("px").cast("array<smallint>").alias("px"))))
    found = frames.withColumn("sheet", F.floor(F.col("frame") / per_sheet).cast("int")).groupBy("sheet").agg(
        F.count(F.lit(1)).cast("int").alias("frames"), *[F.min(c).cast("int").alias(c) for c in ("h", "w", "channels")], held.alias("cells"))
    return found.select("sheet", "frames", "h", "w", "channels", "cells")


class SheetWriter(DataSourceWriter):
    def __init__(self, options: dict):
        import json
        import os
        import uuid

        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.columns, self.per_sheet, self.rest = int(options["columns"]), int(options["per_sheet"]), json.loads(options.get("manifest", "{}"))
        if os.path.exists(self.path):
            raise ValueError(f"{self.path} is there already")
        folder, name = os.path.split(self.path)
        self.staged = f"{folder}/.{name}-{uuid.uuid4().hex}"
        os.makedirs(self.staged)

    def write(self, iterator) -> Sheets:
        import hashlib
        import io
        import os

        written = []
        for row in iterator:
            h, w, c = row["h"], row["w"], row["channels"]
            sheet = np.zeros((-(-len(row["cells"]) // self.columns) * h, self.columns * w, c), np.uint8)
            for i, cell in enumerate(row["cells"]):
                if cell["frame"] != row["sheet"] * self.per_sheet + i:
                    raise ValueError(f"sheet {row['sheet']}: frame {cell['frame']} where {row['sheet'] * self.per_sheet + i} belongs")
                y, x = i // self.columns * h, i % self.columns * w
                sheet[y : y + h, x : x + w] = np.asarray(cell["px"], np.uint8).reshape(h, w, c)
            held = io.BytesIO()
            np.save(held, sheet)
            raw = held.getvalue()
            part = f"{self.staged}/{row['sheet']:04d}.npy.{os.getpid()}-{id(held)}"
            with open(part, "wb") as out:
                out.write(raw)
            os.replace(part, f"{self.staged}/sheet-{row['sheet']:04d}.npy")  # a task that runs twice writes the same
            written.append((row["sheet"], hashlib.sha256(raw).hexdigest(), len(row["cells"]), h, w, c))
        return Sheets(written)

    def commit(self, messages: list) -> None:
        import hashlib
        import json
        import os

        sheets = sorted(s for m in messages if m for s in m.written)
        try:
            if [s[0] for s in sheets] != list(range(len(sheets))) or any(s[2] != self.per_sheet for s in sheets[:-1]) or len({s[3:] for s in sheets}) > 1:
                raise ValueError("sheets are missing, short, or of several sizes")
            for number, sha, *_ in sheets:
                with open(f"{self.staged}/sheet-{number:04d}.npy", "rb") as file:
                    if hashlib.file_digest(file, "sha256").hexdigest() != sha:
                        raise ValueError(f"sheet {number} changed")
            manifest = {**self.rest, "schemaVersion": 3, "columns": self.columns, "framesPerSheet": self.per_sheet, "frameCount": sum(s[2] for s in sheets),
                        "cell": list(sheets[0][3:]) if sheets else [], "sheets": [f"sheet-{s[0]:04d}.npy" for s in sheets], "sheetHashes": {f"sheet-{s[0]:04d}.npy": s[1] for s in sheets}}
            with open(f"{self.staged}/manifest.json", "w") as file:
                json.dump(manifest, file, indent=1, sort_keys=True)
            if os.path.exists(self.path):
                raise ValueError(f"{self.path} is there already")
            os.rename(self.staged, self.path)
        except BaseException:
            self.abort(messages)
            raise

    def abort(self, messages: list) -> None:
        import shutil

        shutil.rmtree(self.staged, ignore_errors=True)


def publish_atlas(frames: DataFrame, path: str, columns: int, per_sheet: int, **manifest) -> None:
    """Frames 0.. of one atlas as sheets and a manifest under ``path``, which must not be there yet."""
    import json

    frames.sparkSession.dataSource.register(AtlasSheets)
    laid_out(frames, per_sheet).write.format("atlas-sheets").mode("append").options(columns=columns, per_sheet=per_sheet, manifest=json.dumps(manifest)).save(path)


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """(frame, h, w, channels, px) of a published atlas, its sheets read by Spark and their hashes checked."""
    manifest = spark.read.schema("columns int, framesPerSheet int, frameCount int, cell array<int>, sheetHashes map<string, string>").option("multiLine", True).json(f"{path}/manifest.json").first()
    columns, per_sheet, count, hashes = manifest["columns"], manifest["framesPerSheet"], manifest["frameCount"], manifest["sheetHashes"] or {}
    h, w, c = manifest["cell"] or (1, 1, 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import io

        for part in parts:
            for name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if hashlib.sha256(content).hexdigest() != hashes.get(name):
                    raise ValueError(f"{name} is not what the manifest says")
                sheet, first = np.load(io.BytesIO(content)), int(name[6:-4]) * per_sheet
                n = min(per_sheet, count - first)
                px = np.stack([sheet[i // columns * h :][:h, i % columns * w :][:, :w] for i in range(n)]).reshape(n, -1).astype(np.int16)
                whole = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(first, first + n, dtype=np.int32)), whole(h), whole(w), whole(c), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * px.shape[1]), pa.array(px.ravel()))],
                    ["frame", "h", "w", "channels", "px"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "sheet-*.npy").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content").mapInArrow(run, "frame int, h int, w int, channels int, px array<smallint>")
