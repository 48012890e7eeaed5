import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequill.sources import clips


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    held = {"a": rng.integers(0, 256, (10, 6, 8, 3), dtype=np.uint8), "b": rng.integers(0, 256, (7, 3, 4, 1), dtype=np.uint8)}
    (tmp_path / "clips").mkdir()
    for name, clip in held.items():
        np.save(tmp_path / "clips" / f"{name}.npy", clip)
    (tmp_path / "clips" / "notes.txt").write_text("no clip")
    return str(tmp_path / "clips"), held


def rows(df):
    return {(r["source"], r["frame"]): (r["ts"], np.array(r["px"], np.uint8).reshape(r["h"], r["w"], r["channels"])) for r in df.collect()}


def same(found, held, step=1, keep=lambda s, i: True):
    want = {(s, i): clip[i * step] for s, clip in held.items() for i in range(-(-len(clip) // step)) if keep(s, i)}
    assert found.keys() == want.keys()
    assert all((found[k][1] == v).all() and abs(found[k][0] - k[1] * step / 25) < 1e-9 for k, v in want.items())


def test_clips_are_read_in_stretches_with_a_stride(spark, folder):
    path, held = folder
    spark.dataSource.register(clips.RawClips)
    df = spark.read.format("raw-clips").options(path=path, frames=3).load()
    assert df.rdd.getNumPartitions() == 4 + 3
    same(rows(df), held)
    same(rows(spark.read.format("raw-clips").options(path=path, frames=2, step=3).load()), held, 3)


def test_filters_choose_files_and_frames_before_reading(spark, folder):
    path, held = folder
    df = clips.raw_clips(spark, path, frames=2).where("frame >= 3 and frame < 6 and source = 'a'")
    assert df.rdd.getNumPartitions() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan raw-clips" in plan and "Filter (" not in plan  # the reader takes all of it
    same(rows(df), held, keep=lambda s, i: s == "a" and 3 <= i < 6)
    both = clips.raw_clips(spark, path, step=2).where("frame = 2 and channels > 0 and source in ('a', 'b')")
    same(rows(both), held, 2, keep=lambda s, i: i == 2)
    assert clips.raw_clips(spark, path).where("frame > 3 and frame <= 3").count() == 0


def test_readers_keep_their_filters():
    reader = clips.PushedClipReader({"path": "x"})
    left = list(reader.pushFilters([clips.GreaterThan(("frame",), 2), clips.LessThan(("frame",), 9), clips.LessThanOrEqual(("frame",), 9), clips.EqualTo(("h",), 3), clips.In(("source",), ("a", "b")), clips.EqualTo(("source",), "b")]))
    assert (reader.low, reader.high, reader.names, left) == (3, 9, {"b"}, [clips.EqualTo(("h",), 3)])


def test_clips_from_a_store_that_only_spark_opens(spark, folder):
    path, held = folder
    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.clips.link./in", f"file://{path}")
    df = clips.clip_frames(spark, "viewfs://clips/in", start=1, stop=4, step=2)
    same(rows(df), held, 2, keep=lambda s, i: 1 <= i < 4)


def test_clips_of_another_shape_are_refused(spark, folder):
    path, _ = folder
    spark.dataSource.register(clips.RawClips)
    assert clips.raw_clips(spark, path, size="400x300").where("source = 'b'").count() == 7
    for df in (lambda: spark.read.format("raw-clips").options(path=path, size="16x9").load().count(), lambda: clips.clip_frames(spark, path, size=(16, 9)).count()):
        with pytest.raises(Exception, match="stretched"):
            df()


def atlas(spark, n, h=4, w=5):
    rng = np.random.default_rng(n)
    px = rng.integers(0, 256, (n, h, w, 4))
    return px, spark.createDataFrame([(i, h, w, 4, p.ravel().tolist()) for i, p in enumerate(px)], "frame int, h int, w int, channels int, px array<smallint>")


def test_sheets_and_manifest_come_together_and_back(spark, tmp_path):
    px, df = atlas(spark, 23)
    target = str(tmp_path / "out" / "atlas")
    (tmp_path / "out").mkdir()
    clips.publish_atlas(df.repartition(3), target, 3, 8, sceneId="s")
    assert sorted(os.listdir(tmp_path / "out")) == ["atlas"] and sorted(os.listdir(target)) == ["manifest.json", *(f"sheet-000{i}.npy" for i in range(3))]
    manifest = json.load(open(f"{target}/manifest.json"))
    assert (manifest["frameCount"], manifest["columns"], manifest["framesPerSheet"], manifest["sceneId"], len(manifest["sheets"])) == (23, 3, 8, "s", 3)
    assert np.load(f"{target}/sheet-0002.npy").shape == (3 * 4, 3 * 5, 4)  # seven cells are left
    back = {r["frame"]: r["px"] for r in clips.read_atlas(spark, target).collect()}
    assert back == {i: p.ravel().tolist() for i, p in enumerate(px)}
    with pytest.raises(Exception, match="there already"):
        clips.publish_atlas(df, target, 3, 8)
    np.save(f"{target}/sheet-0001.npy", np.zeros((12, 15, 4), np.uint8))
    with pytest.raises(Exception, match="not what the manifest says"):
        clips.read_atlas(spark, target).count()


@pytest.mark.parametrize("spoil", [
    lambda df: df.where("frame <> 11"), lambda df: df.where("frame < 8 or frame > 15"), lambda df: df.withColumn("px", F.when(F.col("frame") == 20, F.array(F.lit(1).cast("smallint"))).otherwise(F.col("px"))),
    lambda df: df.withColumn("h", F.when(F.col("frame") > 15, 2).otherwise(F.col("h"))).withColumn("w", F.when(F.col("frame") > 15, 10).otherwise(F.col("w"))), lambda df: df.unionByName(df.where("frame = 3")),
])
def test_a_failing_task_leaves_nothing_behind(spark, tmp_path, spoil):
    _, df = atlas(spark, 23)
    with pytest.raises(Exception):
        clips.publish_atlas(spoil(df), str(tmp_path / "atlas"), 3, 8)
    assert os.listdir(tmp_path) == []


def test_images_manifests_and_archives(spark, tmp_path):
    import hashlib

    from framequill.sources import frames

    (tmp_path / "images").mkdir()
    for name, raw in {"a.png": b"\x89PNG", "b.bin": b"\0"}.items():
        (tmp_path / "images" / name).write_bytes(raw)
    found = {os.path.basename(r["path"]): (r["sha256"], r["bytes"], bytes(r["content"])) for r in frames.read_images(spark, str(tmp_path / "images")).collect()}
    assert found == {"a.png": (hashlib.sha256(b"\x89PNG").hexdigest(), 4, b"\x89PNG"), "b.bin": (hashlib.sha256(b"\0").hexdigest(), 1, b"\0")}
    frames.publish_manifests(spark.createDataFrame([("s", 4, None)], "sceneId string, columns int, eye array<double>"), str(tmp_path / "m"))
    back = frames.read_manifests(spark, str(tmp_path / "m" / "*.json")).first()
    assert (back["sceneId"], back["columns"], back["eye"], back["_corrupt"]) == ("s", 4, None, None)
    with pytest.raises(Exception, match="(?i)exists"):
        frames.publish_manifests(spark.createDataFrame([("s",)], "sceneId string"), str(tmp_path / "m"))
    inputs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"y"),), (bytearray(b"x"),)], "content binary")
    target = str(tmp_path / "archive")
    frames.archive(inputs, target)
    frames.archive(inputs.union(spark.createDataFrame([(bytearray(b"z"),)], "content binary")), target)
    assert spark.read.parquet(target).count() == 3
    spark.read.parquet(target).limit(1).write.mode("append").parquet(target)  # another one wrote at the same time
    assert sorted(bytes(r["content"]) for r in frames.archived(spark, target).collect()) == [b"x", b"y", b"z"]
