"""Captures as formats: ranges, headers, offsets."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.sources import formats as Fm


def cloud(path, points, tail="", extra=""):
    head = f"ply\nformat ascii 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\n{extra}end_header\n"
    path.write_text(head + "".join(f"{x} {y} {z}\n" for x, y, z in points) + tail)


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_ranges_of_a_cloud_hold_each_line_once(tmp_path, step):
    points = np.random.default_rng(1).uniform(-5, 5, (60, 3)).round(3).tolist()
    cloud(tmp_path / "a.ply", points)
    reader = Fm._Cloud({"path": str(tmp_path), "step": str(step)})
    got = [row for r in reader.ranges(str(tmp_path / "a.ply")) for b in reader.read(r) for row in b.to_pylist()]
    assert [[r["x"], r["y"], r["z"]] for r in got] == points and [r["ord"] for r in got] == sorted(r["ord"] for r in got)


def test_many_ranges_share_partitions(tmp_path):
    points = np.random.default_rng(2).uniform(-5, 5, (300, 3)).round(3).tolist()
    for i in range(8):
        cloud(tmp_path / f"{i}.ply", points)
    reader = Fm._Reader(Fm._Cloud({"path": str(tmp_path), "step": "40"}))
    parts = reader.partitions()
    assert 256 <= len(parts) <= 600 and sum(len(p.ranges) for p in parts) > 1000
    got = [row for p in parts for b in reader.read(p) for row in b.to_pylist()]
    assert sorted((r["x"], r["y"], r["z"]) for r in got) == sorted(map(tuple, points * 8))


def test_faces_and_hidden_files_do_not_count(spark, tmp_path):
    cloud(tmp_path / "a.ply", [(1, 2, 3), (4, 5, 6)], "3 0 1 1\n", "element face 1\nproperty list uchar int vertex_indices\n")
    cloud(tmp_path / "none.ply", [])
    cloud(tmp_path / "_aside.ply", [(9, 9, 9)])
    Fm.register(spark)
    got = spark.read.format("ascii_clouds").load(str(tmp_path)).select("x", "y", "z").collect()
    assert sorted(map(tuple, got)) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "bad.ply").write_text("no cloud\n")
    with pytest.raises(Exception, match="not a cloud"):
        spark.read.format("ascii_clouds").load(str(tmp_path)).count()


def test_a_stream_of_frames_goes_on_behind_its_offset(spark, tmp_path):
    Fm.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        np.save(source / f"frame{i}.npy", np.full((5, 4), i + 1, dtype=np.float32))
        os.utime(source / f"frame{i}.npy", ns=(i + 1, i + 1))
        if i != 1:
            spark.readStream.format("depth_frames").option("step", 2).load(str(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row", "col").alias("places")).collect()
    assert sorted(map(tuple, got)) == [(1.0, 20, 20), (2.0, 20, 20), (3.0, 20, 20)]


def test_the_constant_camera(spark, tmp_path):
    Fm.register(spark)
    frames = spark.readStream.format("constant_camera").options(height=3, width=2, depth=0.75, frames=4, per_batch=4).load()
    frames.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 24 and got.select("frame").distinct().count() == 4 and got.agg(F.min("depth")).first()[0] == 0.75
