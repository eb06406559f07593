"""The kept plane from capture to capture, and the streams that keep state by key."""

import os
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanforge.operators import planes as Pl
from spanforge.plans.state_queries import rocks_store
from spanforge.plans.stream_queries import run_parts
from spanforge.streaming import reprocess as Re
from spanforge.streaming import sessions as Se


def plane_points(rng, y, n=900, upright=False):
    """A level table with things 5 to 20 cm above it; upright, the table is a wall."""
    table = np.stack([rng.uniform(-0.5, 0.5, n), np.full(n, y), rng.uniform(0.3, 1.2, n)], 1)
    things = np.stack([rng.uniform(-0.05, 0.05, 200), y - rng.uniform(0.05, 0.2, 200), rng.uniform(0.6, 0.7, 200)], 1)
    both = np.concatenate([table, things])
    return both[:, [0, 2, 1]] if upright else both


SCHEMA = "view int, x double, y double, z double, ord int"


def test_empty_hit_stale_invalid_refit_and_other_setting(spark):
    rng = np.random.default_rng(3)
    clouds = {1: ("a", plane_points(rng, 0.5)), 2: ("a", plane_points(rng, 0.5)), 3: ("a", plane_points(rng, 0.7)), 4: ("a", plane_points(rng, 0.6, upright=True)), 5: ("a", plane_points(rng, 0.7)), 6: ("b", plane_points(rng, 0.7)), 7: ("b", rng.uniform([-0.5, 0, 0.3], [0.5, 1, 1.3], (300, 3))), 8: ("b", plane_points(rng, 0.7)), 9: ("c", plane_points(rng, 0.5, upright=True)), 10: ("c", plane_points(rng, 0.5, upright=True))}
    rows = [(v, *map(float, p), i) for v, (_, pts) in clouds.items() for i, p in enumerate(pts)] + [(11, 0.0, 0.5, 0.5, 0)]
    captures = spark.createDataFrame([(v, s, v) for v, (s, _) in clouds.items()] + [(11, "a", 11), (12, "a", 12)], "view int, setting string, at int")
    objects, status = Pl.extract_objects(spark.createDataFrame(rows, SCHEMA).repartition(4), captures, view=["view"], cache=["setting"], order=["at"])
    got = {r.view: r for r in status.collect()}
    brief = {v: (r.source, r.cache_reason, r.refit_reason, r.replaced) for v, r in got.items()}
    low = "near_plane_inlier_count_too_low"
    assert brief[1] == ("ransac", "cache_miss", None, True)
    assert brief[2] == ("cache", None, None, False) and got[2].plane == got[1].plane
    assert brief[3] == ("ransac", low, None, True)
    assert brief[4] == ("ransac", low, "plane_normal_orientation_invalid", False)
    assert brief[5] == ("cache", None, None, False) and got[5].plane == got[3].plane  # the upright fit was not kept
    assert brief[6] == ("ransac", "cache_miss", None, True)
    assert brief[7][:2] == ("ransac", low) and got[7].error == "geometry_primary_table_plane_too_few_inliers" and got[7].plane is None
    assert brief[8] == ("cache", None, None, False) and got[8].plane == got[6].plane
    assert [brief[v][1:3] for v in (9, 10)] == [("cache_miss", "plane_normal_orientation_invalid")] * 2
    assert got[11].error == "geometry_primary_roi_too_few_points:1" and got[12].error == "geometry_primary_roi_too_few_points:0"
    assert got[1].error is None and got[1].n_final == got[1].n_above == 200
    assert {r.view for r in objects.select("view").distinct().collect()} == {v for v, r in got.items() if r.error is None}


def test_many_captures_that_no_plane_fits_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(v, *map(float, p), i) for v in range(7) for i, p in enumerate(plane_points(rng, 0.5, 300, upright=True))]
    fits = []

    def fit(own):
        fits.append(1)
        return Pl.C.table_planes(own, ["view"])

    captures = spark.createDataFrame([(v, "a") for v in range(7)], "view int, setting string")
    out = Pl.plane_sequence(spark.createDataFrame(rows, SCHEMA), captures, view=["view"], cache=["setting"], order=["view"], fit=fit).collect()
    assert len(out) == 7 and not any(r.replaced for r in out) and len(fits) == 3  # 1, 2 and 4 of them


def test_no_captures(spark):
    points = spark.createDataFrame([], SCHEMA)
    objects, status = Pl.extract_objects(points, spark.createDataFrame([], "view int, setting string"), view=["view"], cache=["setting"], order=["view"])
    assert objects.count() == 0 and status.count() == 0


def test_planes_of_a_key_are_answered_in_order_over_all_chunks(spark):
    rows = [("k", i, i, [float(i)], i % 7 == 0) for i in reversed(range(1000))]
    fits = spark.createDataFrame(rows, "cache_key string, capture_id long, captured_at long, plane array<double>, valid boolean").coalesce(1)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = run_parts(spark, [fits.filter("capture_id < 600"), fits.filter("capture_id >= 600")], Se.stream_planes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(out) == 1000
    assert all(r.plane == [float(r.capture_id // 7 * 7)] and r.reused == (r.capture_id % 7 != 0) for r in out)


class Keeper:
    """State of one key without Spark."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("seed", range(4))
def test_a_job_is_given_out_once_whatever_the_order(seed):
    rows = pd.DataFrame([("require", v) for v in "abc"] + [("view", v) for v in "abcabcz"] + [("view", None)], columns=["kind", "view_name"])
    rows = rows.sample(frac=1, random_state=seed, ignore_index=True)
    p = Se.CompletionProcessor()
    p.init(Keeper())
    out = [len(x) for i in range(len(rows)) for x in p.handleInputRows(("j",), iter([rows.iloc[i : i + 1], rows.iloc[0:0]]), None)]
    assert out == [1]
    none = Se.CompletionProcessor()
    none.init(Keeper())
    assert not list(none.handleInputRows(("j",), iter([rows[rows["kind"] == "view"]]), None))


def test_a_later_frame_winds_the_timer_up_again():
    p, state = Se.FrameProcessor(2000, True), Keeper()
    p.init(state)

    def frames(*rows):
        df = pd.DataFrame([(pd.Timestamp(ms, unit="ms"), n) for ms, n in rows], columns=["ts", "frame"])
        return [tuple(x.iloc[0][["frame", "stale"]]) for x in p.handleInputRows(("c",), iter([df]), None)]

    assert frames((5000, 2), (4000, 9), (5000, 3)) == [(3, False)] and state.timers == {7000}
    assert frames((4999, 50), (5000, 1)) == [] and state.timers == {7000}
    assert frames((5001, 1)) == [(1, False)] and state.timers == {7001}


def test_a_frame_as_old_as_allowed_is_not_stale():
    p, state = Se.FrameProcessor(2000, True), Keeper()
    p.init(state)
    list(p.handleInputRows(("c",), iter([pd.DataFrame({"ts": [pd.Timestamp(5000, unit="ms")], "frame": [1]})]), None))

    def runs(at, watermark):
        state.timers.discard(at)
        return [bool(x["stale"][0]) for x in p.handleExpiredTimer(("c",), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: at))]

    assert runs(7000, 7000) == [] and state.timers == {7001}
    assert runs(6999, 7001) == []
    assert runs(7001, 7001) == [True] and state.timers == set()


def test_frames_go_stale_on_the_clock(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    first = spark.sql("SELECT 'c' AS camera_id, timestamp '2024-01-01' AS ts, 1L AS frame UNION ALL SELECT 'c', timestamp '2023-01-01', 2L")
    first.write.parquet(source)
    with rocks_store(spark):
        stream = Se.stream_frames(spark.readStream.schema(first.schema).parquet(source), stale_s=1.0, event_time=False)
        running = stream.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(processingTime="500 milliseconds").foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).start()
        try:
            for _ in range(120):
                time.sleep(0.5)
                seen = [(r.frame, r.stale) for r in spark.read.parquet(out).collect()] if os.path.exists(out) and any(f.endswith(".parquet") for f in os.listdir(out)) else []
                if (1, True) in seen:
                    break
        finally:
            running.stop()
    assert sorted(seen) == [(1, False), (1, True)]


def files_of(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_the_partitions_of_touched_jobs_are_written(spark, tmp_path):
    path = str(tmp_path / "jobs")
    jobs = spark.range(200).select(F.col("id").alias("job_id"), F.lit("old").alias("status"))
    jobs.withColumn("bucket", Re.bucket_of(["job_id"], 16)).write.partitionBy("bucket").parquet(path)
    before = files_of(path)
    changes = spark.createDataFrame([(3, "new", None, False), (500, "added", None, False), (7, "bad", "invalid_arrangement", False), (9, "x", None, True), (9000, "never there", None, True)], "job_id long, status string, error string, deleted boolean")
    touched = {f"bucket={r.b}" for r in changes.filter("error is null").select(Re.bucket_of(["job_id"], 16).alias("b")).collect()}
    for _ in range(2):
        Re.update_jobs(changes, path, buckets=16)
        got = {r.job_id: r.status for r in spark.read.parquet(path).collect()}
        assert got == {i: "new" if i == 3 else "old" for i in range(200) if i != 9} | {500: "added"}
    kept = {f for f in before if f.split("/")[-2] not in touched}
    assert kept and kept <= files_of(path) and {f.split("/")[-2] for f in files_of(path) - before} <= touched


def test_a_partition_that_loses_its_last_row(spark, tmp_path):
    path = str(tmp_path / "jobs")
    spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "job_id long, status string, bucket int").write.partitionBy("bucket").parquet(path)
    Re.merge_rows(spark.createDataFrame([(2, "b", 1, True)], "job_id long, status string, bucket int, gone boolean"), path, ["job_id"], ["bucket"], delete="gone")
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "a", 0)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    Re.start_table(spark.createDataFrame([(1, "a", 1.0, True), (1, "b", 2.0, False), (2, "a", 3.0, True)], "job_id long, view string, value double, valid boolean"), path, job="job_id", buckets=4)
    calls = []

    def compute(open_):
        calls.append(sorted((r.job_id, r.view) for r in open_.collect()))
        return open_.select("job_id", "view", "bucket", (F.col("amount") * 10).alias("value"), F.lit(True).alias("valid"))

    apply = Re.Reprocessor(path, ["job_id", "view"], compute, job="job_id", order="at", buckets=4)
    batch = spark.createDataFrame([(1, "a", 5.0, False, 1), (1, "b", 6.0, False, 1), (1, "b", 7.0, False, 2), (2, "a", 8.0, True, 1), (2, "a", 9.0, False, 2), (3, "c", 4.0, False, 1)], "job_id long, view string, amount double, requested boolean, at int")
    state = lambda: {(r.job_id, r.view): (r.value, r.batch) for r in spark.read.parquet(path).collect()}
    apply(batch, 0)
    once = state()
    assert once == {(1, "a"): (1.0, -1), (1, "b"): (70.0, 0), (2, "a"): (90.0, 0), (3, "c"): (40.0, 0)}
    apply(batch, 0)
    assert state() == once and calls == [[(1, "b"), (2, "a"), (3, "c")], []]
    apply(batch, 1)
    assert state()[2, "a"] == (90.0, 1) and state()[1, "b"] == (70.0, 0)
