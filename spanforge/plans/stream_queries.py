"""Keyed triggers and timers over the tables as streams."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import jobs as J
from spanforge.plans.base import ORACLE_SQL, QUERIES, scratch
from spanforge.plans.state_queries import rocks_store
from spanforge.sources import formats as Fm
from spanforge.streaming import reprocess as Re
from spanforge.streaming import sessions as Se


def streamed(sql: str):
    """Register a function of (session, table reader) that runs a stream to its end."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def run_parts(spark: SparkSession, parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stream`` gives over ``parts`` that arrive one after the other, with ``batch``; after each part the stream ends and goes on from its checkpoint."""
    source, out, progress = scratch(spark, "source"), scratch(spark, "out"), scratch(spark, "progress")
    for part in parts:
        part.write.mode("append").parquet(source)
        with rocks_store(spark):
            arriving = spark.readStream.schema(parts[0].schema).parquet(source)
            writer = stream(arriving).writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True)
            writer.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


@streamed("""
WITH r AS (SELECT DISTINCT user_id, unnest(CASE user_id % 3 WHEN 0 THEN ['click', 'view'] WHEN 1 THEN ['click', 'purchase', 'signup', 'view'] ELSE ['click', 'error', 'purchase', 'signup', 'view'] END) AS view_name FROM events),
c AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60),
j AS (SELECT r.user_id, count(*) AS n_required, count(c.user_id) AS n_captured, string_agg(view_name, ',' ORDER BY view_name) AS views FROM r LEFT JOIN c ON c.user_id = r.user_id AND c.event_type = r.view_name GROUP BY r.user_id)
SELECT user_id, views, 1::BIGINT AS times FROM j WHERE n_required = n_captured""")
def completion_stream(spark, t):
    """Users whose required kinds of events have all come, each given out once: requirements late, views repeated and out of order."""
    events = t("events")
    job, k = F.col("user_id").cast("string").alias("job_id"), F.col("user_id") % 3
    names = F.when(k == 0, F.array(*map(F.lit, ("click", "view")))).when(k == 1, F.array(*map(F.lit, ("click", "purchase", "signup", "view")))).otherwise(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))))
    required = events.select("user_id").distinct().select("user_id", job, F.lit("require").alias("kind"), F.explode(names).alias("view_name"))
    views = events.filter("value > 60").select("user_id", "event_id", job, F.lit("view").alias("kind"), F.col("event_type").alias("view_name"))
    columns = ["job_id", "kind", "view_name"]
    late = F.col("user_id") % 4
    parts = []
    for i in range(4):
        backwards = views.filter(F.col("event_id") % 4 == 3 - i).select(*columns)
        parts.append(backwards.unionByName(views.filter(F.col("event_id") % 16 == i).select(*columns)).unionByName(required.filter(late == i).select(*columns)))
    out = run_parts(spark, parts, Se.stream_completions)
    return out.groupBy("job_id").agg(F.count(F.lit(1)).alias("times"), F.first("views").alias("v")).select(F.col("job_id").cast("long").alias("user_id"), F.array_join("v", ",").alias("views"), "times")


@streamed("""
WITH f AS (SELECT user_id, event_id, epoch_us(ts) // 20000000 AS ms FROM events),
l AS (SELECT user_id, max(ms * 1000000000 + event_id) % 1000000000 AS frame, max(ms) AS ms FROM f GROUP BY user_id)
SELECT user_id, frame, (SELECT max(ms) FROM f) - ms > 2000 AS stale FROM l""")
def frame_stream(spark, t):
    """Newest event of each user on a clock 20,000 times as fast, and whether a timer has found it stale after two seconds."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 20_000_000)
    frames = t("events").select(F.col("user_id").cast("string").alias("camera_id"), F.timestamp_millis(ms).alias("ts"), F.col("event_id").alias("frame"), ms.alias("ms"))
    ends = frames.agg(F.min("ms").alias("a"), F.max("ms").alias("b")).first()
    step = (ends.b - ends.a) // 3 + 1
    parts = [frames.filter(F.floor((F.col("ms") - ends.a) / step) == i).drop("ms").repartition(4, F.xxhash64("frame")) for i in range(3)]
    out = run_parts(spark, parts, Se.stream_frames)
    last = J.latest(out, ["camera_id"], F.struct("ts", "frame", "stale").desc())
    return last.select(F.col("camera_id").cast("long").alias("user_id"), "frame", "stale")


@streamed("""
WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 'updated' ELSE o_orderstatus END AS status, o_totalprice + CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 THEN 1 ELSE 0 END AS total FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0) AND NOT (o_orderkey % 17 = 0 AND o_orderkey % 2 = 0)
  UNION ALL SELECT -o_orderkey, 'new', o_totalprice FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
SELECT job_id, status, round(total, 2) AS total FROM j""")
def job_updates(spark, t):
    """A jobs table with rows replaced, added and taken out in place, and setups without a capture deleted."""
    path, key = scratch(spark, "jobs"), F.col("o_orderkey")
    rows = t("orders").select(key.alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    rows.withColumn("bucket", Re.bucket_of(["job_id"], 16)).write.partitionBy("bucket").parquet(path)
    k = F.col("job_id")
    touched = rows.filter((k % 7 == 0) | (k % 11 == 0) | (k % 13 == 0))
    error = F.when((k % 7 == 0) & (k % 5 == 0), "invalid_arrangement")
    change = F.when(k % 7 == 0, "updated").when(k % 11 == 0, "deleted").otherwise("new")
    changes = touched.select(F.when(change == "new", -k).otherwise(k).alias("job_id"), change.alias("status"), (F.col("total") + F.when(k % 7 == 0, 1).otherwise(0)).alias("total"), error.alias("error"), (change == "deleted").alias("deleted"))
    Re.update_jobs(changes, path, buckets=16)
    captures = rows.filter("job_id % 2 = 1").select("job_id")
    Re.remove_setups(path, captures, rows.filter("job_id % 17 = 0").select("job_id"), buckets=16)
    return spark.read.parquet(path).select("job_id", "status", F.round("total", 2).alias("total"))


@streamed("""
WITH a AS (SELECT l_orderkey AS view, sum(l_quantity)::DOUBLE AS value, l_orderkey % 5 <> 0 AS valid FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
c AS (SELECT l_orderkey AS view, l_linenumber AS ord, l_extendedprice AS amount, l_returnflag = 'R' AND l_linenumber % 2 = 0 AS requested, (l_linenumber > 3)::INT AS batch FROM lineitem),
b AS (SELECT view, batch, max(ord) AS ord, bool_or(requested) AS requested FROM c GROUP BY view, batch),
v AS (SELECT b.view, b.batch, b.requested, max(c.amount) / 2 AS value FROM b JOIN c ON c.view = b.view AND c.batch = b.batch AND c.ord = b.ord GROUP BY ALL),
one AS (SELECT coalesce(a.view, v.view) AS view, CASE WHEN v.view IS NOT NULL AND (v.requested OR NOT coalesce(a.valid, false)) THEN v.value ELSE a.value END AS value, CASE WHEN v.view IS NOT NULL AND (v.requested OR NOT coalesce(a.valid, false)) THEN 0 ELSE -1 END AS batch, v.view IS NOT NULL OR a.valid AS valid FROM a FULL JOIN (SELECT * FROM v WHERE batch = 0) v ON v.view = a.view),
two AS (SELECT coalesce(o.view, v.view) AS view, CASE WHEN v.view IS NOT NULL AND (v.requested OR NOT coalesce(o.valid, false)) THEN v.value ELSE o.value END AS value, CASE WHEN v.view IS NOT NULL AND (v.requested OR NOT coalesce(o.valid, false)) THEN 1 ELSE o.batch END AS batch FROM one o FULL JOIN (SELECT * FROM v WHERE batch = 1) v ON v.view = o.view)
SELECT view, round(value, 4) AS value, batch::BIGINT AS batch FROM two""")
def reprocessed_views(spark, t):
    """Results of views after two micro-batches of captures: only invalid, unknown and requested ones are computed again."""
    path, source, progress = scratch(spark, "results"), scratch(spark, "captures"), scratch(spark, "progress")
    lines = t("lineitem")
    first = lines.filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("view")).agg(F.sum("l_quantity").cast("double").alias("value")).withColumn("valid", F.col("view") % 5 != 0)
    Re.start_table(first, path, job="view", buckets=8)
    captures = lines.select(F.col("l_orderkey").alias("view"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("amount")).alias("place"), F.col("l_extendedprice").alias("amount"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)).alias("requested"))
    halve = lambda open_: open_.select("view", "bucket", (F.col("amount") / 2).alias("value"), F.lit(True).alias("valid"))
    apply = Re.Reprocessor(path, ["view"], halve, job="view", order="place", buckets=8)
    for part in ("place.line <= 3", "place.line > 3"):
        captures.filter(part).write.mode("append").parquet(source)
        Re.process_stream(spark.readStream.schema(captures.schema).parquet(source), apply, progress).awaitTermination()
    return spark.read.parquet(path).select("view", F.round("value", 4).alias("value"), "batch")


def _as_files(rows: DataFrame, folder: str, encode) -> None:
    """One file for each ``name`` of the rows, put in place by renaming; the names and values go to the tasks by group."""

    def write(part):
        name = part["name"].iloc[0]
        os.makedirs(folder, exist_ok=True)
        aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            encode(part, f)
        os.replace(aside, f"{folder}/{name}")
        return part[["name"]].head(1)

    rows.groupBy("name").applyInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def _save_depth(part, f) -> None:
    grid = np.zeros((40, 25), dtype=np.float32)
    grid[part["row"], part["col"]] = part["depth"]
    np.save(f, grid)


def _save_cloud(part, f) -> None:
    lines = [f"{x!r} {y!r} {z!r}" for x, y, z in zip(part["x"], part["y"], part["z"], strict=True)]
    f.write("\n".join(["ply", "format ascii 1.0", f"element vertex {len(lines)}", *[f"property float {a}" for a in "xyz"], "end_header", *lines, ""]).encode())


@streamed("""
WITH d AS (SELECT o_custkey % 7 AS camera, o_orderkey % 40 AS row, o_custkey % 25 AS col, max(o_totalprice) AS depth FROM orders GROUP BY ALL)
SELECT 'f' || camera || '.npy' AS name, row, count(*) AS n_valid, round(sum(depth::FLOAT::DOUBLE), 2) AS total FROM d GROUP BY ALL""")
def depth_frame_format(spark, t):
    """Depth arrays as a format, read in ranges of seven rows: first as a stream that ends and goes on, and what it gave against the rows."""
    folder = shared_folder(spark, "frames")
    o = t("orders")
    pixels = o.groupBy((F.col("o_custkey") % 7).alias("camera"), (F.col("o_orderkey") % 40).alias("row"), (F.col("o_custkey") % 25).alias("col")).agg(F.max("o_totalprice").alias("depth"))
    named = pixels.withColumn("name", F.concat(F.lit("f"), F.col("camera").cast("string"), F.lit(".npy")))
    Fm.register(spark)
    out, progress = scratch(spark, "pixels"), scratch(spark, "progress")
    for part in ("camera < 4", "camera >= 4"):
        _as_files(named.filter(part), folder, _save_depth)
        frames = spark.readStream.format("depth_frames").option("step", 7).load(folder)
        frames.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(out).filter("depth > 0")
    return seen.groupBy(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("row").cast("long").alias("row")).agg(F.count(F.lit(1)).alias("n_valid"), F.round(F.sum(F.col("depth").cast("double")), 2).alias("total"))


@streamed("SELECT l_orderkey // 1000 AS cloud, count(*) AS n_points, round(sum(l_extendedprice), 2) AS sum_x, round(max(l_quantity * 1.5), 6) AS max_y, round(min(l_discount), 6) AS min_z FROM lineitem GROUP BY 1")
def cloud_format(spark, t):
    """Clouds as a format, read in ranges of 5,000 bytes."""
    folder = shared_folder(spark, "clouds")
    rows = t("lineitem").select(F.concat(F.lit("c"), F.floor(F.col("l_orderkey") / 1000).cast("string"), F.lit(".ply")).alias("name"), F.col("l_extendedprice").cast("double").alias("x"), (F.col("l_quantity") * 1.5).cast("double").alias("y"), F.col("l_discount").cast("double").alias("z"))
    _as_files(rows, folder, _save_cloud)
    Fm.register(spark)
    points = spark.read.format("ascii_clouds").option("step", 5000).load(folder)
    cloud = F.regexp_extract("path", r"c(\d+)\.ply$", 1).cast("long")
    return points.groupBy(cloud.alias("cloud")).agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum("x"), 2).alias("sum_x"), F.round(F.max("y"), 6).alias("max_y"), F.round(F.min("z"), 6).alias("min_z"))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A scratch path as the tasks open it themselves."""
    return scratch(spark, label).removeprefix("file://").removeprefix("file:")
