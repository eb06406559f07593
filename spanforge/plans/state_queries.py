"""Keyed state over a stream, and the box regressor."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from spanforge.operators import jobs as J
from spanforge.operators import training as Tr
from spanforge.plans import job_queries  # noqa: F401  its session query has the same twin
from spanforge.plans.base import ORACLE_SQL, QUERIES, query, scratch
from spanforge.streaming import sessions as Se

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark):
    """Keyed state needs the RocksDB store; the session's own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def session_stream(spark, sf_dir: str):
    """Session states over the events as a stream, all that there is, and the last state of each user."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    k = F.col("event_id") % 4
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(F.col("user_id").cast("string").alias("job_id"), "event_id", "ts", F.when(k == 0, "status").when(k == 1, "view").when(k == 2, "step").when(F.col("event_id") % 8 == 3, "error").otherwise("view").alias("kind"), F.col("event_type").alias("name"), (F.col("value") > 50).alias("done"))
    out = scratch(spark, "states")
    with rocks_store(spark):
        writer = Se.stream_sessions(rows).writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True)
        writer.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start().awaitTermination()
    last = J.latest(spark.read.parquet(out), ["job_id"], F.col("batch").desc())
    return last.select(F.col("job_id").cast("long").alias("user_id"), "status", "n_errors", F.array_join("captured_views", ",").alias("views"), F.size(F.map_filter("steps", lambda _, v: v)).cast("long").alias("done_steps"))


QUERIES["session_stream"] = session_stream
ORACLE_SQL["session_stream"] = ORACLE_SQL["session_state"]


@query()
def forest_boxes(t):
    """Boxes of parts from their size and price."""
    rows = t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_size") * 1.5).alias("length_in"), (F.col("p_size") + 2.0).alias("width_in"), (F.col("p_retailprice") / 100).alias("height_in"))
    models, _ = Tr.train_boxes(rows, ["a", "b"])
    out = Tr.predict_boxes(models, rows, ["a", "b"])
    box = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("length_in", "width_in", "height_in")])
    return out.select("p_partkey", *[f"predicted_{c}" for c in ("length_in", "width_in", "height_in")], Tr.compare_boxes(box("predicted_"), box(""))["match"].alias("match"))
