"""Views that are processed again as captures and requests stream in, with results replaced in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators import jobs as J
from spanforge.sources.files import merge_rows

Compute = Callable[[DataFrame], DataFrame]


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Partition of a row: a hash of its job, so that a table has as many partitions as it needs, not as many as jobs."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Reprocessor:
    """``foreachBatch`` function: computes the views of a batch that have no reusable result or were asked for, and puts the results in place.

    A batch has the key columns, ``requested`` and what ``compute`` needs; of several rows of a view the
    one of the greatest ``order`` counts, and any request does. The table at ``path`` has the keys,
    what ``compute`` gives, ``valid`` (its result may be reused), ``batch`` and ``bucket``, by which it is partitioned. A view
    that this batch or a later one has already written is left alone, so a batch that is replayed
    after a failure changes nothing: its rows that were written stay, the others are written now.
    """

    def __init__(self, path: str, keys: list[str], compute: Compute, *, job: str, order: str, buckets: int):
        self.path, self.keys, self.compute = path, keys, compute
        self.job, self.order, self.buckets = job, order, buckets

    def todo(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The views of a batch that must be computed."""
        per_view = Window.partitionBy(*self.keys)
        asked = batch.withColumns({"requested": F.bool_or("requested").over(per_view), "nth": F.row_number().over(per_view.orderBy(F.col(self.order).desc()))}).filter("nth = 1").drop("nth")
        asked = asked.withColumn("bucket", bucket_of([self.job], self.buckets))
        there = batch.sparkSession.read.parquet(self.path).select(*self.keys, "bucket", "valid", "batch")
        marked = asked.join(there.withColumn("known", F.lit(True)), [*self.keys, "bucket"], "left")
        done = F.coalesce((F.col("valid") & ~F.col("requested")) | (F.col("batch") >= batch_id), F.lit(False))
        return marked.filter(~done).drop("valid", "batch", "known")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        open_ = self.todo(batch, batch_id)
        results = self.compute(open_).withColumn("batch", F.lit(batch_id).cast("long"))
        merge_rows(results, self.path, self.keys, ["bucket"])


def start_table(results: DataFrame, path: str, *, job: str, buckets: int) -> None:
    """Write the first results (keys, values, ``valid``) as a table that a Reprocessor keeps."""
    results.withColumns({"batch": F.lit(-1).cast("long"), "bucket": bucket_of([job], buckets)}).write.partitionBy("bucket").parquet(path)


def process_stream(captures: DataFrame, apply: Reprocessor, progress: str):
    """The running query that applies a Reprocessor to a stream of captures and requests."""
    return captures.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(apply).start()


def update_jobs(changes: DataFrame, path: str, *, buckets: int, job: str = "job_id") -> None:
    """Rows of the jobs table put in place or, with ``deleted``, taken out; setup requests that are not valid change nothing."""
    good = changes.filter("error is null").drop("error") if "error" in changes.columns else changes
    merge_rows(good.withColumn("bucket", bucket_of([job], buckets)), path, [job], ["bucket"], delete="deleted" if "deleted" in changes.columns else None)


def remove_setups(path: str, captures: DataFrame, wanted: DataFrame, *, buckets: int, job: str = "job_id") -> None:
    """Delete the wanted jobs that have no capture; the others stay."""
    jobs = wanted.sparkSession.read.parquet(path).drop("bucket").join(wanted.select(job).distinct(), job, "left_semi")
    update_jobs(J.setup_only(jobs, captures, job=job).withColumn("deleted", F.lit(True)), path, buckets=buckets, job=job)
