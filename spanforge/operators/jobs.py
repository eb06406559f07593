"""Jobs, items, views and files: assembly, merging, presence and reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions import text as T


def job_rows(jobs: DataFrame, items: DataFrame, features: DataFrame, truth: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Jobs that have items, features and ground truth."""
    return jobs.join(items, job).join(features, job).join(truth, job)


def view_names(session: Column, folders: Column, defaults: Column, any_views: Column) -> Column:
    """Views of a job: the session's order, folders with artifacts, the arrangement's own, any at all; empty lists do not count."""
    full = lambda a: F.when(F.size(a) > 0, a)
    return F.coalesce(full(session), full(F.array_sort(folders)), full(defaults), full(F.array_sort(any_views)))


def next_view(required: Column, captured: Column, requested: Column | None = None) -> Column:
    """The requested view, or the first one that is not captured; null when all are."""
    open_ = F.try_element_at(F.array_except(required, F.coalesce(captured, F.array().cast("array<string>"))), F.lit(1))
    return open_ if requested is None else F.coalesce(requested, open_)


def remaining(required: Column, captured: Column) -> Column:
    return F.array_except(required, captured)


def merge_items(items: DataFrame, *, keys: list[str], sku: str = "sku", quantity: str = "quantity", order: str = "ord") -> DataFrame:
    """One row per SKU in any case, quantities added, at the place of its first row."""
    return items.groupBy(*keys, F.upper(T.strip(F.col(sku))).alias("sku")).agg(F.sum(quantity).alias("quantity"), F.min(order).alias("first_ord"))


def item_totals(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.sum("quantity").alias("total_quantity"), F.count_distinct("sku").alias("unique_sku_count"))


def presence(keys: DataFrame, expected: DataFrame, actual: DataFrame, on: list[str], name: str) -> DataFrame:
    """Every key with every expected name and whether it is there."""
    names = expected.agg(F.array_sort(F.collect_set(name)).alias(f"all_{name}"))
    grid = keys.join(names).withColumn(name, F.explode(f"all_{name}")).drop(f"all_{name}")  # one row beside each key
    there = actual.select(*on, name).distinct().withColumn("present", F.lit(True))
    return grid.join(there, [*on, name], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def reusable(*, has_files: Column, geometry_status: Column, features_version: Column, version: str, requested: Column) -> Column:
    """A view whose outputs can stay: complete, not failed, of this version and not asked for again."""
    return F.coalesce(has_files & ~geometry_status.isin("failed", "missing") & (features_version == version) & ~requested, F.lit(False))


def to_process(views: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Views without reusable outputs."""
    return views.join(done.select(*keys), keys, "left_anti")


def profile_totals(stages: DataFrame, keys: list[str], total: str = "total_s") -> DataFrame:
    """Seconds of all stages but the nested ones, and what of the whole they leave unexplained."""
    out = stages.groupBy(*keys).agg(F.sum(F.when(~F.col("stage").isin(*K.NESTED_STAGES), F.col("seconds"))).alias("stage_sum_s"), F.max(total).alias(total))
    return out.withColumn("unattributed_s", F.greatest(F.lit(0.0), F.col(total) - F.coalesce("stage_sum_s", F.lit(0.0))))


def job_metadata(requests: DataFrame) -> DataFrame:
    """Rows of the jobs table for setup requests: arrangement, views, dates; ``error`` for those that are not valid."""
    arrangement = T.normalize_arrangement(F.col("arrangement"))
    out = requests.withColumns({"arrangement_type": arrangement, "view_mode": T.view_mode(F.col("arrangement")), "job_id": T.resolve_job_id(F.col("job_id"), F.concat_ws("_", "job_type", F.date_format("created_at", "yyyyMMdd_HHmmss")))})
    return out.withColumns({"required_views": T.default_views(F.col("view_mode")), "error": F.when(arrangement.isNull(), "invalid_arrangement")})


def setup_only(jobs: DataFrame, captures: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Jobs without any capture: the only ones that may be deleted."""
    return jobs.join(captures.select(job).distinct(), job, "left_anti")


def replace_jobs(old: DataFrame, new: DataFrame, *, job: str = "job_id") -> DataFrame:
    """The jobs table with the rows of ``new`` in place of theirs."""
    return old.join(new.select(job), job, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("nth = 1").drop("nth")
