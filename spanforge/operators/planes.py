"""The kept table plane of a camera setting, and the extraction of objects with it.

Captures of one setting (camera, profile, crop) follow each other. A capture takes the kept
plane if that is valid for its own points; else a plane is fitted to it, and only a fitted plane
that is valid itself is kept from then on. What a capture meets so depends on those before it, but
only by way of the few planes that were ever kept. So captures are resolved in rounds: one
aggregate holds a kept plane against all open captures of its setting at once, all of them up
to the first failure are done, and only captures that fail are fitted: one, then two, four and so on of
a setting until a plane is kept. The number of rounds follows the number of kept planes, not
that of the captures; no group of points is gathered, and each round's small tables are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions.text import first_match
from spanforge.operators import cluster as C
from spanforge.operators import points as P
from spanforge.sources.store import drop, scratch, written

Fit = Callable[[DataFrame], DataFrame]


def plane_sequence(points: DataFrame, captures: DataFrame, *, view: list[str], cache: list[str], order: list[str], fit: Fit | None = None, threshold: float = K.PLANE_THRESHOLD) -> DataFrame:
    """How each capture comes to its plane.

    ``captures`` has a row per view: the columns ``view``, those of its setting ``cache`` and of
    its place ``order``. Columns added: plane (null where none was found), source (``cache`` or
    ``ransac``), cache_reason (``cache_miss`` or why the kept plane did not do; null for a
    reused one), refit_reason (why a fitted plane is not kept), replaced, n_inliers.
    ``fit`` gives plane and n_inliers for each view of a table of points.
    """
    fit = fit or (lambda own: C.table_planes(own, view))
    spark = points.sparkSession
    done = scratch(spark, "planes")
    place = F.row_number().over(Window.partitionBy(*cache).orderBy(*order, *view))
    names = list(dict.fromkeys([*view, *cache]))
    kept_none = F.lit(None).cast("array<double>")
    left = written(captures.select(*names, place.alias("k"), kept_none.alias("plane"), F.lit("cache_miss").alias("cache_reason"), F.lit(1).alias("budget")), "open")
    while left.limit(1).count():
        nth = F.row_number().over(Window.partitionBy(*cache, F.col("cache_reason").isNull()).orderBy("k"))
        tried = left.withColumn("tried", F.col("cache_reason").isNotNull() & (nth <= F.col("budget")))
        own = points.join(tried.filter("tried").select(*view), view, "left_semi")
        fits = written(fit(own).select(*view, F.col("plane").alias("fitted"), "n_inliers"), "fits")
        checked = C.plane_valid(own, fits.select(*view, F.col("fitted").alias("plane")), view, threshold).select(*view, F.col("reason").alias("refit_reason"))
        met = tried.join(fits, view, "left").join(checked, view, "left").withColumn("replaced", F.col("tried") & F.col("fitted").isNotNull() & F.col("refit_reason").isNull())
        stops = met.groupBy(*cache).agg(F.min(F.when(F.col("replaced"), F.col("k"))).alias("hit"), F.max(F.when(F.col("tried"), F.col("k"))).alias("last"), F.count_if(F.col("cache_reason").isNotNull() & ~F.col("tried")).alias("more"))
        stop = F.coalesce("hit", F.when(F.col("more") > 0, F.col("last")), F.lit(1 << 30))
        stopped = written(met.join(stops.select(*cache, stop.alias("stop"), F.col("hit").isNotNull().alias("anew")), cache), "round")

        over = stopped.filter("k <= stop")
        reused = F.col("cache_reason").isNull()
        over.select(*names, "k", F.when(reused, F.col("plane")).otherwise(F.col("fitted")).alias("plane"), F.when(reused, "cache").otherwise("ransac").alias("source"), "cache_reason", F.when(F.col("fitted").isNotNull(), F.col("refit_reason")).alias("refit_reason"), "replaced", F.col("n_inliers").cast("long").alias("n_inliers")).write.mode("append").parquet(done)

        now = stopped.filter("replaced and k = stop").select(*cache, F.col("fitted").alias("new_plane"))
        rest = stopped.filter("k > stop").join(now, cache, "left")
        moved = rest.filter("anew").select(*view, F.col("new_plane").alias("plane"))
        verdict = C.plane_valid(points.join(moved.select(*view), view, "left_semi"), moved, view, threshold).select(*view, F.col("reason").alias("verdict"))
        before, left = left, written(rest.join(verdict, view, "left").select(*names, "k", F.coalesce("new_plane", "plane").alias("plane"), F.when(F.col("anew"), F.col("verdict")).otherwise(F.col("cache_reason")).alias("cache_reason"), F.when(F.col("anew"), 1).otherwise(F.col("budget") * 2).alias("budget")), "open")
        drop(before, fits, stopped)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in captures.select(*names).schema.fields)
    result = f"{fields}, k int, plane array<double>, source string, cache_reason string, refit_reason string, replaced boolean, n_inliers long"
    if captures.limit(1).count():
        return spark.read.schema(result).parquet(done).drop("k")
    return spark.createDataFrame([], result).drop("k")


def plane_error(plane: Column, n_inliers: Column) -> Column:
    """Why a view has no table plane."""
    return first_match([(plane.isNotNull(), F.lit(None).cast("string")), (n_inliers.isNull(), F.lit("geometry_primary_table_plane_ransac_failed"))], F.lit("geometry_primary_table_plane_too_few_inliers"))


def extract_objects(points: DataFrame, captures: DataFrame, *, view: list[str], cache: list[str], order: list[str], fit: Fit | None = None) -> tuple[DataFrame, DataFrame]:
    """The points of each view's object, and a row per capture: what happened to its plane, counts of points, and the first error.

    ``captures`` may have ``has_intrinsics`` and ``has_depth``. A view without a plane, clusters or
    enough points on the way has no object and its error code; the others go on without it.
    """
    least = K.CLUSTER_MIN_POINTS
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in captures.columns else F.lit(True)
    inside = written(P.apply_roi(points).filter("inside").drop("inside"), "inside")
    counted = inside.groupBy(*view).agg(F.count(F.lit(1)).alias("n_roi"))
    seen = captures.join(counted, view, "left").withColumn("n_roi", F.coalesce("n_roi", F.lit(0)))
    early = first_match(
        [
            (~flag("has_intrinsics"), F.lit("geometry_primary_missing_rgb_intrinsics")),
            (~flag("has_depth"), F.lit("geometry_primary_missing_depth_aligned_to_rgb")),
            (F.col("n_roi") < least, F.concat(F.lit("geometry_primary_roi_too_few_points:"), F.col("n_roi").cast("string"))),
        ]
    )
    seen = written(seen.withColumn("early", early), "captures")
    open_ = seen.filter("early is null")
    planes = plane_sequence(inside, open_, view=view, cache=cache, order=order, fit=fit)
    above = written(P.remove_plane(inside, planes.filter("plane is not null").select(*view, "plane"), view), "above")
    n_above = above.groupBy(*view).agg(F.count(F.lit(1)).alias("n_above"))
    enough = above.join(n_above.filter(F.col("n_above") >= least).select(*view), view, "left_semi")
    clustered = C.voxel_clusters(enough, view)
    fates = written(C.select_clusters(C.cluster_records(clustered, view), view).select(*view, "component", "n_points", "fate"), "fates")
    chosen = fates.filter(F.col("fate").isin("primary", "merged"))
    objects = clustered.join(chosen.select(*view, "component"), [*view, "component"], "left_semi").drop("vx", "vy", "vz", "component")
    found = fates.groupBy(*view).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum(F.when(F.col("fate").isin("primary", "merged"), F.col("n_points"))).alias("n_final"))
    steps = planes.select(*view, "plane", "source", "cache_reason", "refit_reason", "replaced", "n_inliers")
    whole = seen.join(steps, view, "left").join(n_above, view, "left").join(found, view, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    late = first_match(
        [
            (F.col("early").isNotNull(), F.col("early")),
            (F.col("plane").isNull(), plane_error(F.col("plane"), F.col("n_inliers"))),
            (zero("n_above") < least, F.concat(F.lit("geometry_primary_table_removal_too_few_points:"), zero("n_above").cast("string"))),
            (F.col("n_clusters").isNull(), F.lit("geometry_primary_no_clusters_after_table_removal")),
            (F.col("n_final").isNull(), F.lit("geometry_primary_no_plausible_central_cluster")),
            (F.col("n_final") < least, F.concat(F.lit("geometry_primary_final_object_too_few_points:"), F.col("n_final").cast("string"))),
        ]
    )
    status = whole.withColumns({"error": late, "n_above": zero("n_above"), "n_final": zero("n_final"), "n_roi": zero("n_roi")}).drop("early", "n_clusters")
    return objects, status
