"""Dimensions of views, each with its warnings and the reason where it has none.

A view that falls out on the way keeps its row: the guards of every step are columns, so
a table of views says what was measured and why the rest was not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions.text import first_match
from spanforge.operators import cluster as C
from spanforge.operators import points as P
from spanforge.operators.features import dimension_warnings
from spanforge.sources.store import written

LEAST = K.CLUSTER_MIN_POINTS
_SIDES = ("horizontal_span_in", "depth_span_in", "vertical_span_in")


def _count(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def _warned(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, in this order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs]))


def _cropped(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points inside the crop, thinned out in views with too many; and the counts of every view."""
    marked = P.apply_roi(points, use_y=False)
    counts = written(marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_input"), F.count_if("inside").alias("n_roi")).withColumn("downsampled", F.col("n_roi") > K.MAX_MEASURE_POINTS), "counts")
    many = marked.filter("inside").drop("inside").join(counts.select(*keys, "downsampled"), keys)
    thin = P.voxel_centroids(many.filter("downsampled"), keys, K.MEASURE_VOXEL).select(*keys, *P.AXES)
    return many.filter(~F.col("downsampled")).select(*keys, *P.AXES).unionByName(thin), counts


def _roi_warnings() -> list[tuple[Column, str]]:
    return [(F.col("n_roi") == 0, "roi_empty"), ((F.col("n_roi") > 0) & (F.col("n_roi") < 0.05 * F.col("n_input")), "roi_removed_most_points")]


def _sized(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Dimensions of each view's largest cluster beside its share and the number of clusters."""
    facts = clustered.groupBy(*keys).agg(F.max("largest_cluster_ratio").alias("largest_cluster_ratio"), F.max("cluster_count").alias("cluster_count"), F.count(F.lit(1)).alias("n_object"))
    return facts.join(P.dimensions(clustered, keys).drop("n_points"), keys)


def _only_measured(df: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Dimensions only where there is no error."""
    return df.select(*keys, *kept, *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in df.columns if c not in (*keys, *kept)])


def measure_object(points: DataFrame, keys: list[str], *, fit: Callable[[DataFrame], DataFrame] | None = None, min_height: float | None = None, max_height: float | None = None) -> DataFrame:
    """A row per view whose object no trusted cloud stands for: crop, centre, table off, largest cluster, dimensions.

    ``error`` says why a view has none, ``warnings`` what happened on the way. A table that leaves
    nothing above it is kept with ``roi_empty``; heights above the table are bounded by the two
    limits and the margin of the crop. ``fit`` gives plane and n_inliers for each view.
    """
    fit = fit or (lambda own: C.fit_plane(own, keys, C.draw_table(own, keys, K.MEASURE_ITERATIONS), K.MEASURE_PLANE))
    inside, counts = _cropped(points, keys)
    kept = P.central_crop(inside, keys)
    centre = written(kept.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy(*P.AXES))), "centre")
    n_centre = centre.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_centre"))
    enough = centre.join(n_centre.filter(F.col("n_centre") >= LEAST).select(*keys), keys, "left_semi")

    planes = fit(enough).select(*keys, "plane", "n_inliers").join(n_centre, keys)
    table = F.col("plane").isNotNull() & (F.col("n_inliers") >= F.greatest(F.lit(100), F.floor(F.col("n_centre") * 0.05)))
    planes = written(planes.select(*keys, "plane", "n_inliers", F.coalesce(table, F.lit(False)).alias("table_found")), "tables")
    away = enough.join(planes.filter("table_found").select(*keys, "plane"), keys).withColumn("signed", P.plane_distance(F.col("plane"))).drop("plane")
    t = K.MEASURE_PLANE
    sides = away.groupBy(*keys).agg((F.count_if(F.col("signed") > t) >= F.count_if(F.col("signed") < -t)).alias("up"))
    height = F.when(F.col("up"), F.col("signed")).otherwise(-F.col("signed"))
    high = F.col("height") > t
    if min_height is not None:
        high &= F.col("height") >= max(0.0, min_height - K.ROI_MARGIN)
    if max_height is not None:
        high &= F.col("height") <= max_height + K.ROI_MARGIN
    above = written(away.join(sides, keys).withColumn("height", height).filter(high).select(*keys, *P.AXES), "above")
    cut = above.select(*keys).distinct()
    whole = above.unionByName(enough.join(cut, keys, "left_anti").select(*keys, *P.AXES))
    n_after = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_after_table"))
    usable = whole.join(n_after.filter(F.col("n_after_table") >= LEAST).select(*keys), keys, "left_semi")
    sized = _sized(written(C.largest_cluster(usable, keys), "largest"), keys)

    out = counts.join(n_centre, keys, "left").join(planes.drop("plane"), keys, "left").join(cut.withColumn("cut", F.lit(True)), keys, "left").join(n_after, keys, "left").join(sized, keys, "left")
    error = first_match(
        [
            (F.col("n_roi") == 0, F.lit("No points remain after workspace ROI crop.")),
            (_count("n_centre") < LEAST, F.lit("Not enough points after ROI crop.")),
            (_count("n_after_table") < LEAST, F.lit("Not enough object points after table removal.")),
            (_count("n_object") < LEAST, F.lit("No usable object cluster found.")),
        ]
    )
    found = F.coalesce("table_found", F.lit(False))
    fitted = _count("n_centre") >= LEAST
    steps = _warned(*_roi_warnings(), (fitted & found & F.col("cut").isNull(), "roi_empty"), (fitted & ~found, "no_table_found"))
    sides_in = dimension_warnings(*[F.col(c) for c in _SIDES])
    sparse = _warned(((F.col("n_roi") > 0) & (_count("n_object") < K.OBJECT_MIN_POINTS), "low_point_count"))
    warnings = F.when(F.col("error").isNull(), F.concat("steps", sides_in, sparse)).otherwise(F.concat("steps", sparse))
    out = out.withColumns({"error": error, "steps": steps, "table_found": found, "n_inliers": _count("n_inliers"), **{c: _count(c) for c in ("n_centre", "n_after_table", "n_object")}}).withColumn("warnings", warnings).drop("steps", "cut")
    return _only_measured(out, keys, ["error", "warnings", "n_input", "n_roi", "downsampled", "n_centre", "table_found", "n_inliers", "n_after_table", "n_object", "cluster_count", "largest_cluster_ratio"])


def measure_trusted(points: DataFrame, keys: list[str]) -> DataFrame:
    """A row per view with a trusted object cloud, measured as it is: dimensions and profile, or why there are none."""
    n = written(points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_object")), "counts")
    enough = points.join(n.filter(F.col("n_object") >= LEAST).select(*keys), keys, "left_semi")
    out = n.join(P.measure(enough, keys).drop("n_points"), keys, "left").withColumn("error", F.when(F.col("n_object") < LEAST, "Not enough points in final object_cloud.ply."))
    sides_in = dimension_warnings(*[F.col(c) for c in _SIDES])
    sparse = _warned((F.col("n_object") < K.OBJECT_MIN_POINTS, "low_point_count"))
    none = F.array().cast("array<string>")
    return _only_measured(out.withColumn("warnings", F.when(F.col("error").isNull(), F.concat(sides_in, sparse)).otherwise(none)), keys, ["error", "warnings", "n_object"])


def measure_part(points: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """A row per view with the cloud of a pot or of leaves: crop, largest cluster, dimensions; ``warnings`` carry the prefix."""
    inside, counts = _cropped(points, keys)
    thin = written(inside, "thin")
    n = thin.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_thin"))
    usable = thin.join(n.filter(F.col("n_thin") >= LEAST).select(*keys), keys, "left_semi")
    sized = _sized(written(C.largest_cluster(usable, keys), "largest"), keys)
    out = counts.join(n, keys, "left").join(sized, keys, "left")
    error = first_match([(F.col("n_roi") == 0, F.lit(f"{prefix}_roi_empty")), ((_count("n_thin") < LEAST) | (_count("n_object") < LEAST), F.lit(f"{prefix}_low_point_count"))])
    out = out.withColumns({"error": error, "n_thin": _count("n_thin"), "n_object": _count("n_object")})
    out = out.withColumn("warnings", F.array_compact(F.concat(_warned(*_roi_warnings()), F.array("error"))))
    return _only_measured(out, keys, ["error", "warnings", "n_input", "n_roi", "downsampled", "n_thin", "n_object", "cluster_count", "largest_cluster_ratio"])
