"""Planes, connected components and the choice of an object's clusters.

Connected cells and density clusters come from ``density``, tile by tile; everything before
and after is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions.boxes import gap_3d
from spanforge.functions.text import first_match
from spanforge.operators import points as P
from spanforge.operators.density import connected_cells, density_clusters
from spanforge.sources.store import written

#: Points of a view that are one row while planes are fitted.
CHUNK = 512


# --- planes
def stride_sample(points: DataFrame, keys: list[str], most: int = K.PLANE_MAX_FIT_POINTS) -> DataFrame:
    """At most ``most`` points of each view at even places of its order ``ord``, ends included."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i = F.row_number().over(Window.partitionBy(*keys).orderBy("ord")) - 1
    placed = points.withColumns({"n_all": n, "i_all": i})
    step = (F.col("n_all") - 1) / float(most - 1)
    k = F.ceil(F.col("i_all") / step)  # the place that may truncate to this index; the quotient may be rounded past it
    hits = [(p >= 0) & (p < most) & (F.floor(p * step) == F.col("i_all")) for p in (k - 1, k, k + 1)]
    return placed.filter((F.col("n_all") <= most) | hits[0] | hits[1] | hits[2]).drop("n_all", "i_all")


def plane_fit_points(points: DataFrame, keys: list[str], voxel_size: float | None = None, most: int = K.PLANE_MAX_FIT_POINTS) -> DataFrame:
    """Points that a plane is fitted to: voxel centroids where these are fewer, then at most ``most`` of them at even places.

    Centroids go by their voxels; a view whose centroids are under three or as many as its
    points keeps the points.
    """
    own = points.select(*keys, *P.AXES, F.col("ord").cast("long").alias("ord"))
    if voxel_size:
        cells = P.voxel_centroids(own, keys, voxel_size)
        n = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_points").alias("n_all"))
        thin = n.filter("n_cells >= 3 and n_cells < n_all").select(*keys)
        order = Window.partitionBy(*keys).orderBy("vx", "vy", "vz")
        centroids = cells.join(thin, keys, "left_semi").withColumn("ord", F.row_number().over(order).cast("long")).select(*keys, *P.AXES, "ord")
        own = centroids.unionByName(own.join(thin, keys, "left_anti"))
    return stride_sample(own, keys, most)


@lru_cache(maxsize=4096)
def draws(n: int, iterations: int = K.PLANE_ITERATIONS, seed: int = K.PLANE_SEED) -> list[tuple[int, int, int]]:
    """Index triples of the seeded generator for a cloud of n points."""
    rng = np.random.default_rng(seed)
    return [tuple(int(i) for i in rng.choice(n, 3, replace=False)) for _ in range(min(iterations, 2 * n))] if n >= 3 else []


def fit_plane(points: DataFrame, keys: list[str], triples: DataFrame, threshold: float = K.PLANE_THRESHOLD) -> DataFrame:
    """Best plane of each view: ``plane``, ``n_inliers``, ``iteration``; null where too few points agree.

    ``triples`` has, per view, ``iteration`` and the indices a, b, c into the order
    ``ord`` of the fit points; there are at most a thousand of them. A view is cut into
    chunks of points. Each chunk meets the list of its view's triples and gives the points
    that these name, then meets the list of planes by a matrix product; what leaves are
    counts. Spark cannot tell how long the lists are, so it may not broadcast them.
    """
    chunks = _chunks(points, keys)
    lists = triples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("iteration").cast("int").alias("iteration"), *[F.col(c).cast("long").alias(c) for c in "abc"]))).alias("triples"))
    named = _corners(chunks.join(lists.hint("merge"), keys), keys).groupBy(*keys).agg(F.flatten(F.collect_list("corners")).alias("corners"), F.any_value("triples", True).alias("triples"))
    near = _near_planes(chunks.join(_planes(named, keys).hint("merge"), keys), keys, threshold)
    counted = near.groupBy(*keys, "iteration").agg(F.sum("n").alias("n_inliers"), F.any_value("plane").alias("plane"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("plane", "n_inliers", "iteration"), F.struct(F.col("n_inliers"), -F.col("iteration"))).alias("b"))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"))
    enough = F.col("b.n_inliers") >= F.greatest(F.lit(K.PLANE_MIN_INLIERS), F.floor(F.col("n_points") * K.PLANE_MIN_INLIER_RATIO))
    return sizes.join(best.hint("merge"), keys, "left").select(*keys, "n_points", F.when(enough, F.col("b.plane")).alias("plane"), F.col("b.n_inliers").alias("n_inliers"), F.col("b.iteration").alias("iteration"))


def _chunks(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a view in rows of at most ``CHUNK``, each with its place ``i`` in the order ``ord``, and the number of those rows."""
    view = Window.partitionBy(*keys)
    numbered = points.withColumns({"i": F.row_number().over(view.orderBy("ord")).cast("long") - 1, "n_view": F.count(F.lit(1)).over(view)})
    chunk = F.floor(F.col("i") / CHUNK).alias("chunk")
    rows = numbered.groupBy(*keys, chunk, F.ceil(F.col("n_view") / CHUNK).alias("n_chunks"))
    return rows.agg(F.collect_list(F.struct("i", *[F.col(a).cast("double").alias(a) for a in P.AXES])).alias("points"))


def _shape(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _lists(column: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """Of each row the fields of its list of structs, as arrays."""
    for row in column:
        yield [np.asarray(f) for f in row.values.flatten()]


def _by_row(batch: pa.RecordBatch, keys: list[str], rows: list[int], **columns: pa.Array) -> pa.RecordBatch:
    """Columns beside the keys of the rows they come from."""
    return pa.record_batch([*[batch.column(k).take(pa.array(rows, pa.int64())) for k in keys], *columns.values()], names=[*keys, *columns])


def _corners(held: DataFrame, keys: list[str]) -> DataFrame:
    """Of each chunk the points that the view's triples name; the first one hands on the triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, (_, a, b, c) in zip(batch.column("points"), _lists(batch.column("triples")), strict=True):
                points = row.values
                place = np.asarray(points.field("i"))
                whole = np.all([np.asarray(points.field(x).is_valid()) for x in P.AXES], axis=0)
                out.append(points.filter(pa.array(np.isin(place, np.concatenate([a, b, c])) & whole)))
            if out:
                ends = np.cumsum([0, *map(len, out)])
                corners = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(out))
                first = pa.array(np.asarray(batch.column("chunk")) == 0)
                yield _by_row(batch, keys, list(range(batch.num_rows)), corners=corners, triples=pc.if_else(first, batch.column("triples"), pa.scalar(None, batch.column("triples").type)))

    corner = f"struct<i:bigint,{','.join(f'{x}:double' for x in P.AXES)}>"
    return held.select(*keys, "chunk", "points", "triples").mapInArrow(run, f"{_shape(held, keys)}, corners array<{corner}>, triples array<struct<iteration:int,a:bigint,b:bigint,c:bigint>>")


def _planes(named: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, c, d) with a unit normal through each triple of points, in the order of iterations; triples on a line have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, iterations, planes = [], [], []
            for at, ((place, *xyz), (iteration, *abc)) in enumerate(zip(_lists(batch.column("corners")), _lists(batch.column("triples")), strict=True)):
                order = np.argsort(place)
                place, xyz = place[order], np.stack(xyz, axis=1)[order]
                known = np.all([np.isin(i, place) for i in abc], axis=0)
                p, q, r = (xyz[np.searchsorted(place, i[known])].T for i in abc)
                (ux, uy, uz), (vx, vy, vz) = q - p, r - p
                n = [uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx]
                size = np.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
                flat = size <= 1e-12  # on a line
                a, b, c = (x[~flat] / size[~flat] for x in n)
                x, y, z = p[:, ~flat]
                rows.append(at)
                iterations.append(iteration[known][~flat])
                planes.append(np.stack([a, b, c, -(a * x + b * y + c * z)], axis=1))
            if rows:
                ends = pa.array(np.cumsum([0, *map(len, iterations)]), pa.int32())
                flat4 = np.concatenate(planes).ravel()
                four = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat4) + 1, 4), pa.int32()), pa.array(flat4))
                both = pa.StructArray.from_arrays([pa.array(np.concatenate(iterations), pa.int32()), four], names=["iteration", "plane"])
                yield _by_row(batch, keys, rows, planes=pa.ListArray.from_arrays(ends, both))

    return named.select(*keys, "corners", "triples").mapInArrow(run, f"{_shape(named, keys)}, planes array<struct<iteration:int,plane:array<double>>>")


def _near_planes(held: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Per chunk and plane: how many points lie within ``threshold``. A view of a single chunk gives only its best plane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, iterations, counts, planes = [], [], [], []
            for at, ((_, *xyz), row, n_chunks) in enumerate(zip(_lists(batch.column("points")), batch.column("planes"), batch.column("n_chunks").to_pylist(), strict=True)):
                if not len(row.values):
                    continue
                iteration = np.asarray(row.values.field("iteration"))
                plane = np.asarray(row.values.field("plane").flatten()).reshape(-1, 4)
                total = (np.abs(np.stack(xyz, axis=1) @ plane[:, :3].T + plane[:, 3]) <= threshold).sum(axis=0)
                take = [int(np.lexsort((iteration, -total))[0])] if n_chunks == 1 else range(len(total))
                rows += [at] * len(take)
                iterations += [int(iteration[i]) for i in take]
                counts += [int(total[i]) for i in take]
                planes += [plane[i].tolist() for i in take]
            if rows:
                yield _by_row(batch, keys, rows, iteration=pa.array(iterations, pa.int32()), n=pa.array(counts, pa.int64()), plane=pa.array(planes, pa.list_(pa.float64())))

    return held.select(*keys, "n_chunks", "points", "planes").mapInArrow(run, f"{_shape(held, keys)}, iteration int, n long, plane array<double>")


def draw_table(points: DataFrame, keys: list[str], iterations: int = K.PLANE_ITERATIONS, seed: int = K.PLANE_SEED) -> DataFrame:
    """Seeded triples for every view, from nothing but its number of points."""
    fields = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields if f.name != "n")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*[getattr(r, k) for k in keys], i, *t) for r in part.itertuples(index=False) for i, t in enumerate(draws(int(r.n), iterations, seed))]
            yield pd.DataFrame(rows, columns=[*keys, "iteration", "a", "b", "c"])

    return fields.mapInPandas(run, f"{shape}, iteration int, a long, b long, c long")


def plane_valid(points: DataFrame, planes: DataFrame, keys: list[str], threshold: float = K.PLANE_THRESHOLD) -> DataFrame:
    """First reason that forbids a kept plane for a new cloud; null allows it."""
    a, b, c, d = (F.col("plane")[i] for i in range(4))
    size = F.sqrt(a * a + b * b + c * c)
    far = P.plane_distance(F.col("plane"))
    inside = points.join(planes, keys)
    bad = F.isnan(far) | (F.abs(far) == float("inf"))
    stats = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"), F.count_if(F.abs(far) <= threshold).alias("near"), F.count_if(far > threshold).alias("up"), F.count_if(far < -threshold).alias("down"))
    n, near, side = F.coalesce("n", F.lit(0)), F.coalesce("near", F.lit(0)), F.coalesce(F.greatest("up", "down"), F.lit(0))
    reason = first_match(
        [
            (F.col("plane").isNull() | F.isnan(size) | ~F.coalesce(F.abs(size - 1) <= 1e-3, F.lit(False)), F.lit("plane_coefficients_invalid_or_not_normalized")),
            (F.abs(b) < K.CACHE_MIN_NORMAL_Y, F.lit("plane_normal_orientation_invalid")),
            (F.abs(d) > K.CACHE_MAX_OFFSET, F.lit("plane_offset_implausible")),
            (n < 3, F.lit("not_enough_points_for_cache_validation")),
            (F.coalesce("n_bad", F.lit(0)) > 0, F.lit("signed_distances_invalid")),
            (near < K.CACHE_MIN_INLIERS, F.lit("near_plane_inlier_count_too_low")),
            (near / n < K.CACHE_MIN_INLIER_RATIO, F.lit("near_plane_inlier_ratio_too_low")),
            (side < K.CACHE_MIN_SIDE, F.lit("remaining_non_table_points_too_low")),
            (side / n < K.CACHE_MIN_SIDE_RATIO, F.lit("above_below_distribution_implausible")),
        ]
    )
    return planes.join(stats, keys, "left").select(*keys, "plane", reason.alias("reason"), reason.isNull().alias("valid"))


def latest_plane(fits: DataFrame, cache_keys: list[str]) -> DataFrame:
    """For each capture the last valid plane of the same camera, profile and crop before it (``captured_at``)."""
    earlier = Window.partitionBy(*cache_keys).orderBy("captured_at").rowsBetween(Window.unboundedPreceding, -1)
    return fits.withColumn("cached_plane", F.last(F.when(F.col("valid"), F.col("plane")), ignorenulls=True).over(earlier))


# --- components
def voxel_clusters(points: DataFrame, keys: list[str], size: float = K.CLUSTER_VOXEL) -> DataFrame:
    """All points with the ``component`` of their voxel; voxels touch also at edges and corners."""
    cells = points.withColumns({f"v{a}": P.voxel(F.col(a), size) for a in P.AXES})
    axes = ["vx", "vy", "vz"]
    return cells.join(connected_cells(cells, keys, axes), [*keys, *axes])


def cluster_records(clustered: DataFrame, keys: list[str], least: int = K.CLUSTER_MIN_POINTS) -> DataFrame:
    """Size, voxels, centroid and box of each cluster of ``least`` points or more."""
    out = clustered.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("vx", "vy", "vz").alias("n_voxels"), *[f(a).alias(f"{n}_{a}") for a in P.AXES for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    return out.filter(F.col("n_points") >= least)


def _selection_state(lows: list[Column], highs: list[Column]) -> Column:
    return F.struct(*[c.alias(f"lo_{a}") for c, a in zip(lows, P.AXES, strict=True)], *[c.alias(f"hi_{a}") for c, a in zip(highs, P.AXES, strict=True)], F.array().cast("array<struct<component:bigint,reason:string>>").alias("seen"))


def select_clusters(records: DataFrame, keys: list[str]) -> DataFrame:
    """Fate of every cluster: ``primary``, ``merged`` or the reason it was left out.

    The largest plausible cluster, its size weighed down by its distance from the middle,
    is the primary one. The others follow in falling size; each is held against the box
    as it has grown so far, so the fold runs over a view's few clusters in order.
    """
    half = K.ROI_HALF_WIDTH
    span = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in P.AXES])
    early = first_match([(F.abs("mean_x") > K.CENTRAL_LIMIT * half, F.lit("centroid_outside_expected_object_zone")), (span > K.MAX_SPAN, F.lit("physically_implausible_span"))])
    score = F.col("n_points") / (1.0 + F.abs("mean_x") / max(0.01, half))
    judged = records.withColumns({"early": early, "score": F.when(early.isNull(), score)})
    item = F.struct((-F.col("n_points")).alias("o"), F.col("component"), F.col("n_points"), *[F.col(f"{n}_{a}") for n in ("min", "max") for a in P.AXES])
    per_view = judged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("early").isNull(), item))).alias("items"), F.max_by(item, F.struct(F.col("score"), F.col("n_points"), -F.col("component"))).alias("p"), F.max("score").alias("best"))
    p = F.col("p")

    def fold(state: Column, c: Column) -> Column:
        lo, hi = [state[f"lo_{a}"] for a in P.AXES], [state[f"hi_{a}"] for a in P.AXES]
        low, high = [c[f"min_{a}"] for a in P.AXES], [c[f"max_{a}"] for a in P.AXES]
        new_lo, new_hi = [F.least(x, y) for x, y in zip(lo, low, strict=True)], [F.greatest(x, y) for x, y in zip(hi, high, strict=True)]
        fate = first_match(
            [
                (c["component"] == p["component"], F.lit("primary")),
                (c["n_points"] > K.FRAGMENT_RATIO * p["n_points"], F.lit("large_separate_cluster")),
                (gap_3d(lo, hi, low, high) > K.MERGE_GAP, F.lit("fragment_too_far_from_primary")),
                (F.greatest(*[h - w for h, w in zip(new_hi, new_lo, strict=True)]) > K.MAX_SPAN, F.lit("merge_would_make_bounds_implausible")),
            ],
            F.lit("merged"),
        )
        grow = fate == "merged"
        seen = F.concat(state["seen"], F.array(F.struct(c["component"].alias("component"), fate.alias("reason"))))
        return F.struct(*[F.when(grow, n).otherwise(o).alias(f"lo_{a}") for n, o, a in zip(new_lo, lo, P.AXES, strict=True)], *[F.when(grow, n).otherwise(o).alias(f"hi_{a}") for n, o, a in zip(new_hi, hi, P.AXES, strict=True)], seen.alias("seen"))

    start = _selection_state([p[f"min_{a}"] for a in P.AXES], [p[f"max_{a}"] for a in P.AXES])
    fates = per_view.filter("best is not null").select(*keys, F.explode(F.aggregate("items", start, fold)["seen"]).alias("f")).select(*keys, "f.component", F.col("f.reason").alias("fate"))
    late = judged.join(fates, [*keys, "component"], "left")
    return late.withColumn("fate", F.coalesce("early", "fate")).drop("early", "score")


def table_planes(points: DataFrame, keys: list[str], voxel_size: float | None = None, most: int = K.PLANE_MAX_FIT_POINTS) -> DataFrame:
    """Table plane of each view and whether it took the second try: where too few thinned points agree, all points are fitted; null where these do not either."""
    sampled = written(plane_fit_points(points, keys, voxel_size, most), "sampled")
    first = written(fit_plane(sampled, keys, draw_table(sampled, keys)).filter("plane is not null").withColumn("full_resolution", F.lit(False)), "first")
    rest = points.join(first.select(*keys), keys, "left_anti")
    second = fit_plane(rest, keys, draw_table(rest, keys)).withColumn("full_resolution", F.lit(True))
    return first.unionByName(second)


def object_points(points: DataFrame, keys: list[str], *, planes: DataFrame | None = None, voxel_size: float | None = None) -> DataFrame:
    """The object of each view: crop, table plane, voxel clusters, choice. Views that fall under 30 points on the way give none."""
    inside = P.apply_roi(points).filter("inside").drop("inside")
    enough = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in")).filter(F.col("n_in") >= K.CLUSTER_MIN_POINTS)
    inside = inside.join(enough.select(*keys), keys, "left_semi")
    if planes is None:
        planes = table_planes(inside, keys, voxel_size)
    above = P.remove_plane(inside, planes.filter("plane is not null"), keys)
    clustered = voxel_clusters(above, keys)
    chosen = select_clusters(cluster_records(clustered, keys), keys).filter(F.col("fate").isin("primary", "merged"))
    return clustered.join(chosen.select(*keys, "component"), [*keys, "component"], "left_semi").drop("vx", "vy", "vz", "component")


# --- density clusters
def largest_cluster(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of the largest density cluster with its share.

    The whole cloud with share 0 when all is noise, and with share 1 when it is smaller
    than a cluster must be.
    """
    labelled = density_clusters(points, keys).drop("is_core")
    sizes = labelled.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy(*keys).agg(F.max_by("cluster", F.when(F.col("cluster") >= 0, F.struct(F.col("n"), -F.col("cluster")))).alias("best"), F.max(F.when(F.col("cluster") >= 0, F.col("n"))).alias("n_best"), F.sum("n").alias("n_all"), F.count_if(F.col("cluster") >= 0).alias("cluster_count"))
    kept = labelled.join(best, keys).filter(F.col("best").isNull() | (F.col("cluster") == F.col("best")))
    return kept.withColumn("largest_cluster_ratio", F.when(F.col("n_all") < K.DBSCAN_MIN, 1.0).otherwise(F.coalesce(F.col("n_best") / F.col("n_all"), F.lit(0.0)))).drop("cluster", "best", "n_best", "n_all")


def mask_components(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Number of four-connected parts of each mask."""
    return connected_cells(pixels, keys, ["row", "col"], diagonal=False).groupBy(*keys).agg((F.max("component") + 1).alias("n_components"))
