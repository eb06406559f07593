"""Objects of views whose table plane is kept from capture to capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.operators import cluster as C
from spanforge.operators import planes as Pl
from spanforge.plans.base import query
from spanforge.plans.points_queries import TRIPLES

_T = ", ".join(map(str, TRIPLES))

def scene_sql(per: int) -> str:
    """Orders in runs of ``per`` are views and their lines are points: a tilted table whose height changes
    every sixth view, and an object above it. Some views stand upright, are scattered, lie outside
    the crop, hold the table alone, or an object aside."""
    return f"""
p0 AS (SELECT l_orderkey // {per} AS view, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 100 + l_quantity::BIGINT AS ord, l_linenumber <= 4 OR l_orderkey // {per} % 19 = 6 AS flat, (l_partkey * 7 + l_orderkey * 31 + l_linenumber * 271) % 1000 / 1000.0::DOUBLE AS u, (l_partkey * 17 + l_orderkey * 3 + l_linenumber * 97) % 997 / 997.0::DOUBLE AS v, (l_quantity % 10)::DOUBLE / 100.0::DOUBLE AS h, 0.4::DOUBLE + 0.05::DOUBLE * (l_orderkey // {6 * per} % 5) AS base FROM lineitem),
p1 AS (SELECT view, ord, flat, CASE WHEN flat THEN u - 0.5::DOUBLE ELSE u * 0.1::DOUBLE - 0.05::DOUBLE + CASE WHEN view % 5 = 4 THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END END AS x,
  CASE WHEN view % 11 = 9 THEN (u * 7919 + v * 104729) % 1.0::DOUBLE WHEN flat THEN base + 0.02::DOUBLE * (u - 0.5::DOUBLE) ELSE base - 0.05::DOUBLE - h END AS y, CASE WHEN flat THEN 0.3::DOUBLE + v ELSE 0.7::DOUBLE + v * 0.1::DOUBLE END + CASE WHEN view % 17 = 16 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS z FROM p0),
p AS (SELECT view, ord, flat, x, CASE WHEN view % 7 = 5 THEN z - 0.3::DOUBLE ELSE y END AS y, CASE WHEN view % 7 = 5 THEN y + 0.3::DOUBLE ELSE z END AS z FROM p1)"""


def scene(t, per: int = 250):
    """The points of ``scene_sql``."""
    key = F.col("l_orderkey")
    view = F.floor(key / per)
    u = ((F.col("l_partkey") * 7 + key * 31 + F.col("l_linenumber") * 271) % 1000) / F.lit(1000.0)
    v = ((F.col("l_partkey") * 17 + key * 3 + F.col("l_linenumber") * 97) % 997) / F.lit(997.0)
    p0 = t("lineitem").select(view.alias("view"), (((key * 10 + F.col("l_linenumber")) * 100_000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("ord"), ((F.col("l_linenumber") <= 4) | (view % 19 == 6)).alias("flat"), u.alias("u"), v.alias("v"), ((F.col("l_quantity") % 10).cast("double") / F.lit(100.0)).alias("h"), (F.lit(0.4) + F.lit(0.05) * (F.floor(key / (6 * per)) % 5)).alias("base"))
    view = F.col("view")
    x = F.when(F.col("flat"), F.col("u") - 0.5).otherwise(F.col("u") * 0.1 - 0.05 + F.when(view % 5 == 4, 0.45).otherwise(0.0))
    y = F.when(view % 11 == 9, (F.col("u") * 7919 + F.col("v") * 104729) % F.lit(1.0)).when(F.col("flat"), F.col("base") + F.lit(0.02) * (F.col("u") - 0.5)).otherwise(F.col("base") - 0.05 - F.col("h"))
    z = F.when(F.col("flat"), F.lit(0.3) + F.col("v")).otherwise(F.lit(0.7) + F.col("v") * 0.1) + F.when(view % 17 == 16, 5.0).otherwise(0.0)
    p1 = p0.select("view", "ord", "flat", x.alias("x"), y.alias("y"), z.alias("z"))
    up = view % 7 == 5
    return p1.select("view", "ord", "flat", "x", F.when(up, F.col("z") - 0.3).otherwise(F.col("y")).alias("y"), F.when(up, F.col("y") + 0.3).otherwise(F.col("z")).alias("z"))


def stated_fit(own, threshold=K.PLANE_THRESHOLD):
    """Planes through stated triples, at even shares of a view's points."""
    sizes = own.groupBy("view").agg(F.count(F.lit(1)).alias("m"))
    shares = F.explode(F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, a, b, c in TRIPLES])).alias("s")
    return C.fit_plane(own, ["view"], sizes.select("view", "m", shares).select("view", "s.iteration", *[F.floor(F.col(f"s.{c}") * F.col("m") / 97).alias(c) for c in ("a", "b", "c")]), threshold)


@query(f"""
WITH RECURSIVE {scene_sql(250)},
views AS (SELECT DISTINCT view, view // 15 AS setting, view % 13 <> 12 AS has_depth FROM p),
roi AS MATERIALIZED (SELECT * FROM p WHERE abs(x) <= 0.5334 + 0.05 AND z BETWEEN 0.25 - 0.05 AND 1.3168 + 0.05 AND y <= 1.0668 + 0.05),
n AS (SELECT v.*, (SELECT count(*) FROM roi WHERE roi.view = v.view) AS n_roi FROM views v),
e AS (SELECT *, CASE WHEN NOT has_depth THEN 'geometry_primary_missing_depth_aligned_to_rgb' WHEN n_roi < 30 THEN 'geometry_primary_roi_too_few_points:' || n_roi END AS early FROM n),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY setting ORDER BY view) AS k FROM e WHERE early IS NULL),
i AS MATERIALIZED (SELECT roi.*, row_number() OVER (PARTITION BY roi.view ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY roi.view) AS m FROM roi JOIN s ON s.view = roi.view), t(iteration, ta, tb, tc) AS (VALUES {_T}),
tri AS (SELECT q.view, iteration, q.x AS px, q.y AS py, q.z AS pz, r.x - q.x AS ux, r.y - q.y AS uy, r.z - q.z AS uz, o.x - q.x AS vx, o.y - q.y AS vy, o.z - q.z AS vz
  FROM t JOIN i q ON q.i = t.ta * q.m // 97 JOIN i r ON r.i = t.tb * r.m // 97 AND r.view = q.view JOIN i o ON o.i = t.tc * o.m // 97 AND o.view = q.view),
nor AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM tri),
pl AS (SELECT view, iteration, nx / g AS a, ny / g AS b, nz / g AS c, -(nx * px + ny * py + nz * pz) / g AS d FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS g FROM nor) WHERE g > 1e-12),
cnt AS (SELECT pl.view, iteration, a, b, c, d, count(*) FILTER (abs(x * a + y * b + z * c + d) <= 0.008) AS n_inliers, count(*) AS m FROM i JOIN pl ON pl.view = i.view GROUP BY ALL),
fit AS MATERIALIZED (SELECT *, n_inliers >= greatest(30, floor(m * 0.03)) AS found FROM cnt QUALIFY row_number() OVER (PARTITION BY view ORDER BY n_inliers DESC, iteration) = 1),
stat AS (SELECT s.view, f.view AS src, any_value(f.b) AS b, any_value(f.d) AS d, count(*) AS n, count(*) FILTER (abs(x * a + y * f.b + z * c + f.d) <= 0.008) AS near, greatest(count(*) FILTER (x * a + y * f.b + z * c + f.d > 0.008), count(*) FILTER (x * a + y * f.b + z * c + f.d < -0.008)) AS side
  FROM s JOIN s o ON o.setting = s.setting AND o.view <= s.view JOIN fit f ON f.view = o.view AND found JOIN i ON i.view = s.view GROUP BY s.view, f.view),
val AS MATERIALIZED (SELECT view, src, CASE WHEN abs(b) < 0.85 THEN 'plane_normal_orientation_invalid' WHEN abs(d) > 2 THEN 'plane_offset_implausible' WHEN n < 3 THEN 'not_enough_points_for_cache_validation' WHEN near < 500 THEN 'near_plane_inlier_count_too_low'
  WHEN near / n < 0.2 THEN 'near_plane_inlier_ratio_too_low' WHEN side < 30 THEN 'remaining_non_table_points_too_low' WHEN side / n < 0.03 THEN 'above_below_distribution_implausible' END AS reason FROM stat),
w AS (SELECT DISTINCT setting, 0::BIGINT AS k, NULL::BIGINT AS view, NULL::BIGINT AS kept, NULL::BIGINT AS used, NULL::VARCHAR AS source, NULL::VARCHAR AS cache_reason, NULL::VARCHAR AS refit_reason, NULL::BOOLEAN AS replaced FROM s
  UNION ALL SELECT w.setting, s.k, s.view, CASE WHEN old.view IS NOT NULL AND old.reason IS NULL THEN w.kept WHEN own.view IS NOT NULL AND own.reason IS NULL THEN s.view ELSE w.kept END,
    CASE WHEN old.view IS NOT NULL AND old.reason IS NULL THEN w.kept ELSE own.src END, CASE WHEN old.view IS NOT NULL AND old.reason IS NULL THEN 'cache' ELSE 'ransac' END,
    CASE WHEN old.view IS NULL THEN 'cache_miss' ELSE old.reason END, CASE WHEN old.view IS NULL OR old.reason IS NOT NULL THEN own.reason END,
    (old.view IS NULL OR old.reason IS NOT NULL) AND own.view IS NOT NULL AND own.reason IS NULL
  FROM w JOIN s ON s.setting = w.setting AND s.k = w.k + 1 LEFT JOIN val old ON old.view = s.view AND old.src = w.kept LEFT JOIN val own ON own.view = s.view AND own.src = s.view),
dist AS (SELECT i.view, i.x, i.y, i.z, i.x * a + i.y * b + i.z * c + d AS f FROM w JOIN i ON i.view = w.view JOIN fit ON fit.view = w.used),
side AS (SELECT view, count(*) FILTER (f > 0.008) >= count(*) FILTER (f < -0.008) AS up FROM dist GROUP BY view),
ab AS MATERIALIZED (SELECT dist.* FROM dist JOIN side ON side.view = dist.view WHERE CASE WHEN up THEN f > 0.008 ELSE f < -0.008 END),
na AS (SELECT view, count(*) AS n_above FROM ab GROUP BY view),
cell AS MATERIALIZED (SELECT ab.view, floor(x / 0.025)::BIGINT AS vx, floor(y / 0.025)::BIGINT AS vy, floor(z / 0.025)::BIGINT AS vz, count(*) AS n, sum(x) AS sx, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM ab JOIN na ON na.view = ab.view AND n_above >= 30 GROUP BY ALL),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY view ORDER BY vx, vy, vz) AS id FROM cell),
edge AS MATERIALIZED (SELECT g.view, g.id AS f, o.id AS t FROM num g JOIN num o ON g.view = o.view AND abs(g.vx - o.vx) <= 1 AND abs(g.vy - o.vy) <= 1 AND abs(g.vz - o.vz) <= 1),
reach AS (SELECT view, id AS f, id AS t FROM num UNION SELECT r.view, r.f, e.t FROM reach r JOIN edge e ON e.view = r.view AND e.f = r.t),
comp AS (SELECT view, f AS id, min(t) AS root FROM reach GROUP BY view, f),
rec AS (SELECT num.view, root, sum(n)::BIGINT AS n, sum(sx) / sum(n) AS mx, greatest(max(x1) - min(x0), max(y1) - min(y0), max(z1) - min(z0)) AS span FROM num JOIN comp ON comp.view = num.view AND comp.id = num.id GROUP BY num.view, root HAVING sum(n) >= 30),
few AS (SELECT view, count(*) FILTER (abs(mx) <= 0.6 * 0.5334 AND span <= 2) AS n_plausible, count(*) AS n_clusters FROM rec GROUP BY view)
SELECT e.view, e.n_roi, source, cache_reason, refit_reason, replaced, coalesce(n_above, 0) AS n_above,
  CASE WHEN early IS NOT NULL THEN early WHEN used IS NULL THEN 'geometry_primary_table_plane_too_few_inliers' WHEN coalesce(n_above, 0) < 30 THEN 'geometry_primary_table_removal_too_few_points:' || coalesce(n_above, 0)
    WHEN n_clusters IS NULL THEN 'geometry_primary_no_clusters_after_table_removal' WHEN n_plausible = 0 THEN 'geometry_primary_no_plausible_central_cluster' END AS error
FROM e LEFT JOIN w ON w.view = e.view LEFT JOIN na ON na.view = e.view LEFT JOIN few ON few.view = e.view""")
def view_extraction(t):
    """Every view with the way it came to its plane and the error that left it without an object."""
    points = scene(t).drop("flat")
    captures = points.select("view").distinct().select("view", F.floor(F.col("view") / 15).alias("setting"), (F.col("view") % 13 != 12).alias("has_depth"))
    _, status = Pl.extract_objects(points, captures, view=["view"], cache=["setting"], order=["view"], fit=stated_fit)
    return status.select("view", "n_roi", "source", "cache_reason", "refit_reason", "replaced", "n_above", "error")
