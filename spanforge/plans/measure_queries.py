"""Sizes of views with their warnings and errors, and density clusters, against SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.operators import cluster as C
from spanforge.operators import measuring as M
from spanforge.plans.base import query, r6
from spanforge.plans.plane_queries import _T, scene, scene_sql, stated_fit

PER = 60


def largest_sql(src: str) -> str:
    """CTE ``big``: of the points of each view in ``src`` (view, id, x, y, z) its largest density cluster, with its share and the number of clusters."""
    return f"""
near AS MATERIALIZED (SELECT a.view, a.id AS s, b.id AS t, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d FROM {src} a JOIN {src} b ON a.view = b.view AND abs(a.x - b.x) <= 0.041 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.04),
core AS MATERIALIZED (SELECT view, s FROM near GROUP BY ALL HAVING count(*) >= 30),
link AS MATERIALIZED (SELECT n.view, n.s, n.t FROM near n JOIN core c ON c.view = n.view AND c.s = n.s JOIN core d ON d.view = n.view AND d.s = n.t),
walk AS (SELECT view, s, s AS t FROM core UNION SELECT w.view, w.s, l.t FROM walk w JOIN link l ON l.view = w.view AND l.s = w.t),
root AS MATERIALIZED (SELECT view, s, min(t) AS root FROM walk GROUP BY view, s),
edge_of AS (SELECT n.view, n.s, arg_min(r.root, (n.d, p.x, p.y, p.z)) AS root FROM near n JOIN root r ON r.view = n.view AND r.s = n.t JOIN {src} p ON p.view = n.view AND p.id = n.t WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.view = n.view AND c.s = n.s) GROUP BY n.view, n.s),
held AS MATERIALIZED (SELECT * FROM root UNION ALL SELECT * FROM edge_of),
first_of AS (SELECT r.view, r.root, min((p.x, p.y, p.z)) AS least FROM root r JOIN {src} p ON p.view = r.view AND p.id = r.s GROUP BY r.view, r.root),
sized AS (SELECT h.view, h.root, count(*) AS n FROM held h GROUP BY h.view, h.root),
best AS MATERIALIZED (SELECT s.view, s.root, s.n, count(*) OVER (PARTITION BY s.view) AS clusters FROM sized s JOIN first_of f ON f.view = s.view AND f.root = s.root QUALIFY row_number() OVER (PARTITION BY s.view ORDER BY s.n DESC, f.least) = 1),
many AS (SELECT view, count(*) AS n_all FROM {src} GROUP BY view),
big AS MATERIALIZED (SELECT p.*, coalesce(b.n / m.n_all, 0) AS ratio, coalesce(b.clusters, 0) AS clusters FROM {src} p JOIN many m ON m.view = p.view LEFT JOIN best b ON b.view = p.view LEFT JOIN held h ON h.view = p.view AND h.s = p.id WHERE b.root IS NULL OR h.root = b.root)"""


SIZED_SQL = """
dim AS (SELECT view, count(*) AS n_object, any_value(ratio) AS ratio, any_value(clusters) AS clusters, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz,
  CASE WHEN count(*) < 10 THEN max(x) - min(x) ELSE quantile_cont(x, 0.99) - quantile_cont(x, 0.01) END AS rx FROM big GROUP BY view)"""


@query(f"""
WITH RECURSIVE {scene_sql(PER)},
roi AS MATERIALIZED (SELECT *, abs(x) <= 0.5834 AND z BETWEEN 0.25 - 0.05 AND 1.3168 + 0.05 AS inside FROM p),
cnt AS (SELECT view, count(*) AS n_input, count(*) FILTER (inside) AS n_roi FROM roi GROUP BY view),
lim AS (SELECT view, quantile_cont(x, 0.04) AS x0, quantile_cont(x, 0.96) AS x1, quantile_cont(y, 0.04) AS y0, quantile_cont(y, 0.96) AS y1 FROM roi WHERE inside GROUP BY view),
cen AS MATERIALIZED (SELECT r.view, x, y, z, row_number() OVER w - 1 AS i, row_number() OVER w AS id, count(*) OVER (PARTITION BY r.view) AS m FROM roi r JOIN lim ON lim.view = r.view WHERE inside AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WINDOW w AS (PARTITION BY r.view ORDER BY x, y, z)),
t(iteration, ta, tb, tc) AS (VALUES {_T}),
tri AS (SELECT q.view, iteration, q.x AS px, q.y AS py, q.z AS pz, r.x - q.x AS ux, r.y - q.y AS uy, r.z - q.z AS uz, o.x - q.x AS vx, o.y - q.y AS vy, o.z - q.z AS vz
  FROM t JOIN cen q ON q.i = t.ta * q.m // 97 AND q.m >= 30 JOIN cen r ON r.i = t.tb * r.m // 97 AND r.view = q.view JOIN cen o ON o.i = t.tc * o.m // 97 AND o.view = q.view),
nor AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM tri),
pl AS (SELECT view, iteration, nx / g AS a, ny / g AS b, nz / g AS c, -(nx * px + ny * py + nz * pz) / g AS d FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS g FROM nor) WHERE g > 1e-12),
hit AS (SELECT pl.view, iteration, a, b, c, d, count(*) FILTER (abs(x * a + y * b + z * c + d) <= 0.015) AS n_inliers, count(*) AS m FROM cen JOIN pl ON pl.view = cen.view GROUP BY ALL),
fit AS MATERIALIZED (SELECT *, n_inliers >= greatest(30, floor(m * 0.03)) AND n_inliers >= greatest(100, floor(m * 0.05)) AS found FROM hit QUALIFY row_number() OVER (PARTITION BY view ORDER BY n_inliers DESC, iteration) = 1),
far AS (SELECT cen.view, cen.id, cen.x, cen.y, cen.z, cen.x * a + cen.y * b + cen.z * c + d AS f FROM cen JOIN fit ON fit.view = cen.view AND found),
side AS (SELECT view, count(*) FILTER (f > 0.015) >= count(*) FILTER (f < -0.015) AS up FROM far GROUP BY view),
above AS MATERIALIZED (SELECT far.view, id, x, y, z FROM far JOIN side ON side.view = far.view WHERE CASE WHEN up THEN f ELSE -f END > 0.015 AND CASE WHEN up THEN f ELSE -f END <= 0.05 + 0.05),
cut AS (SELECT DISTINCT view FROM above),
left_over AS MATERIALIZED (SELECT * FROM above UNION ALL SELECT view, id, x, y, z FROM cen WHERE m >= 30 AND view NOT IN (SELECT view FROM cut)),
aft AS (SELECT view, count(*) AS n_after FROM left_over GROUP BY view),
usable AS MATERIALIZED (SELECT l.* FROM left_over l JOIN aft ON aft.view = l.view AND n_after >= 30),
{largest_sql("usable")},{SIZED_SQL},
j AS (SELECT c.*, coalesce((SELECT any_value(m) FROM cen WHERE cen.view = c.view), 0) AS n_centre, coalesce(f.found, false) AS table_found, coalesce(n_after, 0) AS n_after, coalesce(n_object, 0) AS n_object, ratio, clusters, sx, sy, sz, rx, k.view IS NOT NULL AS was_cut
  FROM cnt c LEFT JOIN fit f ON f.view = c.view LEFT JOIN aft a ON a.view = c.view LEFT JOIN dim d ON d.view = c.view LEFT JOIN cut k ON k.view = c.view),
e AS (SELECT *, CASE WHEN n_roi = 0 THEN 'No points remain after workspace ROI crop.' WHEN n_centre < 30 THEN 'Not enough points after ROI crop.' WHEN n_after < 30 THEN 'Not enough object points after table removal.' WHEN n_object < 30 THEN 'No usable object cluster found.' END AS error FROM j)
SELECT view, error, n_roi, n_centre, table_found, n_after, n_object, CASE WHEN n_object > 0 THEN round(ratio, 6) END AS largest_share, CASE WHEN n_object > 0 THEN clusters END AS n_clusters,
  CASE WHEN error IS NULL THEN round(sx, 6) END AS horizontal, CASE WHEN error IS NULL THEN round(rx, 6) END AS robust_horizontal, CASE WHEN error IS NULL THEN round(sy * 39.3701, 6) END AS vertical_in,
  concat_ws(',', CASE WHEN n_roi = 0 THEN 'roi_empty' END, CASE WHEN n_roi > 0 AND n_roi < 0.05 * n_input THEN 'roi_removed_most_points' END, CASE WHEN n_centre >= 30 AND table_found AND NOT was_cut THEN 'roi_empty' END, CASE WHEN n_centre >= 30 AND NOT table_found THEN 'no_table_found' END,
    CASE WHEN error IS NULL AND least(sx, sy, sz) <= 0 THEN 'dimension_suspicious' END, CASE WHEN error IS NULL AND greatest(sx, sy, sz) * 39.3701 > 120 THEN 'dimension_suspicious' END, CASE WHEN error IS NULL AND sy * 39.3701 < 1 THEN 'dimension_suspicious' END,
    CASE WHEN n_roi > 0 AND n_object < 500 THEN 'low_point_count' END) AS warnings FROM e""")
def object_sizes(t):
    """Views of about 240 points without a trusted cloud: cut, table off up to a height, largest cluster; every view keeps its row."""
    out = M.measure_object(scene(t, PER).drop("flat"), ["view"], fit=partial(stated_fit, threshold=K.MEASURE_PLANE), max_height=0.05)
    counts = [F.col(c).cast("long").alias(c) for c in ("n_roi", "n_centre")]
    return out.select("view", "error", *counts, "table_found", F.col("n_after_table").alias("n_after"), "n_object", r6("largest_cluster_ratio").alias("largest_share"), F.col("cluster_count").cast("long").alias("n_clusters"), r6("horizontal_span_m").alias("horizontal"), r6("robust_horizontal_span_m").alias("robust_horizontal"), r6("vertical_span_in").alias("vertical_in"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""
WITH RECURSIVE {scene_sql(PER)},
q AS (SELECT view, row_number() OVER (PARTITION BY view ORDER BY x, y, z) AS id, x, y, z, abs(x) <= 0.5834 AND z BETWEEN 0.25 - 0.05 AND 1.3168 + 0.05 AS inside FROM p WHERE NOT flat),
cnt AS (SELECT view, count(*) FILTER (inside) AS n_roi FROM q GROUP BY view), use AS MATERIALIZED (SELECT q.* FROM q JOIN cnt ON cnt.view = q.view AND n_roi >= 30 WHERE inside),
{largest_sql("use")},{SIZED_SQL}
SELECT c.view, n_roi, coalesce(n_object, 0) AS n_object, CASE WHEN n_roi = 0 THEN 'leaf_roi_empty' WHEN n_roi < 30 OR coalesce(n_object, 0) < 30 THEN 'leaf_low_point_count' END AS error, clusters AS n_clusters, round(ratio, 6) AS largest_share, CASE WHEN n_object >= 30 THEN round(sx, 6) END AS horizontal, CASE WHEN n_object >= 30 THEN round(sz * 39.3701, 6) END AS depth_in
FROM cnt c LEFT JOIN dim ON dim.view = c.view""")
def part_sizes(t):
    """The parts above the table as leaf clouds: largest cluster and its sizes, or the warning that takes their place."""
    out = M.measure_part(scene(t, PER).filter("not flat").drop("flat"), ["view"], "leaf")
    return out.select("view", F.col("n_roi").cast("long").alias("n_roi"), "n_object", "error", F.col("cluster_count").cast("long").alias("n_clusters"), r6("largest_cluster_ratio").alias("largest_share"), r6("horizontal_span_m").alias("horizontal"), r6("depth_span_in").alias("depth_in"))


@query(f"""
WITH {scene_sql(PER)},
d AS (SELECT view, count(*) AS n, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz, quantile_cont(y * 39.3701, 0.5) AS p50 FROM p WHERE NOT flat GROUP BY view)
SELECT view, n AS n_object, CASE WHEN n < 30 THEN 'Not enough points in final object_cloud.ply.' END AS error, CASE WHEN n >= 30 THEN round(sz, 6) END AS depth, CASE WHEN n >= 30 THEN round(p50, 6) END AS y_p50,
  CASE WHEN n < 30 THEN '' ELSE concat_ws(',', CASE WHEN least(sx, sy, sz) <= 0 THEN 'dimension_suspicious' END, CASE WHEN greatest(sx, sy, sz) * 39.3701 > 120 THEN 'dimension_suspicious' END, CASE WHEN sy * 39.3701 < 1 THEN 'dimension_suspicious' END, CASE WHEN n < 500 THEN 'low_point_count' END) END AS warnings FROM d""")
def trusted_sizes(t):
    """The parts above the table as trusted clouds, measured as they are."""
    out = M.measure_trusted(scene(t, PER).filter("not flat").drop("flat"), ["view"])
    return out.select("view", "n_object", "error", r6("depth_span_m").alias("depth"), r6(F.element_at("height_percentiles", F.lit("y_p50"))).alias("y_p50"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""
WITH {scene_sql(PER)},
k AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY view) AS m, abs(CASE WHEN view % 7 = 5 THEN z - 0.3::DOUBLE ELSE y END - 0.4::DOUBLE - 0.05::DOUBLE * (view // 6 % 5) - 0.02::DOUBLE * x) / sqrt(1.0004::DOUBLE) <= 0.008 AS near FROM p),
g AS (SELECT DISTINCT view, CASE WHEN m <= 40 THEN j ELSE floor(j * ((m - 1) / 39.0::DOUBLE))::BIGINT END AS i FROM (SELECT DISTINCT view, m FROM k), range(40) t(j)),
s AS (SELECT k.view, count(*) FILTER (near) AS n, count(*) AS m FROM k JOIN g ON g.view = k.view AND g.i = k.i GROUP BY k.view),
a AS (SELECT view, count(*) FILTER (near) AS n, count(*) AS m FROM k GROUP BY view)
SELECT a.view, view_ok AND (first_ok OR second_ok) AS found, CASE WHEN view_ok AND (first_ok OR second_ok) THEN NOT first_ok END AS full_resolution, CASE WHEN view_ok AND first_ok THEN sn WHEN view_ok AND second_ok THEN an END AS n_inliers, CASE WHEN view_ok AND (first_ok OR second_ok) THEN CASE WHEN a.view % 7 = 5 THEN 0.0 ELSE 0.9998 END END AS normal_y
FROM (SELECT a.view, s.n AS sn, a.n AS an, a.view % 11 <> 9 AS view_ok, s.n >= greatest(30, floor(s.m * 0.03)) AS first_ok, a.n >= greatest(30, floor(a.m * 0.03)) AS second_ok FROM a JOIN s ON s.view = a.view) a""")
def table_plane_tries(t):
    """Seeded draws over 40 points of each view, and over all of them where too few of those agree. The table holds more than half of a view, so the draws find it."""
    planes = C.table_planes(scene(t, PER).drop("flat"), ["view"], most=40)
    planes = planes.withColumn("plane", F.when(F.col("view") % 11 != 9, F.col("plane")))  # scattered views hold whatever the draws find
    found = F.col("plane").isNotNull()
    return planes.select("view", found.alias("found"), F.when(found, F.col("full_resolution")).alias("full_resolution"), F.when(found, F.col("n_inliers")).alias("n_inliers"), F.round(F.abs(F.get("plane", F.lit(1))), 4).alias("normal_y"))
