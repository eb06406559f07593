"""Point, plane, cluster and mask operators over the embeddings, orders and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.operators import cluster as C
from spanforge.operators import points as P
from spanforge.operators import vision as V
from spanforge.plans.base import query, r6

XYZ_SQL = "SELECT vec_id, label, embedding[1]::DOUBLE * 3 AS x, embedding[2]::DOUBLE * 3 AS y, abs(embedding[3]::DOUBLE) * 5 AS z FROM embeddings"


def xyz(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return t("embeddings").select("vec_id", "label", (e(0) * 3).alias("x"), (e(1) * 3).alias("y"), (F.abs(e(2)) * 5).alias("z"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.99) - quantile_cont(l_extendedprice, 0.01), 6) AS robust_span, round(max(l_extendedprice) - min(l_extendedprice), 6) AS full_span, count(*) AS n_points FROM lineitem GROUP BY 1")
def robust_span(t):
    out = P.quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.99])
    return out.select("l_returnflag", r6(F.col("q")[1] - F.col("q")[0]).alias("robust_span"), r6(F.col("high") - F.col("low")).alias("full_span"), F.col("n").alias("n_points"))


@query("""
SELECT label, count(*) AS n_points, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(max(y) - min(y), 6) AS vertical_m,
       round(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), 6) AS robust_x, round(quantile_cont(z, 0.99) - quantile_cont(z, 0.01), 6) AS robust_z,
       round((max(x) - min(x)) * 39.3701, 6) AS horizontal_in
FROM (%s) GROUP BY label""" % XYZ_SQL)
def cloud_dimensions(t):
    d = P.dimensions(xyz(t), ["label"])
    return d.select("label", "n_points", r6("min_x").alias("min_x"), r6("max_x").alias("max_x"), r6("vertical_span_m").alias("vertical_m"), r6("robust_x").alias("robust_x"), r6("robust_z").alias("robust_z"), r6("horizontal_span_in").alias("horizontal_in"))


@query("""
SELECT vec_id AS row, i - 1 AS col, round((i - 1 - 32) * d / 50, 6) AS x, round((vec_id - 100) * d / 50, 6) AS y, round(d, 6) AS z
FROM (SELECT vec_id, i, abs(embedding[i]::DOUBLE) AS d FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) WHERE d > 0""")
def deproject(t):
    px = t("embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).withColumn("depth", F.abs(F.col("v").cast("double")))
    out = P.deproject(px, fx=F.lit(50.0), fy=F.lit(50.0), cx=F.lit(32.0), cy=F.lit(100.0))
    return out.select("row", F.col("col").cast("long").alias("col"), r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


@query("SELECT vec_id, abs(x) <= 0.5334 + 0.05 AND z BETWEEN 0.25 - 0.05 AND 1.3168 + 0.05 AND y <= 1.0668 + 0.05 AS inside FROM (%s)" % XYZ_SQL)
def roi_filter(t):
    return P.apply_roi(xyz(t)).select("vec_id", "inside")


@query("""
WITH m AS (SELECT label, abs(x) <= 0.5834 AND z BETWEEN 0.2 AND 1.3668 AS inside FROM (%s)),
c AS (SELECT label, count(*) FILTER (inside) AS n_kept, count(*) FILTER (NOT inside) AS n_rejected FROM m GROUP BY label)
SELECT *, round(n_kept * 100.0 / (n_kept + n_rejected), 6) AS kept_percent,
       CASE WHEN n_kept = 0 THEN 'roi_empty' WHEN n_kept < 30 THEN 'too_few_points' WHEN n_kept < 0.05 * (n_kept + n_rejected) THEN 'roi_removed_most_points' ELSE 'ok' END AS status FROM c""" % XYZ_SQL)
def roi_report(t):
    out = P.roi_report(P.apply_roi(xyz(t), use_y=False), ["label"])
    return out.select("label", "n_kept", "n_rejected", r6("kept_percent").alias("kept_percent"), "status")


@query("""
WITH p AS (%s), b AS (SELECT label, quantile_cont(x, 0.04) AS x0, quantile_cont(x, 0.96) AS x1, quantile_cont(y, 0.04) AS y0, quantile_cont(y, 0.96) AS y1 FROM p GROUP BY label)
SELECT p.label, count(*) AS n_kept, round(sum(x), 6) AS sum_x FROM p JOIN b ON p.label = b.label AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY p.label""" % XYZ_SQL)
def central_crop(t):
    return P.central_crop(xyz(t), ["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("n_kept"), r6(F.sum("x")).alias("sum_x"))


@query("""
WITH d AS (SELECT *, 0.6 * y + 0.8 * z - 0.5 AS f FROM (%s)), s AS (SELECT label, count(*) FILTER (f > 0.008) >= count(*) FILTER (f < -0.008) AS up FROM d GROUP BY label)
SELECT vec_id, d.label FROM d JOIN s ON d.label = s.label WHERE CASE WHEN up THEN f > 0.008 ELSE f < -0.008 END""" % XYZ_SQL)
def plane_split(t):
    pts = xyz(t)
    planes = pts.select("label").distinct().withColumn("plane", F.array(F.lit(0.0), F.lit(0.6), F.lit(0.8), F.lit(-0.5)))
    return P.remove_plane(pts, planes, ["label"]).select("vec_id", "label")


#: Triples of points at even shares of each label's own number of points, in 97ths.
TRIPLES = [(i, (i * 7 + 1) % 97, (i * 11 + 30) % 97, (i * 5 + 60) % 97) for i in range(24)]
_T = ", ".join(map(str, TRIPLES))


@query(f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS m FROM ({XYZ_SQL})), t(iteration, a, b, c) AS (VALUES {_T}),
k AS (SELECT q.label, iteration, q.x AS px, q.y AS py, q.z AS pz, r.x - q.x AS ux, r.y - q.y AS uy, r.z - q.z AS uz, s.x - q.x AS vx, s.y - q.y AS vy, s.z - q.z AS vz
      FROM t JOIN p q ON q.i = t.a * q.m // 97 JOIN p r ON r.i = t.b * r.m // 97 AND r.label = q.label JOIN p s ON s.i = t.c * s.m // 97 AND s.label = q.label),
n AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM k),
u AS (SELECT label, iteration, nx / m AS a, ny / m AS b, nz / m AS c, -(nx * px + ny * py + nz * pz) / m AS d FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS m FROM n) WHERE m > 1e-12),
c AS (SELECT p.label, iteration, a, b, c, d, count(*) FILTER (abs(x * a + y * b + z * c + d) <= 0.05) AS n_inliers FROM p JOIN u ON p.label = u.label GROUP BY ALL),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY n_inliers DESC, iteration) = 1)
SELECT label, n_inliers, iteration, CASE WHEN found THEN round(b, 6) END AS normal_y, n_points, found
FROM (SELECT *, (SELECT count(*) FROM p WHERE p.label = best.label) AS n_points, n_inliers >= greatest(30, floor(0.03 * (SELECT count(*) FROM p WHERE p.label = best.label))) AS found FROM best)""")
def ransac_plane(t):
    pts = xyz(t).withColumn("ord", F.col("vec_id"))
    sizes = pts.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    shares = F.explode(F.array(*[F.struct(F.lit(i).alias("iteration"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for i, a, b, c in TRIPLES])).alias("s")
    triples = sizes.select("label", "m", shares).select("label", "s.iteration", *[F.floor(F.col(f"s.{c}") * F.col("m") / 97).alias(c) for c in ("a", "b", "c")])
    fit = C.fit_plane(pts, ["label"], triples, 0.05)
    return fit.select("label", "n_inliers", "iteration", r6(F.col("plane")[1]).alias("normal_y"), "n_points", F.col("plane").isNotNull().alias("found"))


@query("SELECT label, floor(x / 0.05)::BIGINT AS vx, floor(y / 0.05)::BIGINT AS vy, floor(z / 0.05)::BIGINT AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n_points FROM (%s) GROUP BY ALL" % XYZ_SQL)
def voxel_centroids(t):
    out = P.voxel_centroids(xyz(t), ["label"], 0.05)
    return out.select("label", "vx", "vy", "vz", *[r6(a).alias(a) for a in P.AXES], "n_points")


VOXELS_SQL = """v AS (SELECT DISTINCT label, floor(x / 0.4)::BIGINT AS a, floor(y / 0.4)::BIGINT AS b, floor(z / 0.4)::BIGINT AS c FROM (%s)),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a, b, c) AS id FROM v),
e AS (SELECT p.label, p.id AS s, q.id AS t FROM n p JOIN n q ON p.label = q.label AND abs(p.a - q.a) <= 1 AND abs(p.b - q.b) <= 1 AND abs(p.c - q.c) <= 1),
r AS (SELECT label, id AS s, id AS t FROM n UNION SELECT r.label, r.s, e.t FROM r JOIN e ON e.s = r.t AND e.label = r.label),
m AS (SELECT label, s, min(t) AS root FROM r GROUP BY label, s),
comp AS (SELECT n.label, a, b, c, dense_rank() OVER (PARTITION BY n.label ORDER BY root) - 1 AS component FROM n JOIN m ON n.id = m.s AND n.label = m.label)""" % XYZ_SQL


@query(f"WITH RECURSIVE {VOXELS_SQL} SELECT label, a AS vx, b AS vy, c AS vz, component FROM comp")
def voxel_components(t):
    cells = xyz(t).select("label", *[P.voxel(F.col(a), 0.4).alias(f"v{a}") for a in P.AXES])
    return C.connected_cells(cells, ["label"], ["vx", "vy", "vz"], tile=8, few=0).select("label", "vx", "vy", "vz", "component")


@query(f"""
WITH RECURSIVE {VOXELS_SQL}
SELECT p.label, component, count(*) AS n_points, count(DISTINCT (a, b, c)) AS n_voxels, round(avg(x), 6) AS mean_x, round(min(y), 6) AS min_y, round(max(z), 6) AS max_z
FROM ({XYZ_SQL}) p JOIN comp ON p.label = comp.label AND floor(x / 0.4)::BIGINT = a AND floor(y / 0.4)::BIGINT = b AND floor(z / 0.4)::BIGINT = c GROUP BY ALL HAVING count(*) >= 2""")
def cluster_boxes(t):
    records = C.cluster_records(C.voxel_clusters(xyz(t), ["label"], 0.4), ["label"], 2)
    return records.select("label", "component", "n_points", "n_voxels", r6("mean_x").alias("mean_x"), r6("min_y").alias("min_y"), r6("max_z").alias("max_z"))


FINE_SQL = VOXELS_SQL.replace("/ 0.4)", "/ 0.2)")


@query(f"""
WITH RECURSIVE {FINE_SQL},
rec AS (SELECT p.label, component, count(*) AS n, avg(x) AS mx, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz
  FROM ({XYZ_SQL}) p JOIN comp ON p.label = comp.label AND floor(x / 0.2)::BIGINT = a AND floor(y / 0.2)::BIGINT = b AND floor(z / 0.2)::BIGINT = c GROUP BY ALL HAVING count(*) >= 1),
j AS (SELECT *, CASE WHEN abs(mx) > 0.60 * 0.5334 THEN 'centroid_outside_expected_object_zone' WHEN greatest(hx - lx, hy - ly, hz - lz) > 2 THEN 'physically_implausible_span' END AS early FROM rec),
g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, component) AS o FROM j WHERE early IS NULL),
p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY n / (1 + abs(mx) / 0.5334) DESC, n DESC, component) = 1),
walk AS (SELECT label, 0::BIGINT AS o, NULL::BIGINT AS component, NULL::VARCHAR AS fate, lx, ly, lz, hx, hy, hz FROM p
  UNION ALL SELECT label, o, component, fate, CASE WHEN fate = 'merged' THEN ux ELSE lx END, CASE WHEN fate = 'merged' THEN uy ELSE ly END, CASE WHEN fate = 'merged' THEN uz ELSE lz END,
    CASE WHEN fate = 'merged' THEN vx ELSE hx END, CASE WHEN fate = 'merged' THEN vy ELSE hy END, CASE WHEN fate = 'merged' THEN vz ELSE hz END
  FROM (SELECT w.label, g.o, g.component, w.lx, w.ly, w.lz, w.hx, w.hy, w.hz, least(w.lx, g.lx) AS ux, least(w.ly, g.ly) AS uy, least(w.lz, g.lz) AS uz, greatest(w.hx, g.hx) AS vx, greatest(w.hy, g.hy) AS vy, greatest(w.hz, g.hz) AS vz,
    CASE WHEN g.component = p.component THEN 'primary' WHEN g.n > 0.35 * p.n THEN 'large_separate_cluster'
      WHEN sqrt(pow(greatest(0, w.lx - g.hx, g.lx - w.hx), 2) + pow(greatest(0, w.ly - g.hy, g.ly - w.hy), 2) + pow(greatest(0, w.lz - g.hz, g.lz - w.hz), 2)) > 0.08 THEN 'fragment_too_far_from_primary'
      WHEN greatest(greatest(w.hx, g.hx) - least(w.lx, g.lx), greatest(w.hy, g.hy) - least(w.ly, g.ly), greatest(w.hz, g.hz) - least(w.lz, g.lz)) > 2 THEN 'merge_would_make_bounds_implausible' ELSE 'merged' END AS fate
    FROM walk w JOIN g ON g.label = w.label AND g.o = w.o + 1 JOIN p ON p.label = w.label))
SELECT j.label, j.component, j.n AS n_points, coalesce(early, walk.fate) AS fate FROM j LEFT JOIN walk ON walk.label = j.label AND walk.component = j.component""")
def cluster_select(t):
    records = C.cluster_records(C.voxel_clusters(xyz(t), ["label"], 0.2), ["label"], 1)
    return C.select_clusters(records, ["label"]).select("label", "component", "n_points", "fate")


@query(f"""
WITH RECURSIVE p AS (SELECT * FROM ({XYZ_SQL})),
near AS (SELECT a.label, a.vec_id AS s, b.vec_id AS t FROM p a JOIN p b ON a.label = b.label AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 0.45),
core AS (SELECT label, s FROM near GROUP BY ALL HAVING count(*) >= 5),
e AS (SELECT near.* FROM near JOIN core c ON c.label = near.label AND c.s = near.s JOIN core d ON d.label = near.label AND d.s = near.t),
r AS (SELECT label, s, s AS t FROM core UNION SELECT r.label, r.s, e.t FROM r JOIN e ON e.label = r.label AND e.s = r.t),
m AS (SELECT label, s, min(t) AS root FROM r GROUP BY ALL)
SELECT p.label, p.vec_id, m.root IS NOT NULL AS is_core, m.root AS first_core, m.root IS NOT NULL OR EXISTS (SELECT 1 FROM near JOIN core USING (label, s) WHERE near.t = p.vec_id AND near.label = p.label) AS clustered
FROM p LEFT JOIN m ON m.label = p.label AND m.s = p.vec_id""")
def density_clusters(t):
    marked = C.density_clusters(xyz(t), ["label"], 0.45, 5, few=0)
    first = F.min(F.when(F.col("is_core"), F.col("vec_id"))).over(C.Window.partitionBy("label", "cluster"))
    return marked.select("label", "vec_id", "is_core", F.when(F.col("is_core"), first).alias("first_core"), (F.col("cluster") >= 0).alias("clustered"))


@query("""
WITH p AS (SELECT o_orderstatus, o_custkey %% 100 / 100.0 AS x, o_totalprice / 100000 AS y, o_orderkey %% 50 / 50.0 AS z FROM orders),
b AS (SELECT o_orderstatus, min(y) AS y0, max(y) AS y1, count(*) AS n, max(x) - min(x) AS sx, max(z) - min(z) AS sz FROM p GROUP BY 1),
h AS (SELECT p.*, b.*, least(greatest(floor((y - y0) / (y1 - y0) * 10), 0), 9) AS bin FROM p JOIN b ON p.o_orderstatus = b.o_orderstatus)
SELECT o_orderstatus, n AS n_points, round(quantile_cont(y * 39.3701, 0.5), 6) AS y_p50, round(quantile_cont(y * 39.3701, 0.95), 6) AS y_p95, round(avg(y * 39.3701), 4) AS mean_y,
       %s, round(n / (any_value(sx) * any_value(y1 - y0) * any_value(sz) * 39.3701 * 39.3701 * 39.3701), 6) AS compactness,
       round((max(x) FILTER (y BETWEEN y0 AND y0 + (y1 - y0) / 3) - min(x) FILTER (y BETWEEN y0 AND y0 + (y1 - y0) / 3)) * 39.3701, 6) AS lower_width
FROM h GROUP BY o_orderstatus, n""" % ", ".join(f"round(count(*) FILTER (bin = {i}) / n, 6) AS bin_{i}" for i in range(10)))
def vertical_profile(t):
    pts = t("orders").select("o_orderstatus", (F.col("o_custkey") % 100 / 100.0).alias("x"), (F.col("o_totalprice") / 100000).alias("y"), (F.col("o_orderkey") % 50 / 50.0).alias("z"))
    p = P.profile(pts, ["o_orderstatus"], any_size=True)
    q = lambda k: F.element_at("height_percentiles", F.lit(k))
    return p.select("o_orderstatus", "n_points", r6(q("y_p50")).alias("y_p50"), r6(q("y_p95")).alias("y_p95"), F.round("density_center_of_mass_y", 4).alias("mean_y"), *[r6(F.get("vertical_density_bins", F.lit(i))).alias(f"bin_{i}") for i in range(10)], r6("compactness").alias("compactness"), r6(F.element_at("thirds", F.lit("lower_third"))["width_in"]).alias("lower_width"))


@query("SELECT event_type, round(min(value), 6) AS min_depth, round(max(value), 6) AS max_depth, round(median(value), 6) AS median_depth, count(*) AS n_valid, round(count(*) * 100.0 / (SELECT count(*) FROM events e WHERE e.event_type = events.event_type), 6) AS valid_percent FROM events WHERE value > 0 GROUP BY event_type")
def depth_stats(t):
    out = P.depth_stats(t("events"), ["event_type"], "value", any_size=True)
    return out.select("event_type", *[r6(c).alias(c) for c in ("min_depth", "max_depth", "median_depth")], "n_valid", r6("valid_percent").alias("valid_percent"))


@query("""
WITH b AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, abs(embedding[3]::DOUBLE) * 100 + 5 AS w, abs(embedding[4]::DOUBLE) * 100 + 5 AS h FROM embeddings),
p AS (SELECT a.vec_id AS a_id, c.vec_id AS b_id, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, c.x AS cx, c.y AS cy, c.w AS cw, c.h AS ch FROM b a JOIN b c ON c.vec_id = a.vec_id + 1),
i AS (SELECT *, greatest(0, least(ax + aw, cx + cw) - greatest(ax, cx)) * greatest(0, least(ay + ah, cy + ch) - greatest(ay, cy)) AS s,
             greatest(0, ax - (cx + cw), cx - (ax + aw)) AS dx, greatest(0, ay - (cy + ch), cy - (ay + ah)) AS dy FROM p)
SELECT a_id, b_id, round(s, 6) AS shared, round(s / (aw * ah + cw * ch - s), 6) AS iou, round(sqrt(dx * dx + dy * dy), 6) AS gap,
       round(sqrt(pow(ax + aw / 2 - cx - cw / 2, 2) + pow(ay + ah / 2 - cy - ch / 2, 2)) / 200, 6) AS centre_distance FROM i""")
def box_iou(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    b = t("embeddings").select("vec_id", B.box(e(0), e(1), e(0) + F.abs(e(2)) + 5, e(1) + F.abs(e(3)) + 5).alias("box"))
    pairs = b.select(F.col("vec_id").alias("a_id"), F.col("box").alias("a")).join(b.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("box").alias("b")), "a_id")
    x, y = F.col("a"), F.col("b")
    return pairs.select("a_id", "b_id", r6(B.intersection(x, y)).alias("shared"), r6(B.iou(x, y)).alias("iou"), r6(B.gap(x, y)).alias("gap"), r6(B.centre_distance(x, y, F.lit(200.0))).alias("centre_distance"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (quality = 1 OR toxic = 0), 6) AS iou, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (quality = 1), 6) AS precision, round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (toxic = 0), 6) AS recall FROM labels")
def mask_eval(t):
    out = t("labels").agg(*V.evaluate(F.col("quality") == 1, F.col("toxic") == 0))
    return out.select("tp", "fp", "fn", *[r6(c).alias(c) for c in ("iou", "precision", "recall")])


@query("""
WITH a AS (SELECT DISTINCT l_returnflag AS view, l_suppkey % 20 AS row, l_partkey % 30 AS col FROM lineitem WHERE l_quantity > 48),
b AS (SELECT DISTINCT l_returnflag AS view, l_suppkey % 20 AS row, l_partkey % 30 AS col FROM lineitem WHERE l_discount > 0.09),
c AS (SELECT coalesce(a.view, b.view) AS view, a.view IS NOT NULL AS x, b.view IS NOT NULL AS y FROM a FULL JOIN b ON a.view = b.view AND a.row = b.row AND a.col = b.col)
SELECT view, count(*) FILTER (x) AS n_candidate, count(*) FILTER (y) AS n_reference, count(*) FILTER (x AND y) AS n_shared,
       round(count(*) FILTER (x AND y) / count(*) FILTER (x), 6) AS over_candidate, round(count(*) FILTER (x AND y) / count(*) FILTER (y), 6) AS over_reference FROM c GROUP BY view""")
def mask_overlap(t):
    px = t("lineitem").select(F.col("l_returnflag").alias("view"), (F.col("l_suppkey") % 20).alias("row"), (F.col("l_partkey") % 30).alias("col"), "l_quantity", "l_discount")
    out = V.mask_overlap(px.filter("l_quantity > 48").select("view", "row", "col").distinct(), px.filter("l_discount > 0.09").select("view", "row", "col").distinct(), ["view"])
    return out.select("view", "n_candidate", "n_reference", "n_shared", r6("over_candidate").alias("over_candidate"), r6("over_reference").alias("over_reference"))


@query("""
WITH d AS (SELECT vec_id % 25 AS view, vec_id AS idx, CASE label % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'pot' WHEN 2 THEN 'table' ELSE 'leaf' END AS segment, abs(embedding[1]::DOUBLE) * 4 AS confidence,
  800 + floor(abs(embedding[2]::DOUBLE) * 8000) AS n_pixels, abs(embedding[3]::DOUBLE) * 1000 AS x1, abs(embedding[4]::DOUBLE) * 800 AS y1, abs(embedding[3]::DOUBLE) * 1000 + 100 + abs(embedding[5]::DOUBLE) * 1500 AS x2, abs(embedding[4]::DOUBLE) * 800 + 100 + abs(embedding[6]::DOUBLE) * 1500 AS y2 FROM embeddings),
a AS (SELECT *, (x2 - x1) * (y2 - y1) / (1280.0 * 800) AS area, n_pixels >= 1000 AS usable FROM d),
o AS (SELECT view, arg_max(idx, (confidence + least(area, 0.35), -idx)) AS oi, arg_max({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}, (confidence + least(area, 0.35), -idx)) AS ob FROM a WHERE segment = 'object' AND usable GROUP BY view),
j AS (SELECT a.*, ob, oi, coalesce(greatest(0, least(x2, ob.x2) - greatest(x1, ob.x1)) * greatest(0, least(y2, ob.y2) - greatest(y1, ob.y1)) / greatest(1, (x2 - x1) * (y2 - y1)), 0) AS box, coalesce(greatest(0, least(x2, ob.x2) - greatest(x1, ob.x1)) * greatest(0, least(y2, ob.y2) - greatest(y1, ob.y1)) / ((x2 - x1) * (y2 - y1)), 0) AS share,
  coalesce(sqrt(pow((x1 + x2 - ob.x1 - ob.x2) / 2, 2) + pow((y1 + y2 - ob.y1 - ob.y2) / 2, 2)) / sqrt(1280.0 * 1280 + 800 * 800), 0) AS far,
  (x1 <= 1280 * 0.03 OR x2 >= 1280 * 0.97) AND area < 0.01 AS tiny, (y1 + y2) / 2 / 800 AS cy FROM a LEFT JOIN o ON a.view = o.view),
r AS (SELECT *, CASE WHEN NOT usable THEN 'mask_pixel_count_below_minimum'
  WHEN segment = 'object' THEN CASE WHEN idx <> oi THEN 'lower_quality_than_selected_object' ELSE '' END
  WHEN segment = 'pot' THEN concat_ws(',', CASE WHEN confidence < 0.4 THEN 'pot_confidence_below_minimum' END, CASE WHEN ob IS NOT NULL AND share < 0.03 AND box < 0.05 AND far > 0.35 THEN 'pot_not_spatially_consistent_with_object' END, CASE WHEN tiny AND share < 0.03 AND box < 0.05 THEN 'tiny_edge_pot_without_strong_object_overlap' END)
  WHEN segment = 'table' THEN concat_ws(',', CASE WHEN area < 0.05 THEN 'table_area_below_minimum' END, CASE WHEN cy < 0.45 THEN 'table_not_low_enough_in_image' END)
  WHEN ob IS NOT NULL AND share < 0.03 THEN 'leaf_not_overlapping_selected_object' ELSE '' END AS why FROM j),
s AS (SELECT *, CASE WHEN why <> '' AND (segment <> 'object' OR NOT usable) THEN NULL WHEN segment = 'object' THEN confidence + least(area, 0.35) WHEN segment = 'pot' THEN confidence + 2 * share + box - far - CASE WHEN tiny THEN 0.25 ELSE 0 END
  WHEN segment = 'table' THEN confidence + area + cy ELSE confidence + share END AS score FROM r),
w AS (SELECT *, why = '' AND row_number() OVER (PARTITION BY view, segment, why = '' ORDER BY score DESC NULLS LAST, idx) = 1 AS chosen FROM s)
SELECT view, idx, segment, CASE WHEN chosen OR why <> '' THEN why ELSE 'lower_quality_than_selected_' || segment END AS reasons,
  CASE WHEN chosen THEN 'selected_' WHEN why <> '' THEN 'rejected_' ELSE 'rejected_lower_quality_for_' END || segment AS decision, round(score, 6) AS score, chosen FROM w""")
def detection_rank(t):
    e = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    label = F.element_at(F.array(F.lit("Potted plant"), F.lit("plant pot"), F.lit("dining table"), F.lit("leaves")), (F.col("label") % 4 + 1).cast("int"))
    x1, y1 = e(2) * 1000, e(3) * 800
    d = t("embeddings").select((F.col("vec_id") % 25).alias("view"), F.col("vec_id").alias("idx"), label.alias("label"), (e(0) * 4).alias("confidence"), (800 + F.floor(e(1) * 8000)).alias("n_pixels"), B.box(x1, y1, x1 + 100 + e(4) * 1500, y1 + 100 + e(5) * 1500).alias("box"), F.lit(1280.0).alias("width"), F.lit(800.0).alias("height"))
    return V.select_detections(d, ["view"]).select("view", "idx", "segment", F.array_join("reasons", ",").alias("reasons"), "decision", r6("score").alias("score"), "chosen")
