"""Clouds, masks, camera frames and files over the embeddings, lineitem and events tables."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.functions import constants as K
from spanforge.operators import catalogue as Cat
from spanforge.operators import cluster as C
from spanforge.operators import features as Fe
from spanforge.operators import points as P
from spanforge.operators import training as Tr
from spanforge.operators import vision as V
from spanforge.plans.base import ORACLE_SQL, QUERIES, query, r6, scratch
from spanforge.plans.points_queries import XYZ_SQL, xyz
from spanforge.plans.state_queries import rocks_store
from spanforge.sources import files as S
from spanforge.streaming import sessions as Se

MASK_SQL = "SELECT DISTINCT l_returnflag AS view, (l_suppkey * 7 + l_orderkey) % 60 AS row, l_partkey % 80 AS col FROM lineitem"


def mask_pixels(t):
    return t("lineitem").select(F.col("l_returnflag").alias("view"), ((F.col("l_suppkey") * 7 + F.col("l_orderkey")) % 60).alias("row"), (F.col("l_partkey") % 80).alias("col")).distinct()


@query("""
WITH p AS (SELECT l_returnflag AS view, CASE WHEN l_linenumber = 2 THEN 'nan'::DOUBLE WHEN l_linenumber = 3 THEN 'infinity'::DOUBLE ELSE l_quantity * CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0.1 END END AS x, l_discount::DOUBLE AS y, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_tax::DOUBLE END AS z FROM lineitem),
k AS (SELECT * FROM p WHERE NOT isnan(x) AND NOT isinf(x) AND z IS NOT NULL),
s AS (SELECT view, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) > 20 AS scaled, count(*) AS n, max(x) AS mx FROM k GROUP BY view)
SELECT view, n, scaled, round(CASE WHEN scaled THEN mx / 1000 ELSE mx END, 9) AS max_x FROM s""")
def cloud_input(t):
    n = F.col("l_linenumber")
    x = F.when(n == 2, float("nan")).when(n == 3, float("inf")).otherwise(F.col("l_quantity") * F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.1))
    pts = t("lineitem").select(F.col("l_returnflag").alias("view"), x.cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.when(n != 4, F.col("l_tax").cast("double")).alias("z"))
    out = P.normalise_units(P.finite_points(pts), ["view"])
    return out.groupBy("view").agg(F.count(F.lit(1)).alias("n"), F.bool_or("scaled").alias("scaled"), F.round(F.max("x"), 9).alias("max_x"))


@query("SELECT event_id, event_id % 40 + 0.0::DOUBLE AS x, event_id % 30 + 0.0::DOUBLE AS y, value AS z FROM events WHERE value > 0")
def raw_cloud(t):
    out = P.raw_points(t("events").select("event_id", (F.col("event_id") % 40).alias("col"), (F.col("event_id") % 30).alias("row"), F.col("value").alias("depth")))
    return out.select("event_id", "x", "y", "z")


@query("""
WITH p AS (SELECT vec_id, label, x, y + 0.01 AS ty, z + 0.02 AS tz, y, z FROM (%s)),
s AS (SELECT *, round_even(x * 60 / tz + 32, 0)::INTEGER AS px_col, round_even(ty * 60 / tz + 24, 0)::INTEGER AS px_row FROM p WHERE tz > 0),
i AS (SELECT * FROM s WHERE px_col BETWEEN 0 AND 63 AND px_row BETWEEN 0 AND 47),
c AS (SELECT label, count(*) AS n_points, count(*) - count(DISTINCT (px_row, px_col)) AS n_repeated, count(*) FILTER (px_row > 39) AS n_outside, count(*) FILTER (px_row %% 2 = 0 AND px_col %% 3 = 0) AS n_masked FROM i GROUP BY label)
SELECT *, CASE WHEN n_repeated = 0 THEN 'pixel_map' WHEN n_points %% 2 = 0 THEN 'valid_pixels' WHEN n_points %% 3 = 0 THEN 'all_pixels' END AS strategy FROM c""" % XYZ_SQL)
def pixel_mapping(t):
    seen = P.reproject(xyz(t), fx=F.lit(60.0), fy=F.lit(60.0), cx=F.lit(32.0), cy=F.lit(24.0), width=64, height=48, translation=[0.0, 0.01, 0.02])
    check = P.pixel_map_check(seen, ["label"], F.lit(64), F.lit(40))
    mask = seen.select("label", F.col("px_row").alias("row"), F.col("px_col").alias("col")).distinct().filter("row % 2 = 0 and col % 3 = 0")
    masked = P.select_by_mask(seen, mask, ["label"]).groupBy("label").agg(F.count(F.lit(1)).alias("n_masked"))
    n = F.col("n_points")
    strategy = P.mapping_strategy(n, n - F.col("n_repeated"), F.when(n % 2 == 0, n).otherwise(-1), F.when(n % 3 == 0, n).otherwise(-1))
    return check.join(masked, "label", "left").withColumn("n_masked", F.coalesce("n_masked", F.lit(0))).withColumn("strategy", strategy)


@query("""
WITH px AS (SELECT o_orderstatus AS view, o_orderkey % 60 AS row, o_custkey AS col, max(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 50000 END) AS depth FROM orders GROUP BY ALL),
m AS (SELECT * FROM px WHERE (row + col) % 3 = 0)
SELECT view, count(*) FILTER (depth IS NULL) AS invalid, count(depth) AS n_points, round(median(depth), 6) AS median_z, round(max(depth), 6) AS max_z,
  CASE WHEN count(depth) = 0 THEN 'no_valid_depth' WHEN median(depth) NOT BETWEEN 0.1 AND 10 THEN 'median_depth_implausible' WHEN max(depth) > 20 THEN 'max_depth_implausible' END AS error FROM m GROUP BY view""")
def masked_depth(t):
    price = F.col("o_totalprice")
    depth = F.max(F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderstatus") == "F", price).otherwise(price / 50000)))
    px = t("orders").groupBy(F.col("o_orderstatus").alias("view"), (F.col("o_orderkey") % 60).alias("row"), F.col("o_custkey").alias("col")).agg(depth.alias("depth"))
    mask = px.select("view", "row", "col").filter("(row + col) % 3 = 0")
    one = F.lit(1.0)
    _, stats = P.masked_deprojection(px, mask, ["view"], fx=one, fy=one, cx=one, cy=one)
    return stats.select("view", "invalid", F.coalesce("n_points", F.lit(0)).alias("n_points"), r6("median_z").alias("median_z"), r6("max_z").alias("max_z"), "error")


@query("""
WITH p AS (SELECT label, x, y, z FROM (%s)), e AS (SELECT label, quantile_cont(x, 0.01) AS x0, quantile_cont(x, 0.99) AS x1, count(*) AS n FROM p GROUP BY label),
d AS (SELECT p.*, x0, x1, n, abs(x - x0) AS d0, abs(x - x1) AS d1, greatest((x1 - x0) * 0.01, 0.001) AS tol FROM p JOIN e ON p.label = e.label),
c AS (SELECT label, count(*) FILTER (d0 <= tol) AS n0, count(*) FILTER (d1 <= tol) AS n1 FROM d GROUP BY label),
r AS (SELECT d.*, n0, n1, row_number() OVER (PARTITION BY d.label ORDER BY d0, x, y, z) AS k0, row_number() OVER (PARTITION BY d.label ORDER BY d1, x, y, z) AS k1, least(greatest(8, n // 200), n) AS most FROM d JOIN c ON d.label = c.label),
s AS (SELECT label, any_value(x0) AS x0, any_value(x1) AS x1, median(y) FILTER (CASE WHEN n0 > 0 THEN d0 <= tol ELSE k0 <= most END) AS y0, median(y) FILTER (CASE WHEN n1 > 0 THEN d1 <= tol ELSE k1 <= most END) AS y1,
  median(z) FILTER (CASE WHEN n0 > 0 THEN d0 <= tol ELSE k0 <= most END) AS z0, median(z) FILTER (CASE WHEN n1 > 0 THEN d1 <= tol ELSE k1 <= most END) AS z1 FROM r GROUP BY label)
SELECT label, i::INTEGER AS i, round(x0 + (x1 - x0) * (i / 511.0::DOUBLE), 6) AS x, round((y0 + y1) / 2, 6) AS y, round((z0 + z1) / 2, 6) AS z FROM s, range(512) t(i)""" % XYZ_SQL)
def width_lines(t):
    return P.width_line(xyz(t), ["label"]).select("label", "i", *[r6(a).alias(a) for a in P.AXES])


@query("""
WITH p AS (SELECT label, floor(x / 0.3)::BIGINT AS a, floor(y / 0.3)::BIGINT AS b, floor(z / 0.3)::BIGINT AS c, x, y, z, vec_id FROM (%s)), v AS (SELECT label, a, b, c, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label, a, b, c),
s AS (SELECT label, (SELECT count(*) FROM v WHERE v.label = p.label) AS cells, count(*) AS n FROM p GROUP BY label),
f AS (SELECT v.label, v.x, v.y, v.z, row_number() OVER (PARTITION BY v.label ORDER BY a, b, c) AS o FROM v JOIN s ON s.label = v.label AND cells >= 3 AND cells < n
  UNION ALL SELECT p.label, p.x, p.y, p.z, vec_id FROM p JOIN s ON s.label = p.label AND NOT (cells >= 3 AND cells < n)),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY label) AS m FROM f),
w AS (SELECT DISTINCT label, CASE WHEN m <= 20 THEN g ELSE floor(g * ((m - 1) / 19.0::DOUBLE))::BIGINT END AS i FROM (SELECT DISTINCT label, m FROM k), range(20) t(g))
SELECT k.label, k.i AS place, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM k JOIN w ON w.label = k.label AND w.i = k.i""" % XYZ_SQL)
def plane_sample(t):
    pts = xyz(t).withColumn("ord", F.col("vec_id"))
    own = C.plane_fit_points(pts, ["label"], 0.3, 20)
    every = C.plane_fit_points(pts, ["label"], 0.3, 1_000_000_000)
    place = every.select("label", "ord", (F.row_number().over(C.Window.partitionBy("label").orderBy("ord")) - 1).cast("long").alias("place"))
    return own.join(place, ["label", "ord"]).select("label", "place", *[r6(a).alias(a) for a in P.AXES])


@query("""
WITH q AS (SELECT vec_id %% 60 AS view, x * 0.3 AS x, y * 0.3 AS y, least(z * 0.2 + 0.3, 1.3) AS z FROM (%s)), p AS (SELECT * FROM q UNION ALL SELECT view, x, y + 0.0001, z FROM q),
i AS (SELECT * FROM p WHERE abs(x) <= 0.5334 + 0.05 AND z BETWEEN 0.25 - 0.05 AND 1.3168 + 0.05 AND y <= 1.0668 + 0.05),
v AS (SELECT view, avg(x) AS x, avg(y) AS y FROM i GROUP BY view, floor(x / 0.005)::BIGINT, floor(y / 0.005)::BIGINT, floor(z / 0.005)::BIGINT)
SELECT view, count(*) AS n_points, round(max(x) - min(x), 6) AS horizontal, round((max(y) - min(y)) * 39.3701, 6) AS vertical_in FROM v GROUP BY view HAVING count(*) < 30""" % XYZ_SQL)
def small_segments(t):
    q = xyz(t).select((F.col("vec_id") % 60).alias("view"), (F.col("x") * 0.3).alias("x"), (F.col("y") * 0.3).alias("y"), F.least(F.col("z") * 0.2 + 0.3, F.lit(1.3)).alias("z"))
    both = P.merge_clouds(q, q.withColumn("y", F.col("y") + 0.0001))
    thin = P.voxel_centroids(P.apply_roi(both, use_y=False).filter("inside"), ["view"], K.MEASURE_VOXEL).select("view", *P.AXES)
    out = P.dimensions(C.largest_cluster(thin, ["view"]), ["view"])
    return out.filter("n_points < 30").select("view", "n_points", r6("horizontal_span_m").alias("horizontal"), r6("vertical_span_in").alias("vertical_in"))


@query("""
WITH m AS (%s), b AS (SELECT view, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS n FROM m GROUP BY view),
u AS (SELECT m.* FROM m JOIN b ON m.view = b.view AND n >= 400 AND row <= r0 + floor((r1 - r0 + 1) * 0.62)),
l AS (SELECT m.* FROM m JOIN b ON m.view = b.view AND n >= 400 AND row >= r0 + floor((r1 - r0 + 1) * 0.48) AND col >= floor(greatest(0, (c0 + c1) / 2.0 - (c1 - c0 + 1) * 0.34)) AND col < floor(least(80, (c0 + c1) / 2.0 + (c1 - c0 + 1) * 0.34))),
a AS (SELECT 'upper' AS part, view, row + 5 AS row, col + 3 AS col FROM u WHERE view IN (SELECT view FROM u GROUP BY view HAVING count(*) >= 400) UNION ALL SELECT 'lower', view, row + 5, col + 3 FROM l WHERE view IN (SELECT view FROM l GROUP BY view HAVING count(*) >= 200))
SELECT part, view, count(*) AS n_pixels, min(col)::DOUBLE AS x1, min(row)::DOUBLE AS y1, max(col) + 1.0::DOUBLE AS x2, max(row) + 1.0::DOUBLE AS y2 FROM a GROUP BY part, view""" % MASK_SQL)
def stand_in_masks(t):
    m = mask_pixels(t)
    both = V.upper_part(m, ["view"], 400).withColumn("part", F.lit("upper")).unionByName(V.lower_central_part(m, ["view"], F.lit(80), 400).withColumn("part", F.lit("lower")))
    out = V.mask_metrics(V.to_full_image(both, F.lit(3), F.lit(5)), ["part", "view"])
    return out.select("part", "view", "n_pixels", "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2")


@query("""
WITH f AS (SELECT o_custkey, max(o_totalprice) AS c, 1 AS idx FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), k AS (SELECT o_custkey, max(o_totalprice) AS c, 2 AS idx FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(f.o_custkey, k.o_custkey) AS view, CASE WHEN k.c IS NOT NULL AND (f.c IS NULL OR k.c > f.c) THEN 2 ELSE 1 END AS idx, k.c IS NOT NULL AND (f.c IS NULL OR k.c > f.c) AS from_crop FROM f FULL JOIN k ON f.o_custkey = k.o_custkey""")
def crop_masks(t):
    of = lambda s, i: t("orders").filter(s).groupBy(F.col("o_custkey").alias("view")).agg(F.max("o_totalprice").alias("confidence"), F.lit(i).alias("idx"))
    return V.crop_override(of("o_orderstatus <> 'F'", 1), of("o_orderstatus = 'F'", 2), ["view"]).select("view", "best.idx", "from_crop")


@query("""
WITH m AS (%s), g AS (SELECT v.view, r.r, c.c, m.view IS NOT NULL AS hit FROM (SELECT DISTINCT view FROM m) v, range(60) r(r), range(80) c(c) LEFT JOIN m ON m.view = v.view AND m.row = r.r AND m.col = c.c),
d AS (SELECT view, sha256(unhex(string_agg(CASE WHEN hit THEN '01' ELSE '00' END, '' ORDER BY r, c))) AS digest, count(*) FILTER (hit AND r %% 2 = 1 AND c %% 2 = 1) AS half_pixels FROM g GROUP BY view)
SELECT view, digest, half_pixels FROM d""" % MASK_SQL)
def mask_records(t):
    m = mask_pixels(t)
    half = V.resize_mask(m.select("view", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")), ["view"], (60, 80), (30, 40))
    n = half.groupBy("view").agg(F.count(F.lit(1)).alias("half_pixels"))
    return V.mask_digest(m, ["view"], 60, 80).join(n, "view")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT o_orderstatus AS view, o_custkey % 300 * 1000 + o_orderkey % 400 AS id, o_custkey % 300 AS row, o_orderkey % 400 AS col FROM orders),
n AS (SELECT a.view, a.id AS s, b.id AS t FROM e a JOIN e b ON a.view = b.view AND (a.row = b.row AND abs(a.col - b.col) = 1 OR a.col = b.col AND abs(a.row - b.row) = 1)),
r AS (SELECT view, id AS s, id AS t FROM e UNION SELECT r.view, r.s, n.t FROM r JOIN n ON n.view = r.view AND n.s = r.t)
SELECT view, count(DISTINCT root) AS n_components FROM (SELECT view, s, min(t) AS root FROM r GROUP BY ALL) GROUP BY view""")
def mask_parts(t):
    px = t("orders").select(F.col("o_orderstatus").alias("view"), (F.col("o_custkey") % 300).alias("row"), (F.col("o_orderkey") % 400).alias("col"))
    return C.mask_components(px, ["view"])


@query("""
WITH b AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, abs(embedding[3]::DOUBLE) * 100 + 5 AS w, abs(embedding[4]::DOUBLE) * 100 + 5 AS h FROM embeddings)
SELECT vec_id, greatest(0, floor(x - w * 0.14))::BIGINT AS x1, least(200, ceil(y + h + h * 0.14))::BIGINT AS y2, round(x + w + 7, 6) AS moved_x2, round(sqrt(pow(greatest(0, x - 20, -20 - (x + w)), 2) + pow(greatest(0, y - 30, -30 - (y + h)), 2)), 6) AS gap FROM b""")
def box_crops(t):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    x, y, w, h = e(0), e(1), F.abs(e(2)) + 5, F.abs(e(3)) + 5
    box, zero = B.box(x, y, x + w, y + h), F.lit(0.0)
    rows = t("embeddings").select("vec_id", "embedding", box.alias("b"))
    crop = B.crop_around(F.col("b"), F.lit(300).cast("long"), F.lit(200).cast("long"), K.CROP_MARGIN)
    gap = B.gap_3d([x, y, zero], [x + w, y + h, zero], [F.lit(-20.0), F.lit(-30.0), zero], [F.lit(20.0), F.lit(30.0), zero])
    return rows.select("vec_id", crop["x1"].alias("x1"), crop["y2"].alias("y2"), r6(B.moved(F.col("b"), F.lit(7.0), F.lit(0.0))["x2"]).alias("moved_x2"), r6(gap).alias("gap"))


# --- files
def stored(sql: str):
    """Register a query that needs the session, for the folder that it writes to and reads again."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@stored("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'record.json missing' WHEN s_suppkey % 4 = 1 THEN 'record.json malformed' END AS failure, CASE WHEN s_suppkey % 4 > 1 THEN s_name END AS name, s_suppkey % 4 <> 0 AS listed FROM supplier")
def record_files(spark, t):
    """A folder for each supplier, some with a broken record and some with none."""
    path = scratch(spark, "records")
    job = F.concat(F.lit("job"), F.col("s_suppkey").cast("string"))
    good = F.to_json(F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_acctbal").alias("b")).alias("a")), {"pretty": "true"})
    text = F.when(F.col("s_suppkey") % 4 == 1, F.lit('{"name": "broken')).otherwise(good)
    t("supplier").filter("s_suppkey % 4 <> 0").select(job.alias("job"), text.alias("value")).repartition("job").write.option("lineSep", "\n").partitionBy("job").text(path)
    at = lambda c: F.regexp_extract(c, r"job=job(\d+)$", 1).cast("long")
    records = S.read_records(spark, f"{path}/*/part-*", "name string, a struct<b:double>").withColumn("s_suppkey", at("job_id"))
    listed = S.list_jobs(spark, path).select(at("job_id").alias("s_suppkey"), F.lit(True).alias("listed"))
    found = S.failures(records, t("supplier").select("s_suppkey"), "record.json", job="s_suppkey")
    out = found.join(records.filter("failure is null").select("s_suppkey", "name"), "s_suppkey", "left").join(listed, "s_suppkey", "left")
    return out.select("s_suppkey", "failure", "name", F.coalesce("listed", F.lit(False)).alias("listed"))


@stored("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, (label %% 256)::BIGINT AS r FROM (%s)" % XYZ_SQL)
def cloud_files(spark, t):
    path = scratch(spark, "cloud")
    pts = xyz(t).select(F.col("vec_id").alias("ord"), *P.AXES, (F.col("label") % 256).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    S.write_ply(pts, path)
    return S.read_ply(spark, f"{path}/part-*").select("ord", *[r6(a).alias(a) for a in P.AXES], F.col("r").cast("long").alias("r"))


@stored("SELECT o_orderkey::VARCHAR AS a_key, o_orderstatus AS a_status, '[1,' || o_custkey || ']' AS list, round(o_totalprice, 2) AS total FROM orders")
def table_files(spark, t):
    path = scratch(spark, "table")
    rows = t("orders").select(F.round("o_totalprice", 2).alias("total"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key")).alias("a"), F.array(F.lit(1).cast("long"), F.col("o_custkey")).alias("list"), F.lit("x").alias("_runtime_x"))
    S.write_table(S.public_columns(rows), path)
    return spark.read.csv(path, header=True, schema="a_key string, a_status string, list string, total double", enforceSchema=False)


@stored("SELECT 'f' || n_regionkey AS path, (n_nationkey // 5)::BIGINT AS row, (n_nationkey % 5)::BIGINT AS col, CASE WHEN n_nationkey % 5 = n_regionkey THEN n_nationkey / 4.0::DOUBLE ELSE 0.0 END AS depth FROM (SELECT r.r_regionkey AS n_regionkey, n.n_nationkey FROM region r, nation n)")
def depth_files(spark, t):
    """Arrays of five by five as the files of depth cameras hold them."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        grid, out = np.zeros((5, 5), np.float32), io.BytesIO()
        grid[part.row, part.col] = part.depth
        np.save(out, grid)
        return pd.DataFrame({"path": [f"f{part.region.iloc[0]}"], "content": [out.getvalue()]})

    n = F.col("n_nationkey")
    px = t("nation").select((n % 5).alias("region"), F.floor(n / 5).alias("row"), (n % 5).alias("col"), (n / 4.0).alias("depth"))
    out = S.depth_pixels(px.groupBy("region").applyInPandas(pack, "path string, content binary"))
    return out.select("path", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("depth").cast("double").alias("depth"))


@stored("SELECT 'book' || n_regionkey AS path, count(*) AS n_rows, min(n_name) AS first_name, sum(n_nationkey)::BIGINT AS sum_sku, 3::BIGINT AS header_row, 'BadZipFile' AS error FROM nation GROUP BY n_regionkey")
def workbooks(spark, t):
    """A workbook for each region: two rows above the header, then its nations."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        cell = lambda c, r, v: f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
        rows = [(1, [("A", "a list")]), (3, [("A", " Item# "), ("B", "Common  Name"), ("C", "SPEC"), ("D", "odd"), ("E", "UOM")])]
        rows += [(4 + i, [("A", f"{k}.0"), ("B", name), ("C", "4 in")]) for i, (k, name) in enumerate(zip(part.key, part.name_, strict=True))]
        sheet = "".join(f'<row r="{r}">{"".join(cell(c, r, v) for c, v in cells)}</row>' for r, cells in rows)
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        region = part.region.iloc[0]
        return pd.DataFrame({"path": [f"book{region}", f"broken{region}"], "content": [out.getvalue(), b"none"]})

    files = t("nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name_")).groupBy("region").applyInPandas(pack, "path string, content binary")
    cells = S.workbook_rows(files)
    broken = cells.filter("error is not null").select(F.regexp_replace("path", "broken", "book").alias("path"), "error")
    good = cells.filter("error is null")
    table = Cat.entries(Cat.table_rows(good, ["path", "sheet"])).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"), F.min("common_name").alias("first_name"), F.sum(F.col("sku").cast("long")).alias("sum_sku"))
    heads = Cat.header_rows(good, ["path", "sheet"]).select("path", F.col("header_row").cast("long").alias("header_row"))
    return table.join(heads, "path").join(broken, "path")


@stored("SELECT p_partkey, 'forest' AS model FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'forest' FROM part WHERE p_partkey % 3 <> 0")
def prediction_log(spark, t):
    path = scratch(spark, "predictions")
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, "forest").alias("model"))
    for _ in range(2):
        S.append_predictions(rows, path)
    return spark.read.parquet(path).filter("created_at is not null").select("p_partkey", "model")


@query("""
WITH a AS (SELECT n_regionkey AS view, n_nationkey // 5 AS row, n_nationkey % 5 AS col, n_nationkey + 1.0::DOUBLE AS depth FROM nation), b AS (SELECT view, row, col, CASE WHEN view = 1 THEN depth ELSE depth * 2 END AS depth FROM a WHERE view <> 2 OR row > 2),
s AS (SELECT view, min(depth) AS lo, quantile_cont(depth, 0.02) AS e0, quantile_cont(depth, 0.98) AS e1 FROM a GROUP BY view)
SELECT a.view, CASE WHEN a.view = 2 THEN 'shape_mismatch' WHEN a.view = 1 THEN 'raw_and_aligned_identical' END AS error, sum(floor(greatest(0, least(1, (depth - e0) / (e1 - e0))) * 255))::BIGINT AS level_sum, any_value(lo) AS raw_min, (SELECT min(depth) FROM b WHERE b.view = a.view) AS aligned_min
FROM a JOIN s ON s.view = a.view GROUP BY a.view""")
def capture_checks(t):
    n = F.col("n_nationkey")
    a = t("nation").select(F.col("n_regionkey").alias("view"), F.floor(n / 5).alias("row"), (n % 5).alias("col"), (n + 1.0).alias("depth"))
    b = a.filter("view <> 2 or row > 2").withColumn("depth", F.when(F.col("view") == 1, F.col("depth")).otherwise(F.col("depth") * 2))
    levels = S.depth_preview(a, ["view"]).groupBy("view").agg(F.sum("level").cast("long").alias("level_sum"))
    meta = S.capture_meta(S.capture_errors(a, b, ["view"]).select("view", "error"), P.depth_stats(a, ["view"]), P.depth_stats(b, ["view"]), ["view"])
    return meta.join(levels, "view").select("view", "error", "level_sum", F.col("raw_depth.min_depth").alias("raw_min"), F.col("aligned_depth.min_depth").alias("aligned_min"))


@query("SELECT (i // 7)::INTEGER AS row, (i % 7)::INTEGER AS col, 0.75::DOUBLE AS depth FROM range(35) t(i)")
def constant_frame(t):
    return S.fake_camera(t("region").sparkSession, 5, 7, 0.75)


@stored("""
WITH e AS (SELECT event_id, user_id, ts, event_id % 3 = 0 AS valid, event_id::DOUBLE AS p FROM events),
l AS (SELECT *, last_value(CASE WHEN valid THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM e)
SELECT event_id AS capture_id, CASE WHEN valid THEN p ELSE kept END AS plane, NOT valid AND kept IS NOT NULL AS reused FROM l""")
def plane_stream(spark, t):
    """Kept table planes over the events as a stream, all that there is."""
    rows = t("events").select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").alias("capture_id"), (F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000 + F.col("event_id")).alias("captured_at"), F.array(F.col("event_id").cast("double")).alias("plane"), (F.col("event_id") % 3 == 0).alias("valid"))
    source, out = scratch(spark, "fits"), scratch(spark, "planes")
    rows.write.parquet(source)
    with rocks_store(spark):
        stream = Se.stream_planes(spark.readStream.schema(rows.schema).parquet(source))
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True)
        writer.foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out).select("capture_id", F.get("plane", F.lit(0)).alias("plane"), "reused")




@query("""
WITH d AS (SELECT event_id // 40 AS view, event_id AS idx, event_id % 60 AS x, (event_id // 60) % 40 AS y, 6 + event_id % 5 AS s, (['object', 'pot', 'leaf', 'table'])[event_id % 4 + 1] AS segment, event_id % 7 = 0 AS blocked FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY idx) AS o, idx = min(idx) FILTER (segment = 'object') OVER (PARTITION BY view) AS is_primary FROM d),
px AS (SELECT f.*, list_distinct(flatten(list_transform(range(y, y + s), lambda r: list_transform(range(x, x + s + 3), lambda c: r * 100 + c)))) AS pixels FROM f),
p AS (SELECT * FROM px WHERE is_primary),
walk AS (WITH RECURSIVE w AS (SELECT view, 0::BIGINT AS o, NULL::BIGINT AS idx, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS reason, pixels AS u FROM p
  UNION ALL SELECT view, o, idx, reason IS NULL OR reason = 'primary_object_anchor', reason, CASE WHEN reason IS NULL THEN list_distinct(list_concat(u, pixels)) ELSE u END
  FROM (SELECT w.view, px.o, px.idx, w.u, px.pixels, CASE WHEN px.is_primary THEN 'primary_object_anchor' WHEN px.segment = 'table' THEN 'segment_not_part_of_full_object_union'
      WHEN len(px.pixels) < 50 THEN 'mask_pixel_count_below_object_union_minimum' WHEN px.blocked AND px.segment = 'object' THEN 'candidate_has_blocking_rejection'
      WHEN len(list_intersect(px.pixels, w.u)) / len(px.pixels) >= 0.01
        OR greatest(0, least(px.x + px.s + 3, p.x + p.s + 3) - greatest(px.x, p.x)) * greatest(0, least(px.y + px.s, p.y + p.s) - greatest(px.y, p.y)) / ((px.s + 3) * px.s) >= 0.01
        OR sqrt(pow(greatest(0, px.x - list_max(list_transform(w.u, lambda q: q % 100)) - 1, list_min(list_transform(w.u, lambda q: q % 100)) - px.x - px.s - 3), 2)
              + pow(greatest(0, px.y - list_max(list_transform(w.u, lambda q: q // 100)) - 1, list_min(list_transform(w.u, lambda q: q // 100)) - px.y - px.s), 2)) / sqrt(100.0 * 100 + 80 * 80) <= 0.07 THEN NULL
      ELSE 'not_spatially_consistent_with_primary_object' END AS reason
    FROM w JOIN px ON px.view = w.view AND px.o = w.o + 1 JOIN p ON p.view = w.view)) SELECT * FROM w)
SELECT view, idx, accepted, reason FROM walk WHERE o > 0""")
def object_unions(t):
    k = F.col("event_id")
    x, y, s = k % 60, F.floor(k / 60) % 40, 6 + k % 5
    seg = F.element_at(F.array(*[F.lit(v) for v in ("object", "pot", "leaf", "table")]), (k % 4 + 1).cast("int"))
    pixels = F.flatten(F.transform(F.sequence(y, y + s - 1), lambda r: F.transform(F.sequence(x, x + s + 2), lambda c: r * 100 + c)))
    d = t("events").select(F.floor(k / 40).alias("view"), k.alias("idx"), seg.alias("segment"), (k % 7 == 0).alias("blocked"), B.box(x, y, x + s + 3, y + s).alias("box"), pixels.alias("pixels"), F.lit(100).alias("width"), F.lit(80).alias("height"))
    first = F.min(F.when(F.col("segment") == "object", F.col("idx"))).over(C.Window.partitionBy("view"))
    out = V.union_parts(d.withColumn("is_primary", F.coalesce(F.col("idx") == first, F.lit(False))), ["view"])
    return out.filter("reason is null or reason <> 'no_primary_object'").select("view", "idx", "accepted", "reason")


PLANES = [(1, [0.0, 0.6, 0.8, -0.5]), (2, [0.0, 0.99, 0.14106735979665885, -0.2]), (3, [0.0, 2.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 2.5]), (5, [0.0, 1.0, 0.0, 0.0])]


@query("""
WITH c(k, a, b, c, d) AS (VALUES %s), p AS (SELECT k.k, o_custkey %% 100 / 100.0 AS x, o_totalprice / 500000 * (o_orderkey %% 5) / 4.0 AS y, o_orderkey %% 50 / 50.0 AS z FROM orders, range(1, 6) k(k)),
s AS (SELECT c.*, count(p.k) AS n, count(*) FILTER (abs(x * a + y * b + z * c + d) <= 0.008) AS near, greatest(count(*) FILTER (x * a + y * b + z * c + d > 0.008), count(*) FILTER (x * a + y * b + z * c + d < -0.008)) AS side FROM c LEFT JOIN p ON p.k = c.k GROUP BY ALL)
SELECT k, CASE WHEN abs(sqrt(a * a + b * b + c * c) - 1) > 1e-3 THEN 'plane_coefficients_invalid_or_not_normalized' WHEN abs(b) < 0.85 THEN 'plane_normal_orientation_invalid' WHEN abs(d) > 2 THEN 'plane_offset_implausible'
  WHEN n < 3 THEN 'not_enough_points_for_cache_validation' WHEN near < 500 THEN 'near_plane_inlier_count_too_low' WHEN near / n < 0.2 THEN 'near_plane_inlier_ratio_too_low' WHEN side < 30 THEN 'remaining_non_table_points_too_low' WHEN side / n < 0.03 THEN 'above_below_distribution_implausible' END AS reason FROM s""" % ", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in p)})" for k, p in PLANES))
def plane_checks(t):
    o = t("orders")
    pts = o.select(F.explode(F.array(*[F.lit(k) for k, _ in PLANES])).alias("k"), (F.col("o_custkey") % 100 / 100.0).alias("x"), (F.col("o_totalprice") / 500000 * (F.col("o_orderkey") % 5) / 4.0).alias("y"), (F.col("o_orderkey") % 50 / 50.0).alias("z"))
    planes = o.sparkSession.createDataFrame(PLANES, "k int, plane array<double>")
    return C.plane_valid(pts, planes, ["k"]).select("k", "reason")


@query("""
SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM events""")
def kept_planes(t):
    fits = t("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("captured_at"), F.array(F.col("event_id").cast("double")).alias("plane"), (F.col("event_id") % 3 == 0).alias("valid"))
    return C.latest_plane(fits, ["user_id"]).select("event_id", F.get("cached_plane", F.lit(0)).alias("kept"))


@query("""
WITH p AS (%s), v AS (SELECT label, count(*) AS n, max(x) - min(x) AS sx, max(y) - min(y) AS sy, max(z) - min(z) AS sz, quantile_cont(y * 39.3701, 0.9) AS p90 FROM p GROUP BY label)
SELECT label, n AS object_point_count, round(sx * 39.3701, 6) AS object_bbox_length_in, round(p90, 6) AS object_y_p90, true AS object_available, label %% 3 = 0 AS leaf_available, CASE WHEN label %% 3 <> 1 THEN round(sy * 39.3701, 6) END AS leaf_bbox_height_in, label %% 2 = 0 AS table_available FROM v""" % XYZ_SQL)
def view_feature_rows(t):
    pts = xyz(t)
    geometry, profile = P.dimensions(pts, ["label"]).withColumn("geometry_status", F.when(F.col("label") % 2 == 0, "ok").otherwise("degraded")), P.profile(pts, ["label"])
    k = F.col("label")
    seg = pts.select("label").distinct().select("label", F.lit("ok").alias("object_status"), F.when(k % 3 == 0, "ok").when(k % 3 == 1, "fallback").otherwise("missing").alias("leaf_status"), F.when(k % 2 == 0, "ok").alias("table_status"))
    out = Fe.view_features(geometry, profile, profile, seg, ["label"])
    return out.select("label", "object_point_count", r6("object_bbox_length_in").alias("object_bbox_length_in"), r6("object_y_p90").alias("object_y_p90"), "object_available", "leaf_available", r6("leaf_bbox_height_in").alias("leaf_bbox_height_in"), "table_available")


@stored("SELECT label, (SELECT count(*) FROM part) AS n_inside FROM (VALUES ('length_in'), ('width_in'), ('height_in')) t(label)")
def forest_ranges(spark, t):
    """Forests saved, read again and applied: how many of their answers lie between the least and the greatest label that they saw, which all must."""
    rows = t("part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (F.col("p_size") * 1.5).alias("length_in"), (F.col("p_size") + 2.0).alias("width_in"), (F.col("p_retailprice") / 100).alias("height_in"))
    path = scratch(spark, "models")
    models, n = Tr.train_boxes(rows, ["a", "b"])
    Tr.save_models(models, path, spark.createDataFrame([(n,)], "n_rows long"))
    out = Tr.predict_boxes(Tr.load_models(path), rows, ["a", "b"])
    bounds = Tr.label_summary(rows).select("label", "least", "greatest")
    long = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"predicted_{c}").alias("p")) for c in K.LABEL_FIELDS])).alias("e")).select("e.*")
    return long.join(bounds, "label").groupBy("label").agg(F.count_if(F.col("p").between(F.col("least") - 1e-9, F.col("greatest") + 1e-9)).alias("n_inside"))
