"""View features, records and saved models."""

import duckdb
from pyspark.sql import functions as F

from spanforge.operators import features as Fe
from spanforge.operators import points as P
from spanforge.operators import rules as R
from spanforge.operators import training as Tr
from spanforge.plans import catalog
from spanforge.sources import files as S


def test_view_features(spark):
    pts = spark.createDataFrame([(v, i / 10, i / 7, i / 5) for v in (1, 2) for i in range(20)], "view int, x double, y double, z double")
    geometry = P.dimensions(pts, ["view"]).withColumn("geometry_status", F.lit("ok"))
    prof = P.profile(pts, ["view"])
    seg = spark.createDataFrame([(1, "ok", "ok", "ok", 4.0), (2, "ok", "fallback", "missing", None)], "view int, object_status string, leaf_status string, table_status string, pot_diameter_in double")
    out = {r["view"]: r for r in Fe.view_features(geometry, prof, prof, seg, ["view"]).collect()}
    assert out[1].leaf_available and out[1].table_available and out[1].leaf_y_p50 == out[1].object_y_p50 is not None
    assert not out[2].leaf_available and out[2].leaf_y_p50 is None and out[2].object_available and not out[2].table_available
    vec = Tr.vectorise(Fe.view_features(geometry, prof, prof, seg, ["view"]), ["view"])
    assert "object_vertical_density_bins_09" in vec.columns and "leaf_available" in vec.columns


def test_records(spark, tmp_path):
    at = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    r = spark.range(1).select(R.truth_record(R.make_box(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit("good"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), at).alias("t"), R.make_box(F.lit(1.0), F.lit(-2.0), F.lit(3.0)).alias("none"), R.segmentation_record(F.lit("ok"), {"pot": F.lit("ok"), "leaf": F.lit("odd")}).alias("s"), Fe.geometry_record(F.lit("failed"), F.lit("raw_cloud"), F.lit(1.0), F.lit(None).cast("array<string>"), F.lit("x")).alias("g")).first()
    assert r.t.completed and r.t.recorded_at == "2026-01-02T03:04:05Z" and r.t.notes == "" and r.none is None
    assert r.s.error == "invalid_status:leaf" and r.g.dimensions is None and r.g.warnings == []
    rows = spark.createDataFrame([(i, float(i), 1.0 * i, 2.0, 3.0) for i in range(1, 9)], "id int, a double, length_in double, width_in double, height_in double")
    models, n = Tr.train_boxes(rows, ["a"])
    Tr.save_models(models, f"{tmp_path}/m", spark.createDataFrame([(n,)], "rows int"))
    again = Tr.predict_boxes(Tr.load_models(f"{tmp_path}/m"), rows, ["a"])
    assert again.select("predicted_width_in").distinct().first()[0] == 2.0
    px = spark.createDataFrame([(1, 2.0), (1, 4.0)], "view int, depth double")
    stats = P.depth_stats(px, ["view"])
    meta = S.capture_meta(spark.createDataFrame([(1, "cam")], "view int, camera string"), stats, stats, ["view"]).first()
    assert meta.raw_depth.median_depth == 3.0 == meta.aligned_depth.median_depth


def test_view_roles_of_equal_lines_is_the_first_in_the_files(spark, tmp_path):
    con = duckdb.connect(config={"threads": 1})
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, first, n in (("a", 0, 900), ("b", 900, 30000)):  # Spark takes the longer file first
        con.sql(f"COPY (SELECT (i % 300)::BIGINT AS l_orderkey, (i % 2)::VARCHAR AS l_returnflag, 1::INTEGER AS l_linenumber, i::DOUBLE AS l_quantity FROM range({first}, {first + n}) t(i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS FROM '{folder}/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["view_roles"]).fetchall()
    got = catalog.QUERIES["view_roles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 300
