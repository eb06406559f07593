"""Small rules, names, records and job tables over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import catalogue as Cat
from spanforge.operators import features as Fe
from spanforge.operators import jobs as J
from spanforge.operators import points as P
from spanforge.operators import rules as R
from spanforge.operators import training as Tr
from spanforge.plans.base import query, r6
from spanforge.sources import files as S
from spanforge.streaming import sessions as Se


def pick(key: str, *values):
    """One of the values in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


@query(r"""
WITH p AS (SELECT *, (['12', '0', '-3', 'x', ' 7 ', NULL])[p_partkey % 6 + 1] AS s FROM part),
n AS (SELECT *, CASE WHEN regexp_full_match(s, '\s*-?\d+\s*') THEN trim(s)::INTEGER END AS i FROM p)
SELECT p_partkey, CASE WHEN i > 0 THEN i END AS pos, CASE WHEN i >= 0 THEN i END AS nonneg,
  CASE WHEN p_size <> 25 THEN round(p_retailprice / (p_size - 25), 6) END AS ratio, CASE WHEN p_size > 25 THEN round((p_size - 10)::DOUBLE / (p_size - 25), 6) ELSE 0.0 END AS count_ratio,
  coalesce(i, p_size) AS alias, CASE WHEN p_size / 100.0::DOUBLE >= 0.1 THEN round(p_size / 100.0::DOUBLE * 0.001, 9) ELSE p_size / 100.0::DOUBLE END AS metres,
  CASE WHEN p_size > 20 THEN p_size ELSE 1 END AS kept, CASE WHEN p_size % 5 <> 0 THEN (p_size % 5)::DOUBLE ELSE 2.5 END AS nonzero,
  round(CASE WHEN p_size % 3 = 0 THEN p_size WHEN p_size % 3 = 1 THEN p_retailprice * 39.3701 ELSE 1 END, 6) AS span FROM n""")
def number_rules(t):
    s, size = pick("p_partkey", "12", "0", "-3", "x", " 7 ", None), F.col("p_size")
    d = size.cast("double")
    return t("part").select(
        "p_partkey",
        T.positive_int(s).alias("pos"),
        T.nonnegative_int(s).alias("nonneg"),
        r6(T.safe_ratio(F.col("p_retailprice"), size - 25)).alias("ratio"),
        r6(T.ratio_or_zero(size - 10, size - 25)).alias("count_ratio"),
        P.alias_value(s.try_cast("int"), size.cast("int")).alias("alias"),
        F.round(P.metres_per_unit(d / 100.0), 9).alias("metres"),
        Fe.overwrite(F.lit(1), F.when(size > 20, size.cast("int"))).alias("kept"),
        Fe.or_zero(d % 5, F.lit(2.5)).alias("nonzero"),
        r6(Fe.span_in(F.when(size % 3 == 0, d), F.when(size % 3 == 1, F.col("p_retailprice")), F.lit(1.0))).alias("span"),
    )


@query(r"""
WITH o AS (SELECT o_orderkey, (['  ', 'SKU1_20260101_120000', 'My Job/1', NULL, 'GROUP_20260101_120000', ' a b '])[o_orderkey % 6 + 1] AS given, (['collect', 'predict', 'other', NULL])[o_orderkey % 4 + 1] AS mode, (['single', 'group', 'pair'])[o_orderkey % 3 + 1] AS kind FROM orders)
SELECT o_orderkey, CASE WHEN given IN ('SKU1_20260101_120000', 'GROUP_20260101_120000') THEN given WHEN given = 'My Job/1' THEN 'my_job1' WHEN given = ' a b ' THEN 'a_b' ELSE 'made' END AS job_id,
  kind || '_20260714_125623_' AS generated_front, 4 AS generated_tail,
  CASE WHEN mode IS NULL OR mode = 'other' THEN 'unsupported_mode' WHEN kind = 'pair' THEN 'unsupported_job_type' END AS error FROM o""")
def job_names(t):
    at, kind = F.lit("2026-07-14 12:56:23").cast("timestamp_ntz"), pick("o_orderkey", "single", "group", "pair")
    given = pick("o_orderkey", "  ", "SKU1_20260101_120000", "My Job/1", None, "GROUP_20260101_120000", " a b ")
    made = T.generated_job_id(kind, at)
    tail = F.regexp_extract(made, "_([0-9a-f]*)$", 1)
    return t("orders").select("o_orderkey", T.resolve_job_id(given, F.lit("made")).alias("job_id"), F.regexp_replace(made, "[0-9a-f]{4}$", "").alias("generated_front"), F.length(tail).alias("generated_tail"), R.workflow_error(pick("o_orderkey", "collect", "predict", "other", None), kind).alias("error"))


@query(r"""
SELECT s_suppkey, (['raw_sku', 'raw_sku', 'common_name', 'source_file', 'unit_price', 'colour_of_pot', ''])[s_suppkey % 7 + 1] AS name,
  (['a b', NULL, NULL, NULL, 'x'])[s_suppkey % 5 + 1] AS text, (['12', '1200', 'AB-1', NULL, '12.5', '7'])[s_suppkey % 6 + 1] AS sku, (['1234.5', '3.0', 'ask', NULL])[s_suppkey % 4 + 1] AS price FROM supplier""")
def catalogue_cells(t):
    return t("supplier").select(
        "s_suppkey",
        T.column_name(pick("s_suppkey", " item# ", "SKU", "common_name", "Source  File", "Unit Price", "Colour of_pot", None)).alias("name"),
        T.clean_text(pick("s_suppkey", " a b ", "NaN", "  ", None, "x")).alias("text"),
        T.clean_sku_cell(pick("s_suppkey", "12.0", "1200", " AB-1 ", "nan", "12.50", "7.000")).alias("sku"),
        T.clean_price(pick("s_suppkey", "$1,234.50", "3", "ask", " ")).alias("price"),
    )


@query("""
WITH c AS (SELECT p_partkey AS ord, p_partkey % 300 AS k, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'S' || (p_partkey % 300) END AS sku, p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'odd thing ' || p_size ELSE p_size || '" pot' END AS spec FROM part),
f AS (SELECT * FROM c WHERE sku IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sku ORDER BY CASE WHEN ord % 4 = 0 THEN 2 ELSE 4 END DESC, ord) = 1),
run AS (SELECT a.sku, a.ord, bool_or(a.p_brand <> b.p_brand) AS conflict FROM c a JOIN c b ON a.sku = b.sku AND b.ord < a.ord
  AND NOT EXISTS (SELECT 1 FROM c d WHERE d.sku = a.sku AND d.ord < a.ord AND (CASE WHEN d.ord % 4 = 0 THEN 2 ELSE 4 END > CASE WHEN b.ord % 4 = 0 THEN 2 ELSE 4 END OR (CASE WHEN d.ord % 4 = 0 THEN 2 ELSE 4 END = CASE WHEN b.ord % 4 = 0 THEN 2 ELSE 4 END AND d.ord < b.ord))) GROUP BY ALL)
SELECT count(*) AS n_rows_seen, count(*) FILTER (sku IS NULL) AS n_missing_sku, count(DISTINCT sku) AS n_skus, (SELECT count(*) FROM (SELECT sku FROM c WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1)) AS n_repeated,
  (SELECT count(DISTINCT sku) FROM run WHERE conflict) AS n_conflicting, (SELECT string_agg(spec, '|' ORDER BY spec) FROM (SELECT DISTINCT spec FROM c WHERE spec LIKE 'odd%' ORDER BY spec LIMIT 25)) AS unparsed FROM c""")
def catalogue_report(t):
    raw = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit(" s"), (F.col("p_partkey") % 300).cast("string")))
    spec = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("odd thing "), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit('" pot')))
    none = F.lit(None).cast("string")
    rows = Cat.entries(t("part").select(F.col("p_partkey").alias("ord"), raw.alias("raw_sku"), F.col("p_brand").alias("category"), none.alias("description"), none.alias("common_name"), spec.alias("spec"), none.alias("uom"), none.alias("unit_price")))
    scored = rows.withColumn("score", Cat.completeness(F.col("pot_prior.available"), F.col("category"), F.col("spec")))
    winners = Cat.dedupe(scored.filter(~F.col("missing_sku")), fields=["category"])
    out = Cat.build_report(rows, winners)
    return out.select("n_rows_seen", "n_missing_sku", "n_skus", "n_repeated", "n_conflicting", F.array_join("unparsed_specs", "|").alias("unparsed"))


@query("SELECT 'N' || n_nationkey AS sku, n_name AS category, CASE WHEN n_nationkey % 3 = 1 THEN NULL ELSE n_name || ' x' END AS common_name, n_regionkey || ' in' AS spec FROM nation")
def sku_forms(t):
    n = t("nation").withColumns({"sku": F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "category": F.col("n_name"), "common_name": F.when(F.col("n_nationkey") % 3 != 1, F.concat("n_name", F.lit(" x"))), "spec": F.concat(F.col("n_regionkey").cast("string"), F.lit(" in"))})
    body = F.struct("category", "common_name", "spec")
    listed = F.to_json(F.array(F.struct("sku", "category", "common_name", "spec")))
    keyed = F.to_json(F.create_map("sku", body))
    wrapped = F.to_json(F.struct(F.create_map("sku", body).alias("items")))
    kind = F.col("n_nationkey") % 3
    return Cat.sku_mapping(n.select(F.when(kind == 0, listed).when(kind == 1, keyed).otherwise(wrapped).alias("json"))).select("sku", "category", "common_name", "spec")


@query("SELECT c_nationkey, c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'BUILDING', abs(c_acctbal - 5000), c_custkey) = 1")
def camera_profiles(t):
    c = t("customer").select("c_nationkey", "c_custkey", "c_mktsegment", "c_acctbal")
    best = S.best_profile(c, ["c_nationkey"], [F.col("c_mktsegment") != "BUILDING", F.abs(F.col("c_acctbal") - 5000), F.col("c_custkey")])
    return best.select("c_nationkey", "profile.c_custkey", "profile.c_mktsegment")


@query("""
WITH v AS (SELECT p_partkey, (['meters', 'mm', 'raw_sdk_unit', 'feet', NULL])[p_partkey % 5 + 1] AS u, ([1.0, 0.5, 0.001, 0.0, NULL])[p_partkey % 7 % 5 + 1] AS s, p_partkey % 2 = 0 AS a FROM part),
k AS (SELECT *, coalesce(u, 'meters') AS w, coalesce(s, 1.0)::DOUBLE AS f FROM v),
e AS (SELECT *, CASE WHEN f <= 0 THEN 'depth_scale_invalid' WHEN w = 'feet' THEN 'depth_units_unsupported:feet' WHEN a <> (w = 'meters') THEN 'depth_scale_state_invalid' WHEN w = 'raw_sdk_unit' AND f >= 0.1 THEN 'depth_scale_not_meters_per_unit' END AS error FROM k)
SELECT p_partkey, CASE WHEN error IS NULL THEN CASE WHEN w = 'mm' THEN round(f * 0.001, 9) ELSE f END END AS factor, error FROM e""")
def depth_units(t):
    scale = F.element_at(F.array(*[F.lit(v) for v in (1.0, 0.5, 0.001, 0.0, None)]), (F.col("p_partkey") % 7 % 5 + 1).cast("int"))
    out = P.depth_scale(pick("p_partkey", "Meters", "mm", "raw_sdk_unit", "feet", None), scale, F.col("p_partkey") % 2 == 0)
    return t("part").select("p_partkey", F.round(out["factor"], 9).alias("factor"), out["error"].alias("error"))


@query("""
WITH g AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS v, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_min(v) AS least, list_max(v) AS greatest, round(list_sum(v) / n, 6) AS mean, (list_position(v, list_max(v)) - 1)::BIGINT AS peak,
  round(n / 10.0::DOUBLE, 6) AS point_ratio, CASE WHEN n <> 3 THEN round(list_max(v) / (n - 3), 6) END AS volume_ratio FROM g""")
def profile_numbers(t):
    g = t("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("v"), F.count(F.lit(1)).alias("n"))
    s, r = P.profile_summary(F.col("v")), Fe.part_ratios(F.col("n"), F.array_max("v"), F.lit(10.0), F.col("n") - 3)
    return g.select("o_custkey", s["least"].alias("least"), s["greatest"].alias("greatest"), r6(s["mean"]).alias("mean"), s["peak"].alias("peak"), r6(r["point_ratio"]).alias("point_ratio"), r6(r["volume_ratio"]).alias("volume_ratio"))


@query("""
WITH p AS (SELECT *, p_partkey % 7 AS k, p_partkey % 5 AS j, p_partkey % 3 AS m FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN p_size - 3 <= 0 OR j = 0 THEN 'dimension_suspicious' END, CASE WHEN p_retailprice / 10 > 120 THEN 'dimension_suspicious' END, CASE WHEN j < 1 THEN 'dimension_suspicious' END) AS dims,
  CASE WHEN k = 0 OR m = 1 THEN 'degraded' ELSE 'ok' END AS status, k = 2 OR j = 3 AS leaf_fallback,
  CASE WHEN m = 0 THEN NULL WHEN k <> 1 OR j <> 2 THEN 'object_dimension_unit_contract_invalid' END AS contract,
  CASE WHEN m = 1 THEN 'pass' WHEN j < 3 AND k < 5 THEN 'warn' ELSE 'fail' END AS table_check,
  CASE WHEN k = 0 THEN 'fail' WHEN j = 1 AND m = 1 THEN 'pass' WHEN j = 2 AND m = 2 THEN 'pass' ELSE 'warn' END AS pot_check,
  CASE WHEN k IN (2, 5) OR j = 3 THEN NULL ELSE p_size::DOUBLE END AS leaf_height,
  'ok' || ':' || CASE WHEN m = 1 THEN 'a,b' ELSE 'b' END || ':' || CASE WHEN j = 0 THEN 'none' ELSE 'sku_prior' END || ':' || (m = 2) AS flags FROM p""")
def trust_flags(t):
    k, j, m = F.col("p_partkey") % 7, F.col("p_partkey") % 5, F.col("p_partkey") % 3
    fallback = Fe.leaf_from_fallback(k == 2, F.when(j == 3, True), F.lit(None).cast("boolean"))
    warnings = F.when(m == 1, F.array(F.lit("leaf_cloud_missing"), F.lit("object_cloud_fragmented"))).otherwise(F.array(F.lit("leaf_cloud_missing")))
    rows = t("part").withColumn("leaf_bbox_height_in", F.col("p_size").cast("double"))
    q = Fe.quality_flags(F.lit("ok"), F.when(m == 1, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))), F.when(j != 0, "sku_prior"), F.when(m == 2, "fallback").otherwise("ok"))
    hidden = Fe.suppress_leaf(rows, fallback | (k == 5)).withColumnRenamed("leaf_bbox_height_in", "leaf_height")
    return hidden.select(
        "p_partkey",
        F.array_join(Fe.dimension_warnings(F.col("p_size") - 3.0, F.col("p_retailprice") / 10, j.cast("double")), ",").alias("dims"),
        Fe.geometry_status(F.when(k == 0, "x"), warnings).alias("status"),
        fallback.alias("leaf_fallback"),
        Fe.contract_error(m != 0, F.when(k == 1, "rgb_camera").when(k == 2, "depth_camera"), F.when(j == 2, "meters").otherwise("inches")).alias("contract"),
        R.check_table(j < 3, F.when(k < 5, "degraded").otherwise("failed"), m == 1).alias("table_check"),
        R.check_pot(k == 0, F.when(j == 1, "trusted").otherwise("missing"), F.when(m == 1, "segmentation_trusted"), F.when(j == 2, "sku_prior"), F.when(m == 2, "medium").otherwise("low")).alias("pot_check"),
        "leaf_height",
        F.concat_ws(":", q["geometry_status"], F.array_join(q["warnings"], ","), q["pot_source"], q["leaf_from_fallback"].cast("string")).alias("flags"),
    )


@query("""
WITH p AS (SELECT p_partkey, (['ok', 'skipped', 'failed', 'partial', NULL])[p_partkey % 5 + 1] AS st, p_partkey % 2 = 0 AS o, p_partkey % 3 = 0 AS s, p_partkey % 7 < 3 AS pot, p_partkey % 11 < 5 AS leaf FROM part),
l AS (SELECT *, CASE WHEN st = 'skipped' THEN 'skip' WHEN st = 'failed' AND o THEN 'rescued' WHEN st = 'failed' THEN 'lost' WHEN o THEN 'object' WHEN s THEN 'segmented' WHEN pot AND leaf THEN 'both' WHEN pot OR leaf THEN 'one' ELSE 'nothing' END AS c FROM p)
SELECT p_partkey, CASE c WHEN 'rescued' THEN 'object_cloud' WHEN 'object' THEN 'object_cloud' WHEN 'segmented' THEN 'segmented_cloud' WHEN 'both' THEN 'combined_pot_leaf_cloud' ELSE 'raw_cloud' END AS source,
  c IN ('rescued', 'object', 'segmented', 'both', 'one') AS segmentation_used, CASE WHEN c IN ('skip', 'lost', 'nothing') THEN st WHEN c IN ('rescued', 'one') OR st = 'partial' THEN 'partial' ELSE 'ok' END AS status,
  CASE c WHEN 'skip' THEN 'segmentation_skipped_using_raw_cloud' WHEN 'rescued' THEN 'segmentation_failed_manifest_but_object_cloud_available' WHEN 'lost' THEN 'segmentation_failed_using_raw_cloud' WHEN 'nothing' THEN 'segmentation_not_available' END AS warning FROM l""")
def object_sources(t):
    k = F.col("p_partkey")
    o = Fe.object_source(pick("p_partkey", "ok", "skipped", "failed", "partial", None), {"object_cloud": k % 2 == 0, "segmented_cloud": k % 3 == 0, "pot_cloud": k % 7 < 3, "leaf_cloud": k % 11 < 5})
    return t("part").select("p_partkey", *[o[c].alias(c) for c in ("source", "segmentation_used", "status", "warning")])


@query("""
WITH p AS (SELECT *, p_partkey % 4 AS k, p_partkey % 3 AS m FROM part)
SELECT p_partkey, concat_ws(';', CASE WHEN k = 0 THEN 'geometry.json missing' WHEN m = 0 THEN 'geometry.json malformed' END, CASE WHEN k = 1 THEN 'features.json malformed' END) AS failures,
  CASE WHEN m = 2 THEN 'invalid_status:leaf' END AS segment_error, k <> 0 AS has_dimensions, CASE WHEN k = 2 THEN 1 ELSE 0 END AS n_warnings,
  CASE WHEN p_size > 5 THEN p_size::DOUBLE END AS box_length, p_size > 5 AS completed, CASE WHEN k = 3 THEN 'n' ELSE '' END AS notes, '2026-01-02T03:04:05Z' AS recorded_at, k = 1 AS damage,
  CASE WHEN p_size > 10 THEN (p_size + 1)::DOUBLE ELSE ceil(p_retailprice / 100 + 1) END AS suggested FROM p""")
def record_rules(t):
    k, m, size = F.col("p_partkey") % 4, F.col("p_partkey") % 3, F.col("p_size").cast("double")
    at, none = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"), F.lit(None)
    box = R.make_box(F.when(size > 5, size).otherwise(-size), F.lit(2.0), F.lit(3.0))
    truth = R.truth_record(box, F.lit("good"), F.when(k == 1, True), F.when(k == 3, "n"), at)
    seg = R.segmentation_record(F.lit("ok"), {"pot": F.lit("ok"), "leaf": F.when(m == 2, "odd").otherwise("fallback")})
    geo = Fe.geometry_record(F.when(k == 0, "failed").otherwise("ok"), F.lit("object_cloud"), F.struct(size.alias("x")), F.when(k == 2, F.array(F.lit("w"))), none.cast("string"))
    price = F.col("p_retailprice") / 100
    choice = R.suggest_box_of_candidates([(F.when(size > 10, size), size, size), (price, F.lit(1.0), F.lit(1.0))])
    return t("part").select(
        "p_partkey",
        F.array_join(R.load_failures({"geometry.json": (k != 0, m != 0), "features.json": (F.lit(True), k != 1)}), ";").alias("failures"),
        seg["error"].alias("segment_error"),
        geo["dimensions"].isNotNull().alias("has_dimensions"),
        F.size(geo["warnings"]).alias("n_warnings"),
        truth["actual_box"]["length_in"].alias("box_length"),
        truth["completed"].alias("completed"),
        truth["notes"].alias("notes"),
        truth["recorded_at"].alias("recorded_at"),
        truth["damage"].alias("damage"),
        choice["length_in"].alias("suggested"),
    )


@query("SELECT o_custkey, o_orderkey, round(o_totalprice / 1000, 6) AS length_in FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_truth(t):
    side = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") / 1000).otherwise(F.col("o_totalprice") / 1000)
    box = F.struct(F.when(F.col("o_orderstatus") != "O", side).alias("length_in"), F.lit(1.0).alias("width_in"), F.lit(1.0).alias("height_in"))
    rows = t("orders").select("o_custkey", "o_orderkey", F.lit(True).alias("completed"), box.alias("actual_box"), F.struct("o_orderdate", "o_orderkey").alias("recorded_at"))
    return R.ground_truth(rows, job="o_custkey").select("o_custkey", "o_orderkey", r6(F.col("actual_box.length_in")).alias("length_in"))


@query("""
WITH o AS (SELECT *, o_orderkey % 4 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'b,a' WHEN 1 THEN 'c,d' WHEN 2 THEN 'view_01' ELSE 'y,z' END AS views, CASE k WHEN 0 THEN 'view_02' WHEN 1 THEN '' ELSE 'view_01,view_02' END AS missing,
  k < 2 AND o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS can_stay FROM o WHERE NOT (k < 2 AND o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0)""")
def view_state(t):
    k = F.col("o_orderkey") % 4
    a = lambda *v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
    views = J.view_names(F.when(k == 0, a("b", "a")).otherwise(a()), F.when(k == 1, a("d", "c")), F.when(k == 2, a("view_01")).otherwise(a()), a("z", "y"))
    missing = J.remaining(a("view_01", "view_02"), F.when(k == 0, a("view_01")).when(k == 1, a("view_02", "view_01")).otherwise(a()))
    stays = J.reusable(has_files=k < 2, geometry_status=F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed"), features_version=F.lit("v1"), version="v1", requested=F.col("o_orderkey") % 3 == 0)
    rows = t("orders").select("o_orderkey", F.array_join(views, ",").alias("views"), F.array_join(missing, ",").alias("missing"), stays.alias("can_stay"))
    return J.to_process(rows, rows.filter("can_stay and o_orderkey % 2 = 0"), ["o_orderkey"])


@query("SELECT l_orderkey, sum(l_quantity) AS total_quantity, count(DISTINCT l_partkey) AS unique_sku_count FROM lineitem GROUP BY l_orderkey")
def item_totals(t):
    return J.item_totals(t("lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("sku")), ["l_orderkey"])


@query("""
WITH r AS (SELECT c_custkey, (['2 X 5', '1x1', 'bad', '3x3'])[c_custkey % 4 + 1] AS a, CASE WHEN c_custkey % 5 = 0 THEN ' Job ' || c_custkey END AS j FROM customer),
n AS (SELECT c_custkey, coalesce('job_' || trim(replace(j, ' Job ', '')), 'single_20260714_125623') AS job_id, CASE a WHEN '2 X 5' THEN '2x5' WHEN 'bad' THEN NULL ELSE a END AS arrangement_type,
  CASE a WHEN '2 X 5' THEN 2 WHEN 'bad' THEN NULL ELSE 1 END::INTEGER AS n_views, CASE WHEN a = 'bad' THEN 'invalid_arrangement' END AS error FROM r)
SELECT * FROM n WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey % 10 <> 0
UNION ALL SELECT c_custkey, 'replaced', '1x1', 1, NULL FROM customer WHERE c_custkey % 10 = 0""")
def jobs_table(t):
    job = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(" Job "), F.col("c_custkey").cast("string")))
    requests = t("customer").select("c_custkey", job.alias("job_id"), F.lit("single").alias("job_type"), pick("c_custkey", "2 X 5", "1x1", "bad", "3x3").alias("arrangement"), F.lit("2026-07-14 12:56:23").cast("timestamp_ntz").alias("created_at"))
    made = J.job_metadata(requests).select("c_custkey", "job_id", "arrangement_type", F.when(F.col("required_views").isNotNull(), F.size("required_views")).alias("n_views"), "error")
    free = J.setup_only(made, t("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), job="c_custkey")
    new = t("customer").filter("c_custkey % 10 = 0").select("c_custkey", F.lit("replaced").alias("job_id"), F.lit("1x1").alias("arrangement_type"), F.lit(1).alias("n_views"), F.lit(None).cast("string").alias("error"))
    return J.replace_jobs(free, new, job="c_custkey")


@query("""
WITH p AS (SELECT *, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN p_size::DOUBLE WHEN k = 1 THEN (p_size + 1)::DOUBLE END AS diameter_in, CASE k WHEN 0 THEN 'catalog' WHEN 1 THEN 'high' ELSE 'none' END AS confidence, k < 2 AS available, k = 3 AS no_item FROM p""")
def first_items(t):
    k, none = F.col("p_partkey") % 4, F.lit(None)
    prior_type = "struct<available:boolean,diameter_in:double,confidence:string>"
    prior = F.when(k == 0, F.struct(F.lit(True).alias("available"), F.col("p_size").cast("double").alias("diameter_in"), F.lit("catalog").alias("confidence")))
    meta = F.struct(prior.alias("pot_prior"), F.when(k == 1, F.concat((F.col("p_size") + 1).cast("string"), F.lit(" in"))).otherwise(none.cast("string")).alias("pot_size"))
    item = F.array(F.struct(meta.alias("metadata"), F.lit(1).alias("n")))
    items = F.when(k != 3, F.concat(item, item)).otherwise(F.slice(item, 1, 0))
    rows = t("part").select("p_partkey", items.alias("items")).withColumn("p", Fe.first_item_prior(F.col("items"), ["pot_size"], Cat.CONTAINERS, prior_type))
    p = F.col("p")
    return rows.select("p_partkey", p["diameter_in"].alias("diameter_in"), p["confidence"].alias("confidence"), p["available"].alias("available"), Fe.first_item(F.col("items")).isNull().alias("no_item"))


@query("SELECT l_orderkey, l_returnflag AS role, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) = 1")
def view_roles(t):
    """Lines of an order that share flag and number are many; of these the first in the file counts, as in SQL on one thread."""
    place = F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index")
    rows = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("role"), place.alias("ord"), "l_quantity")
    return Fe.roles(rows, ["l_orderkey"]).select("l_orderkey", "role", "ord.l_linenumber", "l_quantity")


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 5 = 0 AS grp, c_custkey % 9 = 0 AS pred FROM customer), f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus <> 'P'), g AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN grp THEN 'job_type_mismatch' WHEN pred THEN 'prediction_job_not_trainable' WHEN f.o_custkey IS NULL THEN 'missing_combined_features' WHEN g.o_custkey IS NULL THEN 'missing_ground_truth'
  WHEN c_custkey % 7 = 0 THEN 'ground_truth_incomplete' WHEN c_custkey % 11 = 0 THEN 'geometry_untrusted' WHEN m <= 100000 THEN 'invalid_actual_box' END AS skip_reason FROM c LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN g ON g.o_custkey = c_custkey""")
def training_rows(t):
    k = F.col("c_custkey")
    jobs = t("customer").select("c_custkey", F.when(k % 5 == 0, "group").otherwise("single").alias("job_type"), (k % 9 == 0).alias("is_prediction"))
    feats = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().select("c_custkey", F.lit(True).alias("has_features"), F.lit(True).alias("object_available"), (k % 11 != 0).alias("geometry_trusted"), F.lit(True).alias("has_composition"))
    box = F.struct(F.lit(1.0).alias("length_in"), F.lit(2.0).alias("width_in"), (F.max("o_totalprice") - 100000).alias("height_in"))
    truth = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(box.alias("actual_box")).withColumn("completed", k % 7 != 0)
    out = Tr.assemble(jobs, feats, truth, "single", job="c_custkey")
    return out.select("c_custkey", "skip_reason")


@query("SELECT unnest(['actual_box', 'nested.predicted_width', 'p_partkey_label', 'unit_price']) AS name")
def leaked_names(t):
    rows = t("part").select("p_partkey", F.lit(1).alias("p_partkey_label"), F.lit(1).alias("actual_box"), F.lit(1.0).alias("unit_price"), F.struct(F.lit(1).alias("predicted_width"), F.lit(2).alias("fine")).alias("nested"))
    return rows.sparkSession.createDataFrame([(n,) for n in Tr.leaked_columns(rows.schema)], "name string")


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) IS NOT NULL AS complete FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) = 2")
def complete_jobs(t):
    seen = t("orders").select("o_custkey", F.col("o_orderpriority").alias("view_name"))
    need = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("required_views"))
    return Se.complete_jobs(seen, need, job="o_custkey").withColumn("complete", F.lit(True))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS frame, epoch(TIMESTAMP '2030-01-01') - max(epoch(ts)) > 2.0 AS stale FROM events GROUP BY user_id")
def frame_cache(t):
    frames = t("events").select("user_id", "ts", F.col("event_id").alias("frame"))
    return Se.latest_frames(frames, F.lit("2030-01-01").cast("timestamp_ntz"), camera="user_id").select("user_id", "frame", "stale")


@query("SELECT c_custkey, min(c_custkey) OVER (PARTITION BY round(c_acctbal / 100), c_nationkey % 5, c_mktsegment) AS first_of_setting FROM customer")
def setting_rows(t):
    """Customers with the same setting share a key: the first of each."""
    setting = F.struct(F.struct(F.round(F.col("c_acctbal") / 100).alias("crop"), (F.col("c_nationkey") % 5).alias("profile")).alias("camera"), F.col("c_mktsegment").alias("mode"))
    keyed = t("customer").select("c_custkey", T.canonical_key(setting.alias("setting")).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("c_custkey").alias("first_of_setting")), "k").drop("k")


@query("""
WITH c AS (SELECT c_custkey, c_acctbal, round(c_acctbal, 2) AS a, c_nationkey AS n FROM customer)
SELECT count(*) AS n_rows, count(DISTINCT (a, n)) AS n_keys FROM c""")
def setting_keys(t):
    rows = t("customer").select(T.canonical_key(F.round(F.col("c_acctbal"), 2).alias("a"), F.col("c_nationkey").alias("n")).alias("k"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("k").alias("n_keys"))


@query("""
WITH g AS (SELECT o_custkey, o_orderpriority AS k, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)
SELECT o_custkey, max(n) FILTER (k = '1-URGENT') AS "qty__1-URGENT", max(n) FILTER (k = '5-LOW') AS "qty__5-LOW" FROM g GROUP BY o_custkey""")
def token_columns(t):
    g = t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return Fe.with_tokens(g, "m", "qty", ["1-URGENT", "5-LOW"]).drop("m")


