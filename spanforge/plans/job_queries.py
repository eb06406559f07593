"""Text, catalogue, item, feature, rule and session operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import catalogue as Cat
from spanforge.operators import features as Fe
from spanforge.operators import jobs as J
from spanforge.operators import rules as R
from spanforge.operators import training as Tr
from spanforge.plans.base import query, r6
from spanforge.streaming import sessions as Se


@query(r"""
SELECT c_custkey, regexp_replace(upper(regexp_replace('  ' || c_name || ' / x', '^\s+|\s+$', '', 'g').regexp_replace('\s+', '-', 'g')), '[^A-Z0-9_.-]', '', 'g') AS sku,
       regexp_replace(regexp_replace(lower(c_mktsegment || ' Job/' || c_custkey), '\s+', '_', 'g'), '[^a-z0-9_-]+', '', 'g') AS job_id,
       regexp_replace(upper('sku#' || c_name), '[^A-Z0-9_-]+', '', 'g') || '_20260714_125623' AS collection_id, true AS valid FROM customer""")
def sku_normalize(t):
    raw = F.concat(F.lit("  "), "c_name", F.lit(" / x\t"))
    at = F.lit("2026-07-14 12:56:23").cast("timestamp_ntz")
    sku = T.require_valid_sku(raw)
    return t("customer").select("c_custkey", sku.alias("sku"), T.sanitize_job_id(F.concat(F.lit(" "), "c_mktsegment", F.lit(" Job/"), F.col("c_custkey").cast("string"))).alias("job_id"), T.collection_job_id(F.lit("single"), F.concat(F.lit("sku#"), "c_name"), F.lit(True), at).alias("collection_id"), T.is_valid_sku(sku).alias("valid"))


@query("""
WITH a AS (SELECT p_partkey, p_size % 5 AS r, p_size % 7 AS c FROM part)
SELECT p_partkey, CASE WHEN r > 0 AND c > 0 THEN r || 'x' || c END AS arrangement_type, CASE WHEN r > 0 AND c > 0 THEN r * c END AS cell_count,
       CASE WHEN r > 0 AND c > 0 THEN r = 1 AND c = 1 END AS is_single,
       CASE WHEN r > 0 AND c > 0 THEN CASE WHEN r = c THEN 'single_view' ELSE 'two_view_rectangle' END END AS view_mode,
       CASE WHEN r > 0 AND c > 0 THEN CASE WHEN r = c THEN 1 ELSE 2 END END AS n_views FROM a""")
def arrangement(t):
    text = F.concat(F.lit(" "), (F.col("p_size") % 5).cast("string"), F.lit(" X "), (F.col("p_size") % 7).cast("string"), F.lit(" "))
    s = t("part").select("p_partkey", T.arrangement_summary(text).alias("s"))
    return s.select("p_partkey", "s.arrangement_type", "s.cell_count", "s.is_single", "s.view_mode", F.when(F.col("s.default_view_names").isNotNull(), F.size("s.default_view_names")).alias("n_views"))


_SPEC = "CASE p_size % 6 WHEN 0 THEN p_size || '\" Pot' WHEN 1 THEN p_size || ' x ' || (p_size + 2) || ' Flat' WHEN 2 THEN p_size || ' Gal' WHEN 3 THEN '  ' WHEN 4 THEN p_size || '.5 inch hb' ELSE p_type END"


@query(r"""
WITH s AS (SELECT p_partkey, trim(%s) AS s FROM part),
k AS (SELECT *, regexp_matches(s, '(?i)[0-9]+(?:\.[0-9]+)?\s*x\s*[0-9]+(?:\.[0-9]+)?\s*(flat|tray)?\b') AS rect, regexp_matches(s, '(?i)[0-9]+(?:\.[0-9]+)?\s*(?:"|in|inch|inches)\s*(pot|basket|hb|hanging basket)?\b') AS rnd FROM s)
SELECT p_partkey, s <> '' AND (rect OR rnd) AS available, CASE WHEN s = '' THEN 'unknown' WHEN rect THEN 'rectangular' WHEN rnd THEN 'round' ELSE 'unknown' END AS shape,
       CASE WHEN NOT rect AND rnd THEN regexp_extract(s, '(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:"|in|inch|inches)', 1)::DOUBLE END AS diameter_in,
       CASE WHEN rect THEN regexp_extract(s, '(?i)([0-9]+(?:\.[0-9]+)?)\s*x', 1)::DOUBLE WHEN rnd THEN regexp_extract(s, '(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:"|in|inch|inches)', 1)::DOUBLE END AS width_in,
       CASE WHEN s = '' THEN 'spec_missing' WHEN rect THEN 'rectangular_dimensions_parsed_from_spec' WHEN rnd THEN 'diameter_parsed_from_spec' WHEN regexp_matches(s, '(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:gal|gallon|gallons)\b') THEN 'gallon_spec_not_mapped' ELSE 'spec_unparsed' END AS note FROM k""" % _SPEC)
def spec_prior(t):
    p = t("part").select("p_partkey", F.expr(_SPEC.replace('\\"', '"')).alias("s")).select("p_partkey", T.spec_prior(F.col("s")).alias("p"))
    return p.select("p_partkey", "p.available", "p.shape", "p.diameter_in", "p.width_in", F.col("p.notes")[0].alias("note"))


@query(r"""
WITH s AS (SELECT p_partkey, p_size, p_size %% 4 AS k FROM part),
v AS (SELECT *, CASE k WHEN 2 THEN p_size * 4.0 WHEN 3 THEN p_size * 1.05668821 END AS qt FROM s),
c(name, d, q, o) AS (VALUES ('1 qt', 4.0, 1.0, 0), ('2 qt', 5.5, 2.0, 1), ('3 qt', 6.5, 3.0, 2), ('1 gal', 6.5, 4.0, 3), ('2 gal', 8.5, 8.0, 4), ('3 gal', 10.0, 12.0, 5), ('5 gal', 12.0, 20.0, 6)),
n AS (SELECT p_partkey, arg_min(name, (abs(q - qt), o)) AS name, arg_min(d, (abs(q - qt), o)) AS d, min(abs(q - qt)) AS delta FROM v, c WHERE qt IS NOT NULL GROUP BY 1)
SELECT v.p_partkey, true AS available, CASE WHEN k < 2 THEN 'high' WHEN delta <= 1 THEN 'medium' ELSE 'low' END AS confidence,
       round(CASE k WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size / 2.54 ELSE d END, 6) AS diameter_in, round(qt, 6) AS volume_qt,
       CASE WHEN k < 2 THEN 'sku_exact' ELSE 'sku_container_lookup' END AS source FROM v LEFT JOIN n ON v.p_partkey = n.p_partkey""".replace("%%", "%"))
def metadata_prior(t):
    size = F.col("p_size").cast("string")
    k = F.col("p_size") % 4
    rows = t("part").select("p_partkey", F.when(k == 0, size).alias("diameter_in"), F.when(k == 1, F.concat(size, F.lit(" cm pot"))).when(k == 2, F.concat(size, F.lit(" gal"))).when(k == 3, F.concat(size, F.lit(" Liters"))).alias("size"))
    p = rows.select("p_partkey", T.metadata_prior({"diameter_in": F.col("diameter_in"), "size": F.col("size")}, Cat.CONTAINERS).alias("p"))
    return p.select("p_partkey", "p.available", "p.confidence", r6("p.diameter_in").alias("diameter_in"), r6("p.volume_qt").alias("volume_qt"), "p.source")


@query("""
WITH c(name, d, q, o) AS (VALUES ('1 qt', 4.0, 1.0, 0), ('2 qt', 5.5, 2.0, 1), ('3 qt', 6.5, 3.0, 2), ('1 gal', 6.5, 4.0, 3), ('2 gal', 8.5, 8.0, 4), ('3 gal', 10.0, 12.0, 5), ('5 gal', 12.0, 20.0, 6))
SELECT p_partkey, arg_min(name, (abs(q - p_size / 2.0), o)) AS container, round(min(abs(q - p_size / 2.0)), 6) AS container_delta, CASE WHEN min(abs(q - p_size / 2.0)) <= 1 THEN 'medium' ELSE 'low' END AS confidence FROM part, c GROUP BY 1""")
def container_nearest(t):
    out = Cat.nearest(t("part").select("p_partkey", (F.col("p_size") / 2.0).alias("volume_qt")))
    return out.select("p_partkey", "container", r6("container_delta").alias("container_delta"), "confidence")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'not_found' ELSE 'found' END AS status, p_brand AS brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND l_partkey % 3 <> 0")
def sku_lookup(t):
    cat = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("SKU-"), "p_partkey")).otherwise(F.concat(F.lit("sku-"), "p_partkey")).alias("sku"), F.col("p_brand").alias("brand"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit(" sku "), "l_partkey", F.when(F.col("l_partkey") % 3 == 0, "-unknown").otherwise(" ")).alias("sku"))
    return Cat.lookup(rows, cat).select("l_orderkey", "l_linenumber", "status", "brand")


@query("SELECT l_orderkey, 'BRAND' || l_partkey % 20 AS sku, sum(l_quantity) AS quantity, min(l_linenumber) AS first_ord FROM lineitem GROUP BY 1, 2")
def item_merge(t):
    rows = t("lineitem").select("l_orderkey", F.concat(F.when(F.col("l_linenumber") % 2 == 0, " Brand").otherwise("bRAND"), (F.col("l_partkey") % 20).cast("string"), F.lit(" ")).alias("sku"), "l_quantity", "l_linenumber")
    return J.merge_items(rows, keys=["l_orderkey"], quantity="l_quantity", order="l_linenumber")


@query(r"""
WITH i AS (SELECT l_orderkey, upper('p' || l_partkey) AS sku, l_quantity::BIGINT AS q, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS category, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS spec, p_size %% 3 <> 0 AS trusted, p_size::DOUBLE AS d FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT l_orderkey, category, spec, sum(q) AS q FROM i GROUP BY ALL),
s AS (SELECT l_orderkey, count(*) AS n, max(q) AS largest, string_agg(category || ':' || spec || ':' || q, '|' ORDER BY category, spec) AS summary FROM t GROUP BY 1)
SELECT i.l_orderkey, any_value(summary) AS summary, CASE WHEN count(DISTINCT sku) = 1 THEN 1.0 ELSE 0.0 END AS homogeneous_group, any_value(n)::DOUBLE AS type_count, round(any_value(largest) / sum(q), 6) AS largest_ratio,
       round(coalesce(sum(q) FILTER (trusted), 0) / sum(q), 6) AS prior_ratio, round(sum(d * q) FILTER (trusted) / sum(q) FILTER (trusted), 6) AS mean_diameter
FROM i JOIN s ON i.l_orderkey = s.l_orderkey GROUP BY 1""".replace("%%", "%"))
def group_composition(t):
    prior = F.col("p_size") % 3 != 0
    items = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("quantity"), F.col("p_type").alias("category"), F.col("p_brand").alias("spec"), F.lit(True).alias("available"), F.when(prior, "catalog").otherwise("low").alias("confidence"), F.col("p_size").cast("double").alias("diameter_in"), *[F.lit(None).cast("double").alias(c) for c in ("width_in", "depth_in", "height_in")])
    g = Fe.group_composition(items, job="l_orderkey")
    return g.select("l_orderkey", F.col("group_composition_summary").alias("summary"), "homogeneous_group", F.col("group_composition_type_count").alias("type_count"), r6("group_largest_type_ratio").alias("largest_ratio"), r6("group_pot_prior_quantity_ratio").alias("prior_ratio"), r6("group_pot_prior_diameter_in_weighted_mean").alias("mean_diameter"))


@query("""
WITH v AS (SELECT l_orderkey, 'view_' || lpad(l_linenumber::VARCHAR, 2, '0') AS view_name, l_linenumber AS ord, l_extendedprice AS h, CASE WHEN l_discount > 0.05 THEN l_extendedprice * 0.98 END AS rh, l_quantity AS vert, l_orderkey % 3 = 0 AS sq FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_quantity) AS l_quantity FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2)),
j AS (SELECT l_orderkey, sq, count(*) AS view_count, arg_min(coalesce(rh, h), ord) AS first_side, arg_min(vert, ord) AS first_vert, max(vert) AS top, max(coalesce(rh, h)) FILTER (view_name = 'view_01') AS l, max(coalesce(rh, h)) FILTER (view_name = 'view_02') AS w FROM v GROUP BY ALL)
SELECT l_orderkey, view_count, CASE WHEN sq THEN 'square_single_view' ELSE 'rectangular_two_view' END AS policy, round(CASE WHEN sq THEN first_side ELSE coalesce(l, first_side) END, 6) AS length_in,
       round(CASE WHEN sq THEN first_side ELSE w END, 6) AS width_in, round(CASE WHEN sq THEN first_vert ELSE top END, 6) AS height_in, CASE WHEN NOT sq AND w IS NULL THEN 'rectangular_arrangement_requires_width_view' END AS error FROM j""")
def view_combine(t):
    li = t("lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_extendedprice", "l_discount", "l_quantity")])
    views = li.select("l_orderkey", T.view_id(F.col("l_linenumber")).alias("view_name"), F.col("l_linenumber").alias("ord"), F.col("l_extendedprice").alias("horizontal_in"), F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice") * 0.98).alias("robust_horizontal_in"), F.col("l_quantity").alias("vertical_in"), F.col("l_quantity").alias("robust_vertical_in"), F.lit(1).alias("point_count"))
    square = F.col("o_orderkey") % 3 == 0
    jobs = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(square, "2x2").otherwise("2x3").alias("arrangement_type"), F.when(square, "single_view").otherwise("two_view_rectangle").alias("view_mode"))
    out = Fe.combine_dimensions(views, jobs, job="l_orderkey")
    return out.select("l_orderkey", "view_count", "policy", r6("length_in").alias("length_in"), r6("width_in").alias("width_in"), r6("height_in").alias("height_in"), "error")


_ADMISSION = """
SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'job_type_mismatch' WHEN d.doc_id % 11 = 0 THEN 'prediction_job_not_trainable' WHEN d.n_chars < 300 THEN 'missing_combined_features'
  WHEN l.doc_id IS NULL THEN 'missing_ground_truth' WHEN l.toxic = 1 THEN 'ground_truth_incomplete' WHEN d.doc_id % 13 = 0 THEN 'missing_ai2_features' WHEN d.lang = 'fr' THEN 'object_unavailable'
  WHEN d.n_chars > 5000 THEN 'geometry_untrusted' WHEN l.quality = 0 THEN 'invalid_actual_box' END AS skip_reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _admission(t):
    d = t("documents").select("doc_id", "lang", "n_chars")
    jobs = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "group").otherwise("single").alias("job_type"), (F.col("doc_id") % 11 == 0).alias("is_prediction"))
    features = d.filter("n_chars >= 300").select("doc_id", (F.col("doc_id") % 13 != 0).alias("has_features"), (F.col("lang") != "fr").alias("object_available"), (F.col("n_chars") <= 5000).alias("geometry_trusted"), F.lit(True).alias("has_composition"))
    side = F.when(F.col("quality") == 1, 2.0).otherwise(0.0)
    truth = t("labels").select("doc_id", (F.col("toxic") == 0).alias("completed"), F.struct(side.alias("length_in"), F.lit(3.0).alias("width_in"), F.lit(4.0).alias("height_in")).alias("actual_box"))
    return Tr.assemble(jobs, features, truth, "single", job="doc_id")


@query(_ADMISSION)
def training_admission(t):
    return _admission(t).select("doc_id", "skip_reason")


@query(f"SELECT skip_reason, count(*) AS n_jobs FROM ({_ADMISSION}) GROUP BY 1")
def admission_audit(t):
    return Tr.audit(_admission(t))


@query("SELECT vec_id, %s, (label %% 2 = 0)::INT::DOUBLE AS leaf_available, NULL::DOUBLE AS leaf_profile_available, NULL::DOUBLE AS object_profile_available, NULL::DOUBLE AS table_available, %s FROM embeddings" % (", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS object_vertical_density_bins_{i:02d}" for i in range(10)), ", ".join(f"NULL::DOUBLE AS leaf_vertical_density_bins_{i:02d}" for i in range(10))))
def feature_vector(t):
    df = t("embeddings").select("vec_id", F.col("embedding").alias("object_vertical_density_bins"), (F.col("label") % 2 == 0).alias("leaf_available"), F.lit(1.0).alias("unit_price_usd"), F.lit("x").alias("job_id"))
    v = Tr.vectorise(df, ["vec_id"])
    return v.select("vec_id", *[r6(c).alias(c) for c in v.columns if c != "vec_id"])


@query("""
WITH j AS (SELECT d.doc_id, l.quality::DOUBLE AS quality, CASE WHEN d.n_chars > 1000 THEN d.n_chars::DOUBLE END AS n, CASE WHEN d.lang <> 'de' THEN d.lang END AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(quality, (SELECT median(quality) FROM j)) AS quality, coalesce(n, (SELECT median(n) FROM j)) AS n, coalesce(lang, '__missing__') AS lang, %s FROM j""" % ", ".join(f"CASE WHEN coalesce(lang, '__missing__') = '{v}' THEN 1.0 ELSE 0.0 END AS lang_{v}" for v in ("en", "fr", "__missing__")))
def impute_onehot(t):
    j = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.col("quality").cast("double").alias("quality"), F.when(F.col("n_chars") > 1000, F.col("n_chars").cast("double")).alias("n"), F.when(F.col("lang") != "de", F.col("lang")).alias("lang"))
    out = Tr.one_hot(Tr.impute(j, ["quality", "n"], ["lang"]), "lang", ["en", "fr", "__missing__"])
    return out.select("doc_id", "quality", "n", "lang", *[F.col(f"`lang={v}`").alias(f"lang_{v}") for v in ("en", "fr", "__missing__")])


@query("SELECT * FROM (SELECT 'quality' AS label, min(quality)::DOUBLE AS least, max(quality)::DOUBLE AS greatest, round(avg(quality), 6) AS mean FROM labels UNION ALL SELECT 'toxic', min(toxic), max(toxic), round(avg(toxic), 6) FROM labels)")
def label_summary(t):
    return Tr.label_summary(t("labels"), ("quality", "toxic")).select("label", "least", "greatest", r6("mean").alias("mean"))


@query("SELECT p_partkey, ceil(p_size + 1)::DOUBLE AS length_in, ceil((p_size / 2.0 + 1))::DOUBLE AS width_in, ceil(p_retailprice / 100 + 1)::DOUBLE AS height_in FROM part WHERE p_size > 0")
def box_suggest(t):
    b = t("part").select("p_partkey", R.suggest_box(F.col("p_size").cast("double"), F.col("p_size") / 2.0, F.col("p_retailprice") / 100).alias("b"))
    return b.filter("b is not null").select("p_partkey", "b.length_in", "b.width_in", "b.height_in")


@query("""
WITH b AS (SELECT o_orderkey, o_totalprice / 10000 AS p, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 10000 + (o_orderkey % 5 - 2) * 0.6 END AS a FROM orders)
SELECT o_orderkey, round(p - a, 6) AS diff, abs(p - a) <= 1.0 AS match FROM b WHERE a IS NOT NULL""")
def pred_vs_truth(t):
    p = F.col("o_totalprice") / 10000
    a = F.when(F.col("o_orderkey") % 4 > 0, p + (F.col("o_orderkey") % 5 - 2) * 0.6)
    box = lambda c: F.struct(c.alias("length_in"), c.alias("width_in"), c.alias("height_in"))
    out = t("orders").select("o_orderkey", Tr.compare_boxes(box(p), box(a)).alias("c")).filter("c is not null")
    return out.select("o_orderkey", r6("c.length_in").alias("diff"), "c.match")


@query("""
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'fail' ELSE 'pass' END AS object, CASE o_orderkey % 8 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS object_cloud, CASE WHEN o_orderstatus = 'P' THEN 'fail' ELSE 'pass' END AS geometry,
  'pass' AS features, CASE o_orderkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS "table", CASE WHEN o_custkey % 2 = 0 THEN 'fail' ELSE 'pass' END AS leaf, CASE WHEN o_custkey % 3 = 0 THEN 'warn' ELSE 'pass' END AS gt FROM orders)
SELECT o_orderkey, CASE WHEN 'fail' IN (object, object_cloud, geometry) THEN 'recapture' WHEN object_cloud = 'warn' OR "table" = 'fail' THEN 'review' ELSE 'proceed' END AS decision,
  concat_ws(',', CASE WHEN object = 'fail' THEN 'object' END, CASE WHEN leaf = 'fail' THEN 'leaf' END, CASE WHEN geometry = 'fail' THEN 'geometry' END, CASE WHEN object_cloud = 'fail' THEN 'object_cloud' END, CASE WHEN "table" = 'fail' THEN 'table' END) AS failed FROM c""")
def quality_decision(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda fail, warn=F.lit(False): F.when(fail, "fail").when(warn, "warn").otherwise("pass")
    checks = {"object": s(k % 9 == 0), "object_cloud": s(k % 8 == 0, k % 8 == 1), "geometry": s(F.col("o_orderstatus") == "P"), "features": F.lit("pass"), "table": s(k % 5 == 0, k % 5 == 1), "leaf": s(c % 2 == 0), "gt": s(F.lit(False), c % 3 == 0)}
    return t("orders").select("o_orderkey", R.decision(checks).alias("d")).select("o_orderkey", "d.decision", "d.failed")


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey * 60 AS n, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 10 / 10.0 END AS ratio, 1 + s_suppkey % 4 / 4.0 AS outlier, s_suppkey % 6 = 0 AS fb, s_acctbal / 60 AS d FROM supplier),
w AS (SELECT *, CASE WHEN n <= 0 THEN 'object_cloud_empty' WHEN n < 500 THEN 'object_cloud_too_sparse' END AS a, CASE WHEN fb THEN 'object_from_fallback_mask' END AS b, CASE WHEN outlier >= 1.75 THEN 'raw_bbox_much_larger_than_robust_bbox' END AS c,
  CASE WHEN ratio < 0.7 THEN 'object_cloud_fragmented' END AS e, CASE WHEN d <= 0 OR d > 120 THEN 'object_cloud_dimensions_suspicious' END AS f FROM s)
SELECT s_suppkey, CASE WHEN n <= 0 OR n < 250 OR coalesce(ratio < 0.4, false) THEN 'fail' WHEN coalesce(a, b, e, f) IS NOT NULL THEN 'review' ELSE 'ok' END AS quality, concat_ws(',', a, b, c, e, f) AS warnings FROM w""")
def cloud_quality(t):
    k, d = F.col("s_suppkey"), F.col("s_acctbal") / 60
    q = Fe.cloud_quality("object", F.col("s_nationkey") * 60, F.when(k % 3 > 0, k % 10 / 10.0), 1 + k % 4 / 4.0, k % 6 == 0, d, F.lit(5.0), F.lit(5.0))
    return t("supplier").select("s_suppkey", q.alias("q")).select("s_suppkey", "q.quality", F.array_join("q.warnings", ",").alias("warnings"))


@query("""
WITH r AS (SELECT p_brand || '-' || p_size AS sku, p_partkey AS ord, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS category, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS description, p_partkey % 5 = 0 AS prior FROM part),
s AS (SELECT *, (category IS NOT NULL)::INT + (description IS NOT NULL)::INT + prior::INT * 2 AS score FROM r)
SELECT sku, ord, score, count(*) OVER (PARTITION BY sku) AS n_rows FROM s QUALIFY row_number() OVER (PARTITION BY sku ORDER BY score DESC, ord) = 1""")
def catalogue_dedupe(t):
    k = F.col("p_partkey")
    rows = t("part").select(F.concat_ws("-", "p_brand", "p_size").alias("sku"), k.alias("ord"), F.when(k % 3 > 0, F.col("p_type")).alias("category"), F.when(k % 4 > 0, F.col("p_name")).alias("description"), (k % 5 == 0).alias("prior"))
    scored = rows.withColumn("score", Cat.completeness(F.col("prior"), F.col("category"), F.col("description")))
    return Cat.dedupe(scored, fields=["category", "description"]).select("sku", "ord", "score", "n_rows")


@query("""
WITH e AS (SELECT user_id, event_id, ts, event_type, CASE event_id % 4 WHEN 0 THEN 'status' WHEN 1 THEN 'view' WHEN 2 THEN 'step' ELSE CASE WHEN event_id % 8 = 3 THEN 'error' ELSE 'view' END END AS kind, value > 50 AS done FROM events),
s AS (SELECT user_id, arg_max(CASE WHEN kind = 'error' THEN 'error' ELSE event_type END, (ts, event_id)) FILTER (kind IN ('status', 'error')) AS status, count(*) FILTER (kind = 'error') AS n_errors FROM e GROUP BY 1),
v AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first_ts, id) AS views FROM (SELECT user_id, event_type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS id FROM e WHERE kind = 'view' GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT user_id, count(*) FILTER (done) AS done_steps FROM (SELECT user_id, event_type, arg_max(done, (ts, event_id)) AS done FROM e WHERE kind = 'step' GROUP BY 1, 2) GROUP BY 1)
SELECT s.user_id, coalesce(status, 'created') AS status, n_errors, coalesce(views, '') AS views, coalesce(done_steps, 0) AS done_steps FROM s LEFT JOIN v ON s.user_id = v.user_id LEFT JOIN p ON s.user_id = p.user_id""")
def session_state(t):
    k = F.col("event_id") % 4
    e = t("events").select("user_id", "event_id", "ts", F.col("event_type").alias("name"), F.when(k == 0, "status").when(k == 1, "view").when(k == 2, "step").when(F.col("event_id") % 8 == 3, "error").otherwise("view").alias("kind"), (F.col("value") > 50).alias("done"))
    out = Se.fold(e, job="user_id")
    return out.select("user_id", "status", "n_errors", F.array_join("captured_views", ",").alias("views"), F.size(F.map_filter("steps", lambda _, v: v)).cast("long").alias("done_steps"))


@query("SELECT user_id, round(sum(value) FILTER (event_type <> 'view'), 6) AS stage_sum_s, 500.0 AS total_s, round(greatest(0, 500 - coalesce(sum(value) FILTER (event_type <> 'view'), 0)), 6) AS unattributed_s FROM events GROUP BY 1")
def profile_totals(t):
    e = t("events").select("user_id", F.when(F.col("event_type") == "view", "rgb_png_write_s").otherwise(F.col("event_type")).alias("stage"), F.col("value").alias("seconds"), F.lit(500.0).alias("total_s"))
    out = J.profile_totals(e, ["user_id"])
    return out.select("user_id", r6("stage_sum_s").alias("stage_sum_s"), "total_s", r6("unattributed_s").alias("unattributed_s"))


@query("""
WITH u AS (SELECT DISTINCT user_id FROM events), k(event_type) AS (SELECT DISTINCT event_type FROM events)
SELECT u.user_id, k.event_type, EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = k.event_type AND value > 60) AS present FROM u, k""")
def presence_matrix(t):
    e = t("events")
    return J.presence(e.select("user_id").distinct(), e.select("event_type").distinct(), e.filter("value > 60"), ["user_id"], "event_type")


@query("""
WITH s AS (SELECT user_id, list(DISTINCT event_type) AS seen FROM events WHERE value > 70 GROUP BY 1)
SELECT user_id, list_filter(['click', 'purchase', 'view'], lambda x: NOT list_contains(seen, x))[1] AS next_view FROM s""")
def next_view(t):
    s = t("events").filter("value > 70").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return s.select("user_id", J.next_view(F.array(F.lit("click"), F.lit("purchase"), F.lit("view")), F.col("seen")).alias("next_view"))


_POT = """
WITH p AS (SELECT vec_id, label = 0 AS fb, abs(embedding[1]::DOUBLE) * 6 AS conf, abs(embedding[2]::DOUBLE) * 3 AS area, abs(embedding[3]::DOUBLE) * 5 AS ov, abs(embedding[4]::DOUBLE) * 7 AS lower, abs(embedding[5]::DOUBLE) * 6 AS centre, abs(embedding[6]::DOUBLE) * 5 AS fill, floor(abs(embedding[7]::DOUBLE) * 20000) AS n, abs(embedding[8]::DOUBLE) * 100 AS w, abs(embedding[9]::DOUBLE) * 100 AS h FROM embeddings),
r AS (SELECT *, concat_ws(';', CASE WHEN fb THEN 'fallback_pot_mask_debug_only' END, CASE WHEN conf < 0.4 THEN 'pot_confidence_below_threshold' END, CASE WHEN area < 0.03 THEN 'pot_area_too_small_relative_to_object' END, CASE WHEN area > 0.55 THEN 'pot_area_too_large_relative_to_object' END,
 CASE WHEN ov < 0.3 THEN 'pot_object_overlap_below_threshold' END, CASE WHEN lower < 0.5 THEN 'pot_not_low_enough_in_object' END, CASE WHEN centre < 0.35 THEN 'pot_badly_off_center' END, CASE WHEN fill < 0.18 THEN 'pot_mask_fill_ratio_too_low' END, CASE WHEN n < 500 THEN 'pot_depth_point_count_too_low' END,
 CASE WHEN w NOT BETWEEN 1.5 AND 30 THEN 'pot_depth_width_physically_implausible' END, CASE WHEN h NOT BETWEEN 1 AND 30 THEN 'pot_depth_height_physically_implausible' END) AS reasons FROM p)
SELECT vec_id, CASE WHEN reasons = '' THEN 'trusted' WHEN fb THEN 'fallback' WHEN conf < 0.4 THEN 'rejected_low_confidence' WHEN ov < 0.3 THEN 'rejected_low_overlap' WHEN area < 0.03 THEN 'rejected_too_small' WHEN area > 0.55 THEN 'rejected_too_large'
  WHEN contains(reasons, 'pot_depth') THEN 'rejected_partial' ELSE 'rejected_bad_location' END AS status, CASE WHEN reasons = '' THEN 'pot_mask_passed_quality_checks' ELSE reasons END AS reason,
  round((least(1, conf / 0.4) + least(1, ov / 0.3) + least(1, centre / 0.35) + least(1, lower / 0.5) + least(1, fill / 0.18)) / 5, 6) AS trust_score FROM r"""


@query(_POT)
def pot_quality(t):
    e = lambda i, k: F.abs(F.get("embedding", F.lit(i)).cast("double")) * k
    q = R.pot_quality(has_mask=F.lit(True), is_fallback=F.col("label") == 0, confidence=e(0, 6), area_ratio=e(1, 3), overlap=e(2, 5), has_object=F.lit(True), lower=e(3, 7), centre=e(4, 6), fill=e(5, 5), points=F.floor(e(6, 20000)), width_in=e(7, 100), height_in=e(8, 100), at_edge=F.lit(False))
    return t("embeddings").select("vec_id", q.alias("q")).select("vec_id", "q.status", "q.reason", r6("q.trust_score").alias("trust_score"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS props_k, json_extract_string(props, '$.n') AS props_n FROM events")
def flatten_json(t):
    e = t("events").select("event_id", F.from_json("props", "k string, n string").alias("props"))
    return T.flatten(e)


@query("""
SELECT o_orderkey, c_name, n_items, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = o_orderkey""")
def job_rows(t):
    jobs = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"))
    truth = t("labels").select(F.col("doc_id").alias("o_orderkey")).distinct()
    return J.job_rows(jobs, items, truth, truth, job="o_orderkey").select("o_orderkey", "c_name", "n_items", "o_totalprice")


@query("""
WITH v AS (SELECT l_orderkey, bool_and(l_returnflag <> 'A' AND l_quantity > 2) AS ok FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(ok, true) AND o_orderstatus <> 'P' AND o_totalprice > 0 AS geometry_trusted FROM orders LEFT JOIN v ON l_orderkey = o_orderkey""")
def geometry_trusted(t):
    views = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "A", "ok").otherwise("degraded").alias("geometry_status"), F.lit("object_cloud").alias("source_cloud"), F.lit("v/object_cloud.ply").alias("cloud_path"), F.lit("rgb_camera").alias("frame"), F.lit("meters").alias("units"), F.when(F.col("l_quantity") > 2, F.col("l_quantity")).otherwise(0.0).alias("point_count"))
    p = F.col("o_totalprice")
    jobs = t("orders").select("o_orderkey", F.lit(True).alias("explicit_spans"), (F.col("o_orderstatus") != "P").alias("object_available"), p.alias("length_in"), p.alias("width_in"), p.alias("height_in"), F.lit("view_01.vertical_span").alias("height_source"), F.lit("view_01.horizontal_span").alias("width_source"), F.lit(True).alias("square_width_equals_length"))
    return Fe.geometry_trusted(views, jobs, job="o_orderkey").select("o_orderkey", "geometry_trusted")


@query("""
SELECT l_orderkey, max(l_extendedprice) AS height_in, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS warnings, count(DISTINCT l_linenumber) AS n_views FROM lineitem GROUP BY 1""")
def view_warnings(t):
    views = t("lineitem").select("l_orderkey", F.col("l_extendedprice").alias("height_in"), F.array("l_returnflag").alias("warnings"), T.view_id(F.col("l_linenumber")).alias("view_name"), F.col("l_linestatus").alias("status"))
    out = Fe.combine_views(views, job="l_orderkey")
    return out.select("l_orderkey", "height_in", F.array_join("warnings", ",").alias("warnings"), F.size("statuses").cast("long").alias("n_views"))


@query("""
WITH l AS (SELECT l_orderkey, sum(l_linenumber) AS total, max(l_orderkey % 10 = 0) AS bad FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN bad THEN 'invalid_item_quantity' WHEN total <> 3 THEN 'quantity_does_not_match_arrangement' END AS error FROM l""")
def quantity_check(t):
    li = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("total"), F.max(F.col("l_orderkey") % 10 == 0).alias("bad"))
    return li.select("l_orderkey", R.quantity_check(F.col("total"), F.col("bad"), F.lit(" 1 X 3")).alias("error"))


@query("""
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'length_in' END, CASE WHEN c_nationkey = 3 THEN 'width_in' END) AS missing, concat_ws(',', CASE WHEN c_custkey % 5 > 0 AND c_acctbal <= 0 THEN 'length_in' END, CASE WHEN c_nationkey <> 3 AND c_nationkey <= 0 THEN 'width_in' END) AS invalid FROM customer""")
def request_check(t):
    length = F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal"))
    width = F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))
    r = t("customer").select("c_custkey", R.missing_and_invalid({"length_in": (length, T.positive(length).isNotNull()), "width_in": (width, T.positive(width).isNotNull())}).alias("r"))
    return r.select("c_custkey", F.array_join("r.missing", ",").alias("missing"), F.array_join("r.invalid", ",").alias("invalid"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'pot' WHEN 2 THEN 'leaf' WHEN 3 THEN 'table' END AS segment,
  CASE WHEN event_id % 2 = 0 THEN 'segmentation_trusted' WHEN event_id % 3 = 0 THEN 'sku_prior' ELSE 'none' END AS pot_source FROM events""")
def label_segments(t):
    k = F.col("event_id")
    label = F.when(k % 5 == 0, " Potted Plant").when(k % 5 == 1, "big planter box").when(k % 5 == 2, "Foliage").when(k % 5 == 3, "side table").otherwise("window")
    pot = Fe.pot_choice(F.when(k % 2 == 0, F.lit(4.0)), F.lit(5.0), F.when(k % 3 == 0, "catalog").otherwise("low"), F.lit(False))
    return t("events").select("event_id", T.segment_of_label(label).alias("segment"), pot["pot_source"].alias("pot_source"))


@query("""
WITH f AS (SELECT event_id, user_id % 7 AS camera, ts, event_id % 3 = 0 AS valid FROM events)
SELECT event_id, last_value(CASE WHEN valid THEN event_id END IGNORE NULLS) OVER (PARTITION BY camera ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cached_id FROM f""")
def plane_cache(t):
    from spanforge.operators.cluster import latest_plane

    f = t("events").select("event_id", (F.col("user_id") % 7).alias("camera"), F.struct("ts", "event_id").alias("captured_at"), (F.col("event_id") % 3 == 0).alias("valid"), F.array("event_id").alias("plane"))
    return latest_plane(f, ["camera"]).select("event_id", F.get("cached_plane", F.lit(0)).alias("cached_id"))
