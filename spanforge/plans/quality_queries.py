"""The operator's quality summary: nine checks with their messages, and the decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import rules as R
from spanforge.plans.base import query


def _fields(k: str, c: str) -> dict[str, str]:
    """SQL of each input, in words that both engines read; ``k`` and ``c`` are whole numbers."""
    pick = lambda n, *values: "CASE " + " ".join(f"WHEN {k} % {n} = {i} THEN {v}" for i, v in enumerate(values)) + " END"
    return {
        "seg_object": f"CASE WHEN {k} % 4 = 0 THEN 'missing' ELSE 'ok' END",
        "seg_leaf": f"CASE WHEN {k} % 5 = 0 THEN 'missing' ELSE 'ok' END",
        "seg_table": f"CASE WHEN {k} % 3 = 0 THEN 'ok' ELSE 'missing' END",
        "pot_status": f"CASE WHEN {k} % 31 <> 0 THEN {pick(5, "'trusted'", "'fallback'", "'missing'", "'rejected_low_overlap'", "'unclear'")} END",
        "geo_status": f"CASE WHEN {k} % 37 <> 0 THEN {pick(3, "'ok'", "'degraded'", "'failed'")} END",
        "has_geo": f"{k} % 37 <> 0",
        "ol": f"CAST({k} % 12 AS DOUBLE) / 2",
        "ow": f"CAST({c} % 7 AS DOUBLE) + 0.5",
        "oh": f"CASE WHEN {k} % 29 <> 0 THEN CAST(3.25 AS DOUBLE) END",
        "has_leaf_box": f"{k} % 37 <> 0 AND {k} % 6 <> 0",
        "lh": f"CAST({k} % 8 AS DOUBLE)",
        "has_box": f"{k} % 37 <> 0 AND {k} % 41 <> 0",
        "n_warnings": f"{k} % 8",
        "has_oc": f"{k} % 37 <> 0 AND {k} % 13 <> 0",
        "oc_quality": pick(4, "'ok'", "'ok'", "'review'", "'fail'"),
        "oc_source": f"CASE WHEN {c} % 3 <> 0 THEN 'geometry_cluster' END",
        "oc_points": f"{k} % 1000",
        "has_lc": f"{k} % 37 <> 0 AND {k} % 7 <> 0",
        "lc_quality": pick(3, "'OK'", "'review'", "''"),
        "object_available": f"{k} % 43 <> 0 AND {c} % 2 = 0",
        "leaf_available": f"{k} % 43 <> 0 AND {k} % 3 <> 1",
        "table_available": f"{k} % 43 <> 0 AND {k} % 10 = 0",
        "has_pot": f"{k} % 43 <> 0 AND {c} % 17 = 0",
        "view_pot_source": f"CASE WHEN {k} % 43 <> 0 AND {k} % 2 = 0 THEN 'segmentation_trusted' END",
        "geometry_trusted": f"{k} % 11 = 0",
        "combined_pot": f"{c} % 6 = 0",
        "combined_source": f"CASE WHEN {c} % 2 = 0 THEN 'sku_prior' ELSE 'none' END",
        "prior_confidence": f"CASE WHEN {c} % 4 = 0 THEN 'high' WHEN {c} % 4 = 2 THEN 'low' END",
        "debug_json": f"CONCAT('{{\"a\": [{{\"', CASE WHEN {c} % 23 = 0 THEN 'pot_debug' ELSE 'pot' END, '\": 1}}], \"b\": \"\\\\\"pot_debug\\\\\": 2\"}}')",
        "truth_there": f"{c} % 2 = 0",
        "truth_fine": f"{c} % 4 = 0",
    }


_SQL = ", ".join(f"{v} AS {n}" for n, v in _fields("o_orderkey", "o_custkey").items()).replace("\\\\", "\\")
_BOX = "coalesce({0}::VARCHAR, 'None') || '/' || coalesce({1}::VARCHAR, 'None') || '/' || coalesce({2}::VARCHAR, 'None')"


@query(f"""
WITH f AS (SELECT o_orderkey, o_orderkey AS k, {_SQL} FROM orders),
g AS (SELECT *, coalesce(geo_status NOT IN ('failed'), true) AND has_geo AND coalesce(ol > 0 AND ow > 0 AND oh > 0, false) AND has_box AS geometry_ok, CASE WHEN NOT has_oc THEN 'fail' WHEN oc_quality = 'ok' THEN 'pass' WHEN oc_quality = 'review' THEN 'warn' ELSE 'fail' END AS oc, CASE WHEN NOT has_lc THEN 'fail' WHEN lower(lc_quality) = 'ok' THEN 'pass' WHEN lc_quality = 'review' THEN 'warn' ELSE 'fail' END AS lc,
  list_filter([CASE WHEN NOT has_geo THEN 'geometry.json missing' END, CASE WHEN k % 43 = 0 THEN 'features.json malformed' END], lambda x: x IS NOT NULL) AS failures,
  CASE WHEN debug_json LIKE '%"pot_debug": 1%' THEN 'Rejected/debug pot fields appear in model-facing features.' WHEN coalesce(pot_status, '') <> 'trusted' AND has_pot THEN 'Rejected/fallback pot dimensions appear in view ai2_features.'
    WHEN coalesce(pot_status, '') <> 'trusted' AND combined_pot AND NOT coalesce(combined_source = 'sku_prior' AND prior_confidence IN ('high', 'medium'), false) THEN 'Combined pot dimensions are not backed by a high/medium SKU prior.' END AS leak FROM f),
h AS (SELECT *, geometry_trusted OR (object_available AND geometry_ok AND oc = 'pass') AS object_ok, seg_leaf <> 'missing' AND leaf_available AND has_leaf_box AND lh > 0 AS leaf_ok, seg_table = 'ok' OR table_available AS table_ok FROM g),
s AS (SELECT *, CASE WHEN object_ok THEN 'pass' ELSE 'fail' END AS s1, CASE WHEN leaf_ok THEN 'pass' ELSE 'fail' END AS s2, CASE WHEN geometry_ok THEN 'pass' ELSE 'fail' END AS s3, CASE WHEN len(failures) > 0 THEN 'fail' ELSE 'pass' END AS s6, CASE WHEN truth_there AND truth_fine THEN 'pass' ELSE 'warn' END AS s7,
  CASE WHEN table_ok THEN 'pass' WHEN geometry_ok AND geo_status IN ('ok', 'degraded') THEN 'warn' ELSE 'fail' END AS s8,
  CASE WHEN leak IS NOT NULL THEN 'fail' WHEN pot_status = 'trusted' AND view_pot_source = 'segmentation_trusted' THEN 'pass' WHEN combined_source = 'sku_prior' AND prior_confidence IN ('high', 'medium') THEN 'pass' ELSE 'warn' END AS s9 FROM h),
m AS (SELECT *, CASE WHEN object_ok AND seg_object = 'missing' THEN 'Authoritative geometry-primary object is available; AI1 object segmentation missing is non-blocking.' WHEN seg_object = 'missing' THEN 'Object segment missing.' WHEN NOT object_available THEN 'Object unavailable in ai2_features.' WHEN NOT has_geo THEN 'Object dimensions missing.'
    ELSE 'Object dimensions available: L ' || ol || ', W ' || ow || ', H ' || coalesce(oh::VARCHAR, 'None') || '.' END AS m1,
  CASE WHEN seg_leaf = 'missing' THEN 'Leaf/canopy segment missing.' WHEN NOT leaf_available THEN 'Leaf/canopy unavailable in ai2_features.' WHEN NOT has_leaf_box THEN 'Leaf/canopy dimensions missing.' ELSE 'Leaf/canopy dimensions available: L 1.5, W 2.0, H ' || lh || '.' END AS m2,
  CASE WHEN geometry_ok THEN 'Object geometry available.' ELSE 'Geometry failed or required dimensions are missing.' END AS m3,
  CASE WHEN NOT has_oc THEN 'Object cloud diagnostics missing.' ELSE 'Object cloud ' || upper(oc_quality) || '; source ' || coalesce(oc_source, 'unknown') || '; points ' || oc_points || '; raw L/W/H ' || {_BOX.format("ol", "ow", "oh")} || '; robust L/W/H None/None/None.' END AS m4,
  CASE WHEN NOT has_lc THEN 'Leaf cloud diagnostics missing.' ELSE 'Leaf cloud ' || upper(CASE WHEN lc_quality = '' THEN 'unknown' ELSE lc_quality END) || '; source unknown; points None; raw L/W/H None/None/None; robust L/W/H ' || {_BOX.format("ol", "ow", "oh")} || '.' END AS m5,
  CASE WHEN len(failures) > 0 THEN array_to_string(failures, '; ') WHEN leak IS NULL THEN 'Model-facing features are clean.' ELSE 'Model-facing feature files are present.' END AS m6,
  CASE WHEN NOT truth_there THEN 'GT pending.' WHEN NOT truth_fine THEN 'Ground truth malformed.' ELSE 'Ground truth present.' END AS m7,
  CASE s8 WHEN 'pass' THEN 'Table support available.' WHEN 'warn' THEN 'Table mask missing, but geometry still produced usable dimensions.' ELSE 'Table missing and geometry is degraded or suspicious.' END AS m8,
  CASE WHEN leak IS NOT NULL THEN leak WHEN pot_status = 'trusted' AND view_pot_source = 'segmentation_trusted' THEN 'Trusted pot segmentation is available.' WHEN s9 = 'pass' THEN 'Pot segmentation excluded; high/medium SKU prior is available.'
    WHEN pot_status IS NULL OR pot_status IN ('fallback', 'missing') OR pot_status LIKE 'rejected%' THEN 'Pot segmentation safely excluded from model features.' ELSE 'Pot status needs review.' END AS m9 FROM s),
d AS (SELECT *, CASE WHEN 'fail' IN (s1, oc, s3, s6) THEN 'recapture' WHEN 'warn' IN (oc, s3) OR s8 = 'fail' THEN 'review' ELSE 'proceed' END AS decision,
  list_filter([CASE WHEN s1 = 'fail' THEN m1 END, CASE WHEN s2 = 'fail' THEN m2 END, CASE WHEN s3 = 'fail' THEN m3 END, CASE WHEN oc = 'fail' THEN m4 END, CASE WHEN lc = 'fail' THEN m5 END, CASE WHEN s6 = 'fail' THEN m6 END, CASE WHEN s8 = 'fail' THEN m8 END, CASE WHEN s9 = 'fail' THEN m9 END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT o_orderkey, decision, CASE decision WHEN 'recapture' THEN 'RECAPTURE RECOMMENDED' WHEN 'review' THEN 'REVIEW' ELSE 'GOOD TO PROCEED' END AS status_label,
  CASE WHEN len(failed) > 0 THEN array_to_string(failed, ' | ') WHEN decision = 'proceed' THEN 'Object, leaf/canopy, geometry, and model-facing features are usable.' ELSE 'Capture is usable, but one or more checks needs operator review.' END AS reasons,
  CASE WHEN has_geo THEN coalesce((SELECT string_agg(DISTINCT 'w' || (i * 7 % 5), ',' ORDER BY 'w' || (i * 7 % 5)) FROM range(1, 6) r(i) WHERE i <= n_warnings AND i % 4 <> 0), '') ELSE '' END AS warnings,
  concat_ws(',', s1, s2, s3, oc, lc, s6, s7, s8, s9) AS statuses, concat_ws(' | ', m1, m2, m3, m4, m5, m6, m7, m8, m9) AS messages FROM d""")
def quality_checks(t):
    """Every order as a view, all nine checks of it."""
    k = F.col("o_orderkey")
    raw = t("orders").select("o_orderkey", *[F.expr(v).alias(n) for n, v in _fields("o_orderkey", "o_custkey").items()])
    c, none = F.col, F.lit(None).cast("double")
    box = lambda *sides: F.struct(*[s.alias(n) for s, n in zip(sides, R.K.LABEL_FIELDS, strict=True)])
    own, unknown = box(c("ol"), c("ow"), c("oh")), box(none, none, none)
    cloud = lambda q, s, n, a, b: F.struct(q.alias("quality"), s.alias("source"), n.alias("point_count"), a.alias("raw_bbox_in"), b.alias("robust_bbox_in"))
    warnings = F.transform(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= c("n_warnings")), lambda i: F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("w"), (i * 7 % 5).cast("string"))))
    geometry = F.struct(
        c("geo_status").alias("status"),
        own.alias("object_dimensions_in"),
        F.when(c("has_leaf_box"), box(F.lit(1.5), F.lit(2.0), c("lh"))).alias("leaf_canopy_dimensions_in"),
        F.when(c("has_box"), box(F.lit(1.0), F.lit(1.0), F.lit(1.0))).alias("dimensions_in"),
        warnings.alias("warnings"),
        F.when(c("has_oc"), cloud(c("oc_quality"), c("oc_source"), c("oc_points"), own, unknown)).alias("object_cloud"),
        F.when(c("has_lc"), cloud(c("lc_quality"), F.lit(None).cast("string"), F.lit(None).cast("long"), unknown, own)).alias("leaf_cloud"),
    )
    views = raw.select(
        "o_orderkey",
        F.create_map(*[x for n in ("object", "leaf", "table") for x in (F.lit(n), c(f"seg_{n}"))]).alias("segments"),
        F.when(c("pot_status").isNotNull(), F.struct(c("pot_status").alias("status"), (c("pot_status") == "trusted").alias("usable_for_model"))).alias("pot"),
        F.when(c("has_geo"), geometry).alias("geometry"),
        F.when(k % 43 != 0, F.struct("object_available", "leaf_available", "table_available", "has_pot", c("view_pot_source").alias("pot_source"))).alias("features"),
        F.struct("geometry_trusted", c("combined_pot").alias("has_pot"), c("combined_source").alias("pot_source"), c("prior_confidence").alias("pot_prior_confidence")).alias("combined"),
        R.has_debug_fields(c("debug_json")).alias("debug_fields"),
        R.load_failures({"geometry.json": (c("has_geo"), F.lit(True)), "features.json": (F.lit(True), k % 43 != 0)}).alias("failures"),
        F.struct(c("truth_there").alias("present"), c("truth_fine").alias("well_formed")).alias("truth"),
    )
    out = R.quality_summary(views)
    joined = lambda f, by: F.concat_ws(by, *[F.col(f"checks.{n}.{f}") for n in R.CHECKS])
    return out.select("o_orderkey", "decision", "status_label", F.array_join("reasons", " | ").alias("reasons"), F.array_join("warnings", ",").alias("warnings"), joined("status", ",").alias("statuses"), joined("message", " | ").alias("messages"))
