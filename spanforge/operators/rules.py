"""Rule cascades: pot trust, capture decisions, box suggestions, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions import text as T

CHECKS = ("object", "leaf", "geometry", "object_cloud", "leaf_cloud", "features", "gt", "table", "pot")


def _score(value: Column, threshold: float) -> Column:
    return F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0)) / max(0.01, threshold))


def pot_quality(*, has_mask: Column, is_fallback: Column, confidence: Column, area_ratio: Column, overlap: Column, has_object: Column, lower: Column, centre: Column, fill: Column, points: Column, width_in: Column, height_in: Column, at_edge: Column) -> Column:
    """Struct of status, trust score, reasons joined by ``;`` and usability of a pot mask."""
    no = lambda c: F.coalesce(c, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(no(is_fallback), "fallback_pot_mask_debug_only"),
            F.when(confidence < K.POT_MIN_CONFIDENCE, "pot_confidence_below_threshold"),
            F.when(area_ratio < K.POT_MIN_AREA, "pot_area_too_small_relative_to_object"),
            F.when(area_ratio > K.POT_MAX_AREA, "pot_area_too_large_relative_to_object"),
            F.when(no(has_object) & (overlap < K.POT_MIN_OVERLAP), "pot_object_overlap_below_threshold"),
            F.when(lower < K.POT_MIN_LOWER, "pot_not_low_enough_in_object"),
            F.when(centre < K.POT_MIN_CENTRE, "pot_badly_off_center"),
            F.when(fill < K.POT_MIN_FILL, "pot_mask_fill_ratio_too_low"),
            F.when(points < K.POT_MIN_POINTS, "pot_depth_point_count_too_low"),
            F.when(~width_in.between(*K.POT_WIDTH_IN), "pot_depth_width_physically_implausible"),
            F.when(~height_in.between(*K.POT_HEIGHT_IN), "pot_depth_height_physically_implausible"),
            F.when(no(at_edge) & (overlap < K.POT_MIN_OVERLAP), "pot_at_image_edge_without_strong_object_overlap"),
        )
    )
    has = lambda r: F.array_contains(reasons, r)
    status = T.first_match(
        [
            (~no(has_mask), F.lit("missing")),
            (F.size(reasons) == 0, F.lit("trusted")),
            (no(is_fallback), F.lit("fallback")),
            (has("pot_confidence_below_threshold"), F.lit("rejected_low_confidence")),
            (has("pot_object_overlap_below_threshold"), F.lit("rejected_low_overlap")),
            (has("pot_area_too_small_relative_to_object"), F.lit("rejected_too_small")),
            (has("pot_area_too_large_relative_to_object"), F.lit("rejected_too_large")),
            (F.exists(reasons, lambda r: r.startswith("pot_depth")), F.lit("rejected_partial")),
        ],
        F.lit("rejected_bad_location"),
    )
    parts = [_score(confidence, K.POT_MIN_CONFIDENCE), _score(overlap, K.POT_MIN_OVERLAP), _score(centre, K.POT_MIN_CENTRE), _score(lower, K.POT_MIN_LOWER), _score(fill, K.POT_MIN_FILL)]
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (parts[0] + parts[1] + parts[2] + parts[3] + parts[4]) / 5.0))
    reason = F.when(status == "missing", "pot_mask_missing").when(status == "trusted", "pot_mask_passed_quality_checks").otherwise(F.array_join(reasons, ";"))
    return F.struct(status.alias("status"), (status == "trusted").alias("usable"), F.when(status == "missing", 0.0).otherwise(trust).alias("trust_score"), reason.alias("reason"))


def check_table(geometry_ok: Column, geometry_status: Column, table_ok: Column) -> Column:
    return F.when(F.coalesce(table_ok, F.lit(False)), "pass").when(F.coalesce(geometry_ok & geometry_status.isin("ok", "degraded"), F.lit(False)), "warn").otherwise("fail")


def check_pot(leak: Column, pot_status: Column, view_source: Column, combined_source: Column, prior_confidence: Column) -> Column:
    return T.first_match(
        [
            (F.coalesce(leak, F.lit(False)), F.lit("fail")),
            ((pot_status == "trusted") & (view_source == "segmentation_trusted"), F.lit("pass")),
            ((combined_source == "sku_prior") & prior_confidence.isin("high", "medium"), F.lit("pass")),
        ],
        F.lit("warn"),
    )


def decision(checks: dict[str, Column]) -> Column:
    """Struct of the decision and the failed checks. Leaf, pot and ground truth never block."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(checks[k], F.lit("fail")).alias("s")) for k in CHECKS if k in checks])
    failed = F.transform(F.filter(pairs, lambda p: p["s"] == "fail"), lambda p: p["k"])
    warned = F.transform(F.filter(pairs, lambda p: p["s"] == "warn"), lambda p: p["k"])
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    verdict = F.when(F.arrays_overlap(failed, names("object", "object_cloud", "geometry", "features")), "recapture").when(F.arrays_overlap(warned, names("object_cloud", "geometry")) | F.array_contains(failed, "table"), "review").otherwise("proceed")
    return F.struct(verdict.alias("decision"), F.array_join(failed, ",").alias("failed"), F.array_join(warned, ",").alias("warned"))


#: Fields that only serve debugging and must not reach a model.
DEBUG_FIELDS = ("debug_features", "rejected_pot_dimensions_in", "raw_pot_candidate_measurements", "pot_debug")
_DEBUG_KEY = r'(?<!\\)"(' + "|".join(DEBUG_FIELDS) + r')"\s*:'


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def has_debug_fields(json: Column) -> Column:
    """A JSON text has a debug field at any depth."""
    return F.coalesce(json.rlike(_DEBUG_KEY), F.lit(False))


def pot_leak(*, debug_fields: Column, usable: Column, view_pot: Column, combined_pot: Column, combined_source: Column, prior_confidence: Column) -> Column:
    """Why pot fields that no trusted mask or prior stands for have reached a model; null when none has."""
    no = lambda c: F.coalesce(c, F.lit(False))
    backed = no((combined_source == "sku_prior") & prior_confidence.isin("high", "medium"))
    return T.first_match(
        [
            (no(debug_fields), F.lit("Rejected/debug pot fields appear in model-facing features.")),
            (~no(usable) & no(view_pot), F.lit("Rejected/fallback pot dimensions appear in view ai2_features.")),
            (~no(usable) & no(combined_pot) & ~backed, F.lit("Combined pot dimensions are not backed by a high/medium SKU prior.")),
        ]
    )


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _all_positive(box: Column) -> Column:
    return F.coalesce((box["length_in"] > 0) & (box["width_in"] > 0) & (box["height_in"] > 0), F.lit(False))


def _segment_message(label: str, status: Column, available: Column, box: Column) -> Column:
    sides = [F.concat(F.lit(f"{n} "), _shown(box[f"{f}_in"])) for n, f in (("L", "length"), ("W", "width"), ("H", "height"))]
    known = F.concat(F.lit(f"{label} dimensions available: "), F.concat_ws(", ", *sides), F.lit("."))
    return T.first_match([(status == "missing", F.lit(f"{label} segment missing.")), (~F.coalesce(available, F.lit(False)), F.lit(f"{label} unavailable in ai2_features.")), (box.isNull(), F.lit(f"{label} dimensions missing."))], known)


def _cloud_message(label: str, cloud: Column) -> Column:
    box = lambda b: F.concat_ws("/", *[_shown(cloud[b][f]) for f in K.LABEL_FIELDS])
    full = lambda c, d: F.coalesce(F.when(c != "", c), F.lit(d))
    known = F.concat(F.lit(f"{label} cloud "), F.upper(full(cloud["quality"], "unknown")), F.lit("; source "), full(cloud["source"], "unknown"), F.lit("; points "), _shown(cloud["point_count"]), F.lit("; raw L/W/H "), box("raw_bbox_in"), F.lit("; robust L/W/H "), box("robust_bbox_in"), F.lit("."))
    return F.when(cloud.isNull(), f"{label} cloud diagnostics missing.").otherwise(known)


def _cloud_status(cloud: Column) -> Column:
    quality = F.lower(cloud["quality"])
    return T.first_match([(quality == "ok", F.lit("pass")), (quality == "review", F.lit("warn"))], F.lit("fail"))


def quality_summary(views: DataFrame) -> DataFrame:
    """``views`` with ``checks`` (name to status and message, nine of them), decision, status_label, reasons and warnings.

    A row is a view with what its records hold, null where a record or a field is missing:
    ``segments`` (segment to status), ``pot`` (status, usable_for_model), ``geometry`` (status,
    object_dimensions_in, leaf_canopy_dimensions_in, dimensions_in, warnings, object_cloud,
    leaf_cloud), ``features`` (object_available, leaf_available, table_available, has_pot,
    pot_source), ``combined`` (geometry_trusted, has_pot, pot_source, pot_prior_confidence),
    ``debug_fields``, ``failures`` (texts of load_failures) and ``truth`` (present, well_formed).
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    seg = lambda n: F.try_element_at("segments", F.lit(n))
    geometry, features, combined = F.col("geometry"), F.col("features"), F.col("combined")
    box, leaf_box = geometry["object_dimensions_in"], geometry["leaf_canopy_dimensions_in"]
    geometry_ok = ~no(geometry["status"].isin("failed", "missing")) & _all_positive(box) & _all_positive(geometry["dimensions_in"])
    cloud_status = {n: _cloud_status(geometry[f"{n}_cloud"]) for n in ("object", "leaf")}
    object_ok = no(combined["geometry_trusted"]) | (no(features["object_available"]) & geometry_ok & (cloud_status["object"] == "pass"))
    leaf_ok = ~no(seg("leaf") == "missing") & no(features["leaf_available"]) & _all_positive(leaf_box)
    leak = pot_leak(debug_fields=F.col("debug_fields"), usable=F.col("pot")["usable_for_model"], view_pot=features["has_pot"], combined_pot=combined["has_pot"], combined_source=combined["pot_source"], prior_confidence=combined["pot_prior_confidence"])
    pot_status = F.col("pot")["status"]
    failed_files = F.size(F.coalesce("failures", _no_texts())) > 0
    status, said = {}, {}

    status["object"] = F.when(object_ok, "pass").otherwise("fail")
    said["object"] = F.when(object_ok & no(seg("object") == "missing"), "Authoritative geometry-primary object is available; AI1 object segmentation missing is non-blocking.").otherwise(_segment_message("Object", seg("object"), features["object_available"], box))
    status["leaf"] = F.when(leaf_ok, "pass").otherwise("fail")
    said["leaf"] = _segment_message("Leaf/canopy", seg("leaf"), features["leaf_available"], leaf_box)
    status["geometry"] = F.when(geometry_ok, "pass").otherwise("fail")
    said["geometry"] = F.when(geometry_ok, "Object geometry available.").otherwise("Geometry failed or required dimensions are missing.")
    for n, label in (("object", "Object"), ("leaf", "Leaf")):
        status[f"{n}_cloud"], said[f"{n}_cloud"] = cloud_status[n], _cloud_message(label, geometry[f"{n}_cloud"])
    status["features"] = F.when(failed_files, "fail").otherwise("pass")
    said["features"] = T.first_match([(failed_files, F.array_join("failures", "; ")), (leak.isNull(), F.lit("Model-facing features are clean."))], F.lit("Model-facing feature files are present."))
    there, fine = no(F.col("truth")["present"]), no(F.col("truth")["well_formed"])
    status["gt"] = F.when(there & fine, "pass").otherwise("warn")
    said["gt"] = T.first_match([(~there, F.lit("GT pending.")), (~fine, F.lit("Ground truth malformed."))], F.lit("Ground truth present."))
    status["table"] = check_table(geometry_ok, geometry["status"], no(seg("table") == "ok") | no(features["table_available"]))
    said["table"] = T.first_match([(status["table"] == "pass", F.lit("Table support available.")), (status["table"] == "warn", F.lit("Table mask missing, but geometry still produced usable dimensions."))], F.lit("Table missing and geometry is degraded or suspicious."))
    status["pot"] = check_pot(leak.isNotNull(), pot_status, features["pot_source"], combined["pot_source"], combined["pot_prior_confidence"])
    trusted = no((pot_status == "trusted") & (features["pot_source"] == "segmentation_trusted"))
    excluded = F.coalesce(pot_status.isin("fallback", "missing") | pot_status.startswith("rejected"), F.lit(False)) | F.col("pot").isNull()
    said["pot"] = T.first_match([(leak.isNotNull(), leak), (trusted, F.lit("Trusted pot segmentation is available.")), (status["pot"] == "pass", F.lit("Pot segmentation excluded; high/medium SKU prior is available.")), (excluded, F.lit("Pot segmentation safely excluded from model features."))], F.lit("Pot status needs review."))

    # every check is computed once, in a step of its own, before the verdict reads it
    checked = views.select("*", F.struct(*[F.struct(status[n].alias("status"), said[n].alias("message")).alias(n) for n in CHECKS]).alias("checks"))
    verdict = decision({n: F.col(f"checks.{n}.status") for n in CHECKS})["decision"]
    reasons = F.transform(F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"checks.{n}.status").alias("s"), F.col(f"checks.{n}.message").alias("m")) for n in CHECKS]), lambda c: (c["s"] == "fail") & (c["n"] != "gt")), lambda c: c["m"])
    usual = F.when(F.col("decision") == "proceed", F.array(F.lit("Object, leaf/canopy, geometry, and model-facing features are usable."))).when(F.col("decision") == "review", F.array(F.lit("Capture is usable, but one or more checks needs operator review."))).otherwise(_no_texts())
    label = F.when(F.col("decision") == "recapture", "RECAPTURE RECOMMENDED").when(F.col("decision") == "review", "REVIEW").otherwise("GOOD TO PROCEED")
    warnings = F.slice(F.coalesce(F.col("geometry")["warnings"], _no_texts()), 1, 5)
    decided = checked.withColumn("decision", verdict).withColumns({"status_label": label, "reasons": reasons, "warnings": F.array_sort(F.array_distinct(F.filter(warnings, lambda w: F.coalesce(w != "", F.lit(False)))))})
    return decided.withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(usual))


def load_failures(files: dict[str, tuple[Column, Column]]) -> Column:
    """Texts of the files (present, well-formed) that are missing or malformed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(p, F.lit(False)), f"{n} missing").when(~F.coalesce(w, F.lit(False)), f"{n} malformed") for n, (p, w) in files.items()]))


def suggest_box(length: Column, width: Column, height: Column, padding: float = 1.0, increment: float = 1.0) -> Column:
    """Padded sides rounded up; null unless all are positive."""
    sides = [T.round_up(T.padded(c, padding), increment) for c in (length, width, height)]
    known = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull()
    return F.when(known, F.struct(*[s.alias(n) for s, n in zip(sides, K.LABEL_FIELDS, strict=True)]))


def suggest_box_of_candidates(candidates: list[tuple[Column, Column, Column]], padding: float = 1.0) -> Column:
    """Box of the first candidate whose sides are all positive."""
    return F.coalesce(*[suggest_box(*c, padding) for c in candidates])


def quantity_check(total: Column, any_invalid: Column, arrangement: Column, strict: bool = True) -> Column:
    """Error of a job's item quantities, null when they fit its arrangement."""
    rows, cols = T.arrangement_dims(arrangement)
    pairs = [(F.coalesce(any_invalid, F.lit(False)), F.lit("invalid_item_quantity"))]
    if strict:
        pairs.append((~total.eqNullSafe((rows * cols).cast("long")), F.lit("quantity_does_not_match_arrangement")))
    return T.first_match(pairs)


def workflow_error(mode: Column, job_type: Column, modes=("collect", "predict"), job_types=("single", "group")) -> Column:
    return T.first_match([(~F.coalesce(mode.isin(*modes), F.lit(False)), F.lit("unsupported_mode")), (~F.coalesce(job_type.isin(*job_types), F.lit(False)), F.lit("unsupported_job_type"))])


def missing_and_invalid(fields: dict[str, tuple[Column, Column]]) -> Column:
    """Struct of the names without a value and of those whose value is not valid: name -> (value, is valid)."""
    gone = F.array_compact(F.array(*[F.when(v.isNull(), n) for n, (v, _) in fields.items()]))
    bad = F.array_compact(F.array(*[F.when(v.isNotNull() & ~F.coalesce(ok, F.lit(False)), n) for n, (v, ok) in fields.items()]))
    return F.struct(gone.alias("missing"), bad.alias("invalid"))


def ground_truth(rows: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Latest completed record of each job whose box is valid; feedback without a box never hides one."""
    from spanforge.operators.training import valid_label

    last = Window.partitionBy(job).orderBy(F.col("recorded_at").desc())
    return rows.filter(F.col("completed") & valid_label(F.col("actual_box"))).withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def make_box(length: Column, width: Column, height: Column) -> Column:
    """A box of three positive, finite sides; null otherwise."""
    sides = [T.positive(c) for c in (length, width, height)]
    known = sides[0].isNotNull() & sides[1].isNotNull() & sides[2].isNotNull()
    return F.when(known, F.struct(*[s.alias(n) for s, n in zip(sides, K.LABEL_FIELDS, strict=True)]))


def truth_record(box: Column, fit: Column, damage: Column, notes: Column, at: Column, source: str = "operator") -> Column:
    """A ground-truth record; completed only with a valid box."""
    return F.struct(box.isNotNull().alias("completed"), F.lit(source).alias("source"), box.alias("actual_box"), fit.alias("fit"), F.coalesce(damage, F.lit(False)).alias("damage"), F.coalesce(notes, F.lit("")).alias("notes"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"))


def segmentation_record(status: Column, segments: dict[str, Column]) -> Column:
    """A segmentation record and the error of a status that is none of ok, fallback and missing."""
    bad = T.first_match([(~F.coalesce(c.isin("ok", "fallback", "missing"), F.lit(False)), F.lit(f"invalid_status:{n}")) for n, c in segments.items()])
    return F.struct(status.alias("status"), F.struct(*[c.alias(n) for n, c in segments.items()]).alias("segments"), bad.alias("error"))
