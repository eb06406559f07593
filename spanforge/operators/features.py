"""From views to one row of features per job: semantics, trust, composition, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions import text as T


def or_zero(*candidates: Column) -> Column:
    """First value that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in candidates])


def span_in(inches: Column, metres: Column, fallback: Column) -> Column:
    return F.coalesce(inches, metres * K.M_TO_IN, fallback)


def contract_error(explicit: Column, frame: Column, units: Column) -> Column:
    """Explicit spans must be metres in the colour camera's frame."""
    bad = explicit & ~(frame.eqNullSafe("rgb_camera") & units.eqNullSafe("meters"))
    return F.when(F.coalesce(bad, F.lit(False)), "object_dimension_unit_contract_invalid")


def is_square(mode: Column, arrangement: Column) -> Column:
    rows, cols = T.arrangement_dims(arrangement)
    return F.when(mode == "two_view_rectangle", False).when(mode == "single_view", True).otherwise(F.coalesce(rows == cols, F.lit(False)))


def combine_dimensions(views: DataFrame, jobs: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Length, width and height of each job from its views' spans.

    ``views`` has view_name, ord and horizontal_in, robust_horizontal_in, vertical_in,
    robust_vertical_in, point_count; ``jobs`` has arrangement_type and view_mode. Square
    jobs take the first view's horizontal span for both sides; others the length view
    (the first view without one) and the width view, the last of each. Height is never
    trimmed, and depth is never a width.
    """
    role = T.view_role(F.col("view_name"), F.col("view_mode"))
    side = F.coalesce("robust_horizontal_in", "horizontal_in")
    rows = views.join(jobs, job).withColumns({"role": role, "square": is_square(F.col("view_mode"), F.col("arrangement_type"))})
    v = F.struct(side.alias("side"), "robust_horizontal_in", "vertical_in", "robust_vertical_in", "point_count", "view_name")
    per_job = rows.groupBy(job).agg(
        F.first("square").alias("square"),
        F.count(F.lit(1)).alias("view_count"),
        F.min_by(v, "ord").alias("first"),
        F.max_by(v, F.when(F.col("role") == "length_view", F.col("ord"))).alias("lv"),
        F.max_by(v, F.when(F.col("role") == "width_view", F.col("ord"))).alias("wv"),
        F.max("vertical_in").alias("top"),
        F.max("robust_vertical_in").alias("robust_top"),
    )
    s, length = F.col("square"), F.coalesce("lv", "first")
    return per_job.select(
        job,
        "view_count",
        F.when(s, "square_single_view").otherwise("rectangular_two_view").alias("policy"),
        F.when(s, F.col("first.side")).otherwise(length["side"]).alias("length_in"),
        F.when(s, F.col("first.side")).otherwise(F.col("wv.side")).alias("width_in"),
        F.when(s, F.col("first.vertical_in")).otherwise(F.col("top")).alias("height_in"),
        F.when(s, F.col("first.robust_horizontal_in")).otherwise(length["robust_horizontal_in"]).alias("length_robust_in"),
        F.when(s, F.col("first.robust_horizontal_in")).otherwise(F.col("wv.robust_horizontal_in")).alias("width_robust_in"),
        F.when(s, F.col("first.robust_vertical_in")).otherwise(F.col("robust_top")).alias("height_robust_in"),
        F.col("first.point_count").alias("point_count"),
        F.when(~s & F.col("wv").isNull(), "rectangular_arrangement_requires_width_view").alias("error"),
    )


def geometry_trusted(views: DataFrame, jobs: DataFrame, *, job: str = "job_id") -> DataFrame:
    """True where every view and the job's own dimensions can be relied on; a job without views passes the view tests.

    ``views``: geometry_status, source_cloud, cloud_path, frame, units, point_count.
    ``jobs``: explicit_spans, object_available, length_in, width_in, height_in,
    height_source, width_source, square_width_equals_length.
    """
    ok = (F.col("geometry_status") == "ok") & (F.col("source_cloud") == "object_cloud") & F.col("cloud_path").endswith("object_cloud.ply") & (F.col("frame") == "rgb_camera") & (F.col("units") == "meters") & T.positive(F.col("point_count")).isNotNull()
    per_job = views.groupBy(job).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("views_ok"))
    positive = F.lit(True)
    for c in K.LABEL_FIELDS:
        positive &= T.positive(F.col(c)).isNotNull()
    same = ~F.coalesce("square_width_equals_length", F.lit(False)) | (F.abs(F.col("length_in") - F.col("width_in")) < 1e-9)
    gate = F.col("explicit_spans") & F.col("object_available") & positive & F.coalesce("views_ok", F.lit(True)) & F.col("height_source").contains("vertical_span") & ~F.coalesce(F.col("width_source"), F.lit("")).contains("depth") & same
    return jobs.join(per_job, job, "left").withColumn("geometry_trusted", F.coalesce(gate, F.lit(False))).drop("views_ok")


def suppress_leaf(df: DataFrame, from_fallback: Column) -> DataFrame:
    """Leaf fields become null where the leaf came from a fallback mask."""
    return df.withColumns({c: F.when(~F.coalesce(from_fallback, F.lit(False)), F.col(c)) for c in K.LEAF_FIELDS if c in df.columns})


def leaf_from_fallback(*signs: Column) -> Column:
    out = F.lit(False)
    for s in signs:
        out |= F.coalesce(s, F.lit(False))
    return out


def group_composition(items: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Order-independent features of a job's items; none for a job with a quantity that is no positive whole number.

    ``items``: sku, quantity, category, spec and the prior's available, confidence,
    diameter_in, width_in, depth_in, height_in. Quantities per category and per
    specification come as maps.
    """
    trusted = F.coalesce(F.col("available") & T.model_confidence(F.col("confidence")).isin("high", "medium"), F.lit(False))
    rows = items.select(job, F.nullif(F.upper(T.strip(F.col("sku"))), F.lit("")).alias("sku"), F.col("quantity").cast("long").alias("q"), T.token(F.col("category")).alias("category"), T.token(F.col("spec")).alias("spec"), trusted.alias("trusted"), "diameter_in", "width_in", "depth_in", "height_in")
    parts = []
    for d in ("diameter_in", "width_in", "depth_in", "height_in"):
        use = F.col("trusted") & T.positive(F.col(d)).isNotNull()
        parts.append(F.try_divide(F.sum(F.when(use, F.col(d) * F.col("q"))), F.sum(F.when(use, F.col("q")))).alias(f"group_pot_prior_{d}_weighted_mean"))
    whole = rows.groupBy(job).agg(F.bool_and(F.coalesce(F.col("q") > 0, F.lit(False))).alias("valid"), F.sum("q").alias("total"), F.count_distinct("sku").alias("n_skus"), F.sum(F.when(F.col("trusted"), F.col("q")).otherwise(0)).alias("prior_q"), F.count_if("trusted").alias("prior_n"), *parts)
    types = rows.groupBy(job, "category", "spec").agg(F.sum("q").alias("q")).groupBy(job).agg(F.array_sort(F.collect_list(F.struct("category", "spec", "q"))).alias("sig"))

    def quantities(c: str) -> Column:
        """Quantity of each name among a job's few types."""
        of = lambda k: F.aggregate(F.filter("sig", lambda s: s[c] == k), F.lit(0).cast("long"), lambda n, s: n + s["q"])
        names = F.array_sort(F.array_distinct(F.transform("sig", lambda s: s[c])))
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("k"), of(k).cast("double").alias("v"))))

    counted = types.withColumns({"n_types": F.size("sig"), "largest": F.array_max(F.transform("sig", lambda s: s["q"])), **{f"group_{c}_qty": quantities(c) for c in ("category", "spec")}})
    out = whole.filter("valid and total > 0").join(counted, job)
    total = F.col("total").cast("double")
    return out.select(
        job,
        F.lit(K.COMPOSITION_VERSION).alias("group_composition_version"),
        F.array_join(F.transform("sig", lambda s: F.concat_ws(":", s["category"], s["spec"], s["q"].cast("string"))), "|").alias("group_composition_summary"),
        F.when(F.col("n_skus") == 1, 1.0).otherwise(0.0).alias("homogeneous_group"),
        F.col("n_types").cast("double").alias("group_composition_type_count"),
        F.col("largest").cast("double").alias("group_largest_type_quantity"),
        (F.col("largest") / total).alias("group_largest_type_ratio"),
        F.col("prior_n").cast("double").alias("group_pot_prior_item_count"),
        F.col("prior_q").cast("double").alias("group_pot_prior_quantity"),
        (F.col("prior_q") / total).alias("group_pot_prior_quantity_ratio"),
        "group_category_qty",
        F.transform_values("group_category_qty", lambda _, v: v / total).alias("group_category_ratio"),
        "group_spec_qty",
        F.transform_values("group_spec_qty", lambda _, v: v / total).alias("group_spec_ratio"),
        *[f"group_pot_prior_{d}_weighted_mean" for d in ("diameter_in", "width_in", "depth_in", "height_in")],
    )


def with_tokens(df: DataFrame, map_col: str, prefix: str, tokens: list[str]) -> DataFrame:
    """Columns ``prefix__token`` of a map, for a stated list of tokens; absent ones are null."""
    return df.withColumns({f"{prefix}__{t}": F.try_element_at(F.col(map_col), F.lit(t)) for t in sorted(tokens)})


def combine_views(views: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Greatest height, all warnings once, and each view's status (the last in order where a view comes twice)."""
    whole = views.groupBy(job).agg(F.max("height_in").alias("height_in"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"))
    by_view = views.groupBy(job, "view_name").agg(F.max("status").alias("status"))
    statuses = by_view.groupBy(job).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("view_name", "status")))).alias("statuses"))
    return whole.join(statuses, job)


def pot_choice(seg_diameter: Column, prior_diameter: Column, prior_confidence: Column, is_group: Column) -> Column:
    """Struct of the pot diameter and its source: segmentation first, a trusted prior of a single job next."""
    good = ~F.coalesce(is_group, F.lit(False)) & T.model_confidence(prior_confidence).isin("high", "medium") & prior_diameter.isNotNull()
    return F.struct(
        F.coalesce(seg_diameter, F.when(good, prior_diameter)).alias("pot_diameter_in"),
        F.when(seg_diameter.isNotNull(), "segmentation_trusted").when(good, "sku_prior").otherwise("none").alias("pot_source"),
    )


def overwrite(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def cloud_quality(label: str, points: Column, ratio: Column, outlier: Column, fallback: Column, *dims: Column) -> Column:
    """Struct of quality ok, review or fail and the warnings, in their order."""
    least = K.LEAF_MIN_POINTS if label == "leaf" else K.OBJECT_MIN_POINTS
    n, out = F.coalesce(points, F.lit(0)), F.coalesce(F.nullif(outlier, F.lit(0.0)), F.lit(1.0))
    odd = F.lit(False)
    for d in dims:
        odd |= F.coalesce((d <= 0) | (d > K.MAX_DIMENSION_IN), F.lit(True))
    raw = "raw_bbox_much_larger_than_robust_bbox"
    warnings = F.array_compact(
        F.array(
            F.when(n <= 0, f"{label}_cloud_empty").when(n < least, f"{label}_cloud_too_sparse"),
            F.when(F.coalesce(fallback, F.lit(False)), f"{label}_from_fallback_mask"),
            F.when(out >= K.OUTLIER_REVIEW, raw),
            F.when(ratio < K.FRAGMENTED_REVIEW, f"{label}_cloud_fragmented"),
            F.when(odd, f"{label}_cloud_dimensions_suspicious"),
        )
    )
    fail = (n <= 0) | (n < least / 2) | F.coalesce(ratio < K.FRAGMENTED_FAIL, F.lit(False))
    quality = F.when(fail, "fail").when(F.size(F.array_except(warnings, F.array(F.lit(raw)))) > 0, "review").otherwise("ok")
    missing = F.lit(True)
    for d in dims:
        missing &= d.isNull()
    missing &= points.isNull()
    return F.struct(F.when(missing, "fail").otherwise(quality).alias("quality"), F.when(missing, F.array(F.lit(f"{label}_cloud_missing"))).otherwise(warnings).alias("warnings"))


def dimension_warnings(length: Column, width: Column, height: Column) -> Column:
    sides = [F.coalesce(c, F.lit(0.0)) for c in (length, width, height)]
    w = F.lit("dimension_suspicious")
    return F.array_compact(F.array(F.when(F.least(*sides) <= 0, w), F.when(F.greatest(*sides) > 120, w), F.when(sides[2] < 1, w)))


def geometry_status(reason: Column, warnings: Column) -> Column:
    """``ok`` without a reason and without a warning that blocks."""
    blocking = F.array_except(warnings, F.array(*[F.lit(w) for w in K.NON_BLOCKING_WARNINGS]))
    return F.when(reason.isNull() & (F.size(blocking) == 0), "ok").otherwise("degraded")


def object_source(manifest: Column, has: dict[str, Column]) -> Column:
    """Struct of the cloud that stands for the object, its segmentation status, whether segmentation was used, and the warning.

    ``manifest`` is the manifest's status; ``has`` says which of object_cloud,
    segmented_cloud, pot_cloud and leaf_cloud could be read. With only one part the raw
    cloud stands in, and segmentation counts as partial.
    """
    there = {n: F.coalesce(has[n], F.lit(False)) if n in has else F.lit(False) for n in ("object_cloud", "segmented_cloud", "pot_cloud", "leaf_cloud")}
    skipped, failed = manifest.eqNullSafe("skipped"), manifest.eqNullSafe("failed")
    both, one = there["pot_cloud"] & there["leaf_cloud"], there["pot_cloud"] | there["leaf_cloud"]
    source = T.first_match(
        [
            (skipped | (failed & ~there["object_cloud"]), F.lit("raw_cloud")),
            (there["object_cloud"], F.lit("object_cloud")),
            (there["segmented_cloud"], F.lit("segmented_cloud")),
            (both, F.lit("combined_pot_leaf_cloud")),
        ],
        F.lit("raw_cloud"),
    )
    used = ~skipped & F.when(failed, there["object_cloud"]).otherwise(there["object_cloud"] | there["segmented_cloud"] | one)
    part = failed | ((source == "raw_cloud") & one)
    status = F.when(~used, manifest).when(part | manifest.eqNullSafe("partial"), "partial").otherwise("ok")
    warning = T.first_match(
        [
            (skipped, F.lit("segmentation_skipped_using_raw_cloud")),
            (failed & there["object_cloud"], F.lit("segmentation_failed_manifest_but_object_cloud_available")),
            (failed, F.lit("segmentation_failed_using_raw_cloud")),
            (~used, F.lit("segmentation_not_available")),
        ]
    )
    return F.struct(source.alias("source"), used.alias("segmentation_used"), status.alias("status"), warning.alias("warning"))


def part_ratios(part_points: Column, part_volume: Column, object_points: Column, object_volume: Column) -> Column:
    return F.struct(T.safe_ratio(part_points, object_points).alias("point_ratio"), T.safe_ratio(part_volume, object_volume).alias("volume_ratio"))


def first_item(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def first_item_prior(items: Column, fields: list[str], containers: list[tuple[str, float, float]], prior_type: str) -> Column:
    """Pot prior of the first item: its own ``pot_prior``, else what its other metadata parses to; ``items`` hold a struct ``metadata``.

    ``prior_type`` names the common fields that leave, as a struct type.
    """
    names = [p.split(":")[0] for p in prior_type.removeprefix("struct<").removesuffix(">").split(",")]
    common = lambda prior: F.struct(*[prior[n].alias(n) for n in names]).cast(prior_type)

    def prior_of(meta: Column) -> Column:
        parsed = T.let(T.metadata_prior({f: meta[f] for f in fields}, containers), common)
        return F.when(meta["pot_prior"].isNotNull(), common(meta["pot_prior"])).otherwise(parsed)

    return T.let(first_item(items)["metadata"], prior_of)


def roles(views: DataFrame, keys: list[str]) -> DataFrame:
    """First view of each role."""
    return views.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "role").orderBy("ord"))).filter("nth = 1").drop("nth")


def profile_features(profiles: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """A profile as flat columns ``<prefix>_...``: bins, percentiles, thirds, density and box."""
    q = lambda k: F.try_element_at("height_percentiles", F.lit(k))
    third = lambda n, s: F.try_element_at("thirds", F.lit(n))[s]
    out = [F.lit(True).alias(f"{prefix}_profile_available"), F.col("n_points").alias(f"{prefix}_point_count")]
    out += [F.col(f"bbox_{c}_in").alias(f"{prefix}_bbox_{c}_in") for c in ("length", "width", "height")]
    out += [F.col("vertical_density_bins").alias(f"{prefix}_vertical_density_bins"), F.col("occupied_bin_count").alias(f"{prefix}_occupied_bin_count"), F.col("max_bin_density").alias(f"{prefix}_max_bin_density"), F.col("density_center_of_mass_y").alias(f"{prefix}_density_center_of_mass_y"), F.col("compactness").alias(f"{prefix}_compactness_point_count_per_bbox_volume")]
    out += [q(f"y_p{p}").alias(f"{prefix}_y_p{p}") for p in K.PROFILE_PERCENTILES]
    out += [third(f"{n}_third", s).alias(f"{prefix}_{n}_third_{s}") for n in ("lower", "middle", "upper") for s in ("width_in", "depth_in")]
    return profiles.select(*keys, *out)


def view_features(geometry: DataFrame, object_profile: DataFrame, leaf_profile: DataFrame, segmentation: DataFrame, keys: list[str]) -> DataFrame:
    """One row of features per view; a side that is missing leaves nulls, and leaf fields of a fallback mask go.

    ``geometry``: dimensions of the object cloud with geometry_status and warnings.
    ``segmentation``: object_status, leaf_status, table_status, pot_diameter_in.
    """
    out = geometry.join(profile_features(object_profile, keys, "object"), keys, "left").join(profile_features(leaf_profile, keys, "leaf"), keys, "left").join(segmentation, keys, "left")
    flags = {
        "object_available": F.col("geometry_status").isin("ok", "degraded") & F.col("object_point_count").isNotNull(),
        "leaf_available": (F.col("leaf_status") == "ok") & F.col("leaf_point_count").isNotNull(),
        "table_available": F.col("table_status") == "ok",
        "object_profile_available": F.col("object_profile_available"),
        "leaf_profile_available": F.col("leaf_profile_available"),
    }
    out = out.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    return suppress_leaf(out, F.col("leaf_status") == "fallback")


def quality_flags(geometry_status: Column, warnings: Column, pot_source: Column, leaf_status: Column) -> Column:
    """Struct of what a reader of the features should know about their sources."""
    return F.struct(geometry_status.alias("geometry_status"), F.array_sort(F.array_distinct(warnings)).alias("warnings"), F.coalesce(pot_source, F.lit("none")).alias("pot_source"), F.coalesce(leaf_status == "fallback", F.lit(False)).alias("leaf_from_fallback"))


def geometry_record(status: Column, source: Column, dims: Column, warnings: Column, reason: Column) -> Column:
    """Geometry of a view with the same fields whether it worked or not; a failed one has null dimensions."""
    failed = status.isin("failed", "missing")
    return F.struct(status.alias("status"), source.alias("source_cloud"), F.when(~failed, dims).alias("dimensions"), F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"), reason.alias("reason"))
