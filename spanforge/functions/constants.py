"""Fixed values that results depend on, in one place."""

from __future__ import annotations

# --- region of interest (metres)
ROI_DEPTH_MIN, ROI_DEPTH_MAX = 0.25, 1.3168
ROI_HALF_WIDTH, ROI_Y_MAX, ROI_MARGIN = 0.5334, 1.0668, 0.05

# --- table plane
PLANE_THRESHOLD, PLANE_ITERATIONS, PLANE_SEED, PLANE_MAX_FIT_POINTS = 0.008, 160, 7, 50_000
PLANE_MIN_INLIERS, PLANE_MIN_INLIER_RATIO = 30, 0.03
CACHE_MIN_INLIERS, CACHE_MIN_INLIER_RATIO, CACHE_MIN_SIDE = 500, 0.20, 30
CACHE_MIN_SIDE_RATIO, CACHE_MIN_NORMAL_Y, CACHE_MAX_OFFSET = 0.03, 0.85, 2.0

# --- clusters
CLUSTER_VOXEL, CLUSTER_MIN_POINTS, MERGE_GAP = 0.025, 30, 0.08
FRAGMENT_RATIO, MAX_SPAN, CENTRAL_LIMIT = 0.35, 2.0, 0.60
DBSCAN_EPS, DBSCAN_MIN = 0.04, 30

# --- measuring
M_TO_IN = 39.3701
MAX_MEASURE_POINTS, MEASURE_VOXEL, MEASURE_PLANE = 120_000, 0.005, 0.015
MEASURE_ITERATIONS = 1000
MIN_ROBUST_POINTS = 10
OBJECT_MIN_POINTS, LEAF_MIN_POINTS = 500, 300
OUTLIER_REVIEW, FRAGMENTED_REVIEW, FRAGMENTED_FAIL, MAX_DIMENSION_IN = 1.75, 0.70, 0.40, 120.0
PROFILE_BINS, PROFILE_PERCENTILES = 10, (10, 25, 50, 75, 90, 95, 99)
NON_BLOCKING_WARNINGS = (
    "leaf_from_fallback_mask",
    "leaf_geometry_from_fallback_mask",
    "leaf_features_suppressed_due_to_fallback",
    "leaf_cloud_missing",
    "raw_bbox_much_larger_than_robust_bbox",
    "object_raw_bbox_much_larger_than_robust_bbox",
    "pot_mask_rejected_not_used_for_geometry",
    "segmentation_failed_manifest_but_object_cloud_available",
    "table_segment_missing_using_ransac",
)

# --- segmentation
MASK_MIN_PIXELS, POT_MIN_CONFIDENCE = 1000, 0.40
MIN_MASK_OVERLAP, MIN_BOX_OVERLAP, MAX_CENTRE_DISTANCE = 0.03, 0.05, 0.35
TINY_EDGE_AREA, EDGE_MARGIN, TABLE_MIN_AREA, TABLE_MIN_CENTRE_Y, OBJECT_AREA_CAP = 0.01, 0.03, 0.05, 0.45, 0.35
UNION_MIN_PIXELS, UNION_MASK, UNION_BOX, UNION_GAP = 50, 0.01, 0.01, 0.07
CROP_MARGIN = 0.14
UPPER_PART, LOWER_PART, LOWER_HALF_WIDTH = 0.62, 0.48, 0.34
SEGMENT_LABELS = {
    "potted plant": "object",
    "whole potted plant": "object",
    "plant": "object",
    "object": "object",
    "plant pot": "pot",
    "flower pot": "pot",
    "planter": "pot",
    "pot": "pot",
    "container": "pot",
    "vase": "pot",
    "leaves": "leaf",
    "foliage": "leaf",
    "leaf": "leaf",
    "plant canopy": "leaf",
    "canopy": "leaf",
    "greenery": "leaf",
    "table": "table",
}
SEGMENT_HINTS = {
    "pot": ("plant pot", "flower pot", "planter", "pot", "container", "vase"),
    "leaf": ("leaves", "foliage", "leaf", "canopy", "greenery"),
    "table": ("table",),
    "object": ("potted plant", "whole potted plant", "plant", "object"),
}

# --- trust of the pot mask
POT_MIN_OVERLAP, POT_MIN_AREA, POT_MAX_AREA, POT_MIN_LOWER, POT_MIN_CENTRE = 0.30, 0.03, 0.55, 0.50, 0.35
POT_MIN_FILL, POT_MIN_POINTS = 0.18, 500
POT_WIDTH_IN, POT_HEIGHT_IN = (1.5, 30.0), (1.0, 30.0)

# --- text
INCH_ROUND = r'(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:"|in|inch|inches)\s*(pot|basket|hb|hanging basket)?\b'
INCH_RECT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*x\s*([0-9]+(?:\.[0-9]+)?)\s*(flat|tray)?\b"
GALLON = r"(?i)\b[0-9]+(?:\.[0-9]+)?\s*(?:gal|gallon|gallons)\b"
LENGTH_TEXT = r'(?i)([0-9]+(?:\.[0-9]+)?)\s*(inches|inch|in|"|cm|mm)\b'
VOLUME_TEXT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(quarts|quart|qt|gallons|gallon|gal|liters|liter|litres|litre|l)\b"
QT_PER_GALLON, QT_PER_LITRE, CM_PER_IN, MM_PER_IN = 4.0, 1.05668821, 2.54, 25.4
COLUMN_ALIASES = {
    "ITEM": "raw_sku",
    "ITEM#": "raw_sku",
    "SKU": "raw_sku",
    "CATEGORY": "category",
    "DESCRIPTION": "description",
    "COMMON NAME": "common_name",
    "SPEC": "spec",
    "UOM": "uom",
    "UNIT PRICE": "unit_price",
    "SOURCEFILE": "source_file",
    "SOURCE FILE": "source_file",
    "SOURCE SHEET": "source_sheet",
    "SOURCESHEET": "source_sheet",
}
KNOWN_COLUMNS = ("raw_sku", "category", "description", "common_name", "spec", "uom", "unit_price", "source_file", "source_sheet")
PRIOR_NUMERIC_KEYS = ("standard_pot_diameter_in", "pot_diameter_in", "container_diameter_in", "diameter_in")
PRIOR_TEXT_KEYS = ("container_size", "pot_size", "nursery_pot_size", "size", "description")

# --- model features
SAFE_TEXT_FEATURES = ("sku_category", "sku_common_name", "sku_spec", "group_composition_version", "group_composition_summary")
BIN_FEATURES = ("object_vertical_density_bins", "leaf_vertical_density_bins")
FLAG_FEATURES = ("leaf_available", "table_available", "object_profile_available", "leaf_profile_available")
SOURCE_ONLY_FEATURES = (*BIN_FEATURES, *FLAG_FEATURES, "geometry_trusted", "object_available", "arrangement", "authoritative_object_source")
BANNED_PARTS = ("ground_truth", "actual_box", "predicted", "prediction", "label", "job_id", "path", "timestamp", "recorded_at", "created_at", "updated_at", "source_file", "unit_price", "uom", "raw_sku", "spreadsheet")
LABEL_FIELDS = ("length_in", "width_in", "height_in")
TREES, FOREST_SEED, LEAST_SAMPLES, MATCH_IN = 64, 42, 2, 1.0
COMPOSITION_VERSION = "v1"
LEAF_FIELDS = (
    "leaf_canopy_length_in",
    "leaf_canopy_width_in",
    "leaf_canopy_height_in",
    "leaf_canopy_point_count",
    "leaf_canopy_length_robust_in",
    "leaf_canopy_width_robust_in",
    "leaf_canopy_depth_robust_in",
    "leaf_canopy_height_robust_in",
    "leaf_point_count",
    "leaf_bbox_length_in",
    "leaf_bbox_width_in",
    "leaf_bbox_height_in",
    "leaf_vertical_density_bins",
    "leaf_occupied_bin_count",
    "leaf_max_bin_density",
    "leaf_density_center_of_mass_y",
    "leaf_compactness_point_count_per_bbox_volume",
    "leaf_y_p10",
    "leaf_y_p25",
    "leaf_y_p50",
    "leaf_y_p75",
    "leaf_y_p90",
    "leaf_y_p95",
    "leaf_y_p99",
    "leaf_lower_third_width_in",
    "leaf_lower_third_depth_in",
    "leaf_middle_third_width_in",
    "leaf_middle_third_depth_in",
    "leaf_upper_third_width_in",
    "leaf_upper_third_depth_in",
    "leaf_canopy_depth_in",
    "leaf_canopy_center_y_in",
    "leaf_leaf_to_object_point_ratio",
    "leaf_leaf_to_object_volume_ratio",
)

# --- request profile: stages nested in others, which a sum of stages leaves out
NESTED_STAGES = (
    "raw_depth_array_prepare_s",
    "aligned_depth_array_prepare_s",
    "rgb_png_write_s",
    "aligned_depth_npy_write_s",
    "raw_depth_npy_write_s",
    "depth_preview_prepare_s",
    "depth_preview_png_write_s",
    "table_plane_cache_lookup_s",
    "table_plane_cache_validation_s",
    "table_plane_cached_apply_s",
    "table_plane_ransac_fallback_s",
    "table_plane_cache_hit",
    "table_plane_cache_replaced",
    "real_capture_process_job_call_s",
    "yoloe_prompt_cache_lookup_s",
    "yoloe_prompt_cache_build_s",
    "yoloe_predict_call_s",
)
FRAME_STALE_S = 2.0
