"""Masks and detections as pixel and box tables: ranking, unions, overlap and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.functions import constants as K
from spanforge.functions import text as T


def mask_metrics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels and bounding box (right and lower edge open) of each mask."""
    out = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"), F.min("col").alias("c0"), F.min("row").alias("r0"), (F.max("col") + 1).alias("c1"), (F.max("row") + 1).alias("r1"))
    return out.select(*keys, "n_pixels", B.box(F.col("c0"), F.col("r0"), F.col("c1"), F.col("r1")).alias("bbox"))


def mask_overlap(candidate: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Shared pixels, over the candidate's and over the reference's."""
    both = candidate.select(*keys, "row", "col", F.lit(1).alias("a")).join(reference.select(*keys, "row", "col", F.lit(1).alias("b")), [*keys, "row", "col"], "full")
    n = both.groupBy(*keys).agg(F.count("a").alias("n_candidate"), F.count("b").alias("n_reference"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_shared"))
    return n.withColumns({"over_candidate": F.coalesce(F.try_divide("n_shared", "n_candidate"), F.lit(0.0)), "over_reference": F.coalesce(F.try_divide("n_shared", "n_reference"), F.lit(0.0))})


def evaluate(predicted: Column, actual: Column) -> list[Column]:
    """Aggregates of two flags: counts, IoU, precision, recall."""
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp, tp + fp + fn).alias("iou"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall")]


def evaluate_masks(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """IoU, precision, recall and the errors of the four edges of each mask."""
    both = predicted.select(*keys, "row", "col", F.lit(True).alias("p")).join(actual.select(*keys, "row", "col", F.lit(True).alias("t")), [*keys, "row", "col"], "full")
    p, t = F.coalesce("p", F.lit(False)), F.coalesce("t", F.lit(False))
    edges = [(f(F.when(p, F.col(c))) - f(F.when(t, F.col(c)))).alias(n) for n, f, c in (("left_error", F.min, "col"), ("right_error", F.max, "col"), ("top_error", F.min, "row"), ("bottom_error", F.max, "row"))]
    return both.groupBy(*keys).agg(*evaluate(p, t), *edges)


def mask_digest(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """SHA-256 of each mask's bytes in row order, a byte of 0 or 1 per pixel."""
    at = F.array_sort(F.collect_set((F.col("row") * width + F.col("col")).cast("long")))
    gaps = F.transform(F.sequence(F.lit(0), F.size("at")), lambda i: F.when(i == F.size("at"), F.lit(height * width)).otherwise(F.get(F.col("at"), i)) - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("at"), i - 1) + 1))
    runs = F.transform(gaps, lambda g: F.repeat(F.lit("00"), g.cast("int")))
    return pixels.groupBy(*keys).agg(at.alias("at")).select(*keys, F.sha2(F.unhex(F.array_join(runs, "01")), 256).alias("digest"))


def resize_mask(pixels: DataFrame, keys: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize from (height, width) to another: each target pixel looks up its source."""
    (sh, sw), (th, tw) = source, target
    spark = pixels.sparkSession
    rows = spark.range(th).select(F.col("id").cast("int").alias("t_row"), B.nearest_source(F.col("id"), F.lit(th), F.lit(sh)).cast("int").alias("row"))
    cols = spark.range(tw).select(F.col("id").cast("int").alias("t_col"), B.nearest_source(F.col("id"), F.lit(tw), F.lit(sw)).cast("int").alias("col"))
    hit = pixels.join(F.broadcast(rows), "row").join(F.broadcast(cols), "col")  # one row per image line
    return hit.select(*keys, F.col("t_row").alias("row"), F.col("t_col").alias("col"))


def to_full_image(pixels: DataFrame, dx: Column, dy: Column) -> DataFrame:
    return pixels.withColumns({"row": F.col("row") + dy, "col": F.col("col") + dx})


def touches_edge(b: Column, width: Column) -> Column:
    """At the left or the right edge of the image."""
    return F.coalesce((b["x1"] <= width * K.EDGE_MARGIN) | (b["x2"] >= width * (1 - K.EDGE_MARGIN)), F.lit(False))


def select_detections(detections: DataFrame, keys: list[str], overlaps: DataFrame | None = None) -> DataFrame:
    """All detections with segment, score, every reason against them, their fate and ``chosen``: the best of each segment of a view, the first on a tie.

    ``detections``: idx, label, confidence, n_pixels (null without a mask), box, width,
    height, and ``in_union`` where parts have been joined to the object. ``overlaps`` gives
    mask_overlap with the object's mask per idx; without it the boxes stand in.
    """
    s, size = F.col("segment"), F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    own = detections.withColumns({"segment": T.segment_of_label(F.col("label")), "area_ratio": B.area(F.col("box")) / size})
    joined_in = F.coalesce(F.col("in_union"), F.lit(False)) if "in_union" in detections.columns else F.lit(False)
    usable = F.coalesce(F.col("n_pixels") >= K.MASK_MIN_PIXELS, F.lit(False))
    quality = F.col("confidence") + F.least(F.col("area_ratio"), F.lit(K.OBJECT_AREA_CAP))
    objects = own.groupBy(*keys).agg(F.max_by(F.struct("idx", "box"), F.when((s == "object") & usable, F.struct(quality, -F.col("idx")))).alias("o"))
    both = own.join(objects, keys, "left")
    if overlaps is not None:
        both = both.join(overlaps.select(*keys, "idx", "mask_overlap"), [*keys, "idx"], "left")
        mask = F.coalesce("mask_overlap", F.lit(0.0))
    else:
        mask = B.overlap(F.col("box"), F.col("o.box"))
    has = F.col("o").isNotNull()
    share = F.when(has, B.intersection(F.col("box"), F.col("o.box")) / F.greatest(F.lit(1.0), B.area(F.col("box")))).otherwise(0.0)
    mask = F.when(has, mask).otherwise(0.0)
    far = B.centre_distance(F.col("box"), F.col("o.box"), F.greatest(F.lit(1.0), F.sqrt(F.col("width") ** 2 + F.col("height") ** 2)))
    close = F.coalesce(far <= K.MAX_CENTRE_DISTANCE, F.lit(False))
    overlaps_object = (mask >= K.MIN_MASK_OVERLAP) | (share >= K.MIN_BOX_OVERLAP)
    tiny = touches_edge(F.col("box"), F.col("width")) & (F.col("area_ratio") < K.TINY_EDGE_AREA)
    centre = B.centre_y(F.col("box")) / F.col("height")
    first = s.isNotNull() & ~usable
    rules = [
        (s.isNull(), "label_not_mapped_to_segment"),
        (s.isNotNull() & F.col("n_pixels").isNull(), "missing_mask"),
        (first, "mask_pixel_count_below_minimum"),
        (~first & (s == "object") & (F.col("o.idx") != F.col("idx")) & ~joined_in, "lower_quality_than_selected_object"),
        (~first & (s == "pot") & (F.col("confidence") < K.POT_MIN_CONFIDENCE), "pot_confidence_below_minimum"),
        (~first & (s == "pot") & has & ~overlaps_object & ~close, "pot_not_spatially_consistent_with_object"),
        (~first & (s == "pot") & tiny & ~overlaps_object, "tiny_edge_pot_without_strong_object_overlap"),
        (~first & (s == "table") & (F.col("area_ratio") < K.TABLE_MIN_AREA), "table_area_below_minimum"),
        (~first & (s == "table") & (centre < K.TABLE_MIN_CENTRE_Y), "table_not_low_enough_in_image"),
        (~first & (s == "leaf") & has & (mask < K.MIN_MASK_OVERLAP), "leaf_not_overlapping_selected_object"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, r in rules]))
    value = T.first_match(
        [
            (s == "object", quality),
            (s == "pot", F.col("confidence") + 2 * mask + share - F.coalesce(far, F.lit(0.0)) - F.when(tiny, 0.25).otherwise(0.0)),
            (s == "table", F.col("confidence") + F.col("area_ratio") + F.coalesce(centre, F.lit(0.0))),
            (s == "leaf", F.col("confidence") + mask),
        ]
    )
    scored = both.withColumns({"reasons": reasons, "joined_in": joined_in}).withColumn("score", F.when((F.size("reasons") == 0) | ((s == "object") & usable), value)).drop("mask_overlap")
    nth = F.row_number().over(Window.partitionBy(*keys, "segment").orderBy(F.when(F.size("reasons") == 0, F.col("score")).desc_nulls_last(), "idx"))
    ranked = scored.withColumn("chosen", (nth == 1) & (F.size("reasons") == 0) & ((s != "object") | (F.col("o.idx") == F.col("idx"))))
    ranked = ranked.withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    fate = T.first_match(
        [
            (s.isNull(), F.lit(None).cast("string")),
            ((s == "object") & F.col("joined_in"), F.lit("unioned_into_object")),
            (F.col("chosen"), F.concat(F.lit("selected_"), s)),
            (F.size("reasons") > 0, F.concat(F.lit("rejected_"), s)),
        ],
        F.concat(F.lit("rejected_lower_quality_for_"), s),
    )
    late = s.isNotNull() & ~F.col("chosen") & (F.size("reasons") == 0) & ~((s == "object") & F.col("joined_in"))
    whole = F.when(late, F.array(F.concat(F.lit("lower_quality_than_selected_"), s))).otherwise(F.col("reasons"))
    return ranked.withColumn("decision", fate).withColumn("reasons", whole).drop("o", "joined_in")


def union_parts(detections: DataFrame, keys: list[str]) -> DataFrame:
    """Detections that grow the primary object's mask, in their order: ``accepted`` and ``reason``, null for a part that joins.

    Each accepted mask widens what the next one is held against, so a view is one group.
    ``detections``: idx, is_primary, segment, blocked, box, pixels (array of row * width + col), width, height.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx").reset_index(drop=True)
        first = part[part.is_primary]
        if first.empty:
            return part.assign(accepted=False, reason="no_primary_object")[columns]
        first = first.iloc[0]
        width = int(first.width)
        union, out = set(first.pixels), []
        diagonal = (float(first.width) ** 2 + float(first.height) ** 2) ** 0.5

        def grown(u: tuple, px: set) -> tuple:
            """Bounds of a mask that has bounds ``u`` and these pixels."""
            if not px:
                return u
            rows, cols = [p // width for p in px], [p % width for p in px]
            return min(u[0], *cols), min(u[1], *rows), max(u[2] - 1, *cols) + 1, max(u[3] - 1, *rows) + 1

        far = float("inf")
        u = grown((far, far, -far, -far), union)

        for d in part.itertuples():
            pixels = set(d.pixels if d.pixels is not None else ())
            if d.is_primary:
                out.append((True, "primary_object_anchor"))
                continue
            if d.segment not in ("object", "pot", "leaf"):
                out.append((False, "segment_not_part_of_full_object_union"))
                continue
            if not pixels:
                out.append((False, "missing_mask"))
                continue
            if len(pixels) < K.UNION_MIN_PIXELS:
                out.append((False, "mask_pixel_count_below_object_union_minimum"))
                continue
            if d.blocked and d.segment == "object":
                out.append((False, "candidate_has_blocking_rejection"))
                continue
            b, p = d.box, first.box
            inter = max(0.0, min(b["x2"], p["x2"]) - max(b["x1"], p["x1"])) * max(0.0, min(b["y2"], p["y2"]) - max(b["y1"], p["y1"]))
            own = max(1.0, (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
            dx, dy = max(0.0, b["x1"] - u[2], u[0] - b["x2"]), max(0.0, b["y1"] - u[3], u[1] - b["y2"])
            near = len(pixels & union) / len(pixels) >= K.UNION_MASK or inter / own >= K.UNION_BOX or (diagonal > 0 and (dx * dx + dy * dy) ** 0.5 / diagonal <= K.UNION_GAP)
            out.append((near, None if near else "not_spatially_consistent_with_primary_object"))
            if near:
                union |= pixels
                u = grown(u, pixels)
        return part.assign(accepted=[a for a, _ in out], reason=[r for _, r in out])[columns]

    columns = [*keys, "idx", "accepted", "reason"]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema.fields if f.name in (*keys, "idx"))
    return detections.groupBy(*keys).applyInPandas(run, f"{shape}, accepted boolean, reason string")


def crop_override(full: DataFrame, crop: DataFrame, keys: list[str]) -> DataFrame:
    """A crop's detection replaces the full image's where that is absent or less confident."""
    a, b = full.select(*keys, F.struct("confidence", "idx").alias("f")), crop.select(*keys, F.struct("confidence", "idx").alias("c"))
    use = F.col("f").isNull() | (F.col("c.confidence") > F.col("f.confidence"))
    return a.join(b, keys, "full").select(*keys, F.when(F.coalesce(use & F.col("c").isNotNull(), F.lit(False)), F.col("c")).otherwise(F.col("f")).alias("best"), F.coalesce(use & F.col("c").isNotNull(), F.lit(False)).alias("from_crop"))


def _of_enough(pixels: DataFrame, keys: list[str], least: int) -> DataFrame:
    enough = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return pixels.join(enough.select(*keys), keys, "left_semi")


def upper_part(pixels: DataFrame, keys: list[str], least: int = K.MASK_MIN_PIXELS) -> DataFrame:
    """Pixels of each mask down to 62 % of its own height, that line included, where mask and part have enough: a stand-in for a leaf mask."""
    bounds = pixels.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    cutoff = F.col("r0") + F.floor((F.col("r1") - F.col("r0") + 1) * K.UPPER_PART)
    return _of_enough(pixels.join(bounds, keys).filter(F.col("row") <= cutoff).drop("r0", "r1", "n"), keys, least)


def lower_central_part(pixels: DataFrame, keys: list[str], width: Column, least: int = K.MASK_MIN_PIXELS) -> DataFrame:
    """Pixels of each mask from 48 % of its height down and within 34 % of its width either side of its middle; a third of ``least`` of them, 200 at least. ``width`` is the image's."""
    b = pixels.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    across, centre = F.greatest(F.lit(1), F.col("c1") - F.col("c0") + 1) * K.LOWER_HALF_WIDTH, (F.col("c0") + F.col("c1")) / 2.0
    left = F.greatest(F.lit(0.0), centre - across).cast("int")
    right = F.least(width.cast("double"), centre + across).cast("int")
    top = F.col("r0") + F.floor((F.col("r1") - F.col("r0") + 1) * K.LOWER_PART)
    kept = pixels.join(b, keys).filter((F.col("row") >= top) & (F.col("col") >= left) & (F.col("col") < right)).drop("r0", "r1", "c0", "c1", "n")
    return _of_enough(kept, keys, max(200, least // 3))
