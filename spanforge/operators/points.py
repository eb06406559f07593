"""Point tables: deprojection, crops, exact extents, profiles and voxels.

A cloud is a set of rows with the key columns of its view and x, y, z in metres. All
statistics are exact, and every operator is one aggregate, or one more that is joined
back, on the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.functions.text import first_match
from spanforge.sources.store import drop, written

AXES = ("x", "y", "z")


def depth_scale(units: Column, scale: Column, applied: Column) -> Column:
    """Struct of the factor to metres and the error that forbids one.

    Saved metres need an applied scale; raw units and millimetres one that is not applied.
    """
    u = F.lower(F.coalesce(units, F.lit("meters")))
    raw, mm = u.isin("raw_sdk_unit", "raw_sdk_units"), u.isin("millimeter", "millimeters", "mm")
    known = F.coalesce(scale.cast("double"), F.lit(1.0))
    error = first_match(
        [
            ((known <= 0) | F.isnan(known) | (known == float("inf")), F.lit("depth_scale_invalid")),
            (~(u == "meters") & ~raw & ~mm, F.concat(F.lit("depth_units_unsupported:"), u)),
            (~applied.eqNullSafe(u == "meters"), F.lit("depth_scale_state_invalid")),
            (raw & (known >= 0.1), F.lit("depth_scale_not_meters_per_unit")),
        ]
    )
    return F.struct(F.when(error.isNull(), F.when(mm, known * 0.001).otherwise(known)).alias("factor"), error.alias("error"))


def metres_per_unit(s: Column) -> Column:
    """A camera's scale: 0.1 and more are millimetres."""
    return F.when(s >= 0.1, s * 0.001).otherwise(s)


def alias_value(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


def valid_depth(depth: Column) -> Column:
    d = depth.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (d > 0) & (d != float("inf"))


def deproject(pixels: DataFrame, *, row: str = "row", col: str = "col", depth: str = "depth", fx: Column, fy: Column, cx: Column, cy: Column, scale: Column | None = None) -> DataFrame:
    """Valid depth pixels as points, their row and column kept."""
    z = F.col(depth).cast("double") * (F.lit(1.0) if scale is None else scale)
    kept = pixels.filter(valid_depth(F.col(depth))).withColumn("z", z)
    return kept.withColumns({"x": (F.col(col) - cx) * F.col("z") / fx, "y": (F.col(row) - cy) * F.col("z") / fy})


def raw_points(pixels: DataFrame) -> DataFrame:
    """Column, row and depth as they are, without a projection."""
    return pixels.filter(valid_depth(F.col("depth"))).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double"), "z": F.col("depth").cast("double")})


def masked_deprojection(pixels: DataFrame, mask: DataFrame, keys: list[str], **intrinsics) -> tuple[DataFrame, DataFrame]:
    """Points under a mask, and per view their number, median depth, invalid pixels and the reason that makes them implausible."""
    under = pixels.join(mask.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")
    points = deproject(under, **intrinsics)
    invalid = under.groupBy(*keys).agg(F.count_if(~valid_depth(F.col("depth"))).alias("invalid"))
    stats = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.median("z").alias("median_z"), F.max("z").alias("max_z"))
    reason = first_match([(F.col("n_points").isNull(), F.lit("no_valid_depth")), (~F.col("median_z").between(0.1, 10.0), F.lit("median_depth_implausible")), (F.col("max_z") > 20.0, F.lit("max_depth_implausible"))])
    return points, invalid.join(stats, keys, "left").withColumn("error", reason)


def reproject(points: DataFrame, *, fx: Column, fy: Column, cx: Column, cy: Column, width: int, height: int, rotation: list[float] | None = None, translation: list[float] | None = None) -> DataFrame:
    """Pixel of another camera for every point in front of it and inside its image."""
    r, t = rotation or [1, 0, 0, 0, 1, 0, 0, 0, 1], translation or [0, 0, 0]
    x, y, z = (F.col("x") * float(r[3 * i]) + F.col("y") * float(r[3 * i + 1]) + F.col("z") * float(r[3 * i + 2]) + float(t[i]) for i in range(3))
    moved = points.withColumns({"tx": x, "ty": y, "tz": z}).filter("tz > 0")
    seen = moved.withColumns({"px_col": F.rint(F.col("tx") * fx / F.col("tz") + cx).cast("int"), "px_row": F.rint(F.col("ty") * fy / F.col("tz") + cy).cast("int")})
    return seen.filter(F.col("px_col").between(0, width - 1) & F.col("px_row").between(0, height - 1)).drop("tx", "ty", "tz")


def pixel_map_check(points: DataFrame, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Per view: points, repeated pixels, pixels outside the image."""
    outside = ~(F.col("px_row").between(0, height - 1) & F.col("px_col").between(0, width - 1))
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), (F.count(F.lit(1)) - F.count_distinct("px_row", "px_col")).alias("n_repeated"), F.count_if(outside).alias("n_outside"))


def select_by_mask(points: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Points whose own pixel is in the mask."""
    return points.join(mask.select(*keys, F.col("row").alias("px_row"), F.col("col").alias("px_col")), [*keys, "px_row", "px_col"], "left_semi")


def mapping_strategy(n_points: Column, n_mapped: Column, n_valid_pixels: Column, n_pixels: Column) -> Column:
    """How points belong to pixels: an explicit map, the valid pixels in order, or all pixels in order."""
    return first_match([(n_mapped == n_points, F.lit("pixel_map")), (n_valid_pixels == n_points, F.lit("valid_pixels")), (n_pixels == n_points, F.lit("all_pixels"))])


def finite_points(points: DataFrame) -> DataFrame:
    good = [~F.isnan(a) & (F.abs(a) != float("inf")) & F.col(a).isNotNull() for a in AXES]
    return points.filter(good[0] & good[1] & good[2])


def normalise_units(points: DataFrame, keys: list[str]) -> DataFrame:
    """Clouds that span over 20 are millimetres: scaled, and marked by ``scaled``."""
    span = F.greatest(*[F.max(a) - F.min(a) for a in AXES])
    bounds = points.groupBy(*keys).agg((span > 20).alias("scaled"))
    return points.join(bounds, keys).withColumns({a: F.when(F.col("scaled"), F.col(a) / 1000.0).otherwise(F.col(a)) for a in AXES})


# --- crops
def inside_roi(x: Column, y: Column, z: Column, *, use_y: bool = True, y_min: float | None = None) -> Column:
    """Inside the calibrated volume and its margin, edges included."""
    m = K.ROI_MARGIN
    ok = (F.abs(x) <= K.ROI_HALF_WIDTH + m) & z.between(K.ROI_DEPTH_MIN - m, K.ROI_DEPTH_MAX + m)
    if use_y:
        ok &= y <= K.ROI_Y_MAX + m
        if y_min is not None:
            ok &= y >= y_min - m
    return F.coalesce(ok, F.lit(False))


def apply_roi(points: DataFrame, *, use_y: bool = True) -> DataFrame:
    """All points with ``inside``: kept and rejected ones from one pass."""
    return points.withColumn("inside", inside_roi(F.col("x"), F.col("y"), F.col("z"), use_y=use_y))


def roi_report(marked: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """Per view: kept, rejected, kept share and the warning or error that follows."""
    out = marked.groupBy(*keys).agg(F.count_if("inside").alias("n_kept"), F.count_if(~F.col("inside")).alias("n_rejected"))
    share = F.col("n_kept") / (F.col("n_kept") + F.col("n_rejected"))
    return out.withColumns({"kept_percent": share * 100.0, "status": first_match([(F.col("n_kept") == 0, F.lit("roi_empty")), (F.col("n_kept") < least, F.lit("too_few_points")), (share < 0.05, F.lit("roi_removed_most_points"))], F.lit("ok"))})


def central_crop(points: DataFrame, keys: list[str], low: float = 0.04, high: float = 0.96) -> DataFrame:
    """Points between two quantiles of x and of y."""
    bounds = points.groupBy(*keys).agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("bx"), F.percentile("y", F.array(F.lit(low), F.lit(high))).alias("by"))
    kept = points.join(bounds, keys).filter(F.col("x").between(F.col("bx")[0], F.col("bx")[1]) & F.col("y").between(F.col("by")[0], F.col("by")[1]))
    return kept.drop("bx", "by")


def plane_distance(plane: Column | tuple) -> Column:
    """Signed distance to (a, b, c, d) with a unit normal."""
    a, b, c, d = (plane[i] for i in range(4))
    return F.col("x") * a + F.col("y") * b + F.col("z") * c + d


def remove_plane(points: DataFrame, planes: DataFrame, keys: list[str], threshold: float = K.PLANE_THRESHOLD) -> DataFrame:
    """Points beyond the plane on the side that holds more of them; the positive one on a tie. ``planes`` has ``plane`` per view."""
    away = points.join(planes.select(*keys, "plane"), keys).withColumn("distance", plane_distance(F.col("plane")))
    sides = away.groupBy(*keys).agg((F.count_if(F.col("distance") > threshold) >= F.count_if(F.col("distance") < -threshold)).alias("up"))
    kept = away.join(sides, keys).filter(F.when(F.col("up"), F.col("distance") > threshold).otherwise(F.col("distance") < -threshold))
    return kept.drop("plane", "distance", "up")


# --- statistics
def extents(points: DataFrame, keys: list[str]) -> DataFrame:
    """Number of points and least, greatest and span of each axis."""
    aggs = [F.count(F.lit(1)).alias("n_points")]
    for a in AXES:
        aggs += [F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), (F.max(a) - F.min(a)).alias(f"span_{a}")]
    return points.groupBy(*keys).agg(*aggs)


def robust_span(values: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Exact span between two percentiles, interpolated."""
    p = F.percentile(values, F.array(F.lit(low), F.lit(high)))
    return p[1] - p[0]


#: Cut points of equal depth that a sketch gives, and values that one window sorts.
CUTS, SORTED = 256, 1 << 17


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], most: int = SORTED) -> DataFrame:
    """Exact, interpolated quantiles of groups of any size and distribution: keys, n, low, high and ``q``, an array.

    An aggregate that holds a group's distinct values in one task ends where a group is a
    third of a large table. Here a sketch cuts each group into parts of about equal depth, whatever
    its values; the few parts around a wanted rank make its bracket. One pass counts what
    lies below a bracket and, by value, what lies inside. A bracket with more than ``most``
    values is cut again; a sketch that missed the rank costs another pass, not the result. Null
    and NaN do not count.
    """
    own = rows.select(*keys, F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    depth = F.percentile_approx("v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), 20 * CUTS)
    groups = written(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), depth.alias("cuts")), "groups")
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))

    def bracket(i: int, q: float) -> Column:
        first = F.floor(place(q) / F.col("n") * CUTS) - 1
        low = F.when(first > 0, F.least(F.get("cuts", first.cast("int")), F.col("high"))).otherwise(F.col("low"))
        last = F.ceil((place(q) + 1) / F.col("n") * CUTS) + 1
        high = F.when(last < CUTS, F.greatest(F.get("cuts", last.cast("int")), F.col("low"))).otherwise(F.col("high"))
        return F.struct(F.lit(i).alias("i"), low.alias("a"), high.alias("b"))

    wanted = groups.select(*keys, F.posexplode(F.array(*[F.struct(place(q).alias("p")) for q in shares])).alias("i", "w"))
    ranks = wanted.select(*keys, "i", F.floor("w.p").alias("r0"), F.ceil("w.p").alias("r1"), (F.col("w.p") - F.floor("w.p")).alias("part"))

    def counted(brackets: DataFrame) -> DataFrame:
        """(keys, i, v, times): values inside each bracket, and one row without a value for all below it."""
        each = own.join(brackets, keys).select(*keys, "v", F.explode("brackets").alias("k")).filter(F.col("v") <= F.col("k.b"))
        return each.groupBy(*keys, F.col("k.i").alias("i"), F.when(F.col("v") >= F.col("k.a"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("times"))

    held = written(counted(groups.select(*keys, F.array(*[bracket(i, q) for i, q in enumerate(shares)]).alias("brackets"))), "held")
    by = [*keys, "i"]
    inside = lambda df: df.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("times"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("times"))), F.lit(0)).alias("here"), F.count("v").alias("n_values"))
    fit = (F.col("below") <= F.col("r0")) & (F.col("r1") < F.col("below") + F.col("here"))
    missed = ranks.join(inside(held), by, "left").filter(~F.coalesce(fit, F.lit(False))).select(*by)
    if missed.limit(1).count():
        whole = groups.join(missed.groupBy(*keys).agg(F.collect_set("i").alias("which")), keys)
        again = counted(whole.select(*keys, F.transform("which", lambda i: F.struct(i.alias("i"), F.col("low").alias("a"), F.col("high").alias("b"))).alias("brackets")))
        held = written(held.join(missed, by, "left_anti").unionByName(again), "held")
    while True:
        sizes = written(inside(held).join(ranks, by), "sizes")
        large = sizes.filter(F.col("n_values") > most)
        if not large.limit(1).count():
            break
        before, held = held, written(held.join(large.select(*by), by, "left_anti").unionByName(_narrowed(held, large, by)), "held")
        drop(before, sizes)

    before = Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = held.withColumn("less", F.coalesce(F.sum("times").over(before), F.lit(0))).filter("v is not null").join(sizes.select(*by, "r0", "r1", "part"), by)
    at = lambda r: F.max(F.when((F.col(r) >= F.col("less")) & (F.col(r) < F.col("less") + F.col("times")), F.col("v")))
    each = placed.groupBy(*by).agg(at("r0").alias("x0"), at("r1").alias("x1"), F.max("part").alias("part")).select(*by, (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("part")).alias("x"))
    q = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("q"))
    return groups.drop("cuts").join(q, keys)


def _narrowed(held: DataFrame, large: DataFrame, by: list[str]) -> DataFrame:
    """The brackets of ``large`` cut down to the parts, of about equal numbers of values, that hold the wanted ranks."""
    own = held.join(large.select(*by, "r0", "r1"), by)
    cuts = own.groupBy(*by).agg(F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), 20 * CUTS)).alias("cuts"))
    parted = written(own.join(cuts, by).withColumn("no", F.when(F.col("v").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("v"))))).drop("cuts"), "parted")
    whole = parted.groupBy(*by, "no").agg(F.sum("times").alias("times"), F.first("r0").alias("r0"), F.first("r1").alias("r1"))
    before = Window.partitionBy(*by).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    ends = whole.withColumn("less", F.coalesce(F.sum("times").over(before), F.lit(0)))
    holds = lambda r: (F.col(r) >= F.col("less")) & (F.col(r) < F.col("less") + F.col("times"))
    span = ends.groupBy(*by).agg(F.max(F.when(holds("r0"), F.col("no"))).alias("first"), F.max(F.when(holds("r1"), F.col("no"))).alias("last"))
    kept = parted.join(span, by).filter(F.col("no") <= F.col("last"))
    return kept.groupBy(*by, F.when(F.col("no") >= F.col("first"), F.col("v")).alias("v")).agg(F.sum("times").alias("times"))


def robust_extents(points: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of percentiles 1 to 99 on x and z and of all of y; of all on each axis under ten points."""
    few = F.count(F.lit(1)) < K.MIN_ROBUST_POINTS
    whole = {a: F.max(a) - F.min(a) for a in AXES}
    return points.groupBy(*keys).agg(F.when(few, whole["x"]).otherwise(robust_span(F.col("x"))).alias("robust_x"), whole["y"].alias("robust_y"), F.when(few, whole["z"]).otherwise(robust_span(F.col("z"))).alias("robust_z"))


def dimensions(points: DataFrame, keys: list[str]) -> DataFrame:
    """Length (x), height (y) and depth (z) in metres and inches, raw and robust, and their greatest ratio."""
    both = extents(points, keys).join(robust_extents(points, keys), keys)
    out = {}
    for name, a in (("horizontal", "x"), ("vertical", "y"), ("depth", "z")):
        for prefix, column in (("", f"span_{a}"), ("robust_", f"robust_{a}")):
            out[f"{prefix}{name}_span_m"] = F.col(column)
            out[f"{prefix}{name}_span_in"] = F.col(column) * K.M_TO_IN
    ratios = [F.when(F.col(f"robust_{a}") > 0, F.col(f"span_{a}") / F.col(f"robust_{a}")) for a in AXES]
    out["max_raw_to_robust"] = F.coalesce(F.greatest(*ratios), F.lit(1.0))
    out["bbox_volume_in3"] = F.col("span_x") * F.col("span_y") * F.col("span_z") * K.M_TO_IN**3
    return both.withColumns(out)


def depth_stats(pixels: DataFrame, keys: list[str], depth: str = "depth", *, any_size: bool = False) -> DataFrame:
    """Least, greatest and median valid depth and the share of pixels that have one; ``any_size`` where a key is more than an image."""
    d = F.when(valid_depth(F.col(depth)), F.col(depth).cast("double"))
    aggs = [F.min(d).alias("min_depth"), F.max(d).alias("max_depth"), F.count(d).alias("n_valid"), (F.count(d) * 100.0 / F.count(F.lit(1))).alias("valid_percent")]
    if not any_size:
        return pixels.groupBy(*keys).agg(*aggs, F.median(d).alias("median_depth"))
    middle = quantiles(pixels.select(*keys, d.alias("d")), keys, "d", [0.5]).select(*keys, F.get("q", F.lit(0)).alias("median_depth"))
    return pixels.groupBy(*keys).agg(*aggs).join(middle, keys, "left")


def voxel(c: Column, size: float) -> Column:
    return F.floor(c.cast("double") / F.lit(size).cast("double")).cast("long")


def voxel_centroids(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """One mean point per occupied voxel."""
    cells = points.withColumns({f"v{a}": voxel(F.col(a), size) for a in AXES})
    return cells.groupBy(*keys, "vx", "vy", "vz").agg(*[F.avg(a).alias(a) for a in AXES], F.count(F.lit(1)).alias("n_points"))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Histogram bin with a closed last edge; without a span all fall into the middle."""
    at = F.floor((value - low) / (high - low) * bins).cast("int")
    return F.when(high > low, F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).otherwise(bins // 2)


def profile(points: DataFrame, keys: list[str], bins: int = K.PROFILE_BINS, *, any_size: bool = False) -> DataFrame:
    """Vertical density profile of each cloud: percentiles, bins, compactness, mean height and thirds; ``any_size`` where a cloud is more than a view."""
    bounds = extents(points, keys)
    placed = points.join(bounds, keys).withColumn("bin", bin_of(F.col("y"), F.col("min_y"), F.col("max_y"), bins))
    y_in = F.col("y") * K.M_TO_IN
    at = [p / 100 for p in K.PROFILE_PERCENTILES]
    aggs = [] if any_size else [F.percentile(y_in, F.array(*[F.lit(p) for p in at])).alias("ps")]
    aggs += [F.avg(y_in).alias("mean_y_in"), F.array(*[F.count_if(F.col("bin") == i) for i in range(bins)]).alias("hist")]
    thirds = ("lower_third", "middle_third", "upper_third")
    for k, name in enumerate(thirds):
        low = F.col("min_y") + F.col("span_y") * (k / 3.0)
        high = F.col("min_y") + F.col("span_y") * ((k + 1) / 3.0 if k < 2 else 1.0)
        band = (F.col("span_y") <= 0) | F.col("y").between(low, high)
        for side, a in (("width_in", "x"), ("depth_in", "z")):
            v = F.when(band, F.col(a))
            aggs.append(((F.max(v) - F.min(v)) * K.M_TO_IN).alias(f"{name}_{side}"))
    parts = placed.groupBy(*keys).agg(*aggs).join(bounds, keys)
    if any_size:
        parts = parts.join(quantiles(points.select(*keys, y_in.alias("y_in")), keys, "y_in", at).select(*keys, F.col("q").alias("ps")), keys)
    volume = F.col("span_x") * F.col("span_y") * F.col("span_z") * K.M_TO_IN**3
    density = F.transform("hist", lambda n: n / F.col("n_points"))
    return parts.select(
        *keys,
        "n_points",
        *[(F.col(f"span_{a}") * K.M_TO_IN).alias(f"bbox_{n}_in") for n, a in (("length", "x"), ("width", "z"), ("height", "y"))],
        F.map_from_arrays(F.array(*[F.lit(f"y_p{p}") for p in K.PROFILE_PERCENTILES]), F.col("ps")).alias("height_percentiles"),
        density.alias("vertical_density_bins"),
        F.size(F.filter("hist", lambda n: n > 0)).alias("occupied_bin_count"),
        F.array_max(density).alias("max_bin_density"),
        F.col("mean_y_in").alias("density_center_of_mass_y"),
        F.when(volume > 0, F.col("n_points") / volume).alias("compactness"),
        F.map_from_arrays(F.array(*[F.lit(t) for t in thirds]), F.array(*[F.struct(F.col(f"{t}_width_in").alias("width_in"), F.col(f"{t}_depth_in").alias("depth_in")) for t in thirds])).alias("thirds"),
    )


def profile_summary(values: Column) -> Column:
    """Least, greatest, mean and first peak of a list of numbers."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.array_min(values).alias("least"), F.array_max(values).alias("greatest"), F.try_divide(total, F.size(values)).alias("mean"), (F.array_position(values, F.array_max(values)) - 1).alias("peak"))


def width_line(points: DataFrame, keys: list[str], samples: int = 512) -> DataFrame:
    """Debug line between the robust ends in x (the ends themselves under ten points), level at the middle of both ends.

    An end's y and z are the medians of the points within 1 % of the width of it, one
    millimetre at least; without any, of its max(8, n / 200) nearest points.
    """
    few = F.count(F.lit(1)) < K.MIN_ROBUST_POINTS
    robust = F.percentile("x", F.array(F.lit(0.01), F.lit(0.99)))
    ends = points.groupBy(*keys).agg(F.when(few, F.array(F.min("x"), F.max("x"))).otherwise(robust).alias("ends"), F.count(F.lit(1)).alias("n_all"))
    tolerance = F.greatest((F.col("ends")[1] - F.col("ends")[0]) * 0.01, F.lit(0.001))
    away = [F.abs(F.col("x") - F.col("ends")[i]) for i in (0, 1)]
    placed = points.join(ends, keys).withColumns({"ends": F.col("ends"), "tolerance": tolerance} | {f"away{i}": away[i] for i in (0, 1)})
    inside = placed.groupBy(*keys).agg(F.count_if(F.col("away0") <= F.col("tolerance")).alias("n0"), F.count_if(F.col("away1") <= F.col("tolerance")).alias("n1"))
    sides = []
    for i in (0, 1):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(f"away{i}", *AXES))
        most = F.least(F.greatest(F.lit(8), F.floor(F.col("n_all") / 200)), F.col("n_all"))
        near = placed.join(inside.filter(f"n{i} > 0").select(*keys), keys, "left_semi").filter(F.col(f"away{i}") <= F.col("tolerance"))
        far = placed.join(inside.filter(f"n{i} = 0").select(*keys), keys, "left_semi").withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")
        sides.append(near.unionByName(far).groupBy(*keys).agg(F.median("y").alias(f"y{i}"), F.median("z").alias(f"z{i}")))
    line = ends.join(sides[0], keys).join(sides[1], keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    x = F.col("ends")[0] + (F.col("ends")[1] - F.col("ends")[0]) * (F.col("i") / float(samples - 1))
    return line.select(*keys, "i", x.alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), ((F.col("z0") + F.col("z1")) / 2).alias("z"))


def measure(points: DataFrame, keys: list[str]) -> DataFrame:
    """A trusted object cloud measured as it is: dimensions beside its profile."""
    own = profile(points, keys)
    return dimensions(points, keys).join(own.drop("n_points"), keys)


def merge_clouds(*clouds: DataFrame) -> DataFrame:
    first, *rest = clouds
    for c in rest:
        first = first.unionByName(c)
    return first
