"""Literal cases of the point, plane, cluster and profile operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.operators import cluster as C
from spanforge.operators import measuring as M
from spanforge.operators import points as P


def cloud(spark, xyz, view=1):
    rows = [(view, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "view int, ord long, x double, y double, z double")


def test_robust_extents_trim_x_and_z_only(spark):
    pts = [(i, 2 * i, -3 * i) for i in range(101)]
    r = P.robust_extents(cloud(spark, pts), ["view"]).first()
    p1, p99 = np.percentile(np.array(pts, float), [1, 99], axis=0)
    assert (r.robust_x, r.robust_y, r.robust_z) == pytest.approx((p99[0] - p1[0], 200.0, p99[2] - p1[2]))
    few = P.robust_extents(cloud(spark, pts[:9]), ["view"]).first()
    assert (few.robust_x, few.robust_y, few.robust_z) == (8.0, 16.0, 24.0)


def test_spans_in_metres_and_inches(spark):
    d = P.dimensions(cloud(spark, [(-0.10, -0.20, 0.70), (0.15, 0.30, 0.80), (0.05, -0.10, 0.75)]), ["view"]).first()
    assert (d.span_x, d.span_y, d.span_z) == pytest.approx((0.25, 0.50, 0.10))
    assert (d.horizontal_span_in, d.vertical_span_in, d.depth_span_in) == pytest.approx((9.842525, 19.68505, 3.93701))
    e = P.extents(cloud(spark, [(5, -10, 2), (8, -2, 7)]), ["view"]).first()
    assert (e.span_x, e.span_y, e.span_z) == (3, 8, 5)


def test_roi_keeps_and_rejects(spark):
    pts = [(0, 0, 0.8)] * 30 + [(0, 0, 2), (1, 0, 0.8)]
    marked = P.apply_roi(cloud(spark, pts))
    assert {r.ord: r.inside for r in marked.collect()} == {i: i < 30 for i in range(32)}
    report = P.roi_report(marked, ["view"]).first()
    assert (report.n_kept, report.n_rejected, report.status) == (30, 2, "ok")


def test_deprojection(spark):
    depth = [[0, 1, 2], [float("nan"), 0, 3], [4, -1, 5]]
    px = spark.createDataFrame([(r, c, float(d)) for r, row in enumerate(depth) for c, d in enumerate(row)], "row int, col int, depth double")
    one = F.lit(1.0)
    out = P.deproject(px, fx=one, fy=one, cx=F.lit(0.0), cy=F.lit(0.0)).collect()
    assert sorted((r.row, r.col) for r in out) == [(0, 1), (0, 2), (1, 2), (2, 0), (2, 2)]
    assert all((r.x, r.y) == (r.col * r.z, r.row * r.z) for r in out)


def test_masked_deprojection(spark):
    px = spark.createDataFrame([(1, 0, 0, 2000.0), (1, 0, 1, 0.0), (1, 1, 0, float("nan")), (1, 1, 1, 4000.0)], "view int, row int, col int, depth double")
    mask = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 1)], "view int, row int, col int")
    one = F.lit(1.0)
    pts, stats = P.masked_deprojection(px, mask, ["view"], fx=one, fy=one, cx=F.lit(0.0), cy=F.lit(0.0), scale=F.lit(0.001))
    assert sorted((r.x, r.y, r.z) for r in pts.collect()) == [(0, 0, 2), (4, 4, 4)]
    s = stats.first()
    assert (s.invalid, s.median_z, s.error) == (1, 3.0, None)


def test_depth_units(spark):
    rows = [("raw_sdk_unit", 1.0, False), ("raw_sdk_unit", 0.001, False), ("meters", 1.0, True), ("meters", 1.0, False), ("mm", 1.0, False), ("feet", 1.0, False), (None, -1.0, True)]
    df = spark.createDataFrame(rows, "u string, s double, a boolean").select(P.depth_scale(F.col("u"), F.col("s"), F.col("a")).alias("d")).select("d.*")
    assert [(r.factor, r.error) for r in df.collect()] == [(None, "depth_scale_not_meters_per_unit"), (0.001, None), (1.0, None), (None, "depth_scale_state_invalid"), (0.001, None), (None, "depth_units_unsupported:feet"), (None, "depth_scale_invalid")]


def test_depth_stats(spark):
    px = spark.createDataFrame([(1, d) for d in (1500.0, 0.0, 2500.0, 3500.0)], "view int, depth double")
    s = P.depth_stats(px, ["view"]).first()
    assert (s.min_depth, s.median_depth, s.valid_percent) == (1500, 2500, 75.0)


def test_profile_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    p = P.profile(cloud(spark, x), ["view"]).first()
    hist = np.histogram(x[:, 1], bins=10, range=(x[:, 1].min(), x[:, 1].max()))[0]
    assert p.vertical_density_bins == pytest.approx((hist / 500).tolist())
    assert p.height_percentiles["y_p25"] == pytest.approx(np.percentile(x[:, 1] * K.M_TO_IN, 25))
    low, span = x[:, 1].min(), np.ptp(x[:, 1])
    band = x[x[:, 1] <= low + span / 3]
    assert p.thirds["lower_third"].width_in == pytest.approx(np.ptp(band[:, 0]) * K.M_TO_IN)
    assert p.occupied_bin_count == np.count_nonzero(hist)
    flat = P.profile(cloud(spark, [(0, 1, 0)] * 4), ["view"]).first()
    assert flat.vertical_density_bins[5] == 1.0 and flat.compactness is None


def test_units_are_normalised(spark):
    r = P.normalise_units(cloud(spark, [(0, 0, 0), (1000, 10, 10)]), ["view"]).agg(F.max("x"), F.max("scaled")).first()
    assert r[0] == 1.0 and r[1]


def test_plane_and_object(spark):
    rng = np.random.default_rng(1)
    plane = [(-0.4 + 0.8 * i / 41, 0.5, 0.4 + 0.8 * j / 41) for i in range(42) for j in range(42)]
    body = [(-0.1 + 0.2 * i / 11, 0.1 + 0.2 * j / 9, 0.7 + 0.1 * k / 7) for i in range(12) for j in range(10) for k in range(8)]
    pts = cloud(spark, [*plane, *body, (0.45, 0.1, 1.0)])
    sampled = C.stride_sample(pts, ["view"])
    fit = C.fit_plane(sampled, ["view"], C.draw_table(sampled, ["view"])).first()
    assert abs(fit.plane[1]) > 0.99 and fit.n_inliers >= len(plane)
    xyz = np.array([*plane, *body, (0.45, 0.1, 1.0)])
    best, want = 0, None
    for i, t in enumerate(C.draws(len(xyz))):
        a, b, c = xyz[list(t)]
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) > 1e-12:
            n /= np.linalg.norm(n)
            k = int((np.abs((xyz - a) @ n) <= K.PLANE_THRESHOLD).sum())
            if k > best:
                best, want = k, i
    assert (fit.n_inliers, fit.iteration) == (best, want)
    got = C.object_points(pts, ["view"])
    assert {r.ord for r in got.collect()} == set(range(len(plane), len(plane) + len(body)))
    planes = spark.createDataFrame([(1, fit.plane)], "view int, plane array<double>")
    assert C.plane_valid(pts, planes, ["view"]).first().reason is None
    moved = pts.withColumn("y", F.col("y") + 0.35)
    assert C.plane_valid(moved, planes, ["view"]).first().reason == "near_plane_inlier_count_too_low"
    tilted = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "view int, plane array<double>")
    assert C.plane_valid(pts, tilted, ["view"]).first().reason == "plane_normal_orientation_invalid"
    assert rng is not None


def test_stride_sample_takes_the_truncated_places(spark):
    got = sorted(r.ord for r in C.stride_sample(cloud(spark, [(i, 0, 0) for i in range(100)]), ["view"], 7).collect())
    assert got == [int(i * 99 / 6) for i in range(7)]


def fold(records):
    """Plain form of the choice of clusters: (component, n, low, high, mean_x)."""
    half, out, good = K.ROI_HALF_WIDTH, {}, []
    for c, n, lo, hi, mx in records:
        if abs(mx) > K.CENTRAL_LIMIT * half:
            out[c] = "centroid_outside_expected_object_zone"
        elif max(h - w for h, w in zip(hi, lo, strict=True)) > K.MAX_SPAN:
            out[c] = "physically_implausible_span"
        else:
            good.append((n / (1 + abs(mx) / half), c, n, lo, hi))
    good.sort(key=lambda g: (-g[2], g[1]))
    if not good:
        return out
    p = max(good, key=lambda g: g[0])
    lo, hi = list(p[3]), list(p[4])
    for _, c, n, a, b in good:
        if c == p[1]:
            out[c] = "primary"
            continue
        gap = sum(max(0, w - y, x - h) ** 2 for w, h, x, y in zip(lo, hi, a, b, strict=True)) ** 0.5
        ul, uh = [min(x, y) for x, y in zip(lo, a, strict=True)], [max(x, y) for x, y in zip(hi, b, strict=True)]
        if n > K.FRAGMENT_RATIO * p[2]:
            out[c] = "large_separate_cluster"
        elif gap > K.MERGE_GAP:
            out[c] = "fragment_too_far_from_primary"
        elif max(h - w for h, w in zip(uh, ul, strict=True)) > K.MAX_SPAN:
            out[c] = "merge_would_make_bounds_implausible"
        else:
            out[c], lo, hi = "merged", ul, uh
    return out


def test_selection_follows_the_plain_fold(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for view in range(30):
        records = []
        for c in range(int(rng.integers(1, 9))):
            at, size = rng.uniform(-0.4, 0.4, 3), rng.uniform(0.01, 0.3, 3) * (8 if rng.random() < 0.1 else 1)
            records.append((c, int(rng.integers(30, 400)), (at - size / 2).tolist(), (at + size / 2).tolist(), float(at[0])))
        want |= {(view, c): f for c, f in fold(records).items()}
        rows += [(view, c, n, mx, *lo, *hi) for c, n, lo, hi, mx in records]
    df = spark.createDataFrame(rows, "view int, component long, n_points long, mean_x double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    assert {(r["view"], r.component): r.fate for r in C.select_clusters(df, ["view"]).collect()} == want


def test_components_and_density_clusters(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 5, 5), (1, 5, 6)], "view int, row long, col long")
    assert C.mask_components(cells, ["view"]).first().n_components == 3
    joined = C.connected_cells(cells, ["view"], ["row", "col"])
    assert {(r.row, r.col): r.component for r in joined.collect()} == {(0, 0): 0, (1, 1): 0, (5, 5): 1, (5, 6): 1}
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 0.01, (60, 3)), rng.normal(1, 0.01, (40, 3)), [[5, 5, 5]]])
    got = [r.cluster for r in C.density_clusters(cloud(spark, pts), ["view"]).orderBy("ord").collect()]
    assert len(set(got[:60])) == 1 and len(set(got[60:100])) == 1 and got[0] != got[60] and got[100] == -1
    kept = C.largest_cluster(cloud(spark, pts), ["view"])
    assert kept.count() == 60 and kept.first().largest_cluster_ratio == pytest.approx(60 / 101)


def test_reprojection_and_pixel_maps(spark):
    pts = cloud(spark, [(0.0, 0.0, 1.0), (0.5, 0.0, 1.0), (9.0, 0.0, 1.0), (0.0, 0.0, -1.0)])
    ten = F.lit(10.0)
    seen = P.reproject(pts, fx=ten, fy=ten, cx=F.lit(5.0), cy=F.lit(5.0), width=12, height=12)
    assert {(r.ord, r.px_row, r.px_col) for r in seen.collect()} == {(0, 5, 5), (1, 5, 10)}
    check = P.pixel_map_check(seen.unionByName(seen), ["view"], F.lit(12), F.lit(12)).first()
    assert (check.n_points, check.n_repeated, check.n_outside) == (4, 2, 0)


def table_and_object(seed):
    """A flat table of 20 % of the points beside a box full of points."""
    rng = np.random.default_rng(seed)
    table = np.column_stack([rng.uniform(-0.25, 0.25, 300), np.full(300, 0.3), rng.uniform(0.5, 0.9, 300)])
    box = np.column_stack([rng.uniform(-0.25, 0.25, 1200), rng.uniform(-0.3, 0.28, 1200), rng.uniform(0.5, 0.9, 1200)])
    return np.concatenate([table, box])


def test_fallback_finds_a_table_of_a_fifth_of_the_points(spark, monkeypatch):
    fits, fit = [], C.fit_plane
    monkeypatch.setattr(C, "fit_plane", lambda *args: fits.append(fit(*args)) or fits[-1])
    M.measure_object(cloud(spark, table_and_object(1)), ["view"])
    plane = fits[0].first()  # none of the first 160 draws lies on the table
    assert abs(plane.plane[1]) > 0.99 and abs(abs(plane.plane[3]) - 0.3) < 0.01


def test_stride_sample_loses_no_place_to_rounding(spark):
    got = sorted(r.ord for r in C.stride_sample(cloud(spark, [(i, 0, 0) for i in range(170)]), ["view"], 40).collect())
    assert got == [int(j * (169 / 39)) for j in range(40)]


def test_triples_and_planes_are_not_broadcast(spark, tmp_path):
    cloud(spark, np.random.default_rng(3).uniform(size=(60, 3))).write.parquet(str(tmp_path / "points"))
    pts = spark.read.parquet(str(tmp_path / "points"))
    fit = C.fit_plane(pts, ["view"], C.draw_table(pts, ["view"]))
    assert "Broadcast" not in fit._jdf.queryExecution().executedPlan().toString()
