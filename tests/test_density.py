"""Tiled components, density clusters and quantiles against plain forms."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators import density as D
from spanforge.operators import points as P


def plain_labels(cells, touch):
    cells = [tuple(c) for c in cells]
    parent = {c: c for c in cells}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in cells:
        for b in cells:
            if touch(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    roots = sorted({find(c) for c in cells})
    return {c: roots.index(find(c)) for c in cells}


def plain_density(x, eps, least):
    """Core flags and clusters by all pairs; clusters numbered by their least core points."""
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (far <= eps).sum(axis=1) >= least
    rows = [tuple(r) for r in x]
    member = plain_labels([r for r, c in zip(rows, core, strict=True) if c], lambda a, b: np.sqrt(sum((p - q) ** 2 for p, q in zip(a, b, strict=True))) <= eps)
    out = []
    for i, r in enumerate(rows):
        near = [(far[i, j], rows[j]) for j in np.flatnonzero(core) if far[i, j] <= eps]
        out.append(member[r] if core[i] else member[min(near)[1]] if near else -1)
    return core, out


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(*[st.integers(-3, 4)] * 2), max_size=25), st.booleans())
def test_cells_of_a_tile(cells, diagonal):
    cells = sorted(cells)
    got = D.cell_labels(np.array(cells, dtype=np.int64).reshape(-1, 2), diagonal)
    steps = (lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1) if diagonal else (lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1)
    want = plain_labels(cells, steps)
    assert {c: want[cells[g]] for c, g in zip(cells, got.tolist(), strict=True)} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 70), st.sampled_from([0.05, 0.2, 0.6]), st.integers(1, 6))
def test_points_of_a_tile(seed, n, eps, least):
    x = np.unique(np.random.default_rng(seed).uniform(-0.5, 0.5, (n, 3)).round(2), axis=0)
    core, want = plain_density(x, eps, least)
    grid = D.Grid(x, eps)
    assert (grid.cores(np.ones(len(x)), least) == core).all()
    for flags, label, nearest in ((core, *grid.clusters(core)), D.dense_clusters(x, np.ones(len(x)), eps, least)):
        label[nearest >= 0] = label[nearest[nearest >= 0]]
        assert (flags == core).all()
        assert [len({w for w, g in zip(want, label, strict=True) if g == k}) for k in set(label.tolist())] == [1] * len(set(label.tolist()))
        assert ((label < 0) == (np.array(want) < 0)).all() and len(set(label.tolist())) == len(set(want))


def test_tiles_join_what_lies_in_several(spark):
    ring = [(1, 5 * i, 0) for i in range(9)] + [(2, 0, 0), (2, 1, 1), (2, 9, 9)]
    snake = [(1, x, y) for y in range(0, 40, 2) for x in range(40)] + [(1, 39 if y % 4 == 1 else 0, y) for y in range(1, 39, 2)]
    cells = spark.createDataFrame([(2, *r[1:]) for r in ring] + snake, "view int, row long, col long").repartition(5)
    got = {(r.view, r.row, r.col): r.component for r in D.connected_cells(cells, ["view"], ["row", "col"], diagonal=False, tile=8, few=10).collect()}
    assert {v for k, v in got.items() if k[0] == 1} == {0}
    want = plain_labels([r[1:] for r in ring], lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1)
    assert {k[1:]: v for k, v in got.items() if k[0] == 2} == want


def test_density_clusters_of_a_view_of_many_tiles(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.stack([np.linspace(-1, 1, 400), rng.normal(0, 0.01, 400), rng.normal(0, 0.01, 400)], 1), rng.uniform(-1, 1, (150, 3)), np.repeat([[0.9, 0.9, 0.9]], 8, axis=0)]).round(3)
    rows = [(1, *map(float, r), i) for i, r in enumerate(x)] + [(2, 0.0, 0.0, 0.0, 1), (2, None, 0.0, 0.0, 2), (2, float("nan"), 0.0, 0.0, 3)]
    df = spark.createDataFrame(rows, "view int, x double, y double, z double, cluster_no long").repartition(4)
    out = D.density_clusters(df, ["view"], 0.05, 8, tile=3, few=10)
    assert out.columns == [*df.columns, "is_core", "cluster"]
    got = {(r.view, r.cluster_no): (r.is_core, r.cluster) for r in out.collect()}
    core, want = plain_density_with_copies(x, 0.05, 8)
    assert [got[1, i] for i in range(len(x))] == list(zip(core, want, strict=True))
    assert [got[2, i] for i in (1, 2, 3)] == [(False, -1)] * 3 and len(got) == len(rows)


def plain_density_with_copies(x, eps, least):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (far <= eps).sum(axis=1) >= least
    once, at = np.unique(x, axis=0, return_inverse=True)
    flags = np.zeros(len(once), dtype=bool)
    flags[at] = core
    gap = np.sqrt(((once[:, None] - once[None]) ** 2).sum(axis=2))
    label, n = np.full(len(once), -1), 0
    for i in np.flatnonzero(flags):
        if label[i] < 0:
            label[i], todo = n, [i]
            while todo:
                k = todo.pop()
                for j in np.flatnonzero((gap[k] <= eps) & flags & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~flags):
        near = [(gap[i, j], tuple(once[j]), j) for j in np.flatnonzero(flags) if gap[i, j] <= eps]
        if near:
            label[i] = label[min(near)[2]]
    return core.tolist(), label[at.reshape(-1)].tolist()


@pytest.mark.parametrize("most", [20, 1 << 17])
def test_quantiles_of_any_distribution(spark, most):
    rng = np.random.default_rng(8)
    groups = {"outlier": np.append(rng.uniform(0, 1, 5000), 1e12), "ties": np.repeat([3.0, 4.0], 1500), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "wide": 10 ** rng.uniform(-9, 9, 3000)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    shares = [0.0, 0.01, 0.5, 0.999, 1.0]
    got = {r.g: r for r in P.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", shares, most).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert (got[g].n, got[g].low, got[g].high) == (len(vs), vs.min(), vs.max())
        assert got[g].q == pytest.approx([float(np.quantile(vs, s)) for s in shares], rel=1e-12)


def test_a_sketch_that_misses_costs_a_pass_not_the_result(spark, monkeypatch):
    monkeypatch.setattr(P.F, "percentile_approx", lambda c, shares, accuracy: P.F.transform(shares, lambda s: P.F.max(c)))
    values = [float(v) for v in range(500)]
    got = P.quantiles(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v", [0.25, 0.5]).first()
    assert got.q == [124.75, 249.5]
