"""The joint forest against a tree grown in plain Python."""

import numpy as np
import pytest

from spanforge.operators import forest as Fo

LABELS = ["u", "v"]


def plain_tree(bins, y, depth, least):
    """Mean of the leaf of each row: cuts by the summed squares, the least feature and bin on a tie."""
    out = np.zeros(y.shape)

    def grow(rows, level):
        best = None
        whole = (y[rows].sum(axis=0) ** 2).sum() / len(rows)
        for f in range(bins.shape[1]):
            for b in sorted(set(bins[rows, f])):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if len(left) >= least and len(right) >= least:
                    gain = (y[left].sum(axis=0) ** 2).sum() / len(left) + (y[right].sum(axis=0) ** 2).sum() / len(right) - whole
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
        if best is None or level == depth:
            out[rows] = y[rows].mean(axis=0)
        else:
            grow(best[1], level + 1)
            grow(best[2], level + 1)

    grow(np.arange(len(y)), 0)
    return out


def table(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, (n, 3)).round(2)
    y = np.stack([x[:, 0] * 2 + (x[:, 1] > 5) * 7, x[:, 2] - x[:, 0]], axis=1).round(2)
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, u double, v double")


def test_one_tree_equals_the_plain_one(spark):
    x, y, df = table(spark)
    edges = [[2.0, 4.0, 6.0, 8.0]] * 3
    forest = Fo.fit_forest(df, ["a", "b", "c"], LABELS, key="id", trees=1, depth=3, least=5, sampled=False, edges=edges)
    want = plain_tree(np.stack([np.searchsorted(edges[0], c, side="left") for c in x.T], axis=1), y, 3, 5)
    got = {r.id: (r.predicted_u, r.predicted_v) for r in Fo.predict(forest, df).collect()}
    assert np.array([got[i] for i in range(len(y))]) == pytest.approx(want, abs=1e-5)


def test_a_forest_is_the_same_however_its_rows_lie(spark, monkeypatch):
    x, y, df = table(spark)
    monkeypatch.setattr(Fo, "CELLS", 600)  # several passes a level
    one = Fo.fit_forest(df.repartition(5), ["a", "b", "c"], LABELS, key="id", trees=3, depth=3, bins=8)
    monkeypatch.setattr(Fo, "CELLS", 1 << 21)
    two = Fo.fit_forest(df.coalesce(1), ["a", "b", "c"], LABELS, key="id", trees=3, depth=3, bins=8)
    assert one.cuts == two.cuts and one.values == two.values and one.cuts[0] != one.cuts[1]
    draws = Fo.bootstrap(np.arange(20_000), 2, 42)
    assert abs(draws.mean() - 1) < 0.03 and abs((draws == 0).mean() - np.exp(-1)) < 0.02


def test_answers_with_and_without_a_model(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0, True, True), (2, None, False, None)], "job_id long, a double, object_available boolean, geometry_trusted boolean")
    none = {r.job_id: r for r in Fo.answers(None, rows, path="/models/x").collect()}
    assert not none[1].model_available and none[1].predicted_box is None and none[1].warnings == ["ai2_model_missing: /models/x"]
    train = spark.createDataFrame([(i, float(i % 4), 1.0 + i % 4, 2.0, float("nan") if i == 9 else 3.0) for i in range(40)], "id long, a double, length_in double, width_in double, height_in double")
    forest = Fo.fit_forest(train.filter("not isnan(height_in)"), ["a"], ["length_in", "width_in", "height_in"], key="id", trees=2, depth=2, bins=4)
    Fo.save(forest, spark, str(tmp_path / "m"))
    got = {r.job_id: r for r in Fo.answers(Fo.load(spark, str(tmp_path / "m")), rows, path="").collect()}
    assert got[1].model_available and got[1].predicted_box.width_in == 2.0 and got[1].warnings == [] and got[1].feature_snapshot == {"a": 1.0}
    assert got[2].warnings == ["object_unavailable", "geometry_untrusted"] and got[2].feature_snapshot == {"a": None}
    empty = Fo.fit_forest(train.filter("false"), ["a"], ["length_in"], key="id", trees=2, depth=2, edges=[[1.0]])
    assert not Fo.answers(empty, rows, path="p").first().model_available
