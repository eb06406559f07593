"""Ball k-means against the plain loop over all centroids, in Python integers."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm.balls import OP13_SQL, Balls, cluster_vectors, integers, op13_balls

SCHEMA = "vec_id long, embedding array<double>, cluster string, q int, distance string"


def plain_clusters(rows, k, rounds, dims, scale=256, seed=2):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) of kept rows, a vector at a time."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z", np.array(q, "<i4").tobytes(), q) for i, q in kept)
    centres = [q for *_, q in first[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        for j in range(len(centres)):
            members = [q for (_, q), c in zip(kept, own, strict=True) if c == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    last = [nearest(q) for _, q in kept]
    inertia = {j: sum(d for d, c in last if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i or -1, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, last, strict=True))


def result(df):
    return sorted((r.vec_id or -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(0, 60), st.sampled_from([2, 9, 300]))
def test_assignment_equals_comparing_with_all(seed, k, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread + 1, (k, 3))
    q = rng.integers(-spread, spread + 1, (n, 3)).astype(np.int32)
    label, distance = Balls(centres).assign(q, rng.integers(0, k, n).astype(np.int32))
    every = ((q[:, None].astype(np.int64) - centres[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_large_components_stay_exact():
    centres = np.array([[2**26 - 1, 0], [-(2**26) + 1, 1], [2**26 - 2, 0]])
    q = np.array([[2**26 - 1, 1], [2**26 - 2, 1], [-(2**26) + 1, 0]], dtype=np.int32)
    label, distance = Balls(centres).assign(q, np.zeros(3, np.int32))
    assert label.tolist() == [0, 2, 1] and distance.tolist() == [1, 1, 1]


def test_balls_save_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (40, 8))
    near = rng.integers(0, 40, 4000).astype(np.int32)
    q = (centres[near] + rng.integers(-40, 41, (4000, 8))).astype(np.int32)
    balls = Balls(centres)
    label, _ = balls.assign(q, near)
    assert (label == near).all() and balls.compared == len(q)  # all in their stable cores


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, None, 2.0, 3.0]), (204, [1.0, float("nan"), 2.0, 3.0]), (205, [1.0, float("inf"), 2.0, 3.0]), (5, rows[5][1]), (5, rows[5][1]), (None, [0.5] * 4), (206, [0.0] * 4), (207, [0.0] * 4)]
    docs = spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA).repartition(3)
    assert result(cluster_vectors(docs, k=7, dims=4)) == plain_clusters(rows, 7, 5, 4)
    assert result(cluster_vectors(docs.repartition(1), k=7, dims=4)) == plain_clusters(rows, 7, 5, 4)
    few = docs.filter("vec_id < 3")
    assert result(cluster_vectors(few, k=7, dims=4)) == plain_clusters(rows[:3], 7, 5, 4)
    huge = [(1, [2.0**21] + [0.0] * 3), (2, [1.0] * 4), (3, [-(2.0**20)] * 3 + [3.0]), (4, [1e300] * 4), (5, [2.0**20.9, 0.0, -1.0, 2.0])]
    got = result(cluster_vectors(spark.createDataFrame([(i, v, "x", 1, None) for i, v in huge], SCHEMA), k=3, dims=4))
    assert [r[0] for r in got] == [2, 3, 5] and got == plain_clusters([huge[1], huge[2], huge[4]], 3, 5, 4)
    nothing = cluster_vectors(docs.filter("false"), k=7, dims=4)
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_a_third_of_all_rows_equal(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [0.25, -0.5, 0.125]) for i in range(100)] + [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(200)]
    docs = spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA)
    assert result(cluster_vectors(docs, k=9, dims=3)) == plain_clusters(rows, 9, 5, 3)


def test_integers_floor_below_zero():
    import pyarrow as pa

    rows, q = integers(pa.array([[-0.001, 0.001], None, [1.0], [None, 1.0]], pa.list_(pa.float64())), 2, 256)
    assert rows.tolist() == [0] and q.tolist() == [[-1, 0]]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    sf = f"/root/testdata/{size}"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    got, want = op13_balls(spark, sf), duckdb.sql(OP13_SQL)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
