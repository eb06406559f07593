import math

import duckdb
import numpy as np
import pytest

from spanforge.llm.hnsw import Hnsw
from spanforge.llm.vectors import OP10_SQL, audited, near_vectors, op10_hnsw


def brute(rows, least=0.9):
    vectors = {}
    for i, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            vectors[i] = np.array(v, dtype=np.float64) / np.linalg.norm(v)
    links = {i: [j for j, b in vectors.items() if i != j and len(a) == len(b) and a @ b >= least] for i, a in vectors.items()}
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((name, len(links.get(i, [])), min(ids, default=None)))
    return out


def test_recall_of_the_graph():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x[1000:] = x[rng.integers(0, 30, 500)] + 0.1 * rng.normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, beam = audited(x, 0.9, 0.98)
    true = x @ x.T >= 0.9
    assert isinstance(graph, Hnsw) and beam <= 128
    assert sum(int(true[i, r].sum()) for i, r in enumerate(graph.within(x, 0.9, beam))) >= 0.98 * true.sum()


@pytest.mark.parametrize("n", [0, 1, 600])
def test_equals_brute_force(spark, n):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, 16)).tolist()
    group = (np.ones(16) + 0.2 * rng.normal(size=(n // 4, 16))).tolist()
    rows = [(i * 7 % 1009, v) for i, v in enumerate(base + group + base[: n // 10] + group[:30])]
    if n > 1:
        rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None]), (2004, [float("nan")] * 16), (2005, [1e300] * 16), (2006, [1.0] * 16), (2007, [1.0] * 3), (None, base[0]), (None, None), (2008, [float("inf")] * 16)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, links string")
    got = near_vectors(frame, chunk_rows=200).collect()
    want = [(a, b, c) for (a, b, c) in (brute([(i, [x / 1e290 for x in v] if v and v[0] == 1e300 else v) for i, v in rows]))]
    assert sorted(map(str, [(r.vec_id, r.n_links, r.component_id) for r in got])) == sorted(map(str, want))


def test_query_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    got = op10_hnsw(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(OP10_SQL).fetchall())
    assert got.columns == duckdb.sql(OP10_SQL).columns


@pytest.mark.parametrize("sizes", [{"block_rows": 40, "chunk_rows": 150, "least_shards": 5}, {"least_shards": 1}])
def test_large_cluster_in_blocks_counts_both_ends(spark, sizes):
    rng = np.random.default_rng(12)
    cluster = np.ones(16) + 0.33 * rng.normal(size=(300, 16))
    rows = list(enumerate([*cluster.tolist(), *rng.normal(size=(200, 16)).tolist(), *[[-0.0, 1.0], [0.0, 1.0], [1.0, 0.0]], *cluster[:5].tolist()]))
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **sizes).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows))
    assert sum(r.n_links for r in got) % 2 == 0


def test_the_edge_of_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9 + 1e-9, math.sqrt(1 - (0.9 + 1e-9) ** 2)]), (3, [0.9 - 1e-9, math.sqrt(1 - (0.9 - 1e-9) ** 2)]), (4, [-1.0, 0.0])]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert (got[2].n_links, got[3].n_links, got[4].n_links) == (2, 1, 0)


def test_of_new_links_back_the_most_similar_stay():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Hnsw(x, links=4)
    layer, node = graph.layers[0], 7
    layer[:] = -1
    batch = np.array([i for i in range(400) if i != node])
    graph._back_links(batch, np.full((len(batch), 1), node, dtype=np.int32), 0)
    best = batch[np.argsort(-(x[batch] @ x[node]))][: 3 * layer.shape[1]]
    kept = layer[node][layer[node] >= 0]
    assert best[0] in kept and set(kept.tolist()) <= set(best.tolist())


@pytest.mark.parametrize("least", [0.3, 0.45])
def test_vectors_that_do_link_equal_sql_and_recall_is_measured(spark, least):
    sf = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = duckdb.sql(OP10_SQL.replace("0.9", str(least))).fetchall()
    got = near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), least=least).collect()
    true = sum(r[1] for r in want)
    assert true > 10 and sum(r.n_links for r in got) >= 0.9 * true
    assert sum(tuple(r) in set(want) for r in got) >= 0.9 * len(want)
