"""Near-duplicate embeddings: a small-world graph per shard, every shard asked for every vector.

Equal vectors are one class with a number and a count. Classes are dealt to shards of
``shard_rows`` classes and ``shard_bytes`` of single precision at most on average; there
are at least ``least_shards``. A task builds the graph of its shard and audits it: sampled
vectors and noisy copies of them are searched, results are compared with the whole shard,
and the beam is doubled until the mean recall of either kind is ``least_recall``, matches
with itself aside (or the beam is the shard). Graphs lie in the shared folder. A search
task gets one graph and streams up to ``chunk_rows`` vectors past it, so a graph is copied
once for each so many vectors and a vector once for each shard, in single precision.

What searches find, with a margin for single precision, leaves as spanning forests and
bounds who can be linked. Inside a component all cosines are then taken in double
precision, in blocks of ``block_rows`` vectors at most: links are counted for both ends, so counts
are symmetric, and what leaves is a count for each vector and a spanning forest, never the
pairs. A member is repeated once for each block of its own component. Components of the
confirmed links are the result.

Asking every shard costs (rows x shards): shards grow with the input only once they are
full, and the cost of one search with the logarithm of a shard.

Defined results: a null vector, a zero one, one with null or non-finite components and an
empty one link with nothing; vectors of different lengths never link; a cosine that
double precision gives as ``least`` or more links; repeated rows and equal vectors link with each other;
a null id never wins a component; an empty table gives no rows; only the two named columns
are read, so extra columns with clashing names change nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.graph import attach, components
from spanforge.llm.hnsw import Hnsw
from spanforge.llm.minhash import _sides, block_pairs, groups, shares
from spanforge.llm.storage import discard, materialise, with_clear_names

CHECKED = "vec_id long, n1 long, n2 long, dim int, raw binary"
#: Vectors searched or compared at once.
STEP = 512


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, raws = [], []
        for v in batch.column(1).to_pylist():
            x = None if not v or None in v else np.array(v, dtype=np.float64)
            good = x is not None and np.isfinite(x).all() and x.any()
            raws.append((x + 0.0).tobytes() if good else None)  # no negative zeros
            digests.append(xxhash.xxh3_128_digest(raws[-1] or b""))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        dims = pa.array([None if r is None else len(r) // 8 for r in raws], pa.int32())
        yield pa.record_batch([batch.column(0), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), dims, pa.array(raws, pa.binary())], names=["vec_id", "n1", "n2", "dim", "raw"])


def unit(raws: list[bytes]) -> np.ndarray:
    """Rows of length 1 in double precision, whatever their magnitude."""
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in single precision for the graphs."""
    for batch in batches:
        short = [unit([r])[0].astype(np.float32).tobytes() for r in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(short, pa.binary())], names=["cid", "dim", "v"])


def _stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def audited(x: np.ndarray, least: float, least_recall: float, seed: int = 9) -> tuple[Hnsw, int]:
    """The graph of ``x`` and the beam under which it passes its audit, for sampled vectors and for noisy copies."""
    graph = Hnsw(x)
    rng = np.random.default_rng(seed)
    own = rng.permutation(len(x))[:128]
    some = x[own].astype(np.float64)
    noise = rng.normal(size=some.shape)
    noise -= (noise * some).sum(axis=1, keepdims=True) * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    near = min(1.0, least + 0.3 * (1 - least))
    kinds = (some, near * some + np.sqrt(1 - near**2) * noise)
    true = [q @ x.T >= least for q in kinds]
    true[0][np.arange(len(own)), own] = False
    beam = 32
    while beam < len(x):
        passed = True
        for q, t in zip(kinds, true, strict=True):
            shares = [t[i, r].sum() / t[i].sum() for i, r in enumerate(graph.within(q, least, beam)) if t[i].any()]
            passed &= not shares or float(np.mean(shares)) >= least_recall
        if passed:
            break
        beam *= 2
    return graph, beam


def _build(least: float, least_recall: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("cid").combine_chunks()
        graph, beam = audited(_stacked(table["v"].chunk(0)), least, least_recall)
        blob = pickle.dumps({"layers": graph.layers, "entry": graph.entry, "beam": beam, "x": graph.x, "cid": table["cid"].to_numpy()}, protocol=5)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "graph": pa.array([blob], pa.large_binary()).cast(pa.binary())})

    return run


def merged(tree: np.ndarray, nodes: np.ndarray) -> None:
    """Make the trees of ``nodes`` one, in place; a tree is named by its least node."""
    own = tree[nodes]
    if len(own) and (own != own[0]).any():
        own = np.unique(own)
        tree[np.isin(tree, own)] = own[0]


def _edges(a, b, links=None) -> pa.RecordBatch:
    n = len(a)
    return pa.record_batch([pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(np.zeros(n, np.int64) if links is None else links, pa.int64())], names=["a", "b", "links"])


class _Shard:
    """A graph under search, and the trees of its nodes that the vectors so far have joined."""

    def __init__(self, blob: bytes):
        g = pickle.loads(blob)
        self.graph = Hnsw.__new__(Hnsw)
        self.graph.x, self.graph.layers, self.graph.entry = g["x"], g["layers"], g["entry"]
        self.cid, self.beam = g["cid"], g["beam"]
        self.tree = np.arange(len(self.cid))

    def ask(self, cid: np.ndarray, q: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(q), STEP):
            a, b = [], []
            for c, hits in zip(cid[at : at + STEP].tolist(), self.graph.within(q[at : at + STEP], least, self.beam), strict=True):
                hits = hits[self.cid[hits] != c]
                if len(hits):
                    merged(self.tree, hits)
                    a.append(c)
                    b.append(int(self.cid[hits[0]]))
            yield _edges(a, b)

    def close(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.tree != np.arange(len(self.tree)))
        return _edges(self.cid[self.tree[at]], self.cid[at])


def _search(least: float):
    """Rows come as task, dim, kind (0: a graph, 1: a vector), cid and value, in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, None
        for batch in batches:
            task, dim, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(task, prepend=-1) != 0) | (np.diff(dim, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
                if kind[a] == 0:
                    if shard:
                        yield shard.close()
                    shard, of = _Shard(batch.column(4)[a].as_py()), (task[a], dim[a])
                elif of == (task[a], dim[a]):  # no shard has vectors of this length otherwise
                    yield from shard.ask(batch.column(3).to_numpy()[a:b], _stacked(batch.column(4).slice(a, b - a)), least)
        if shard:
            yield shard.close()

    return run


def _confirm(least: float):
    """Counts of links (a, null, links) and spanning edges (a, b, 0) of sorted groups (key, i, j, side, cid, (copies, raw))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            if g.num_rows < 2:
                continue
            cid, copies = g.column(4).to_numpy(), g.column(5).field("copies").to_numpy()
            x = unit(g.column(5).field("raw").to_pylist())
            left, right = _sides(g.column(3).to_numpy())
            within = len(left) == len(right) and (left == right).all()
            links, tree = np.zeros(len(cid), np.int64), np.arange(len(cid))
            for at in range(0, len(left), STEP):
                rows = left[at : at + STEP]
                near = x[rows] @ x[right].T >= least
                if within:
                    near[np.arange(len(rows)), at + np.arange(len(rows))] = False
                links[rows] += near @ copies[right]
                if not within:
                    links[right] += copies[rows] @ near
                for i, hits in zip(rows.tolist(), near, strict=True):
                    if hits.any():
                        merged(tree, np.append(right[hits], i))
            some = np.flatnonzero(links)
            yield _edges(cid[some], None, links[some])
            moved = np.flatnonzero(tree != np.arange(len(tree)))
            yield _edges(cid[tree[moved]], cid[moved])

    return run


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, shard_rows: int = 100_000, shard_bytes: int = 64 << 20, least_shards: int = 3, chunk_rows: int = 500_000, block_rows: int = 8192, least_recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    own = with_clear_names(rows, {"vec_id": id_col, "vector": vector_col}).select("vec_id", F.col("vector").cast("array<double>"))
    checked = materialise(own.mapInArrow(_checked, CHECKED), "vectors")
    good = checked.filter("raw is not null")
    of_class = [F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")]
    classes = materialise(good.groupBy("n1", "n2", "dim").agg(*of_class).withColumn("cid", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dim").cast("long") * 4).alias("bytes")).first()
    shards, chunks = max(least_shards, -(-size["n"] // shard_rows), -(-(size["bytes"] or 0) // shard_bytes)), max(1, -(-size["n"] // chunk_rows))

    single = classes.select("cid", "dim", "raw").mapInArrow(_single, "cid long, dim int, v binary")
    dealt = single.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int"))
    graphs = materialise(dealt.groupBy("dim", "shard").applyInArrow(_build(least, least_recall), "dim int, shard int, graph binary"), "graphs")
    shard, chunk = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    asked = single.select("*", shard.alias("shard"), F.pmod(F.xxhash64("cid", F.lit("chunk")), F.lit(chunks)).cast("int").alias("chunk"))
    task = (F.col("shard") * chunks + F.col("chunk")).cast("int").alias("task")
    stream = asked.select(task, "dim", F.lit(1).alias("kind"), "cid", "v").unionAll(graphs.select("*", chunk.alias("chunk")).select(task, "dim", F.lit(0), F.lit(-1).cast("long"), "graph"))
    searched = stream.repartitionById(shards * chunks, "task").sortWithinPartitions("task", "dim", "kind").mapInArrow(_search(least), "a long, b long, links long")
    bounds = components(searched.select("a", "b"))

    known = classes.join(bounds.select(F.col("node").alias("cid"), F.col("root").alias("grp")), "cid").select("cid", "grp", F.struct("copies", "raw").alias("value"))
    sizes = known.groupBy("grp").agg(shares(F.count(F.lit(1)), block_rows).cast("int").alias("blocks"))
    pairs = block_pairs(attach(known, sizes, "grp"), "grp", "blocks", "value")
    found = materialise(pairs.mapInArrow(_confirm(least), "a long, b long, links long"), "links")
    discard(bounds, graphs)

    counts = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    linked = components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("cid"), "root")
    of_class = classes.select("cid", "n1", "n2", "least_id", "copies").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    roots = of_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    node = F.struct("n1", "n2").alias("node")
    facts = attach(of_class, roots, "root").join(counts, "cid", "left").select(node, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = attach(good.select("vec_id", node), facts, "node").select("vec_id", "n_links", "component_id")
    alone = checked.filter("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_hnsw(spark, sf_dir: str) -> DataFrame:
    """All vectors, links from a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
