"""Ball k-means over vectors of integers: neighbours by radii, a stable core, annuli.

Components become integers, so every distance and every comparison is exact. A cluster is
a ball: its centroid and the greatest distance of a member. Another centroid can only
win a member when it is a neighbour, that is within twice the radius, and it can only win
members outside half of the way to it: those inside half of the way to the nearest
neighbour are the stable core and are compared with nothing; the rest lie in annuli
between the halves of the ways to the neighbours in rising order, and a member of the m-th
annulus is compared with the first m neighbours, no others. Members exactly at half of the
way may tie, so they belong to the annulus outside. A batch of a task takes the ball of its own
members, which is inside the cluster's. At first all vectors are members of centroid 0.

A round reads the table of members once and writes it with its new clusters, then sums
each cluster by task (at most ``k`` rows leave each) and over the tasks. The driver holds the
centroids (``k`` times ``dims`` integers, both parameters), which go to the tasks with the
code. One table and its successor lie in the shared folder at a time, so a lost executor
repeats its own part of one step. No group is gathered anywhere, so a cluster of any share
of the rows is like any other.

Defined results: a vector that is null, has another number of components, or null or
non-finite ones, is left out, and so is one of length 2**29 / ``scale`` or more, whose
squared distances no long can hold; repeated rows are members each for itself; ties of
distance go to the smaller number; a vector without an id starts a centroid only where
ids run out, and equal ids go by their components; fewer vectors than ``k`` make fewer centroids;
a centroid without members stays where it is; sums of distances beyond a long are null; an empty
table gives no rows; only the two named columns are read, so extra columns with clashing names
change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import discard, materialise, with_clear_names

MEMBERS = "vec_id long, q binary, cluster int, distance long"
CLUSTERED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
#: Squared length that integer vectors stay below, so that four times a squared distance fits a long.
MOST = 1 << 58


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are kept, and their components as floor(scale * x)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims) * scale)  # nulls are not a number here
    with np.errstate(invalid="ignore", over="ignore"):
        good = np.einsum("nd,nd->n", x, x) < MOST
    return rows[good], x[good].astype(np.int32)


def _binary(q: np.ndarray) -> pa.Array:
    width = q.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(np.ascontiguousarray(q, dtype="<i4").tobytes())]).cast(pa.binary())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), dims)


def _quantise(dims: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, q = integers(batch.column(1), dims, scale)
            if len(rows):
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), _binary(q), pa.array(np.zeros(len(rows), np.int32)), pa.array(np.zeros(len(rows), np.int64))], names=["vec_id", "q", "cluster", "distance"])

    return run


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid, or to one for each row."""
    gap = x.astype(np.int64) - centre
    if len(gap) and int(np.abs(gap).max()) ** 2 * gap.shape[1] < 1 << 53:
        gap = gap.astype(np.float64)  # all sums are whole numbers that doubles hold
    return np.einsum("nd,nd->n", gap, gap).astype(np.int64)


class Balls:
    """Centroids with the ways between them."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        gaps = np.array([squared(centres, c) for c in centres])
        np.fill_diagonal(gaps, -1)  # itself comes first
        self.order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        #: Distances taken so far, for whoever wants to know what the balls save.
        self.compared = 0

    def assign(self, q: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row and its squared distance, from the clusters that the rows were in."""
        label = cluster.astype(np.int64)
        best = squared(q, self.centres[label])
        self.compared += len(q)
        for i in np.unique(cluster).tolist():
            rows = np.flatnonzero(cluster == i)
            far = 4 * best[rows]
            n_neighbours = int(np.searchsorted(self.gaps[i], far.max(), side="right"))
            if not n_neighbours:
                continue  # no centroid within twice the radius
            annulus = np.searchsorted(self.gaps[i, :n_neighbours], far, side="right")
            outermost = np.argsort(-annulus, kind="stable")
            rows = rows[outermost]
            reached = len(rows) - np.searchsorted(annulus[outermost[::-1]], np.arange(n_neighbours), side="right")
            for j, n in zip(self.order[i, :n_neighbours].tolist(), reached.tolist(), strict=True):
                outer = rows[:n]
                distance = squared(q[outer], self.centres[j])
                self.compared += n
                wins = (distance < best[outer]) | ((distance == best[outer]) & (j < label[outer]))
                best[outer[wins]], label[outer[wins]] = distance[wins], j
        return label.astype(np.int32), best


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(centres)
        for batch in batches:
            if batch.num_rows:
                label, distance = balls.assign(_matrix(batch.column(1), centres.shape[1]), batch.column(2).to_numpy())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(label), pa.array(distance)], names=["vec_id", "q", "cluster", "distance"])

    return run


def _sums(k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy()
            order = np.argsort(label, kind="stable")
            found, first, n = np.unique(label[order], return_index=True, return_counts=True)
            if len(found):
                total[found] += np.add.reduceat(_matrix(batch.column(1), dims)[order].astype(np.int64), first, axis=0)
                count[found] += n
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def moved(members: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids at the exact floor of the mean of their members; those without any stay."""
    k, dims = centres.shape
    parts = members.select("cluster", "q").mapInArrow(_sums(k, dims), "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in sums.collect():  # k * dims rows at most
        out[r.cluster, r.i] = r.x // r.n
    return out


def _digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centre.tolist())).encode()).hexdigest()


def start_centroids(members: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors with the ``k`` least digests of their seeded ids, in rising order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = members.select(digest.alias("digest"), "q").orderBy(F.col("digest").asc_nulls_last(), "q").limit(k).collect()
    return np.array([np.frombuffer(r.q, dtype="<i4") for r in rows], dtype=np.int64).reshape(len(rows), dims)


def cluster_vectors(vectors: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per kept vector: cluster, squared distance, sums of distances over its cluster and over all, digest of its centroid."""
    spark = vectors.sparkSession
    own = with_clear_names(vectors, {"vec_id": id_col, "v": vector_col})
    ready = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    members = materialise(ready.mapInArrow(_quantise(dims, scale), MEMBERS), "vectors")
    centres = start_centroids(members, k, dims, seed)
    if not len(centres):
        return spark.createDataFrame([], CLUSTERED)
    for left in range(rounds, -1, -1):
        after = materialise(members.mapInArrow(_assign(centres), MEMBERS), "members")
        discard(members)
        members = after
        if left:
            centres = moved(members, centres)
    sums = {r.cluster: int(r.s) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}  # k rows at most
    whole = sum(sums.values())
    fits = lambda n: n if n < 1 << 63 else None
    facts = spark.createDataFrame([(c, fits(s), fits(whole), _digest(centres[c])) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_balls(spark, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT vec_id, min(d * 40 + c) AS m FROM (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL) GROUP BY vec_id),
s{r} AS (SELECT m % 40 AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.c, c.i, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} c LEFT JOIN s{r} s USING (c, i)),"""


OP13_SQL = f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM e),
c0 AS MATERIALIZED (SELECT c, i, x FROM h JOIN v USING (vec_id) WHERE c < 40),
{"".join(_round_sql(r) for r in range(5))}
a5 AS MATERIALIZED (SELECT vec_id, min(d * 40 + c) AS m FROM (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c5 c USING (i) GROUP BY ALL) GROUP BY vec_id),
p AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c),
o AS (SELECT vec_id, m % 40 AS c, m // 40 AS d FROM a5)
SELECT vec_id, o.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY o.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM o JOIN p ON p.c = o.c
"""
