"""A random forest for several outputs at once: level by level, from histograms, split by the summed variance.

Each level is a pass over the rows: a task adds weights and labels by tree, node, feature and bin,
sums are shuffled, and the best cut of each node is chosen in Spark. Labels are whole numbers of
2**-20 and bootstrap weights follow from a hash of the row's key, so all sums are exact and a forest is
the same however its rows lie. The driver holds the model: trees x 2**depth nodes at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import constants as K
from spanforge.sources.store import written

SCALE = 1 << 20
#: Cells of histograms that a task holds at once.
CELLS = 1 << 21


@dataclass
class Forest:
    """Cuts and values of heap-numbered nodes (root 1, children 2n and 2n + 1) of each tree."""

    features: list[str]
    labels: list[str]
    edges: list[np.ndarray]
    cuts: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    values: list[dict[int, list[float]]] = field(default_factory=list)

    def nodes(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins has come to; a bin up to the cut goes left."""
        at = np.ones(len(bins), dtype=np.int64)
        cuts = self.cuts[tree]
        for n in sorted(cuts):
            rows = np.flatnonzero(at == n)
            f, b = cuts[n]
            at[rows] = 2 * n + (bins[rows, f] > b)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        total = np.zeros((len(bins), len(self.labels)))
        for tree, values in enumerate(self.values):
            names = np.array(sorted(values))
            total += np.array([values[n] for n in names.tolist()])[np.searchsorted(names, self.nodes(tree, bins))]
        return total / max(1, len(self.values))


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cut points of each feature at about even depth; numbers that the driver keeps."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(f, shares, 100_000).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], dtype=np.float64)) for f in features]


def _bins(batch: pa.RecordBatch, first: int, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value; a missing value is below all."""
    columns = [np.nan_to_num(batch.column(first + i).to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf) for i in range(len(edges))]
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, columns, strict=True)], axis=1) if columns else np.zeros((batch.num_rows, 0), np.int64)


_POISSON = np.cumsum([np.exp(-1) / float(np.prod(range(1, k + 1))) for k in range(12)])


def bootstrap(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a row is drawn for a tree: a Poisson number from a hash of its key."""
    h = key.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(seed * 0xC2B2AE3D27D4EB4F % 2**64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / float(1 << 53), side="right")


def _histograms(forest: Forest, open_: dict[int, list[int]], sampled: bool, seed: int):
    n_f, n_l, width = len(forest.features), len(forest.labels), max([len(e) for e in forest.edges], default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((len(nodes), n_f, width, 1 + n_l), dtype=np.int64) for t, nodes in open_.items()}
        for batch in batches:
            key = batch.column(0).to_numpy()
            bins = _bins(batch, 1, forest.edges)
            y = np.stack([batch.column(1 + n_f + i).to_numpy() for i in range(n_l)], axis=1)
            for t, nodes in open_.items():
                place = np.full(max(nodes) + 1, -1)
                place[nodes] = np.arange(len(nodes))
                at = forest.nodes(t, bins)
                rows = np.flatnonzero((at < len(place)) & (place[np.minimum(at, len(place) - 1)] >= 0))
                w = bootstrap(key[rows], t, seed) if sampled else np.ones(len(rows), np.int64)
                cells = np.column_stack([w, w[:, None] * y[rows]])
                for f in range(n_f):
                    np.add.at(sums[t], (place[at[rows]], f, bins[rows, f]), cells)
        for t, nodes in open_.items():
            i, f, b = np.nonzero(sums[t][..., 0])
            found = sums[t][i, f, b]
            n = len(i)
            yield pa.record_batch([pa.array(np.full(n, t, np.int32)), pa.array(np.array(nodes, np.int64)[i]), pa.array(f.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(found[:, j]) for j in range(1 + n_l)]], names=["tree", "node", "feature", "bin", "w", *[f"s{j}" for j in range(n_l)]])

    return run


def best_cuts(cells: DataFrame, n_labels: int, least: int) -> DataFrame:
    """Per tree and node: weight and sums, and the cut (feature, bin) of the greatest gain, the least one on a tie; null where none gains."""
    names = ["w", *[f"s{j}" for j in range(n_labels)]]
    upto = Window.partitionBy("tree", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("tree", "node", "feature")
    both = cells.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l_{c}") for c in names], *[F.sum(c).over(whole).alias(f"a_{c}") for c in names])
    part = lambda s, w: sum(((F.col(c).cast("double") if isinstance(c, str) else c.cast("double")) ** 2 for c in s), F.lit(0.0)) / w.cast("double")
    left, right = F.col("l_w"), F.col("a_w") - F.col("l_w")
    gain = part([f"l_s{j}" for j in range(n_labels)], left) + part([F.col(f"a_s{j}") - F.col(f"l_s{j}") for j in range(n_labels)], right) - part([f"a_s{j}" for j in range(n_labels)], F.col("a_w"))
    scored = both.withColumn("gain", F.when((left >= least) & (right >= least), gain))
    order = F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"))
    good = F.when(F.col("gain") > 1e-6 * SCALE, order)
    return scored.groupBy("tree", "node").agg(*[F.max(f"a_{c}").alias(c) if c == "w" else F.first(f"a_{c}").alias(c) for c in names], F.max_by(F.struct("feature", "bin"), good).alias("cut"))


def fit_forest(rows: DataFrame, features: list[str], labels: list[str], *, key: str, trees: int = K.TREES, depth: int = 8, bins: int = 64, least: int = K.LEAST_SAMPLES, seed: int = K.FOREST_SEED, sampled: bool = True, edges: list[list[float]] | None = None) -> Forest:
    """One forest for all ``labels``; rows without one of them do not count. ``key`` tells rows apart and decides how often each tree draws them."""
    known = rows.dropna(subset=labels)
    forest = Forest(features, labels, [np.array(e, dtype=np.float64) for e in edges] if edges else bin_edges(known, features, bins), [{} for _ in range(trees)], [{} for _ in range(trees)])
    own = written(known.select(F.xxhash64(key).alias("k"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], *[F.round(F.col(y) * SCALE).cast("long").alias(f"y{i}") for i, y in enumerate(labels)]), "rows")
    n_l, width = len(labels), max([len(e) for e in forest.edges], default=0) + 1
    fields = "tree int, node long, feature int, bin int, " + ", ".join(f"{c} long" for c in ["w", *[f"s{j}" for j in range(n_l)]])
    todo = {t: [1] for t in range(trees)}
    for level in range(depth + 1):
        following: dict[int, list[int]] = {}
        for part in _parts(todo, len(features) * width * (1 + n_l)):
            cells = own.mapInArrow(_histograms(forest, part, sampled, seed), fields).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ["w", *[f"s{j}" for j in range(n_l)]]])
            for r in best_cuts(cells, n_l, least).collect():  # a row per open node of these trees
                forest.values[r.tree][r.node] = [r[f"s{j}"] / r.w / SCALE for j in range(n_l)]
                if r.cut is not None and level < depth:
                    following.setdefault(r.tree, []).extend((2 * r.node, 2 * r.node + 1))
                    forest.cuts[r.tree][r.node] = (r.cut.feature, r.cut.bin)
        todo = {t: sorted(n) for t, n in sorted(following.items())}
        if not todo:
            break
    return forest


def _parts(todo: dict[int, list[int]], cells_of_node: int) -> Iterator[dict[int, list[int]]]:
    """Open nodes in parts whose histograms fit a task."""
    part, held = {}, 0
    for tree, nodes in todo.items():
        step = max(1, CELLS // max(1, cells_of_node))
        for at in range(0, len(nodes), step):
            some = nodes[at : at + step]
            if part and held + len(some) * cells_of_node > CELLS:
                yield part
                part, held = {}, 0
            part.setdefault(tree, []).extend(some)
            held += len(some) * cells_of_node
    if part:
        yield part


def predict(forest: Forest, rows: DataFrame, prefix: str = "predicted_") -> DataFrame:
    """``rows`` with a prediction of each label."""
    first, shared = len(rows.columns), rows.sparkSession.sparkContext.broadcast(forest)
    names = [f"{prefix}{y}" for y in forest.labels]
    schema = rows.select("*", *[F.lit(0.0).cast("double").alias(n) for n in names]).schema
    ready = rows.select("*", *[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(forest.features)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.predict(_bins(batch, first, shared.value.edges))
            yield pa.record_batch([*batch.columns[:first], *[pa.array(out[:, j]) for j in range(len(names))]], names=schema.names)

    return ready.mapInArrow(run, schema)


def answers(forest: Forest | None, rows: DataFrame, *, path: str) -> DataFrame:
    """What a caller is told about each job: ``model_available``, ``predicted_box``, ``warnings`` and the ``feature_snapshot`` that the model saw.

    Without a model at ``path`` there is no box and a warning that says so. Sides that are no number are 0;
    a job whose object or geometry is not to be trusted is answered with a warning. ``rows`` may
    have object_available and geometry_trusted.
    """
    text, box = "array<string>", "struct<" + ", ".join(f"{y}: double" for y in K.LABEL_FIELDS) + ">"
    if forest is None or not any(forest.values):
        return rows.withColumns({"model_available": F.lit(False), "predicted_box": F.lit(None).cast(box), "warnings": F.array(F.lit(f"ai2_model_missing: {path}")), "feature_snapshot": F.lit(None).cast("map<string,double>")})
    told = [F.when(~F.coalesce(F.col(c), F.lit(False)), w) for c, w in (("object_available", "object_unavailable"), ("geometry_trusted", "geometry_untrusted")) if c in rows.columns]
    warnings = F.array_compact(F.array(*told)) if told else F.array().cast(text)
    sane = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    snapshot = F.create_map(*[x for f in forest.features for x in (F.lit(f), F.col(f).cast("double"))])
    sides = F.struct(*[sane(F.col(f"predicted_{y}")).alias(y) for y in forest.labels])
    return predict(forest, rows).withColumns({"model_available": F.lit(True), "predicted_box": sides, "warnings": warnings, "feature_snapshot": snapshot}).drop(*[f"predicted_{y}" for y in forest.labels])


def save(forest: Forest, spark, path: str) -> None:
    """The model as one JSON record in a folder."""
    body = {"features": forest.features, "labels": forest.labels, "edges": [e.tolist() for e in forest.edges], "cuts": forest.cuts, "values": forest.values}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark, path: str) -> Forest:
    body = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    whole = lambda trees, f: [{int(n): f(v) for n, v in t.items()} for t in trees]
    return Forest(body["features"], body["labels"], [np.array(e, dtype=np.float64) for e in body["edges"]], whole(body["cuts"], tuple), whole(body["values"], list))
