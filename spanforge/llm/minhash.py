"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation gives two values of a signature, the least and the greatest hash, so
128 values cost 64 hash evaluations a shingle. Four values make a band, 32 bands a
signature: a pair of similarity 0.8 misses all bands with a chance of 5e-8.

Steps, the same at every size:
1. One pass over the texts: digests of the text and of its shingle set, band keys, a byte
   of each value. Rows of one set are one class with a number; from here on, classes are
   compared, not copies, and one row of each class stands for its text.
2. In each bucket of two classes or more, classes whose signature bytes agree enough (0.6
   of the values, over five deviations below 0.8) are linked.
3. Components of these links bound who can be linked at all.
4. Inside a component full sets are compared; components of the confirmed links are the
   result.

Steps 2 and 4 never list pairs. A bucket or component is cut into blocks of bounded size,
every pair of blocks is one unit of work, and what leaves is a spanning forest of the
pair. Within it, classes that are in one tree already are not compared again, so a large
group of near copies costs little more than one comparison for each member and block. A
member is repeated once for each block of its own group: members / 16,384 in step 2; in
step 4 shingles / a million or the root of members / 64, whichever is more, so that a
group of any size is many units of work. Nothing is capped.

Joins on keys that may be hot go through ``graph.attach``, so that adaptive execution can
split them; a partition under its threshold stays whole.

Defined results: texts without words have an empty set and stay alone; fewer words than a
shingle form one shingle; repeated rows fall into one class; a null doc_id never wins a
component (its class's least non-null id does; all null gives null and kept false); an
empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.graph import attach, components
from spanforge.llm.storage import discard, fresh, materialise, with_clear_names
from spanforge.llm.words import mixed, shingle_set

PERMUTATIONS = 64
ROWS = 4
SIGNED = "doc_id long, t1 long, t2 long, n_shingles long, n1 long, n2 long, sketch binary, keys array<long>"
#: Classes in a block of a bucket, and shingles in a block of a component.
BLOCK, BLOCK_SHINGLES = 16_384, 1_000_000
#: Up to so many rows are compared as one square.
SQUARE = 64
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation: 2 x PERMUTATIONS."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        h = shingles[None, at : at + 4096] * _FACTORS[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """A key per band: both values of two permutations and the band's number."""
    pairs = values.reshape(2, PERMUTATIONS // 2, 2).transpose(1, 0, 2).reshape(-1, ROWS)
    h = np.arange(len(pairs), dtype=np.uint64)
    for j in range(ROWS):
        h = mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + pairs[:, j])
    return h.view(np.int64)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, sketch, keys = [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), width)
                v = signature(s) if len(s) else None
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch.append(None if v is None else (mixed(v) >> np.uint64(56)).astype(np.uint8).tobytes())
                keys.append(None if v is None else band_keys(v))
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            columns = [pa.array(size, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch([*batch.columns[:3], *columns], names=["doc_id", "t1", "t2", "n_shingles", "n1", "n2", "sketch", "keys"])

    return run


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Row groups equal in the first ``by`` columns, of batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for i in range(by):
            c = batch.column(i)
            change |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
        held = [batch.slice(cuts[-1])]
    yield from held


class Forest:
    """Union-find over positions; ``edges`` of one spanning star per tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(*(x.tolist() for x in np.nonzero(mask)), strict=True):
            a, b = self.root(int(left[i])), self.root(int(right[j]))
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(self.root(i), i) for i in range(len(self.up)) if self.root(i) != i]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks to compare; a block against itself is one side twice."""
    if (side == 2).any():
        return np.flatnonzero(side == 2), np.flatnonzero(side == 2)
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def spanning(n: int, left: np.ndarray, right: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Least row of each row's tree under the links of ``left`` with ``right``; ``linked(i, rows)`` says which rows i links to.

    Rows already in the tree of i are not asked for, and a few are asked first: if i joins
    a large tree through them, what is left is short.
    """
    tree = np.arange(n)
    for i in left.tolist():
        rest = right[tree[right] != tree[i]]
        for part in (rest[:SQUARE], rest[SQUARE:]):
            part = part[tree[part] != tree[i]]
            hits = part[linked(i, part)] if len(part) else part
            if len(hits):
                own = np.unique(np.append(tree[hits], tree[i]))
                tree[np.isin(tree, own)] = own[0]
    return tree


def trees_of(matrix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for a whole matrix of links of a few rows."""
    forest = Forest(len(matrix))
    forest.link(matrix[np.ix_(left, right)], left, right)
    return np.array([forest.root(i) for i in range(len(matrix))])


def _forests(trees: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]):
    """Runs ``trees`` over sorted groups (key, i, j, side, cid, payload); edges (a, b) of a star for each tree leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            if g.num_rows > 1:
                cid = g.column(4).to_numpy()
                tree = trees(g, *_sides(g.column(3).to_numpy()))
                at = np.flatnonzero((tree != np.arange(len(tree))) & (cid[tree] != cid))
                if len(at):
                    yield pa.record_batch([pa.array(cid[tree[at]]), pa.array(cid[at])], names=["a", "b"])

    return run


def _sketch_trees(least: float):
    need = int(np.ceil(least * 2 * PERMUTATIONS))

    def trees(g: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = g.num_rows
        sketch = np.frombuffer(b"".join(g.column(5).to_pylist()), np.uint8).reshape(n, -1)
        if n <= SQUARE:
            return trees_of((sketch[:, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16) >= need, left, right)
        return spanning(n, left, right, lambda i, rows: (sketch[rows] == sketch[i]).sum(axis=1, dtype=np.int16) >= need)

    return trees


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of presence blocks over the shared shingles."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out, width = np.zeros((len(sets), len(sets))), 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, (at, at + width))
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[a:b], place[a:b] - at] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def _set_trees(percent: int):
    def trees(g: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = g.num_rows
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in g.column(5)]
        size = np.array([len(s) for s in sets])
        if n <= SQUARE and size.sum() <= BLOCK_SHINGLES:
            inter = common_counts(sets)
            return trees_of(100 * inter >= percent * (size[:, None] + size[None, :] - inter), left, right)
        place = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        first = np.concatenate(([0], np.cumsum(size)))
        marked = np.zeros(int(place.max()) + 1, dtype=bool)

        def linked(i: int, rows: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rows), dtype=bool)
            near = np.flatnonzero(100 * np.minimum(size[rows], size[i]) >= percent * np.maximum(size[rows], size[i]))
            own = place[first[i] : first[i + 1]]
            marked[own] = True
            for at in range(0, len(near), 1024):
                some = rows[near[at : at + 1024]]
                held = marked[np.concatenate([place[first[r] : first[r + 1]] for r in some.tolist()])]
                inter = np.add.reduceat(held, np.concatenate(([0], np.cumsum(size[some])[:-1])), dtype=np.int64)
                out[near[at : at + 1024]] = 100 * inter >= percent * (size[some] + size[i] - inter)
            marked[own] = False
            return out

        return spanning(n, left, right, linked)

    return trees


def _sets(width: int):
    """Shingle sets of the texts that stand for their classes; equal rows of a task give one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            first = []
            for c in batch.column(1).to_pylist():
                first.append(c not in seen)
                seen.add(c)
            batch = batch.filter(pa.array(first, pa.bool_()))
            sets = [shingle_set(text.as_py(), width).tobytes() for text in batch.column(0)]
            yield pa.record_batch([*batch.columns[1:], pa.array(sets, pa.binary())], names=["cid", "grp", "blocks", "shingles"])

    return run


def shares(n: Column, most: int) -> Column:
    """Blocks of a group of ``n``: as many as its root over eight, so that units of work grow more slowly than groups, and ``most`` rows at most in each."""
    return F.greatest(F.ceil(n / most), F.ceil(F.sqrt(n / 64.0)))


def block_pairs(rows: DataFrame, key: str, blocks: str, payload: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in, sorted by (key, i, j).

    ``side`` says of which block a row is: 2 where a block meets itself, else 0 or 1.
    """
    own = F.pmod(F.xxhash64("cid"), F.col(blocks)).cast("int")
    placed = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
    placed = placed.select(F.col(key), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "cid", F.col(payload))
    # a block that meets another also lies in the pair of that other one, so i = j holds one block only
    return placed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "cid", "side")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and 128 bits of the text, taken without Python."""
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col})
    return own.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")


def _row():
    """What tells a document from others: its id and its text. No field is null, and rows without an id come last."""
    return F.struct(F.isnull("doc_id").alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), "t1", "t2")


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int, least_estimate: float) -> tuple[DataFrame, DataFrame]:
    """(signed, linked): a row per document with its set's digest; the number of each class and the root of its component."""
    texts = _identified(docs, id_col, text_col)
    signed = materialise(texts.mapInArrow(_sign(width), SIGNED), "signed")
    of_class = [F.min("doc_id").alias("least_id"), F.min(_row()).alias("row"), F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")]
    classes = materialise(signed.filter("n_shingles > 0").groupBy("n1", "n2").agg(*of_class).withColumn("cid", F.monotonically_increasing_id()), "classes")

    keyed = classes.select(F.explode("keys").alias("key"), "cid")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = attach(keyed, buckets, "key").join(classes.select("cid", "sketch"), "cid")
    maybe = block_pairs(members, "key", "blocks", "sketch").mapInArrow(_forests(_sketch_trees(least_estimate)), "a long, b long")
    found = components(maybe)
    bounds = materialise(found, "bounds")
    discard(found)

    known = classes.join(bounds.select(F.col("node").alias("cid"), F.col("root").alias("grp")), "cid").select("cid", "grp", "row", "n_shingles")
    sizes = known.groupBy("grp").agg(F.greatest(shares(F.count(F.lit(1)), block), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    candidates = materialise(attach(known.select("cid", "grp", "row"), sizes, "grp"), "candidates")
    # a sort-merge join at every size: rows of a hot key can be split, and no candidate list is ever sent to all
    standing = attach(texts.select(_row().alias("row"), "text"), candidates.hint("merge"), "row").select("text", "cid", "grp", "blocks")
    sets = standing.mapInArrow(_sets(width), "cid long, grp long, blocks int, shingles binary")
    links = block_pairs(sets, "grp", "blocks", "shingles").mapInArrow(_forests(_set_trees(percent)), "a long, b long")
    found = components(links)
    roots = found.select(F.col("node").alias("cid"), "root")
    linked = materialise(classes.select("n1", "n2", "least_id", "row", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).drop("cid"), "linked")
    discard(found, classes, bounds, candidates)
    return signed, linked


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK, least_estimate: float = 0.6) -> DataFrame:
    """One row of each component with all its columns: the one of the least doc_id, without any id the one of the least text hash.

    A row is told by its doc_id and its text: rows that share both are one document and
    give one row, the least by the JSON text of all columns; rows that share only the id are told apart. Texts without words all stay.
    """
    signed, linked = _labelled(docs, id_col, text_col, width, percent, block, least_estimate)
    row, times, names = fresh("row_key", docs.columns), fresh("row_times", docs.columns), [f"`{c}`" for c in docs.columns]
    chosen = linked.groupBy("root").agg(F.min("row").alias("row")).select("row").unionByName(signed.filter("n_shingles = 0").select(_row().alias("row")).distinct())
    rows = signed.groupBy(_row().alias("row")).agg(F.count(F.lit(1)).alias("times"))
    kept = materialise(rows.join(chosen, "row").select(F.col("row").alias(row), F.col("times").alias(times)), "kept")
    discard(signed, linked)
    text = F.col(f"`{text_col}`")
    own_id = F.col(f"`{id_col}`")
    keyed = docs.withColumn(row, F.struct(F.isnull(own_id).alias("none"), F.coalesce(own_id, F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")))
    once = keyed.join(kept.filter(F.col(times) == 1).hint("merge"), row, "left_semi").select(*names)
    again = kept.filter(F.col(times) > 1)
    if again.isEmpty():
        return once
    whole, order = fresh("row_all", docs.columns), fresh("row_order", docs.columns)
    copies = keyed.join(again, row, "left_semi").select(row, F.struct(*names).alias(whole)).withColumn(order, F.to_json(F.struct(whole)))
    return once.unionByName(copies.groupBy(row).agg(F.min_by(whole, order).alias(whole)).select(f"{whole}.*"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK, least_estimate: float = 0.6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    signed, linked = _labelled(docs, id_col, text_col, width, percent, block, least_estimate)
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    node = F.struct("n1", "n2").alias("node")
    labels = attach(linked.select("root", node), least, "root").select("node", "component_id")
    full = attach(signed.filter("n_shingles > 0").select("doc_id", "n_shingles", node), labels, "node").select("doc_id", "n_shingles", "component_id")
    empty = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op7_minmax(spark, sf_dir: str) -> DataFrame:
    """All documents, sets of four words, links from 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
