"""Joins whose hot keys adaptive execution can split, and connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import discard, materialise


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key.

    Both sides are shuffled for the join itself: the key goes in as a struct, so that
    ``facts`` never counts as partitioned already. Adaptive execution can then split the
    rows of a hot key over many tasks, as it does for no other shape of join. It does so
    past its own threshold (``spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes``),
    so a smaller partition of a hot key is read by one task.
    """
    own = [c for c in rows.columns if c != key]
    left = rows.select(F.struct(key).alias("hot_safe_key"), *own)
    right = facts.select(F.struct(key).alias("hot_safe_key"), *[c for c in facts.columns if c != key])
    joined = left.join(right, "hot_safe_key")
    return joined.select(F.col(f"hot_safe_key.{key}").alias(key), *[c for c in joined.columns if c != "hot_safe_key"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b)."""
    if large:
        rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = attach(rows, least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable.

    Large-star and small-star steps alternate; each round is written to the shared folder,
    so a lost executor repeats one round at most. The number of rounds grows with the
    logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    now = materialise(edges, "edges")
    state = _state(now)
    while True:
        after = materialise(_star(_star(now, True), False), "stars")
        found = _state(after)
        discard(now)
        now, same, state = after, found == state, found
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]
