"""Connected components of an edge table by alternating stars, and components that tiles found apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.store import drop, written


def attach(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key.

    The key goes in as a struct, so that neither side counts as partitioned already: both are
    shuffled for the join, and adaptive execution can split a hot key over many tasks.
    """
    own = [c for c in rows.columns if c != key]
    left = rows.select(F.struct(key).alias("hot_safe_key"), *own)
    right = facts.select(F.struct(key).alias("hot_safe_key"), *[c for c in facts.columns if c != key])
    joined = left.join(right, "hot_safe_key")
    return joined.select(F.col(f"hot_safe_key.{key}").alias(key), *[c for c in joined.columns if c != "hot_safe_key"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b)."""
    rows = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        rows = rows.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = attach(rows, least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.filter(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, write: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node reachable. Nodes of any type that has an order.

    Large-star and small-star steps alternate until the edges are stars; each round is written.
    The number of rounds grows with the logarithm of the longest path.
    """
    now = write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    state = _state(now)
    while True:
        after = write(_star(_star(now, True), False), "stars")
        found = _state(after)
        drop(now)
        now, same, state = after, found == state, found
        if same:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def with_tiles(rows: DataFrame, keys: list[str], axes: list[str], size: float, halo: float, few: int) -> DataFrame:
    """``rows`` once for every tile whose halo reaches them: ``_tile``, an array of the tile's places, and ``_own`` where the tile holds the row itself.

    A view of ``few`` rows at most is one tile, without places.
    """
    small = rows.groupBy(*keys).agg((F.count(F.lit(1)) <= few).alias("_small"))

    def crossed(tiles: Column, places: Column) -> Column:
        return F.flatten(F.transform(tiles, lambda t: F.transform(places, lambda i: F.concat(t, F.array(i)))))

    alone = F.array().cast("array<bigint>")
    every = F.array(alone)
    for a in axes:
        every = crossed(every, F.sequence(F.floor((F.col(a) - halo) / size), F.floor((F.col(a) + halo) / size)))
    home = F.array(*[F.floor(F.col(a) / size) for a in axes])
    sized = rows.join(small, keys).withColumns({"_home": F.when(F.col("_small"), alone).otherwise(home), "_tiles": F.when(F.col("_small"), F.array(alone)).otherwise(every)})
    return sized.withColumn("_tile", F.explode("_tiles")).withColumn("_own", F.col("_tile") == F.col("_home")).drop("_home", "_tiles", "_small")


def stitched(labelled: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """One component per row of the rows that tiles own, from labels that are good inside a tile.

    ``labelled`` has keys, identity, _tile, _own and ``_label`` (null for rows in no component). A
    row that several tiles labelled joins their labels; each of its tiles knows it, so all of a
    border's joins are seen. Components of a view are numbered by their least identities.
    ``_seed`` rows (all, where there is no such column) may join labels and give the least identity.
    """
    seed = F.col("_seed") if "_seed" in labelled.columns else F.lit(True)
    rows = labelled.withColumn("_node", F.when(F.col("_label").isNotNull(), F.struct(*keys, "_tile", "_label"))).withColumn("_seed", seed)
    mine = rows.filter("_own")
    sure = mine.filter("_seed and _label is not null")
    other = rows.filter("not _own and _seed and _label is not null")
    edges = sure.select(*keys, *identity, F.col("_node").alias("a")).join(other.select(*keys, *identity, F.col("_node").alias("b")), [*keys, *identity]).select("a", "b")
    roots = components(edges).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    whole = mine.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node")).drop("_node")
    least = whole.filter("_seed and _label is not null").groupBy(*keys, "_root").agg(F.min(F.struct(*identity)).alias("_least"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_least")).cast("long") - 1
    numbered = least.select(F.struct("_root").alias("_of"), number.alias("component"))
    return whole.withColumn("_of", F.struct("_root")).join(numbered, "_of", "left").drop("_of", "_root", "_label", "_tile", "_own")
