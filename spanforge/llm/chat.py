"""Collapse of cumulative conversation snapshots, then chat formatting; DataFrame functions only.

A logger that saves a conversation after every turn leaves its prefixes behind. A prefix
hash is the running sum of a hash of each turn with its position (two sums of 64-bit
hashes, so 128 bits), which makes it the same in all conversations that begin alike.
Conversations of the same hash and length are copies: the least conv_id stays. An
anti-join drops those whose whole is a proper prefix elsewhere. The rest is rendered.

Positions and running sums are taken in two levels: rows are range-partitioned by
conversation and turn, each partition is summed up by itself, and sums of partitions are
added. A conversation of any length spreads over many tasks, and what is left is a row
per turn with its offset in the rendered whole, never a conversation in one cell.

Defined results: rows equal in conv_id, turn, role and text are one turn; turns go by
their number (null last), then by a hash of role and text; null role or text renders as
empty but is told from an empty one; a null conv_id is one conversation; of equal
conversations, however many, the least conv_id stays with their number; a turn of any
length is one row; an empty table gives no rows; only the four named columns are read, so
extra columns with clashing names change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.graph import attach
from spanforge.llm.storage import materialise, with_clear_names

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of a partition, about.
PART_TURNS = 500_000
SUMS = ("s1", "s2", "width")


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template."""
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def _running(rows: DataFrame, columns: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Running sums of ``columns`` over a conversation, under the same names, and its totals as ``all_<column>``."""
    totals = rows.groupBy("conv", "pid").agg(*[F.sum(c).alias(c) for c in columns])
    whole = Window.partitionBy("conv")
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns], *[F.sum(c).over(whole).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy("conv", "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(inside) for c in columns})
    return local.join(totals, ["conv", "pid"]).withColumns({c: F.col(c) + F.col(f"before_{c}") for c in columns}).drop(*[f"before_{c}" for c in columns])


def snapshots(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn with its position and the hash of the conversation up to it."""
    own = with_clear_names(conversations, {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    marks = [F.isnull("role"), F.isnull("text")]
    turns = own.dropDuplicates(["conv_id", "turn", "role", "text"]).select("*", F.struct(F.isnull("conv_id").alias("none"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("id")).alias("conv"), F.xxhash64("role", F.lit("|"), "text", *marks).alias("h"))
    order = [F.col("turn").asc_nulls_last(), F.col("h"), F.length("text")]
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // PART_TURNS))
    dealt = materialise(turns.repartitionByRange(parts, "conv", *order).withColumn("pid", F.spark_partition_id()).withColumn("position", F.lit(1).cast("long")), "turns")
    numbered = _running(dealt, ("position",), order)
    wide = "decimal(20,0)"
    hashed = numbered.withColumns(
        {
            "s1": F.xxhash64("position", "role", F.lit("|"), "text", *marks).cast(wide),
            "s2": F.xxhash64(F.lit("second"), "text", "position", F.lit("|"), "role", *marks).cast(wide),
            "width": F.length(render(F.col("role"), F.col("text"))).cast("long"),
            "own": F.length(render(F.col("role"), F.col("text"))).cast("long"),
        }
    )
    return _running(hashed, SUMS, [F.col("position")]).withColumn("start", F.col("width") - F.col("own"))


def collapse(conversations: DataFrame, **columns) -> DataFrame:
    """Turns of maximal conversations, rendered: conv_id, position, turn, role, rendered, start, n_turns, n_copies."""
    rows = materialise(snapshots(conversations, **columns).select("conv_id", "conv", "turn", "position", "role", "text", "start", "s1", "s2", "all_position", "all_s1", "all_s2"), "snapshots")
    last = rows.filter("position = all_position")
    whole = last.groupBy("position", "s1", "s2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    longer = rows.filter("position < all_position").select("position", "s1", "s2").distinct()
    kept = materialise(whole.join(longer, ["position", "s1", "s2"], "left_anti").select("conv", F.col("position").alias("n_turns"), "n_copies"), "maximal")
    return attach(rows, kept, "conv").select("conv_id", "position", "turn", "role", render(F.col("role"), F.col("text")).alias("rendered"), "start", "n_turns", "n_copies")


def op9_snapshots(spark, sf_dir: str) -> DataFrame:
    """All conversations."""
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
             '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(rendered ORDER BY position) AS s FROM p GROUP BY conv_id),
k AS (SELECT s, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns FROM c GROUP BY s),
longer AS (SELECT DISTINCT s[1:i] AS s FROM (SELECT s, unnest(range(1, n_turns)) AS i FROM c)),
kept AS (SELECT * FROM k ANTI JOIN longer USING (s))
SELECT p.conv_id, p.position, p.turn, p.role, p.rendered,
       coalesce(sum(length(p.rendered)) OVER (PARTITION BY p.conv_id ORDER BY p.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       kept.n_turns, kept.n_copies
FROM p JOIN kept USING (conv_id)
"""
