"""Rendezvous hashing of record keys over weighted shards, in DataFrame functions only.

Every shard draws a number from the key and the shard's own number; with a uniform u the
score is -weight / ln(u), and the greatest score has the record. A shard that is added
changes no other shard's score, so records move only into it, about weight / total of
them. Slots order a shard's rows by a hash of the key in ranges, 4,096 for 24 shards:
counts per range (2^17 rows at most, whatever the input) are summed up, broadcast and
added to a row number inside each range. With more than 2^16 shards the counts are joined
without a broadcast. Equal rows are counted before they are shuffled and unfolded at the
end.

Defined results: a null doc_id is a key of its own; a null text has size 8 and checksum 0;
repeated rows share their shard and take consecutive slots; of equal scores the greater
shard number wins; a text of any length counts with its bytes; an empty table gives no
rows; only ``doc_id`` and ``text`` are read, so extra columns with clashing names change
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.storage import with_clear_names

#: Most counts of ranges, over all shards, that are broadcast.
MOST_COUNTS = 1 << 17
#: Equal rows are unfolded in runs of so many.
RUN = 1 << 16


def uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the key and the shard decide; 52 bits of their hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard with the greatest weighted score."""
    scored = [F.struct((F.lit(-float(w)) / F.log(uniform(key, i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def range_bits(shards: int) -> int:
    """Bits of the hash that tell a shard's ranges: as many as leave MOST_COUNTS counts over all shards, one at least."""
    return max(1, (MOST_COUNTS // shards).bit_length() - 1)


def assign(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 24, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after one more of ``grown_weight``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_clear_names(docs, {"doc_id": id_col, "text": text_col}).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    bits = range_bits(len(weights))
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = distinct.withColumns(
        {
            "shard": rendezvous(F.col("doc_id"), weights),
            "grown_shard": rendezvous(F.col("doc_id"), [*weights, grown_weight]),
            "h": F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"),
        }
    ).withColumn("part", F.shiftrightunsigned("h", 64 - bits))
    counts = placed.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    bounded = F.broadcast(starts) if len(weights) << bits <= MOST_COUNTS else starts
    numbered = placed.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(bounded, ["shard", "part"])
    runs = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))).alias("run"))
    unfolded = runs.select("*", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("copies")) - 1)).alias("copy"))
    return unfolded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("earlier") + F.col("copy")).alias("slot"), "grown_shard")


def op5_rendezvous(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards, and where a 25th would take them."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
