"""Training-order materialisation: token sequences in a keyed random order, as fixed-stride shards.

Texts become token sequences of ``length`` ids, the last of which is always the closing
id 0; a long text gives several. Sequences are numbered without gaps in the order of the
scan: its partitions one after the other. A keyed Feistel network over the smallest even
number of bits that holds the count, walked on until it lands below the count, permutes
the numbers: a bijection, so every sequence has its own slot and every slot a sequence.
Shard k holds slots k * shard_rows and on, in order, with the same number of bytes for
each, so slot s lies at a place that its number alone gives, and a reader can stop and go
on anywhere.

Texts are encoded twice: once for the index, which gives the counts, and once for the
shards, whose records move in a single shuffle. Keeping the ids between the two would
save the second encoding for once more the size of the ids on disk. Both passes must meet
the same rows in the same order in the same partitions, as file scans do: the index gives
a mark of each partition's records in their order, and a task whose records have another
mark fails instead of writing shards that disagree with the index; write shuffled input to
a table first. Only the first number, the count and the mark of each partition are sent to
the tasks.

Files are written by the engine's own text writer with its committer, so a lost task
leaves no half shard: a record is the bytes of its ids but the last one, and the record
separator is the byte 0, which is the high byte of the closing id.

A reader lists the files, opens those from the wanted shard on and no earlier one.

Defined results: a null or empty text gives one sequence with no id but the closing one; a
text of any length gives as many sequences as its ids fill; repeated rows give equal
sequences in slots of their own, and there are no ties, as slots are a permutation; an
empty table gives no rows and no shard; only ``doc_id`` and ``text`` are read, so extra
columns with clashing names change nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe
from spanforge.llm.storage import materialise, table_path, with_clear_names
from spanforge.llm.words import mixed

SEQUENCES = "slot long, crc32 long, ids array<int>"
INDEX = "doc_id long, seq int, n_tokens int, crc32 long, part int, ordinal long"
ROUNDS = 4


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0 .. n-1: balanced Feistel rounds, repeated while the value is n or more."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(f"{key}/{r}/{n}")) for r in range(ROUNDS)]
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int, width: int) -> Iterator[list[tuple]]:
    """(doc_id, seq, n_tokens, record) of every sequence, a list per batch."""
    encoder, room, kind = bpe.load(vocabulary), length - 1, f"<u{width}"
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoder.ids(text.as_py())
            n = max(1, -(-len(ids) // room))
            grid = np.zeros((n, length), dtype=kind)
            for seq in range(n):
                part = ids[seq * room : (seq + 1) * room]
                grid[seq, : len(part)] = part
                out.append((doc_id, seq, len(part), grid[seq].tobytes()))
        yield out


def marks(ordinal, crc):
    """A number under 2**53 for each record that its place and its checksum decide; xor sums them up."""
    return crc * (ordinal % (1 << 20) * 2 + 1)


def _index(vocabulary: str, length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for rows in _sequences(batches, vocabulary, length, width):
            n = len(rows)
            columns = ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(r[3]) for r in rows], [part] * n, range(done, done + n))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            done += n
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "seq", "n_tokens", "crc32", "part", "ordinal"])

    return run


def _records(vocabulary: str, length: int, width: int, starts, total: int, key: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        first, expected, mark = starts.value.get(part, (0, 0, 0))
        for rows in _sequences(batches, vocabulary, length, width):
            n = len(rows)
            if done + n > expected:
                raise RuntimeError("the scan gave other rows than it gave for the index")
            slots = feistel(first + done + np.arange(n), total, key)
            crc = np.fromiter((zlib.crc32(r[3]) for r in rows), dtype=np.int64, count=n)
            mark ^= int(np.bitwise_xor.reduce(marks(np.arange(done, done + n), crc), initial=0))
            done += n
            yield pa.record_batch([pa.array((slots // shard_rows).astype(np.int32)), pa.array(slots), pa.array([r[3][:-1] for r in rows], pa.binary())], names=["shard", "slot", "payload"])
        if done != expected or mark:
            raise RuntimeError("the scan gave other rows than it gave for the index")

    return run


def training_order(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 512, shard_rows: int = 16_384, key: int = 77, vocabulary: str = bpe.DEFAULT) -> DataFrame:
    """Write the shards under ``path``; a row per sequence: its document, slot, shard, byte offset and checksum."""
    spark = docs.sparkSession
    width = 2 if vocabulary.endswith("50k") else 4  # ids under 2**16 take two bytes
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col})
    index = materialise(own.mapInArrow(_index(vocabulary, length, width), INDEX), "index")
    starts, total = {}, 0
    of_part = [F.count(F.lit(1)).alias("n"), F.bit_xor(marks(F.col("ordinal"), F.col("crc32"))).alias("mark")]
    for r in index.groupBy("part").agg(*of_part).orderBy("part").collect():  # a row per task of the scan
        starts[r["part"]] = (total, r["n"], r["mark"])
        total += r["n"]
    shared = spark.sparkContext.broadcast(starts)
    if total:
        records = own.mapInArrow(_records(vocabulary, length, width, shared, total, key, shard_rows), "shard int, slot long, payload binary")
        ordered = records.repartitionById(-(-total // shard_rows), F.col("shard")).sortWithinPartitions("slot")
        ordered.select(F.col("payload").cast("string").alias("value")).write.option("lineSep", "\0").text(path)

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, ordinal: pd.Series) -> pd.Series:
        first = np.array([shared.value[p][0] for p in part.tolist()], dtype=np.int64)
        return pd.Series(feistel(first + ordinal.to_numpy(), total, key))

    placed = index.withColumn("slot", slot_of("part", "ordinal")).withColumn("shard", F.floor(F.col("slot") / shard_rows).cast("int"))
    return placed.select("doc_id", "seq", "n_tokens", "slot", "shard", ((F.col("slot") - F.col("shard") * shard_rows) * (length * width)).alias("byte_offset"), "crc32")


def read_from(spark: SparkSession, path: str, slot: int = 0, *, length: int = 512, shard_rows: int = 16_384, width: int = 2) -> DataFrame:
    """Sequences from ``slot`` on, in order within a shard: slot, crc32 and ids without the padding's end. Shards before it are not opened."""
    stride = length * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, stride)
                start = max(0, slot - shard * shard_rows)
                for at in range(start, len(data), 4096):
                    rows = data[at : at + 4096]
                    ids = rows.view("<u2" if width == 2 else "<u4").astype(np.int32)
                    yield pa.record_batch([pa.array(shard * shard_rows + at + np.arange(len(rows))), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64()), pa.array(list(ids), pa.list_(pa.int32()))], names=["slot", "crc32", "ids"])

    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    wanted = [f for f in parts.load(path).inputFiles() if int(re.search(r"part-(\d+)-", f)[1]) >= slot // shard_rows]
    if not wanted:
        return spark.createDataFrame([], SEQUENCES)
    numbered = parts.load(wanted).select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("shard"), "content")
    return numbered.mapInArrow(run, SEQUENCES)


def op3_training_order(spark, sf_dir: str) -> DataFrame:
    """All documents; shards go to the shared folder."""
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), table_path(spark, "shards"))
