"""First-fit-decreasing packing with a tournament tree, in randomised groups.

A document becomes its token ids and a closing id 0. Ids beyond whole sequences are the
document's remainder; each whole sequence is a piece of its own. Pieces go to random
groups of about ``group_docs`` documents' worth: a keyed hash of doc_id, ids and start
decides, so that any order of rows, any partitions and any retried task give the same
groups. Only a row equal to an earlier one of its task is told apart by its number there,
so equal rows spread too; a task remembers ``REMEMBERED`` rows for it and then starts anew, so a group
holds one copy of a row for each so many rows at most beside its share. In a group, pieces in falling order of length go to the first bin with room: a
tournament tree over bin capacities finds it in log time.

Defined results: a null or empty text is the single id 0; repeated rows are packed once
for each row; ties in length go by doc_id, start and checksum; a text of any length is cut
into pieces that spread over the groups; an empty table gives no rows; only ``doc_id`` and
``text`` are read, so further columns, whatever their names, change nothing. A null doc_id
stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import bpe
from spanforge.llm.storage import with_clear_names
from spanforge.llm.words import mixed

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Rows of a task that later ones are compared with.
REMEMBERED = 1 << 16
#: Bits of a sequence id that number the bins of a group.
BIN_BITS = 24


class Tournament:
    """Bins with their free room in the leaves; each inner node knows the most room below it."""

    def __init__(self, n_bins: int, capacity: int):
        self.leaves = 1 << max(0, (n_bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """First bin with room for ``size``: its number and the room it had; the room shrinks."""
        room, at, leaves = self.room, 1, self.leaves
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        bin_no = at - leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_no, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ties keep their order of arrival. Lengths are 1 to ``capacity``."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.count_nonzero(lengths == capacity))
    bins[order[:full]] = np.arange(full)  # nothing else fits beside a whole sequence
    tree = Tournament(max(1, len(lengths) - full), capacity)
    for i in order[full:].tolist():
        size = int(lengths[i])
        bin_no, had = tree.place(size)
        bins[i], offsets[i] = full + bin_no, capacity - had
    return bins, offsets


def document_ids(text: str | None, vocabulary: str) -> np.ndarray:
    return np.append(bpe.load(vocabulary).ids(text), np.uint32(0)).astype("<u4")


def _cut(vocabulary: str, capacity: int, groups: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, times = TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            keys: list[int] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(document_ids(text.as_py(), vocabulary).tobytes())
                n = len(raw) // 4
                key = xxhash.xxh3_64_intdigest(f"{doc_id}", xxhash.xxh3_64_intdigest(raw, seed))
                if len(times) >= REMEMBERED:
                    times.clear()
                copy = times[key] = times.get(key, -1) + 1
                if copy:
                    key = xxhash.xxh3_64_intdigest(f"{part}/{copy}", key)
                for start in range(0, n, capacity):
                    piece = raw[4 * start : 4 * (start + capacity)]
                    keys.append(key)
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        column.append(value)
            spread = mixed(np.array(keys, dtype=np.uint64) + np.array(out[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.record_batch([*[pa.array(x, pa.int64()) for x in out], pa.array((spread % np.uint64(groups)).astype(np.int64))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])

    return run


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows >= 1 << BIN_BITS:
            raise ValueError("a group has more pieces than its bins can be numbered; lower group_docs")
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        ids = table["grp"].to_numpy() << BIN_BITS | bins
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, group_docs: int = 1024, vocabulary: str = bpe.DEFAULT, seed: int = 17) -> DataFrame:
    """A row per piece: where it lies in its document, its checksum, its sequence and its offset there."""
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col})
    groups = max(1, -(-own.count() // group_docs))
    pieces = own.mapInArrow(_cut(vocabulary, capacity, groups, seed), PIECES)
    return pieces.groupBy("grp").applyInArrow(_pack_group(capacity), PACKED)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, in sequences of 1024."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
