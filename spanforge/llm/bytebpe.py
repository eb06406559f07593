"""Byte-level BPE: boundaries by a scan, cached pair merging of the slices between them, decoding by offsets.

Texts are split into pre-tokens by ``pretokens`` (arrays, no regular expression). Each slice
of bytes is merged once and remembered, up to ``REMEMBERED`` slices of at most ``SHORT_SLICE``
bytes a worker; beyond that the memory starts anew. A remembered slice has its ids as bytes, so
those of a text are one join and no list. A long slice is merged with a heap, so a
text without any blank costs n log n. Each id keeps the byte at which it starts, and decoding
writes the bytes of every id to its own place. Texts are read whole; arrays are made for
about a megabyte of text at a time, and a longer text passes the scan's state from block to
block. Both directions are one pass without a shuffle, so a lost executor costs its own tasks.

Defined results: a null or empty text gives no ids, and these decode to no bytes; strings of
special tokens are ordinary text; repeated rows are encoded each for itself; an empty table
gives no rows; null ids or offsets, an id outside the vocabulary and lists of two lengths
decode to null; ``encode`` reads two named columns and ``decode`` two, so further columns
with clashing names change nothing. A null doc_id stays null. There are no ties: of pairs
with one rank the leftmost merges first.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.bpe import DEFAULT, vocabulary_path
from spanforge.llm.pretokens import BLOCK, long_openings, text_openings
from spanforge.llm.storage import with_clear_names

ENCODED = "doc_id long, ids array<int>, starts array<int>"
#: Slices that a worker remembers, and the longest of them in bytes.
REMEMBERED = 1 << 19
SHORT_SLICE = 48
#: Ids in one batch of rows that leaves a worker.
BATCH_IDS = 1 << 20


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of least rank merges first, the leftmost of equal ones, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT_SLICE:
        return _merged_short(piece, ranks)
    end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is part of another
    before = list(range(-1, n - 1))

    def rank_at(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    todo = [(r, i) for i in range(n - 1) if (r := rank_at(i)) is not None]
    heapq.heapify(todo)
    while todo:
        r, i = heapq.heappop(todo)
        if not end[i] or rank_at(i) != r:
            continue  # an older state of this place
        j = end[i]
        end[i], end[j] = end[j], 0
        if end[i] < n:
            before[end[i]] = i
            if (r := rank_at(i)) is not None:
                heapq.heappush(todo, (r, i))
        k = before[i]
        if k >= 0 and (r := rank_at(k)) is not None:
            heapq.heappush(todo, (r, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a few bytes, where looking at every pair is less work than a heap."""
    get, none = ranks.get, 1 << 62
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        del pairs[i], cuts[i + 1]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in pairwise(cuts)]


class Slices(dict):
    """Ids of the slices that were merged lately, as the bytes of their int32 array: {slice: ids}."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = array("i", merged(piece, self.ranks)).tobytes()
        if len(piece) <= SHORT_SLICE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Ranks of a public vocabulary, with the slices that were merged lately."""

    def __init__(self, name: str = DEFAULT, folder: str | None = None):
        with open(vocabulary_path(name, ".tiktoken", folder), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.known = Slices(self.ranks)

    def ids(self, raw: bytes, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text whose pre-tokens start at ``opens``, and the byte that each id starts at."""
        cuts = opens.tolist()
        pieces = map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), dtype=np.int32)
        sizes = self.sizes[ids]
        return ids, (np.cumsum(sizes) - sizes).astype(np.int32)

    def text(self, ids: np.ndarray, starts: np.ndarray) -> bytes | None:
        """The bytes of all ids, each at its own place; null for an id outside the vocabulary."""
        if len(ids) != len(starts) or (len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all())):
            return None
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        every = np.arange(int(sizes.sum()))
        out = np.zeros(int((starts + sizes).max(initial=0)), dtype=np.uint8)
        out[np.repeat(starts - before, sizes) + every] = self.bytes[np.repeat(self.places[ids] - before, sizes) + every]
        return out.tobytes()


_loaded: dict[tuple, Codec] = {}


def codec(name: str = DEFAULT, folder: str | None = None) -> Codec:
    """The worker's own codec of that vocabulary."""
    key = (name, folder)
    if key not in _loaded:
        _loaded[key] = Codec(name, folder)
    return _loaded[key]


def _blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in their order, about ``BLOCK`` bytes together; a longer text comes alone."""
    block, size = [], 0
    for raw in texts:
        if block and size + len(raw) > BLOCK:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield block


def _opened(block: list[bytes]) -> list[np.ndarray]:
    raws = [np.frombuffer(raw, dtype=np.uint8) for raw in block]
    return [long_openings(raws[0])] if len(raws) == 1 else text_openings(raws)


def _rows(key: pa.Array, lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *[len(ids) for ids, _ in lists]]).astype(np.int32))
    columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in lists]))) for k in range(2)]
    return pa.record_batch([key, *columns], names=["doc_id", "ids", "starts"])


def _encode(name: str, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, folder)
        for batch in batches:
            made, first, total = [], 0, 0
            texts = ((t.as_buffer() or b"") if t.is_valid else b"" for t in batch.column(1).cast(pa.binary()))
            for block in _blocks(bytes(t) for t in texts):
                for raw, opens in zip(block, _opened(block), strict=True):
                    made.append(own.ids(raw, opens))
                    total += len(made[-1][0])
                if total >= BATCH_IDS:
                    yield _rows(batch.column(0).slice(first, len(made)), made)
                    made, first, total = [], first + len(made), 0
            if made:
                yield _rows(batch.column(0).slice(first, len(made)), made)

    return run


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """A row per document: its ids and the byte of the text that each starts at."""
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col})
    return own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(vocabulary, folder), ENCODED)


def _decode(name: str, folder: str | None, ids_at: int, starts_at: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, folder)

        def numbers(value: pa.ListScalar) -> np.ndarray | None:
            return None if not value.is_valid or value.values.null_count else value.values.to_numpy().astype(np.int64)

        for batch in batches:
            first, made, total = 0, [], 0
            for ids, starts in zip(map(numbers, batch.column(ids_at)), map(numbers, batch.column(starts_at)), strict=True):
                made.append(None if ids is None or starts is None else own.text(ids, starts))
                total += len(made[-1] or b"")
                if total >= 4 * BATCH_IDS:
                    yield _with(batch.slice(first, len(made)), made, out)
                    first, made, total = first + len(made), [], 0
            if made:
                yield _with(batch.slice(first, len(made)), made, out)

    return run


def _with(batch: pa.RecordBatch, values: list[bytes | None], name: str) -> pa.RecordBatch:
    return pa.record_batch([*batch.columns, pa.array(values, pa.binary())], names=[*batch.schema.names, name])


def decode(tokens: DataFrame, *, ids_col: str = "ids", starts_col: str = "starts", out_col: str = "decoded", vocabulary: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``tokens`` with the bytes that the ids stand for, every id's at its retained offset."""
    schema = tokens.select("*", F.lit(None).cast("binary").alias(out_col)).schema
    at = [tokens.columns.index(c) for c in (ids_col, starts_col)]
    return tokens.mapInArrow(_decode(vocabulary, folder, *at, out_col), schema)


def op11_bytebpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: number and digest of the ids, digest of the decoded bytes."""
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
