"""Repeated passages across documents by hashing normalised units.

Units are whole lines and, below them, sentences and parts of sentences. In a line,
sentences of fewer than four words join what follows. A sentence is cut after words whose
hash is the least of three words either side, so that where a passage pasted into a line
is cut depends, but for three words at its ends, on its own words; a repeat loses all but
the words before its first cut and after its last one. Units are lower-cased letter by
letter, their blanks count as one, and they are hashed to 96 bits. Of equal units the one
of the least doc_id stays, in a document the first; the rest are repeats. Lines of four
words or more that equal an earlier line go; other repeats go when a run of neighbours
holds ``least_run`` words or more: a short sentence that two documents share by chance
stays. Offsets of what went refer to the original text.

With ``sentences=False`` lines alone are units, and every repeated one of ``least_line``
words or more goes.

Texts are cut in blocks of about 250,000 characters, all at once by array operations; a
longer text is a block of its own, so a text costs memory in proportion to its length.

Defined results: a null text stays null; an empty one stays empty; a null doc_id ranks
last; rows that share a doc_id, or have none, rank by a 128-bit hash of id and text; of rows
that share id and text one is the earliest and the others lose all of their lines and runs
that are long enough; an empty table gives no rows; extra columns
pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.graph import attach
from spanforge.llm.storage import discard, fresh, materialise
from spanforge.llm.words import mixed, powers

LEAST_UNIT, LEAST_RUN = 4, 16
#: Texts cut together hold about so many characters.
BLOCK_CHARS = 250_000
#: Units of numbered texts, and for each text one row of unit -1 that names it.
UNITS = "num long, unit int, d1 long, d2 int, k1 long, k2 long, rank long"
REMOVED = "array<struct<start:int,end:int>>"
#: In place of the units that are repeats: all of them.
EVERY = -1
ENDS, CLOSERS = ".!?…。！？", "\"'”’)]"
#: No letter with a case and no blank lies at or above this code point.
_TOP = 0x20000
_BLANK, _END, _CLOSER = 1, 2, 4
_tables: list[np.ndarray] = []


def _of_letters() -> list[np.ndarray]:
    """Kind and lower case of every code point under _TOP; letters whose lower case is no single one stay."""
    if not _tables:
        kind, lower = np.zeros(_TOP, np.uint8), np.arange(_TOP, dtype=np.uint32)
        for i in range(_TOP):
            c = chr(i)
            if c.isspace():
                kind[i] = _BLANK
            low = c.lower()
            if low != c and len(low) == 1:
                lower[i] = ord(low)
        kind[[ord(c) for c in ENDS]] = _END
        kind[[ord(c) for c in CLOSERS]] = _CLOSER
        _tables.extend((kind, lower))
    return _tables


class Units(NamedTuple):
    """Units of a block of texts in text order; a line's own unit has no width and comes before those inside the line."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    d1: np.ndarray
    d2: np.ndarray
    first: np.ndarray  # first unit of each text, and the number of units
    repeated: np.ndarray  # equal to an earlier unit of its text


def _segments(last: np.ndarray, line_last: np.ndarray) -> np.ndarray:
    """Of the sentences that end at words ``last``, the ends of those that close a unit: with what is held, four words or more, or the end of a line."""
    size = np.diff(last, prepend=-1)
    ends_line = line_last[last]
    closes = (size >= LEAST_UNIT) | ends_line
    held, before = 0, -2
    for s in np.flatnonzero(~closes).tolist():
        held = (held if s == before + 1 else 0) + int(size[s])
        if held >= LEAST_UNIT:
            closes[s], held = True, 0
        before = s
    return last[closes]


def cut(texts: list[str], least_line: int = LEAST_UNIT) -> Units:
    """Units of whole texts, by array operations over all of them; lines of ``least_line`` words or more have a unit of their own."""
    kinds, lowers = _of_letters()
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype="<u4")
    low = np.minimum(points, _TOP - 1)
    kind = kinds[low]
    low = lowers[low]
    if (points >= _TOP).any():
        low = np.where(points >= _TOP, points, low)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_start = np.concatenate(([0], np.cumsum(size + 1)))
    solid = np.concatenate(([False], kind != _BLANK, [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    begin, stop = edge[::2], edge[1::2]
    n = len(begin)
    if not n:
        nothing = np.empty(0, np.int64)
        return Units(nothing, nothing, nothing, nothing, nothing, nothing.astype(np.int32), np.zeros(len(texts) + 1, np.int64), nothing.astype(bool))
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mixed(low.astype(np.uint64)) * up[: len(points)], out=total[1:])
    word = mixed((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    breaks = np.flatnonzero(points == 10)
    line = np.searchsorted(breaks, begin)
    line_last = np.append(line[1:] != line[:-1], True)
    solid_at = np.maximum.accumulate(np.where(kind != _CLOSER, np.arange(len(points)), -1))[stop - 1]
    sentence_end = (solid_at >= begin) & (kind[solid_at] == _END)

    closing = _segments(np.flatnonzero(sentence_end | line_last), line_last)
    seg = np.searchsorted(closing, np.arange(n))
    seg_first = np.concatenate(([0], closing[:-1] + 1))
    at, length = np.arange(n) - seg_first[seg], (closing - seg_first + 1)[seg]
    least = (at >= LEAST_UNIT - 1) & (at < length - LEAST_UNIT)
    for k in range(1, LEAST_UNIT):
        least[k:] &= word[k:] < word[:-k]
        least[:-k] &= word[:-k] <= word[k:]
    least[closing] = True
    last = np.flatnonzero(least)
    first = np.concatenate(([0], last[:-1] + 1))

    owner = np.searchsorted(text_start, begin[last], side="right") - 1
    line_end = np.minimum(breaks[line[last]] + 1, text_start[owner + 1] - 1)
    whole = (closing - seg_first + 1)[seg[last]]
    end = np.where(line_last[last] & ~(sentence_end[last] & (whole >= LEAST_UNIT)), line_end, stop[last]) - text_start[owner]
    start = np.concatenate(([0], end[:-1]))
    start[np.flatnonzero(np.diff(owner, prepend=-1))] = 0

    line_ends = np.flatnonzero(line_last)
    line_first = np.concatenate(([0], line_ends[:-1] + 1))
    long = line_ends - line_first + 1 >= least_line
    line_first, line_ends = line_first[long], line_ends[long]
    before = np.searchsorted(last, line_first)  # the first unit inside the line
    a, b = np.insert(first, before, line_first), np.insert(last, before, line_ends) + 1
    is_line = np.insert(np.zeros(len(last), np.uint64), before, np.uint64(1))
    owner, end = np.insert(owner, before, owner[before]), np.insert(end, before, start[before])
    start = np.insert(start, before, start[before])
    digests = []
    for salt in (0x9E3779B97F4A7C15, 0x165667B19E3779F9):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(word + np.uint64(salt)) * up[:n], out=sums[1:])
        digests.append(mixed((sums[b] - sums[a]) * down[a] + ((b - a).astype(np.uint64) * np.uint64(2) + is_line) * np.uint64(salt)))
    d1, d2 = digests[0].view(np.int64), (digests[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((d2, d1, owner))
    same = (owner[order[1:]] == owner[order[:-1]]) & (d1[order[1:]] == d1[order[:-1]]) & (d2[order[1:]] == d2[order[:-1]])
    repeated = np.zeros(len(a), dtype=bool)
    repeated[order[1:][same]] = True
    return Units(owner, start, end, b - a, d1, d2, np.searchsorted(owner, np.arange(len(texts) + 1)), repeated)


def units(text: str) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(start, end, words, digest) of each unit of one text."""
    u = cut([text])
    return list(zip(u.start.tolist(), u.end.tolist(), u.words.tolist(), zip(u.d1.tolist(), u.d2.tolist(), strict=True), strict=True))


def blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about BLOCK_CHARS characters together."""
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + n > BLOCK_CHARS:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield at, len(lengths)


def _listed(least_line: int, sentences: bool):
    """A row for each text, and one for the first of equal units of a text. Numbers are a task's own; the written table keeps them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num = TaskContext.get().partitionId() << 40
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            texts, n = batch.column(3), batch.num_rows
            for a, b in blocks(pc.utf8_length(texts).to_pylist()):
                u = cut(texts.slice(a, b - a).to_pylist(), least_line)
                use = np.flatnonzero(~u.repeated & (sentences | (u.start == u.end)))
                owner = u.owner[use]
                columns = (num + a + owner, use - u.first[owner], u.d1[use], u.d2[use])
                yield pa.record_batch([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], *[pa.nulls(len(use), k) for k in kinds[4:]]], names=[c.split()[0] for c in UNITS.split(", ")])
            named = [pa.array(num + np.arange(n)), pa.array(np.full(n, -1), pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *batch.columns[:3]]
            yield pa.record_batch(named, names=[c.split()[0] for c in UNITS.split(", ")])
            num += n

    return run


def _spans(u: Units, a: int, b: int, repeated: np.ndarray, least_run: int) -> list[tuple[int, int]]:
    """Spans of repeated lines and of long runs of repeated units, of the units a to b."""
    spans: list[tuple[int, int]] = []
    run: list[tuple[int, int, int, bool]] = []  # start, end, words, in a repeated line

    def close() -> None:
        whole = sum(n for _, _, n, _ in run) >= least_run
        for x, y, _, in_line in run:
            if whole or in_line:
                if spans and spans[-1][1] == x:
                    x = spans.pop()[0]
                spans.append((x, y))
        run.clear()

    line_left = 0
    for x, y, n, again in zip(u.start[a:b].tolist(), u.end[a:b].tolist(), u.words[a:b].tolist(), repeated[a:b].tolist(), strict=True):
        if x == y:
            line_left = n if again else 0
        elif again or line_left:
            run.append((x, y, n, line_left > 0))
            line_left = max(0, line_left - n)
        elif run:
            close()
    close()
    return spans


def repeated_spans(text: str, repeats: set[int], least_run: int = LEAST_RUN) -> list[tuple[int, int]]:
    """What goes from one text of which the units ``repeats`` have an earlier equal elsewhere."""
    u = cut([text])
    flags = u.repeated.copy()
    flags[list(repeats)] = True
    return _spans(u, 0, len(flags), flags, least_run)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def _cleaned(position: int, least_run: int, least_line: int, sentences: bool):
    """The last column of a batch holds the repeated units; it becomes the removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(position)), 0).to_pylist()
            for a, b in blocks(lengths):  # a block leaves before the next one is read
                part = batch.slice(a, b - a)
                texts, found = part.column(position).to_pylist(), part.column(part.num_columns - 1)
                u, gone = cut([t or "" for t in texts], least_line), [[]] * len(texts)
                flags = u.repeated & (sentences | (u.start == u.end))
                held, which = np.asarray(found.value_lengths().fill_null(0)), found.flatten().to_numpy()
                texts_of = np.repeat(np.arange(len(texts)), held)
                for i in texts_of[which == EVERY].tolist():
                    flags[u.first[i] : u.first[i + 1]] = sentences | (u.start[u.first[i] : u.first[i + 1]] == u.end[u.first[i] : u.first[i + 1]])
                flags[(u.first[texts_of] + which)[which != EVERY]] = True
                for i in np.unique(u.owner[flags]).tolist():
                    if spans := _spans(u, int(u.first[i]), int(u.first[i + 1]), flags, least_run):
                        texts[i] = without(texts[i], spans)
                        gone[i] = [{"start": x, "end": y} for x, y in spans]
                columns = [*part.columns[:-1], pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                columns[position] = pa.array(texts, pa.string())
                yield pa.record_batch(columns, names=batch.schema.names)

    return run


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_run: int = LEAST_RUN, least_line: int = LEAST_UNIT, sentences: bool = True, removed_col: str = "removed") -> DataFrame:
    """All rows and columns of ``docs``, the text without its repeats, and the removed spans in ``removed_col``."""
    key, removed = fresh("row_key", docs.columns), fresh(removed_col, docs.columns)
    own_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = docs.withColumn(key, F.struct(F.xxhash64(own_id, text).alias("k1"), F.xxhash64(F.lit("second"), own_id, text).alias("k2")))
    rank = F.coalesce(own_id.cast("long"), F.lit(2**63 - 1))
    texts = keyed.select(F.col(f"`{key}`.k1"), F.col(f"`{key}`.k2"), rank.alias("rank"), text.alias("text")).filter("text is not null")
    listed = materialise(texts.mapInArrow(_listed(least_line, sentences), UNITS), "units")
    found = listed.filter("unit >= 0")
    several = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    digest, order = F.struct("d1", "d2").alias("digest"), F.struct("rank", "k1", "k2")
    shared = attach(found.select(digest, "num", "unit"), several.select(digest), "digest")
    shared = materialise(shared.join(listed.filter("unit < 0").select("num", "k1", "k2", "rank"), "num").drop("num"), "shared")
    twins = materialise(listed.filter("unit < 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.struct("k1", "k2").alias(key)), "twins")
    discard(listed)
    least = shared.groupBy("digest").agg(F.min(order).alias("least"))
    again = attach(shared, least, "digest").filter(order > F.col("least"))
    flagged = materialise(again.groupBy("k1", "k2").agg(F.collect_set("unit").alias("repeats")).select(F.struct("k1", "k2").alias(key), F.col("repeats").alias(removed)), "repeats")
    discard(shared)
    names = [f"`{c}`" for c in docs.columns]
    if twins.isEmpty():
        joined = keyed.join(flagged, key, "left").select(*names, f"`{removed}`")
    else:  # rows with the same id and text get numbers that stay, and all but one are repeats as a whole
        number, first = fresh("row_number", docs.columns), fresh("row_first", docs.columns)
        copies = materialise(keyed.join(twins, key, "left_semi").withColumn(number, F.monotonically_increasing_id()), "copies")
        firsts = copies.groupBy(key).agg(F.min(number).alias(first))
        marked = attach(copies, firsts, key).join(flagged, key, "left")
        every = F.when(F.col(number) == F.col(first), F.col(f"`{removed}`")).otherwise(F.array(F.lit(EVERY)))
        alone = keyed.join(twins, key, "left_anti").join(flagged, key, "left").select(*names, f"`{removed}`")
        joined = alone.unionByName(marked.select(*names, every.alias(removed)))
    shape = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], f"`{removed}` {REMOVED}"])
    return joined.mapInArrow(_cleaned(docs.columns.index(text_col), least_run, least_line, sentences), shape)


def op6_passages(spark, sf_dir: str) -> DataFrame:
    """All documents: what is left of each text and which spans went."""
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
