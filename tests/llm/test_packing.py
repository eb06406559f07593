import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanforge.llm.packing import first_fit_decreasing, pack

SCHEMA = "doc_id long, text string, length string, grp int"


def plain_first_fit(lengths, capacity):
    rooms, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        if b == len(rooms):
            rooms.append(capacity)
        where[i] = (b, capacity - rooms[b])
        rooms[b] -= lengths[i]
    return [where[i] for i in range(len(lengths))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_tree_equals_plain_first_fit(lengths):
    bins, offsets = first_fit_decreasing(np.array(lengths, dtype=np.int64), 16)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == plain_first_fit(lengths, 16)


def test_pieces_hold_every_id_once(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "one two", "x", 0), (2, None, "x", 0), (3, "", "x", 0), (None, "no id", None, 0), (5, "word \n\n  é" * 900, "x", 0), (5, "word \n\n  é" * 900, "x", 0), (6, "a <|endoftext|> b", "x", 0)]
    got = pack(spark.createDataFrame(rows, SCHEMA), capacity=64, group_docs=2).collect()
    for doc_id, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        copies = sum(r[0] == doc_id for r in rows)
        mine = [r for r in got if r.doc_id == doc_id]
        assert sum(r.length for r in mine) == copies * len(ids)
        for r in mine:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_little_padding(spark, sf):
    got = pack(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    assert got.length.sum() / (got.sequence_id.nunique() * 1024) > 0.97


def test_groups_are_even_whatever_the_partitions(spark):
    rows = [(i, f"text {i} " + "word " * (i % 37)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (pack(docs.repartition(n), capacity=64, group_docs=40).toPandas() for n in (3, 200))
    sizes = many.groupby(many.sequence_id // 2**24).size()
    assert len(sizes) == 100 and sizes.max() < 3 * sizes.mean()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(one[names].itertuples(index=False)) == sorted(many[names].itertuples(index=False))


def test_equal_rows_spread_over_groups(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) doc_id", "'the very same text' text").coalesce(2)
    got = pack(docs, capacity=64, group_docs=100).toPandas()
    sizes = got.groupby(got.sequence_id // 2**24).size()
    assert len(got) == 3000 and len(sizes) == 30 and sizes.max() < 200


def test_a_task_remembers_a_bounded_number_of_rows(spark, monkeypatch):
    import spanforge.llm.packing as packing

    class Partition:
        def partitionId(self):
            return 0

    monkeypatch.setattr(packing, "REMEMBERED", 4)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: Partition())
    table = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}") for i in range(40)], "doc_id long, text string").toArrow()
    out = list(packing._cut("byte_bpe_50k", 64, 8, 17)(iter(table.to_batches())))
    assert sum(b.num_rows for b in out) == 40
