import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from spanforge.llm import sharding
from spanforge.llm.sharding import assign, op5_rendezvous, range_bits


def test_rendezvous(spark):
    rows = [(i, f"text {i % 7} é", "x", 1) for i in range(3000)] + [(None, None, "x", 1)] * 2 + [(5, "again", "x", 1)] * 4 + [(9, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = assign(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and 70 < len(slots) < 190
    shard_of = {}
    for r in got:
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard and r.law == "key"
        assert r.grown_shard in (r.shard, 24)
    assert 60 < sum(r.grown_shard == 24 for r in got) < 190
    assert assign(docs.limit(0)).count() == 0


def test_weights(spark):
    docs = spark.range(8000).selectExpr("id doc_id", "'t' text")
    got = Counter(r.shard for r in assign(docs, weights=(1.0, 3.0)).collect())
    assert 2.6 < got[1] / got[0] < 3.4


def test_same_whatever_the_partitions(spark):
    docs = spark.range(500).selectExpr("id doc_id", "cast(id % 3 as string) text")
    assert sorted(assign(docs).collect()) == sorted(assign(docs.repartition(7)).collect())


def winner(doc_id, weights):
    """Shard of the greatest weighted score, by the published hash over the key's and the shard's bytes."""
    scores = []
    for shard, weight in enumerate(weights):
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        u = ((xxhash.xxh64_intdigest(struct.pack("<i", shard), seed) >> 12) + 0.5) / 2**52
        scores.append((-weight / math.log(u), shard))
    return max(scores)[1]


@pytest.mark.parametrize("weights", [(1.0,) * 24, (1.0, 2.5, 0.5)])
def test_shards_equal_brute_force(spark, weights):
    docs = spark.createDataFrame([(None if i == 7 else i * 9973 - 5000, "t") for i in range(700)], "doc_id long, text string")
    for r in assign(docs, weights=weights).collect():
        assert r.shard == winner(r.doc_id, weights) and r.grown_shard == winner(r.doc_id, (*weights, 1.0))


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_rendezvous(spark, sf).collect()
    want = {(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", winner(d, (1.0,) * 24), winner(d, (1.0,) * 25)) for d, t in texts.items()}
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == want and len(got) == len(texts)
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_very_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "é" * 300_000, 1), (2, "", 2), (3, None, 3)], "doc_id long, text string, size int")
    assert {r.doc_id: r["size"] for r in assign(docs).collect()} == {1: 600_008, 2: 8, 3: 8}


def test_counts_that_are_broadcast_are_bounded(spark, monkeypatch):
    assert range_bits(24) == 12 and range_bits(1) == 17 and range_bits(1 << 16) == range_bits(1 << 20) == 1
    assert all(n << range_bits(n) <= sharding.MOST_COUNTS for n in range(1, (1 << 16) + 1, 97))
    docs = spark.range(400).selectExpr("id doc_id", "cast(id as string) text")
    monkeypatch.setattr(sharding, "MOST_COUNTS", 4)
    got = assign(docs, weights=(1.0,) * 5).collect()
    assert len(got) == 400 and all(r.shard == winner(r.doc_id, (1.0,) * 5) for r in got)
    for shard in range(5):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
