"""Boundaries against the pattern, ids and bytes against the public library."""

import base64
import gc
import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import bytebpe, pretokens
from spanforge.llm.bytebpe import codec, decode, encode, merged, op11_bytebpe

SIGNS = "ab s t're've'll 'm  \n\t'd12é!.,''´日本٣'SR ́𝟘🙂\U00013c9d"


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_openings(text):
    return np.cumsum([0, *[len(m.group().encode()) for m in regex.finditer(public_tokenizers.PATTERN, text)]])[:-1].tolist()


def raw_of(text):
    return np.frombuffer(text.encode(), np.uint8)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(SIGNS.replace("\U00013c9d", "")), max_size=30), max_size=5))
def test_scan_equals_the_pattern(texts):
    assert [x.tolist() for x in pretokens.text_openings([raw_of(t) for t in texts])] == [plain_openings(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(SIGNS.replace("\U00013c9d", "")), max_size=200), st.integers(1, 9))
def test_blocks_pass_their_state_on(text, block):
    assert pretokens.long_openings(raw_of(text), block).tolist() == plain_openings(text)


def test_composition_is_associative_and_has_an_identity():
    _, then, functions, _ = pretokens.automaton()
    rng = np.random.default_rng(5)
    f, g, h = rng.integers(0, len(then), (3, 5000))
    assert (then[then[f, g], h] == then[f, then[g, h]]).all() and (then[0, f] == f).all() and (then[f, 0] == f).all()
    assert (functions[then[f, g]] == np.take_along_axis(functions[g], functions[f].astype(int), 1)).all()


def test_every_code_point_is_classed_as_the_library_does():
    own, plain = codec(), library()
    for start in range(0, 0x110000, 0x8000):
        text = "".join(f"a{chr(c)}b 1{chr(c)}" for c in range(start, start + 0x8000) if not 0xD800 <= c < 0xE000)
        raw = text.encode()
        assert own.ids(raw, pretokens.long_openings(raw_of(text)))[0].tolist() == plain.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from(SIGNS), max_size=300))
def test_ids_equal_the_library(text):
    raw = text.encode("utf-8", "ignore")
    ids, starts = codec().ids(raw, pretokens.long_openings(np.frombuffer(raw, np.uint8)))
    assert ids.tolist() == library_of_session.encode_ordinary(raw.decode())
    assert codec().text(ids, starts) == raw


library_of_session = library()


def test_long_slices_merge_as_the_library_does():
    for text in ("a" * 5000, "ab" * 3000, "zqxj" * 900 + "日本" * 700, "=" * 4097, " " * 3000 + "x", "\n" * 2000):
        raw = text.encode()
        assert codec().ids(raw, pretokens.long_openings(raw_of(text)))[0].tolist() == library_of_session.encode_ordinary(text)
    assert merged(b"aaaa", {b"a": 0, b"aa": 1}) == [1, 1]


def test_memory_of_slices_is_bounded(monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 4)
    own = bytebpe.Codec()
    text = " ".join(f"word{i} x" for i in range(50))
    raw = text.encode()
    assert own.ids(raw, pretokens.long_openings(raw_of(text)))[0].tolist() == library_of_session.encode_ordinary(text)
    assert len(own.known) <= 4


def test_rows_of_every_kind(spark, monkeypatch):
    long_text = "Ça va — it's 2024!\n\n  <|endoftext|> wörter " * 60_000
    rows = [(1, "it's  a\ttest", "x", "y"), (2, None, "x", "y"), (3, "", None, None), (None, "no id", "x", "y"), (5, long_text, "x", "y"), (6, "same", "x", "y"), (6, "same", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, starts string").repartition(2)
    coded = decode(encode(docs)).collect()
    assert len(coded) == len(rows)
    for doc_id, text, *_ in rows:
        for r in [r for r in coded if r.doc_id == doc_id]:
            assert r.ids == library_of_session.encode_ordinary(text or "") and bytes(r.decoded) == (text or "").encode()
            sizes = [len(library_of_session.decode_single_token_bytes(i)) for i in r.ids]
            assert r.starts == (np.cumsum(sizes) - sizes).tolist() if sizes else r.starts == []
    assert sorted((r.doc_id or 0) for r in coded) == [0, 1, 2, 3, 5, 6, 6]
    empty = decode(encode(docs.filter("false")))
    assert empty.count() == 0 and empty.columns == ["doc_id", "ids", "starts", "decoded"]


def test_ids_that_stand_for_nothing_decode_to_null(spark):
    rows = [(1, [50256], [0]), (2, [-1], [0]), (3, None, [0]), (4, [5, None], [0, 1]), (5, [5, 6], [0]), (6, [], []), (7, [39, 40], [0, 1])]
    got = {r.k: r.decoded for r in decode(spark.createDataFrame(rows, "k int, ids array<int>, starts array<int>")).collect()}
    assert [got[k] for k in range(1, 6)] == [None] * 5 and bytes(got[6]) == b"" and bytes(got[7]) == library_of_session.decode_bytes([39, 40])


def test_query_on_whole_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_bytebpe(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        ids = library_of_session.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_short_and_long_slices_merge_alike(monkeypatch):
    rng, ranks = np.random.default_rng(7), bytebpe.codec().ranks
    pieces = [bytes(rng.choice(np.frombuffer(b"aeinrst hg\xc3\xa90", np.uint8), rng.integers(1, bytebpe.SHORT_SLICE + 1))) for _ in range(500)]
    short = [bytebpe._merged_short(p, ranks) for p in pieces]
    monkeypatch.setattr(bytebpe, "SHORT_SLICE", 0)
    assert short == [bytebpe.merged(p, ranks) for p in pieces]


def test_remembered_slices_are_bytes_that_no_collector_walks():
    own, text = bytebpe.Codec(), "Ça va — it's 2024!  some slices some slices " + "q" * 60
    raw = text.encode()
    for _ in range(2):  # merged, then remembered
        ids, starts = own.ids(raw, pretokens.long_openings(raw_of(text)))
        assert ids.tolist() == library_of_session.encode_ordinary(text) and own.text(ids, starts) == raw
    assert b" slices" in own.known and not any(len(piece) > bytebpe.SHORT_SLICE for piece in own.known)
    assert not any(gc.is_tracked(ids) for ids in own.known.values())
    assert all(np.frombuffer(ids, np.int32).tolist() == library_of_session.encode_ordinary(piece.decode()) for piece, ids in own.known.items())


def test_offsets_with_gaps_and_out_of_order_are_kept():
    own = codec()
    assert own.text(np.array([39, 40, 262]), np.array([6, 0, 2])) == b"I\0" + own.text(np.array([262]), np.array([0])).ljust(4, b"\0") + b"H"
