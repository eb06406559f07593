"""Spelling variants against a table of all edit distances, and against SQL."""

import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import variants as V
from spanforge.llm.variants import OP12_SQL, Halves, near_words, one_edit, op12_variants, roots, variants, word_counts

SCHEMA = "doc_id long, text string, word string, n string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    near = {w: [v for v in words if distance(w, v) == 1] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


word = st.text(st.sampled_from("abé"), min_size=4, max_size=8)


@settings(max_examples=300, deadline=None)
@given(word, word)
def test_one_edit_is_distance_one(a, b):
    assert one_edit(a, b) == (distance(a, b) == 1)


@settings(max_examples=200, deadline=None)
@given(st.sets(word, max_size=80), st.sets(word, max_size=20), st.sampled_from([0, 2, 12]))
def test_halves_find_each_near_word_once(owners, scanned, few):
    kept, V.FEW = V.FEW, few
    try:
        first, second = Halves(sorted(owners), False), Halves(sorted(owners), True)
        for w in scanned | owners:
            a, b = first.near(w), second.near(w)
            assert not a & b and a | b == {v for v in owners if distance(w, v) == 1}
    finally:
        V.FEW = kept


def test_a_shared_half_costs_no_comparison_with_all(monkeypatch):
    calls = []
    monkeypatch.setattr(V, "one_edit", lambda a, b: calls.append(1) or one_edit(a, b))
    words = [f"prefixprefix{''.join(chr(97 + (i // 26**k) % 26) for k in range(3))}{''.join(chr(97 + (i * 7 // 26**k) % 26) for k in range(9))}" for i in range(4000)]
    halves = Halves(words, False)
    for w in words:
        halves.near(w)
    assert len(calls) < 60 * len(words)


def test_blocks_of_a_hot_shard(spark):
    words = {f"start{chr(97 + i // 26)}{chr(97 + i % 26)}": 3 + i % 50 for i in range(300)} | {f"{chr(97 + i // 26)}{chr(97 + i % 26)}ending": 3 + i for i in range(100)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((w, v, words[v]) for w in words for v in words if distance(w, v) == 1)
    for size in (17, 10_000):
        assert sorted(map(tuple, near_words(df, shard_words=size).collect())) == want
    assert result(variants(df, shard_words=40)) == plain_variants(words)


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [(f"x{i}", "w3") for i in range(50)]
    got = dict(map(tuple, roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w20" for w, _ in chain}


def test_rows_of_every_kind(spark):
    texts = [
        (1, "Colour colour COLOUR colour color color center centre centre centre Ärger Ärger Ärger ärger ärger ärger"),
        (2, "colours colour colour colour colour colour d'accord naïveté naïveté naïveté naivete naivete naivete naïvet"),
        (3, None),
        (4, ""),
        (5, "1234 !!! ab abcd ab-cd_ef"),
        (None, "colour colour center center center centre centre centre centre centre centre centre"),
        (2, "colours colour colour colour colour colour"),
        (2, "colours colour colour colour colour colour"),
        (7, "lorem ipsum dolor loren ipsun dolar " * 3000),
        (8, "x" * 5000 + " " + "x" * 5001 + (" " + "x" * 5000) * 3 + (" " + "x" * 5001) * 9),
        (9, "tokens÷tokens×token's ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿ ßßßßß ßßßßß ßßßßß"),
    ]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA).repartition(3)
    words = plain_counts(texts)
    assert dict(map(tuple, word_counts(docs).collect())) == words
    assert result(variants(word_counts(docs))) == plain_variants(words)
    nothing = variants(word_counts(docs.filter("false")))
    assert nothing.count() == 0 and nothing.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_counts_pass_on_in_parts(spark, monkeypatch):
    rows = [(i, " ".join(f"{c}{d}word{e}" for c in "abcde" for d in "fghij" for e in "klm")) for i in range(6)]
    monkeypatch.setattr(V, "COUNTED", 10)
    parts = list(V._counted(5, 97)(iter(spark.createDataFrame(rows, "doc_id long, text string").toArrow().to_batches())))
    assert len(parts) > 3
    total = Counter()
    for p in parts:
        for r in p.to_pylist():
            total[r["word"]] += r["n"]
    assert {w: n for w, n in total.items() if n >= 3} == plain_counts(rows)


def test_query_equals_plain_words_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    words = plain_counts(map(tuple, docs))
    got = op12_variants(spark, sf).collect()
    assert {r.word: r.n for r in got} == words


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    sf = f"/root/testdata/{size}"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = duckdb.sql(OP12_SQL)
    got = op12_variants(spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    columns = want.columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
