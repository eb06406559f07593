from collections import defaultdict

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm.passages import cut, drop_repeats, op6_passages, repeated_spans, units, without
from tests.llm import plain_passages


def brute(rows, least_run=16):
    """Texts left, with all units of all texts in one table."""
    rank = [d if d is not None else float("inf") for d, _ in rows]
    least = defaultdict(lambda: float("inf"))
    for r, (_, t) in zip(rank, rows, strict=True):
        for *_, plain in units(t or ""):
            least[plain] = min(least[plain], r)
    out = []
    for r, (d, t) in zip(rank, rows, strict=True):
        if t is None:
            out.append((d, None))
            continue
        repeats = {i for i, (*_, plain) in enumerate(units(t)) if least[plain] < r}
        out.append((d, without(t, repeated_spans(t, repeats, least_run))))
    return out


def test_units_cover_the_text():
    for text in ["", "one two. three four five six. seven", "a b c\n\nd e f g h\n", "x " * 300, "Hi. There is more to say! Ok?\nEnd of it all now", " \n "]:
        spans = [(a, b) for a, b, *_ in units(text)]
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and (not spans or (spans[0][0] == 0))
        assert not spans or not text[spans[-1][1] :].strip()


def sentences(rng, n):
    return " ".join(" ".join(f"w{i}" for i in rng.integers(0, 900, rng.integers(4, 12))).capitalize() + "." for _ in range(n))


def test_passages_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(2)
    passage, bare = sentences(rng, 8), " ".join(f"v{i}" for i in rng.integers(0, 9000, 80))
    clean = [sentences(rng, 12) for _ in range(20)]
    texts = [f"{sentences(rng, 3)} cut here {passage} and {sentences(rng, 2)}" for _ in range(6)]
    runs = [f"{sentences(rng, 3)} cut here {bare} and {sentences(rng, 2)}" for _ in range(4)]
    rows = list(enumerate([*clean, *texts, *runs, None, "", "short one.", "short one.", texts[0] + "\n" + passage])) + [(None, texts[0]), (3, clean[5]), (40, texts[1]), (40, texts[1])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row_key int, removed string")
    got = [(r.doc_id, r.text) for r in drop_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    left = dict(got[: len(got)])
    assert all(left[i] == clean[i] for i in range(20) if i not in (3, 5))
    assert sum(passage in t for t in texts) == 6 and sum(passage in (t or "") for _, t in got) == 1
    assert sum(bare in (t or "") for _, t in got) == 1
    assert drop_repeats(docs.limit(0)).count() == 0


def test_offsets_refer_to_the_original(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_passages(spark, sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(sorted(texts.items())))
    for r in got:
        assert without(texts[r.doc_id], [(s.start, s.end) for s in r.removed]) == r.text


def words(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))


def test_passages_pasted_into_a_line_are_found():
    rng = np.random.default_rng(7)
    for passage in [f"{words(rng, 27)}. {words(rng, 27)}" for _ in range(100)] + [words(rng, n) for n in (52, 60) for _ in range(100)]:
        first, second = f"{words(rng, 30)} {passage} {words(rng, 25)}", f"{words(rng, 40)} {passage} {words(rng, 33)}"
        known = {plain for *_, plain in units(first)}
        spans = repeated_spans(second, {i for i, (*_, plain) in enumerate(units(second)) if plain in known})
        gone = " ".join(second[a:b].strip() for a, b in spans)
        assert gone in passage and len(gone.split()) > 0.5 * len(passage.split())


def test_short_lines_go_but_for_the_earliest(spark):
    rng = np.random.default_rng(8)
    line = "Licensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame([(i, f"{sentences(rng, 3)}\n{line}\n{sentences(rng, 3)}") for i in range(6)] + [(9, f"{sentences(rng, 2)} {line} {sentences(rng, 2)}")], "doc_id long, text string")
    left = {r.doc_id: r.text for r in drop_repeats(docs).collect()}
    assert [i for i, t in sorted(left.items()) if line in t] == [0, 9]


def test_rows_without_an_id_or_with_the_same_lose_repeats(spark):
    rng = np.random.default_rng(9)
    passage = sentences(rng, 8)
    for doc_id in (None, 4):
        docs = spark.createDataFrame([(doc_id, f"{sentences(rng, 2)} {passage} {sentences(rng, 2)}") for _ in range(5)], "doc_id long, text string")
        assert sum(passage in r.text for r in drop_repeats(docs).collect()) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b.", "C", "İd", "É", "long", "word", 'x."', "ok?!", ".", "日本。", "\n", "\n\n", "\x1c", "\x85", "\u2003", "𝔘", "q)", "end.)"]), max_size=60).map(" ".join), max_size=4))
def test_units_equal_the_plain_rules(texts):
    u = cut(texts)
    names = {}
    for i, text in enumerate(texts):
        a, b = u.first[i], u.first[i + 1]
        want = list(plain_passages.units(text))
        assert [(x, y, n) for x, y, n, _ in want] == list(zip(u.start[a:b].tolist(), u.end[a:b].tolist(), u.words[a:b].tolist(), strict=True))
        assert [(x, y, n) for x, y, n, _ in want] == [(x, y, n) for x, y, n, _ in units(text)]
        for (*_, what), d in zip(want, zip(u.d1[a:b].tolist(), u.d2[a:b].tolist(), strict=True), strict=True):
            assert names.setdefault(what, d) == d
        assert u.repeated[a:b].tolist() == [what in [w for *_, w in want[:k]] for k, (*_, what) in enumerate(want)]
    assert len(set(names.values())) == len(names)


def test_query_equals_the_plain_rules(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted((r.doc_id, r.text) for r in op6_passages(spark, sf).collect()) == sorted(plain_passages.brute(sorted(texts.items())))


def test_very_long_text(spark):
    rng = np.random.default_rng(11)
    long = words(rng, 300_000)
    docs = spark.createDataFrame([(1, long), (2, f"before {long}"), (3, "x" * 500_000), (4, "y " * 200_000)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in drop_repeats(docs).collect()}
    assert left[1] == long and len(left[2]) < 200 and left[3] == "x" * 500_000 and len(left[4]) <= 400_000


def test_lines_alone_are_the_plain_method(spark):
    rng = np.random.default_rng(13)
    pool = ["one", "two words", "A  third line here", "", " ", *[words(rng, 9) for _ in range(6)]]
    rows = [(i, "\n".join(pool[j] if j < len(pool) else words(rng, 7) for j in rng.integers(0, 16, 8))) for i in range(30)]
    seen, want = set(), {}
    for i, text in rows:
        left = []
        for line in text.splitlines(keepends=True):
            name = " ".join(line.lower().split())
            if not name or name not in seen:
                left.append(line)
            seen.add(name)
        want[i] = "".join(left)
    got = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), sentences=False, least_line=1).collect()}
    # blank lines belong to the line after them, so what is left is compared without them
    plain = lambda text: [" ".join(x.split()) for x in text.splitlines() if x.strip()]
    assert {i: plain(r.text) for i, r in got.items()} == {i: plain(t) for i, t in want.items()}
    for i, r in got.items():
        assert without(dict(rows)[i], [(s.start, s.end) for s in r.removed]) == r.text


def test_one_of_rows_with_the_same_id_and_text_stays_whole(spark):
    rng = np.random.default_rng(12)
    text = "\n".join(" ".join(words(rng, 30)) for _ in range(3))
    other = " ".join(words(rng, 40))
    rows = [(1, text, "a"), (1, text, "b"), (1, text, "c"), (None, other, "d"), (None, other, "d"), (2, other, "e"), (3, "short one", "f"), (3, "short one", "f")]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string, row_key string").repartition(3)).collect()
    assert sorted(r.row_key for r in got) == sorted(r[2] for r in rows)
    whole = [r.text for r in got if r.doc_id == 1]
    assert sorted(map(len, whole)) == [0, 0, len(text)]
    assert {r.row_key: r.text for r in got}["e"] == other  # ids rank before rows without one
    assert [r.text for r in got if r.doc_id is None] == ["", ""]
    assert [r.text for r in got if r.doc_id == 3] == ["short one"] * 2
    for r in got:
        if r.doc_id == 1 and not r.text:
            assert [(x.start, x.end) for x in r.removed] == [(0, len(text))]
