import re

import duckdb
import numpy as np
import pytest

from spanforge.llm.graph import components
from spanforge.llm.minhash import OP7_SQL, common_counts, keep_one, near_duplicates, op7_minmax, spanning
from spanforge.llm.words import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, width):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, width):
    """(n_shingles, component) of each (doc_id, text), all pairs compared."""
    sets = [sets_of(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 10 >= 8 * max(len(a), len(b)):
                inter = len(a & b)
                if 100 * inter >= 80 * (len(a) + len(b) - inter):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def shuffled_copies(n, words, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, edits):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_word_hashes_follow_the_words():
    a, b = word_hashes("Ab cd\x1cé\n\n AB  x"), WORD.findall("Ab cd\x1cé\n\n AB  x")
    assert len(a) == len(b) and a[0] == a[2] and len(set(a.tolist())) == 3
    assert word_hashes("z" * 9000)[0] == word_hashes("y " * 5000 + "z" * 9000)[-1]


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, k, dtype=np.uint64)) for k in (5, 3000, 4000, 1, 2500)]
    assert common_counts(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def test_components_of_paths(spark):
    rng = np.random.default_rng(1)
    name = rng.permutation(300).tolist()
    rows = [(name[i], name[i + 1]) for i in range(299) if i % 50 != 49]
    want = {n: min(name[i - i % 50 : i - i % 50 + 50]) for i, n in enumerate(name)}
    assert {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()} == want


@pytest.mark.parametrize("block", [256, 7])
def test_equals_brute_force(spark, block):
    texts = [None, "", " \n", "a b", "A  b", "one", "a b c d", *shuffled_copies(40, 120, 3, 1), *shuffled_copies(25, 60, 2, 2), *shuffled_copies(12, 300, 14, 3), "z" * 5000, " ".join(f"q{i}" for i in range(20_000))]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(None, texts[10]), (None, "a null alone x"), (5000, texts[12]), (5000, texts[12]), (5001, "")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, key int")
    got = near_duplicates(docs, width=4, block=block).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got])) == sorted(map(str, brute(rows, 4)))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op7_minmax(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(brute(rows, 4))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(OP7_SQL).fetchall()) and got.columns == duckdb.sql(OP7_SQL).columns


def test_spanning_trees_are_the_components():
    rng = np.random.default_rng(6)
    for n, share in ((300, 0.004), (300, 0.02), (200, 0.5)):
        m = rng.random((n, n)) < share
        m |= m.T
        side = rng.integers(0, 2, n)
        for left, right in ((np.arange(n), np.arange(n)), (np.flatnonzero(side == 0), np.flatnonzero(side == 1))):
            use = np.zeros((n, n), bool)
            use[np.ix_(left, right)] = m[np.ix_(left, right)]
            use |= use.T
            want = np.arange(n)
            for _ in range(n):
                want = np.minimum(want, np.where(use, want[None, :], n).min(axis=1))
            assert spanning(n, left, right, lambda i, rows, m=m: m[i, rows]).tolist() == want.tolist()


@pytest.mark.parametrize("block", [16_384, 90])
def test_large_group_in_blocks(spark, block):
    texts = [*shuffled_copies(260, 90, 4, 5), *shuffled_copies(120, 40, 2, 6)]
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 5))


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = shuffled_copies(1, 50, 0, 1)[0], shuffled_copies(1, 50, 0, 2)[0], shuffled_copies(1, 50, 0, 3)[0]
    rows = [(1, a, "p"), (None, a, "q"), (None, b, "r"), (5, c, "s"), (5, a, "t"), (7, c, "u"), (None, None, "v"), (8, "", "w"), (8, "", "x"), (9, " ", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = keep_one(docs)
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert kept.columns == docs.columns and got == sorted([("1", a), ("None", b), ("5", c), ("None", ""), ("8", ""), ("9", " ")])


def test_many_rows_without_or_with_the_same_id(spark):
    texts = [t for k in range(10) for t in shuffled_copies(10, 80, 1, 20 + k)]
    rows = [(None, t) for t in texts[:50]] + [(3, t) for t in texts[50:]] + [(None, texts[0])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs)
    assert got.count() == len(rows) and sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()])) == sorted(map(str, brute(rows, 5)))
    assert keep_one(docs).count() == len({c for *_, c in brute(list(enumerate(texts)), 5)})


def test_very_long_texts(spark):
    rng = np.random.default_rng(14)
    words = rng.integers(0, 50_000, 200_000)
    near, far = words.copy(), words.copy()
    near[rng.integers(0, len(words), 2000)] += 50_000
    far[rng.integers(0, len(words), 30_000)] += 50_000
    rows = [(i, " ".join(map(str, w.tolist()))) for i, w in enumerate((words, near, far))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4))


def test_of_rows_with_the_same_id_and_text_the_least_by_all_columns_stays(spark):
    rows = [(1, "one two three four five six", c, {"k": c}) for c in ("z", "m", "b", "q")] + [(2, "", "y", {"k": "y"}), (2, "", "a", {"k": "a"})]
    for parts in (1, 3):
        got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string, extra map<string,string>").repartition(parts)).collect()
        assert sorted((r.doc_id, r.row, r.extra["k"]) for r in got) == [(1, "b", "b"), (2, "a", "a")]
