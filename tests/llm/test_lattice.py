import math
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from spanforge.llm.lattice import BLANK, Lattices, Vocabulary, decode, load, plain_ids, sample_block, sample_segmentations

SMALL = ["", BLANK, "a", "b", BLANK + "a", "ab", "ba", "aba"]


def small():
    return Vocabulary(SMALL, [float(i) for i in range(len(SMALL))], {}, 1.0)


def segmentations(text, v):
    """Every segmentation with its probability."""
    text, names = BLANK + text.replace(" ", BLANK), dict(zip(SMALL, range(len(SMALL)), strict=True))
    out = {}

    def walk(at, ids, w):
        if at == len(text):
            out[tuple(ids)] = math.exp(w)
        for j in range(at + 1, len(text) + 1):
            if text[at:j] in names:
                i = names[text[at:j]]
                walk(j, [*ids, i], w + v.log_weight[i])

    walk(0, [], 0.0)
    total = sum(out.values())
    return {k: p / total for k, p in out.items()}


def test_samples_follow_the_distribution_without_replacement():
    v = small()
    true = segmentations("aba ab", v)
    n, k = 4000, 3
    found = sample_block(["aba ab"] * n, list(range(n)), k, Lattices(v, 2000))
    names = list(true)
    first = Counter(tuple(own[0][0].tolist()) for own in found)
    for s, p in true.items():
        assert abs(first[s] / n - p) < 0.03
    for own in found[:300]:
        ids = [tuple(o[0].tolist()) for o in own]
        assert len(set(ids)) == k and all(i in true for i in ids)
        assert all(abs(o[1] - math.log(true[i])) < 1e-5 for o, i in zip(own, ids, strict=True))
        scores = [o[2] for o in own]
        assert scores == sorted(scores, reverse=True)
    pairs = Counter(tuple(own[1][0].tolist()) for own in found)
    want = {b: sum(true[a] * true[b] / (1 - true[a]) for a in names if a != b) for b in names}
    for s, p in want.items():
        assert abs(pairs[s] / n - p) < 0.03
    # estimates weighted by inclusion are unbiased: they sum to one
    total = np.mean([sum(math.exp(o[1] - o[3]) for o in own) for own in found])
    assert abs(total - 1) < 0.05


def test_all_segmentations_when_there_are_few():
    v = small()
    true = segmentations("ab", v)
    own = sample_block(["ab"], [7], 50, Lattices(v, 2000))[0]
    assert {tuple(o[0].tolist()) for o in own} == set(true) and all(o[3] == 0.0 for o in own)


def test_defined_results_and_round_trip(spark, sf):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a  b\n\nc é 𝔘𓀀", "x"), (4, " lead and trail ", "x"), (5, "y" * 30_000, "x"), (5, "y" * 30_000, "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sample_segmentations(docs, k=3).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert sum(r.doc_id in (1, 2) for r in got) == 2 and all(r.log_inclusion == 0.0 and r.ids == [] for r in got if r.doc_id in (1, 2))
    assert all(r.round_trip for r in got)
    assert len({tuple(r.ids) for r in got if r.doc_id == 5}) == 3 and sum(r.doc_id == 5 for r in got) == 6
    back = decode(sample_segmentations(docs, k=3)).collect()
    assert all(r.text == texts[r.doc_id] for r in back)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(model.decode(r.ids) == texts[r.doc_id] for r in got)
    assert sample_segmentations(docs.limit(0)).count() == 0
    real = sample_segmentations(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all(r.round_trip for r in real) and len({(r.doc_id, tuple(r.ids)) for r in real}) == len(real)


def test_long_segment_has_right_sums():
    v = load()
    text = "unbelievable" * 40
    own = sample_block([text], [3], 2, Lattices(v, 100))[0]
    assert all(v.decode(plain_ids(o[0], v).tolist()) == text for o in own)


def test_any_character_comes_back(spark):
    texts = ["a\0b", "\0", "\0\0 \0", "a\x01b", "日\0本 \U0010ffff", "x" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decode(sample_segmentations(docs, k=3)).collect()
    assert all(r.text == texts[r.doc_id] and r.round_trip for r in got) and len({(r.doc_id, tuple(r.ids)) for r in got}) == len(got)


def test_pieces_longer_than_usual_and_refused_ones():
    v = Vocabulary(["", BLANK, "a", "a" * 40], [0.0, 1.0, 2.0, 3.0], {}, 0.0)
    own = sample_block(["a" * 40], [1], 50, Lattices(v, 100))[0]
    assert v.width == 40 and len(own) == 2 and {len(o[0]) for o in own} == {2, 41}
    try:
        Vocabulary([f"a{BLANK}"], [0.0], {}, 1.0)
    except ValueError:
        return
    raise AssertionError("accepted")


def test_samples_do_not_depend_on_the_block():
    v = load()
    texts, keys = ["one two one two", "", "two  two", "three one"], [5, 6, 7, 8]
    together = sample_block(texts, keys, 3, Lattices(v, 2000))
    alone = [sample_block([t], [key], 3, Lattices(v, 500))[0] for t, key in zip(texts, keys, strict=True)]
    assert [[(o[0].tolist(), *o[1:]) for o in own] for own in together] == [[(o[0].tolist(), *o[1:]) for o in own] for own in alone]


def test_samples_do_not_depend_on_what_the_table_held():
    v = load()
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(1, 14, 3000)]
    blocks = [[" ".join(words[i] for i in rng.integers(0, 3000, 400)) for _ in range(10)] for _ in range(4)]
    emptied, kept, found = Lattices(v, 9_000), Lattices(v, 400_000), []
    for b, texts in enumerate(blocks):
        keys = list(range(b * 10, b * 10 + 10))
        one, other = sample_block(texts, keys, 2, emptied), sample_block(texts, keys, 2, kept)
        assert [[(o[0].tolist(), *o[1:]) for o in own] for own in one] == [[(o[0].tolist(), *o[1:]) for o in own] for own in other]
        found += one
    assert len(emptied.known) < len(kept.known) and all(len(own) == 2 for own in found)


def test_choices_beyond_the_room_of_the_table():
    v = Vocabulary(["", BLANK, *["a" * n for n in range(1, 13)]], [float(n) for n in range(14)], {}, 1.0)
    lattices = Lattices(v, 50)
    own = sample_block(["a" * 40, "a" * 33], [1, 2], 3, lattices)
    assert lattices.used_choices > 3 * 50 and [v.decode(o[0].tolist()) for x in own for o in x] == ["a" * 40] * 3 + ["a" * 33] * 3
