import numpy as np

import corpus_pipeline
from spanforge.llm import bpe, fertility, language
from spanforge.llm.passages import drop_repeats
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_passages import brute as repeat_brute


def test_stages_follow_the_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "substring dedup", "packing"]


def test_run_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r for r in docs.collect() if fertility.measure_text(r.text)[-1]]
    model = language.train(spark.createDataFrame(rows, docs.schema))
    scratch = np.zeros(1 << language.BITS, dtype=bool)
    langs, scores = model.predict([language.features(r.text, scratch) for r in rows])
    rows = [r for r, a, b in zip(rows, langs, scores, strict=True) if a != "und" and b >= 0.3]
    least = {d: c for d, _, c in near_brute([(r.doc_id, r.text) for r in rows], 5)}
    rows = [(r.doc_id, r.text) for r in rows if least[r.doc_id] == r.doc_id]
    texts = dict(repeat_brute(rows))
    got = corpus_pipeline.run(spark, sf).collect()
    encoder = bpe.load()
    assert {r.doc_id for r in got} == set(texts) and 0 < len(texts) < docs.count()
    for d, text in texts.items():
        assert sum(r.length for r in got if r.doc_id == d) == len(encoder.ids(text)) + 1


def test_stages_keep_the_columns(spark):
    words = np.random.default_rng(3)
    text = [" ".join(f"the{i}" for i in words.integers(0, 900, 60)) + "." for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(text)] + [(1, text[1], "en", "s", 5), (None, text[2], None, None, None), (99, None, "en", "s", 0), (98, "", None, "s", 0), (97, text[3] + " more", "en", "t", 9), (None, text[0] + " and more than that", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), "").count() == 0
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted([*map(str, range(12)), "98", "99"])
    assert drop_repeats(docs).count() == len(rows)


def test_a_stage_called_twice_and_two_runs_do_not_meet(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = corpus_pipeline.near_duplicates(spark, docs, "x")
    b = corpus_pipeline.near_duplicates(spark, docs, "x")
    c = corpus_pipeline.near_duplicates(spark, docs.limit(50), "y")
    corpus_pipeline.repeats(spark, docs.limit(5), "y").count()
    assert a.count() == b.count() > 0 and sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())
    c = corpus_pipeline.near_duplicates(spark, docs.limit(50), "z")
    first = corpus_pipeline.run(spark, sf)
    second = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) and c.count() > 0


def test_long_texts_and_clashing_names_pass_all_stages(spark):
    rng = np.random.default_rng(6)
    long_text = ". ".join(" ".join(f"the{i}" for i in rng.integers(0, 5000, 12)) for _ in range(20_000))
    rows = [(i, " ".join(f"the{j}" for j in rng.integers(0, 900, 60)) + ".", "en", i, "k", 0) for i in range(9)] + [(20, long_text, "en", 1, "k", 1), (21, long_text + " more", "en", 1, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key long, root string, grp int")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, "long").collect(), docs.schema)
        assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert 21 not in left and len(left[20]) > 0.9 * len(long_text)
    pieces = corpus_pipeline.packs(spark, out, "long").collect()
    assert sum(r.length for r in pieces if r.doc_id == 20) == len(bpe.load().ids(left[20])) + 1
