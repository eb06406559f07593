import zlib

import numpy as np

from spanforge.llm.language import BITS, ORDERS, _SLOT, features, fit, held_out, identify, keep_recognised, op4_language, sample, train


def grams(text):
    kept, out = [" "], set()
    for c in text.lower():
        if c.isalpha() or kept[-1] != " ":
            kept.append(c if c.isalpha() else " ")
    kept.append(" ")
    for n in ORDERS:
        for i in range(len(kept) - n + 1):
            h = sum(ord(kept[i + j]) * int(_SLOT[j]) for j in range(n)) % 2**64
            out.add(((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n)) % 2**64 >> (64 - BITS))
    return sorted(out)


def test_features_equal_brute_force():
    scratch = np.zeros(1 << BITS, dtype=bool)
    for text in ["Ab, c!", "éÀß 9x", "a", "x" * 50]:
        assert features(text, scratch).tolist() == grams(text)
    assert not scratch.any() and len(features("12 !?", scratch)) == 0 and len(features(None, scratch)) == 0


def test_kernel_is_the_normalised_common_share():
    texts = ["aber und der", "the and for", "und das der", "then and of"]
    model = fit(texts, ["de", "en", "de", "en"], landmarks=4)
    scratch = np.zeros(1 << BITS, dtype=bool)
    found = [features(t, scratch) for t in texts]
    k = model.kernel(found)
    want = {round(len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)), 12) for a in found for b in found}
    assert {round(float(x), 12) for x in k.ravel()} == want
    assert model.predict(found)[0] == ["de", "en", "de", "en"]


def test_defined_results(spark):
    rows = [(i, t, y, "x") for i, (t, y) in enumerate([("der und das ist gut", "de"), ("the cat and the dog", "en"), (None, "de"), ("123 !", "en"), ("und der und das", None)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    assert len(got) == len(rows)
    for i, text, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == ("und" if text in (None, "123 !") else lang or "de")
        assert 0 <= got[i].score <= 1
    assert {r.text for r in keep_recognised(docs, train(docs)).collect()} == {t for _, t, _, _ in rows if t and t != "123 !"}
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in identify(unlabelled, train(unlabelled)).collect()} == {"und"}
    assert identify(docs.limit(0), train(docs)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op4_language(spark, sf).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_texts_in_no_learned_language_are_not_recognised(spark):
    rng = np.random.default_rng(3)
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.lang and r.text and len(r.text.split()) >= 20]
    foreign = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.", "Все люди рождаются свободными и равными в своем достоинстве и правах."]
    junk = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)) for n in (20, 100, 400) for _ in range(10)]
    scratch = np.zeros(1 << BITS, dtype=bool)
    for languages in (["en", "de", "fr", "es"], ["en", "de"], ["en"]):
        own = [r for r in docs if r.lang in languages]
        held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in own]
        model = fit([r.text for r, h in zip(own, held, strict=True) if not h], [r.lang for r, h in zip(own, held, strict=True) if not h])
        scores = {name: np.array(model.predict([features(t, scratch) for t in texts])[1]) for name, texts in {"none": foreign + junk, "held": [r.text for r, h in zip(own, held, strict=True) if h]}.items()}
        assert (scores["none"] < 0.3).all() and (scores["held"] >= 0.3).mean() > 0.98


def test_prediction_equals_the_dual_solution(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", "lang").limit(150).collect() if r.lang and r.text]
    texts, labels = [r.text for r in rows], [r.lang for r in rows]
    model = fit(texts, labels, landmarks=32, ridge=0.5)
    sets = [set(grams(t[:400])) for t in texts[:25]]
    scratch = np.zeros(1 << BITS, dtype=bool)
    every = [set(features(t, scratch).tolist()) for t in texts]
    assert all(set(features(t[:400], scratch).tolist()) == s for t, s in zip(texts, sets, strict=False))
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    names = [i for i in range(model.landmarks.shape[1])]
    held = {tuple(np.flatnonzero(model.landmarks[:, j]).tolist()): j for j in names}
    rows_of = np.flatnonzero(model.row_of >= 0)
    marks = [set(rows_of[list(k)].tolist()) for k, _ in sorted(held.items(), key=lambda x: x[1])]
    assert len(marks) == len(names) and all(m in every for m in marks)
    languages, n = sorted(set(labels)), len(labels)
    y = np.array([[1.0 if a == b else -1.0 for b in languages] for a in labels])
    weight = np.array([1.0 / labels.count(a) for a in labels])
    inner = np.linalg.pinv(kernel(marks, marks), rcond=1e-8, hermitian=True)
    nm = kernel(every, marks)
    alpha = np.linalg.solve(nm @ inner @ nm.T + np.diag(0.5 / n / weight), y)
    want = kernel(sets, marks) @ inner @ nm.T @ alpha
    got = model.kernel([np.array(sorted(s)) for s in sets]) @ model.weights
    assert np.abs(got - want).max() < 1e-6
    assert model.predict([np.array(sorted(s)) for s in sets])[0] == [languages[i] for i in want.argmax(axis=1)]


def test_every_label_is_learned_and_ties_go_to_the_first(spark):
    rng = np.random.default_rng(4)
    alphabet = [chr(0x4E00 + 40 * k) for k in range(260)]
    rows = [(i, "".join(chr(ord(alphabet[i % 260]) + int(x)) for x in rng.integers(0, 30, 40)), f"l{i % 260:03}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert len(model.languages) == 260
    got = {r.doc_id: r.lang_pred for r in identify(docs, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.9
    tied = fit(["ab ab", "ab ab"], ["b", "a"], landmarks=2)
    scratch = np.zeros(1 << BITS, dtype=bool)
    assert tied.predict([features("ab ab", scratch)])[0] == ["a"]


def test_very_long_text(spark):
    rows = [(i, "der und das ist gut", "de") for i in range(8)] + [(i, "the cat and the dog", "en") for i in range(8, 16)]
    docs = spark.createDataFrame([*rows, (50, "das und der " * 100_000, None), (51, "x" * 500_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, train(docs)).collect()}
    assert got[50] == "de" and got[51] in ("de", "en")


def test_the_sample_is_bounded_whatever_the_number_of_labels(spark):
    rows = [(4 * i, f"{chr(97 + i % 26) * 3} {chr(97 + i // 26 % 26) * 4} word{i}", f"l{i % 90:03}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, per_language=50, most=180, landmarks=16, most_landmarks=16)
    assert len(model.languages) > 60 and model.weights.shape[0] <= 16 and model.weights.shape[1] == len(model.languages)
    assert len(sample(docs.filter(~held_out("doc_id")), 50, 180)) <= 360
