"""Language identification by a blended-spectrum string kernel.

A text is the set of its character n-grams, n = 1 to 4, over lower-cased letters and
single blanks, hashed to 2**18 features. The kernel of two texts is the size of the
common set over the root of the product of their sizes. Landmarks are a sample of the
labelled texts; kernel ridge regression, one language against the rest, is solved on the
Nyström features K_nm K_mm^(-1/2). A batch of texts is scored by the product of its
kernel block with the folded weights.

The score is a softmax of the regression scores, but where the best of those is under half
of what 99.5 % of the training texts reach, it falls below 0.3 however few languages there
are: such a text is in none of them.

Only the training sample is bounded: about ``per_language`` labelled texts of each label,
drawn by a hash of id and text, and fewer of each where the labels together would pass ``most``
texts; every label is learned. What is collected are the features of the sample (2**18 bits a
text at most, whatever its length). The model has ``landmarks`` landmarks at most, spread over the
labels or, where there are more labels, over some of them; 2**18 x landmarks bytes and landmarks
x labels weights go to the workers.

Defined results: a null text or one without letters is ``und`` with score 0.0; rows whose
label is null are never learned from; without any labelled row all are ``und``; of equal
scores the first label in alphabetical order wins; repeated rows get the same result; a
text of any length counts whole; an empty table gives no rows; only the named columns are
read, so extra columns with clashing names change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import discard, materialise, with_clear_names

BITS = 18
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Texts scored together; their feature lists are held at once.
BLOCK = 256
#: A score under it is no recognition; texts under the model's least regression score get less.
RECOGNISED = 0.3
_letters: list[np.ndarray] = []
_SLOT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def features(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """Hashed n-grams that a whole text holds, in rising order; empty without letters. ``scratch`` is all False before and after."""
    if not text:
        return np.empty(0, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint64)
    for n in ORDERS:
        size = len(points) - n + 1
        if size <= 0:
            break
        h = points[:size] * _SLOT[0]
        for j in range(1, n):
            h += points[j : j + size] * _SLOT[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
        scratch[(h >> np.uint64(64 - BITS)).astype(np.int64)] = True
    found = np.flatnonzero(scratch)
    scratch[found] = False
    return found


class KernelModel:
    """Landmark features as a dense presence matrix and the folded regression weights."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, row_of: np.ndarray, sizes: np.ndarray, weights: np.ndarray, least: float = 0.1):
        self.languages, self.landmarks, self.row_of, self.sizes, self.weights, self.least = languages, landmarks, row_of, sizes, weights, least

    def kernel(self, found: list[np.ndarray]) -> np.ndarray:
        """Block of kernel values: texts by landmarks."""
        out = np.zeros((len(found), len(self.sizes)))
        for i, f in enumerate(found):
            rows = self.row_of[f]
            rows = rows[rows >= 0]
            if len(rows):
                out[i] = self.landmarks[rows].sum(axis=0, dtype=np.int32) / np.sqrt(self.sizes * len(f))
        return out

    def predict(self, found: list[np.ndarray]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(found), [0.0] * len(found)
        scores = self.kernel(found) @ self.weights
        best = scores.argmax(axis=1)
        odds = np.exp(4.0 * (scores - scores.max(axis=1, keepdims=True)))
        raw = scores.max(axis=1)
        sure = np.where(raw < self.least, np.minimum(1.0 / odds.sum(axis=1), RECOGNISED * np.maximum(raw, 0.0) / self.least), 1.0 / odds.sum(axis=1))
        known = [len(f) > 0 for f in found]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(s) if k else 0.0 for s, k in zip(sure, known, strict=True)]


def fit(texts: list[str], labels: list[str], **parameters) -> KernelModel:
    """A model of labelled texts."""
    scratch = np.zeros(1 << BITS, dtype=bool)
    return fit_features([features(t, scratch) for t in texts], labels, **parameters)


def fit_features(found: list[np.ndarray], labels: list[str], *, landmarks: int = 128, most_landmarks: int = 2048, ridge: float = 1e-2, seed: int = 5) -> KernelModel:
    """Nyström landmarks spread evenly over the languages, then ridge regression in their feature space."""
    pairs = [(f, y) for f, y in zip(found, labels, strict=True) if len(f)]
    languages = sorted({y for _, y in pairs})
    row_of = np.full(1 << BITS, -1, dtype=np.int32)
    if not languages:
        return KernelModel([], np.zeros((0, 0), np.uint8), row_of, np.zeros(0), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    chosen: list[np.ndarray] = []
    share = max(1, landmarks // len(languages))
    of: dict[str, list[np.ndarray]] = {}
    for f, label in pairs:
        of.setdefault(label, []).append(f)
    lead = languages if len(languages) <= most_landmarks else [languages[i] for i in sorted(rng.permutation(len(languages))[:most_landmarks])]
    for language in lead:
        own = of[language]
        chosen += [own[i] for i in sorted(rng.permutation(len(own))[:share])]
    used = np.unique(np.concatenate(chosen))
    row_of[used] = np.arange(len(used), dtype=np.int32)
    presence = np.zeros((len(used), len(chosen)), dtype=np.uint8)
    for j, f in enumerate(chosen):
        presence[row_of[f], j] = 1
    sizes = np.array([len(f) for f in chosen], dtype=np.float64)
    model = KernelModel(languages, presence, row_of, sizes, np.zeros((len(chosen), len(languages))))
    k_mm = model.kernel(chosen)
    values, vectors = np.linalg.eigh((k_mm + k_mm.T) / 2)
    good = values > 1e-8 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = model.kernel([f for f, _ in pairs]) @ whiten
    number = {language: i for i, language in enumerate(languages)}
    label = np.array([number[y] for _, y in pairs])
    balance = 1.0 / np.bincount(label)[label]
    weighted = balance[:, None] * z
    target = np.zeros((z.shape[1], len(languages)))  # of targets 1 for the own language and -1 for the others, never written out
    np.add.at(target.T, label, 2.0 * weighted)
    target -= weighted.sum(axis=0)[:, None]
    solved = np.linalg.solve(z.T @ weighted + ridge / len(pairs) * np.eye(z.shape[1]), target)
    model.weights = whiten @ solved
    best = np.concatenate([(z[at : at + BLOCK] @ solved).max(axis=1) for at in range(0, len(z), BLOCK)])
    model.least = max(0.1, 0.5 * float(np.quantile(best, 0.005)))
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scratch = np.zeros(1 << BITS, dtype=bool)
    for batch in batches:
        found = [features(t.as_py(), scratch).astype(np.int32) for t in batch.column(0)]
        yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["features", "lang", "k"])


def sample(labelled: DataFrame, per_language: int, most: int) -> list[tuple[np.ndarray, str]]:
    """(features, lang) for training: about ``per_language`` texts of each label, fewer where all labels together would pass ``most``, whatever the input's size."""
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "labels")
    labels = counts.count()
    if not labels:
        discard(counts)
        return []
    each = min(per_language, max(1, most // labels))
    share = (F.least(F.lit(1.0), each / F.col("n")) * (1 << 30)).cast("long")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share")
    rows = labelled.join(counts.select("lang", share.alias("share")), "lang").filter(drawn).select("text", "lang", F.xxhash64("text", "doc_id").alias("k"))
    few = rows.orderBy("k", "lang").limit(min(2 * each * labels, 2 * most))
    found = few.mapInArrow(_featured, "features array<int>, lang string, k long").collect()
    discard(counts)
    return [(np.array(r["features"], dtype=np.int64), r["lang"]) for r in sorted(found, key=lambda r: (r["k"], r["lang"]))]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300, most: int = 20_000, landmarks: int = 128, most_landmarks: int = 2048) -> KernelModel:
    """Learn from the documents whose crc32 of the id leaves no 2 when divided by 4.

    The driver gets the features of at most 2 * ``most`` texts, and the model has ``landmarks``
    landmarks, or one for each label where there are more, ``most_landmarks`` at most.
    """
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col, "lang": lang_col})
    labelled = own.filter(~held_out("doc_id") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = sample(labelled, per_language, most)
    return fit_features([f for f, _ in rows], [y for _, y in rows], landmarks=landmarks, most_landmarks=most_landmarks)


def held_out(column: str):
    """A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _predicted(model, position: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.zeros(1 << BITS, dtype=bool)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                langs, scores = model.value.predict([features(t.as_py(), scratch) for t in batch.column(position)])
                yield batch, langs, scores

    return run


def _labelled(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, scores in _predicted(model, 2)(batches):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _recognised(model, position: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, scores in _predicted(model, position)(batches):
            yield batch.filter(pa.array([a != UNKNOWN and b >= least for a, b in zip(langs, scores, strict=True)], pa.bool_()))

    return run


def identify(docs: DataFrame, model: KernelModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, predicted language and score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col}).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return own.mapInArrow(_labelled(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_recognised(docs: DataFrame, model: KernelModel, *, text_col: str = "text", least: float = RECOGNISED) -> DataFrame:
    """The documents in a language that the model knows, with all their columns; a score under ``least`` is no recognition."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_recognised(shared, docs.columns.index(text_col), least), docs.schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
