"""Quality rules from tokeniser fertility.

Two public vocabularies read every whole text: a byte-level BPE (characters per token,
token entropy) and a piece BPE with byte fallback (characters per piece, share of byte
pieces). Bands per script say what is rejected. Entropy is taken as a share of what as
many distinct tokens, 1,024 at most, would have; prose uses up that share as it grows
longer, so the least one of a script that was measured follows the number of tokens.

Defined results: a null text counts as empty (all counts 0, base failed, rejected);
repeated rows are measured each for itself; ties cannot arise, as every row is judged
alone; a very long text is measured whole, in memory in proportion to its length; an empty
table gives no rows; the measures read only ``doc_id`` and ``text`` and name their output
columns themselves, so extra columns and clashing names change nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm import bpe
from spanforge.llm.storage import with_clear_names
from spanforge.llm.words import word_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
BLANK = "▁"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: First code point and script, in rising order; a letter belongs to the last one not above it.
SCRIPTS = [(0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x31350, "other")]
STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = [b for _, b in SCRIPTS]

#: Least and most characters per token of the byte vocabulary, most share of byte pieces,
#: least share of the possible token entropy.
BANDS = {
    "latin": (1.3, 8.0, 0.20, 0.40),
    "greek": (0.4, 6.0, 0.30, 0.35),
    "cyrillic": (0.4, 6.0, 0.30, 0.35),
    "hebrew": (0.35, 6.0, 0.60, 0.30),
    "arabic": (0.35, 6.0, 0.60, 0.30),
    "indic": (0.2, 6.0, 0.90, 0.25),
    "thai": (0.2, 6.0, 0.90, 0.25),
    "hangul": (0.25, 6.0, 0.90, 0.25),
    "kana": (0.25, 6.0, 0.80, 0.25),
    "han": (0.25, 6.0, 0.80, 0.25),
    "other": (0.2, 10.0, 0.95, 0.20),
    "none": (1.0, 8.0, 0.05, 0.50),
}

#: Tokens and least entropy share there, straight lines over the logarithm between them:
#: mean less 2.5 deviations of the 3,302 documents labelled good at sf0.1, all of them
#: Latin. A script without labelled documents has the constant of its band.
LEAST_ENTROPY = {"latin": ((40, 0.893), (80, 0.834), (160, 0.779), (320, 0.720), (640, 0.662), (1280, 0.626), (2560, 0.643), (5120, 0.641))}
#: Numbers fall into few tokens whatever they say; no labelled document has more digits
#: than this among its characters, and beyond it the constant of the band holds.
MOST_DIGITS = 0.15
COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "script": pa.string(), "chars_per_token": pa.float64(), "chars_per_piece": pa.float64(), "byte_share": pa.float64(), "entropy_share": pa.float64(), "reject_reason": pa.string(), "kept": pa.bool_()}
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, chars_per_token double, chars_per_piece double, byte_share double, entropy_share double, reject_reason string, kept boolean"

_SLOT = np.random.default_rng(20).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
#: Words whose pieces a worker remembers.
REMEMBERED = 60_000
_BLANKS_AND_WORD = re.compile(" +[^ ]*")
_loaded: dict = {}


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in windows of eight words found at least twice, the first one included; ``words`` are hashes."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = words[:n] * _SLOT[0]
    for j in range(1, WINDOW):
        h += words[j : j + n] * _SLOT[j]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    cover[at] += 1
    cover[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(cover)))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = word_hashes(text, fold=False)
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dups, repeated_words(words)


def entropy_share(ids: np.ndarray) -> float:
    """Shannon entropy of the tokens over the logarithm of their number, 1,024 at most; 1.0 below two tokens."""
    n = len(ids)
    if n < 2:
        return 1.0
    ids = np.sort(ids)
    counts = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
    return float(max(0.0, math.log(n) - (counts * np.log(counts)).sum() / n) / math.log(min(n, 1024)))


def main_script(text: str) -> str:
    """Script of most letters; ``none`` without letters."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    letters = np.frombuffer("".join(filter(str.isalpha, text)).encode("utf-32-le"), dtype="<u4")
    if not len(letters):
        return "none"
    counts = np.bincount(np.searchsorted(STARTS, letters, "right") - 1, minlength=len(NAMES))
    total: dict[str, int] = {}
    for name, k in zip(NAMES, counts.tolist(), strict=True):
        total[name] = total.get(name, 0) + k
    return max(sorted(total), key=total.get)


class Pieces:
    """Counts of pieces and of byte pieces by the piece vocabulary.

    No piece spans the start of a blank run, so a text's pieces are those of its words,
    each with the blanks before it; what a word gives is remembered.
    """

    def __init__(self, folder: str | None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k", ".model", folder))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.starts = np.array([self.model.id_to_piece(i).startswith(BLANK) for i in range(self.model.vocab_size())])
        self.known: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        plain = [w for w in new if w and " " not in w]
        if plain:  # each begins with a piece of its own, so one call does for all
            ids = np.array(self.model.encode(" ".join(plain)))
            first = np.flatnonzero(self.starts[ids])
            whole = np.diff(first, append=len(ids)) + (np.add.reduceat(self.is_byte[ids], first, dtype=np.int64) << 32)
            self.known.update(zip(plain, whole.tolist(), strict=True))
        for word in new:
            if word not in self.known:
                ids = self.model.encode(word)
                # the encoder puts one blank in front, and gives nothing for that alone
                self.known[word] = (len(ids) or 1) + (int(np.count_nonzero(self.is_byte[ids])) << 32 if ids else 0)

    def counts(self, text: str) -> tuple[int, int]:
        """Pieces and byte pieces of a whole text."""
        if not text:
            return 0, 0
        led = f" {text}".replace(BLANK, " ")  # the vocabulary's own sign for a blank
        words = [m[1:] for m in _BLANKS_AND_WORD.findall(led)] if "  " in led else led.split(" ")[1:]
        try:
            total = sum(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(set(words))
            total = sum(map(self.known.__getitem__, words))
        return total & 0xFFFFFFFF, total >> 32


def _pieces(folder: str | None) -> Pieces:
    if folder not in _loaded:
        _loaded[folder] = Pieces(folder)
    return _loaded[folder]


def least_share(script: str, text: str, tokens: int) -> float:
    """Least entropy share of a text of so many tokens by LEAST_ENTROPY; 0.0 where nothing was measured."""
    line = LEAST_ENTROPY.get(script)
    if not line or sum(map(text.count, "0123456789")) > MOST_DIGITS * len(text):
        return 0.0
    return float(np.interp(math.log(max(1, tokens)), [math.log(n) for n, _ in line], [x for _, x in line]))


def verdict(script: str, per_token: float, byte_share: float, entropy: float, bands=BANDS, least: float = 0.0) -> str | None:
    """First band that the measures leave, or None; ``least`` raises the band's own entropy share."""
    low, high, most_bytes, least_entropy = bands.get(script, bands["other"])
    if per_token < low:
        return "few_chars_per_token"
    if per_token > high:
        return "many_chars_per_token"
    if byte_share > most_bytes:
        return "byte_fallback"
    return "low_entropy" if entropy < max(least, least_entropy) else None


def measure_text(text: str | None, bands=BANDS, folder: str | None = None) -> tuple:
    """The values of COLUMNS for one whole text."""
    text = text or ""
    n_words, word_chars, n_symbols, dups, repeats = base_counts(text)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    ids = bpe.load(folder=folder).ids(text)
    pieces, bytes_ = _pieces(folder).counts(text)
    per_token, per_piece = len(text) / max(1, len(ids)), len(text) / max(1, pieces)
    share = bytes_ / max(1, pieces)
    entropy, script = entropy_share(ids), main_script(text)
    reason = "base" if failed else verdict(script, per_token, share, entropy, bands, least_share(script, text, len(ids)))
    return n_words, word_chars, n_symbols, dups, repeats, failed, script, per_token, per_piece, share, entropy, reason, reason is None


def _scored(bands, folder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure_text(t.as_py(), bands, folder) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
            yield pa.record_batch([batch.column(0), *[pa.array(c, kind) for c, kind in zip(columns, COLUMNS.values(), strict=True)]], names=["doc_id", *COLUMNS])

    return run


def _kept(bands, folder, position):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure_text(t.as_py(), bands, folder)[-1] for t in batch.column(position)], pa.bool_()))

    return run


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, folder: str | None = None) -> DataFrame:
    """A row per document: the base counts, the fertility measures and the verdict."""
    return with_clear_names(docs, {"doc_id": id_col, "text": text_col}).mapInArrow(_scored(bands, folder), f"doc_id long, {DDL}")


def keep_good(docs: DataFrame, *, text_col: str = "text", bands=BANDS, folder: str | None = None) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return docs.mapInArrow(_kept(bands, folder, docs.columns.index(text_col)), docs.schema)


def op1_fertility(spark, sf_dir: str) -> DataFrame:
    """All documents under the production bands."""
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
