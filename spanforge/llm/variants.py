"""Spelling variants: words one edit apart, found by automata over the halves of words.

One edit leaves one half of a word as it was: its first half still opens the other word, or
its second half still closes it. So an Aho-Corasick automaton holds the halves of the words
of a shard, every word is run through the automata, and a hit counts when the half lies at
its end of the word and the lengths differ by one at most. Then the distance is verified:
owners of a half that have one length are compared directly when they are few, else their
rests are halved again in the same way, so a half that very many words share costs no
comparison with each of them.

Shards: a first half has two code points at least, and a hit has to lie at the start, so an
automaton for words that start alike is needed by words with the same two first code points
only (for second halves: the same two last ones). These pairs are dealt to shards by hash, and
a word visits one shard for each end. A shard with more than ``shard_words`` words is cut into parts;
each part of the owners meets each part of the words in a block of its own, so that no
task holds more than two parts, whatever share of the words starts alike.

Words are counted by task before any shuffle; links leave the blocks as rows and are
aggregated, never gathered by word. Roots are found by pointer jumping, in as many rounds as
the logarithm of the longest chain of forms, each written to the shared folder, so a lost executor costs a
part of one step.

Defined results: a null or empty text has no words; a null doc_id counts as the empty text
before the colon; repeated rows count each for itself (equal ids give equal slips); of near words with
the same count the smallest in code-point order is the form; forms have twice the count, so
chains end; an empty table gives no rows; texts of any length are read whole; only the named
columns are read, so extra columns with clashing names change nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.storage import discard, materialise, with_clear_names

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 17
#: Owners of a half that are compared one by one; more are halved again.
FEW = 12


# --- words
def slipped(prefix: bytes, run: str, every: int) -> str:
    """The run, or without one code point where ``every`` divides the checksum of its document and itself."""
    h = zlib.crc32(run.encode(), zlib.crc32(prefix))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_length: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                prefix = f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode()
                for word, n in Counter(_RUN.findall(bytes(text.as_buffer()).lower().decode())).items():
                    if len(word) >= least_length:
                        word = slipped(prefix, word, every)
                        if len(word) >= least_length:
                            total[word] = total.get(word, 0) + n
                if len(total) >= COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    return run


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, slips applied, that are long and frequent enough."""
    own = with_clear_names(docs, {"doc_id": id_col, "text": text_col}).select("doc_id", F.col("text").cast("string").alias("text"))
    parts = own.mapInArrow(_counted(least_length, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- near words
def one_edit(a: str, b: str) -> bool:
    """The two differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    if len(a) == len(b):
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    return len(a) == len(b) + 1 and a[i + 1 :] == b[i:]


class Rests:
    """What is left of words of one length beside a half that they share: (rest, word) pairs with rests of one length."""

    def __init__(self):
        self.pairs: list[tuple[str, str]] = []
        self.heads: dict[str, Rests] | None = None
        self.tails: dict[str, Rests] = {}

    def add(self, rest: str, word: str) -> None:
        self.pairs.append((rest, word))

    def _halve(self, half: int) -> None:
        self.heads = {}
        for rest, word in self.pairs:
            self.heads.setdefault(rest[:half], Rests()).add(rest[half:], word)
            self.tails.setdefault(rest[half:], Rests()).add(rest[:half], word)

    def near(self, x: str, found: set[str]) -> None:
        """Adds the words whose rest is one edit from ``x``; lengths differ by one at most."""
        size = len(self.pairs[0][0])
        if len(self.pairs) <= FEW or size < 2:
            found.update(word for rest, word in self.pairs if one_edit(rest, x))
            return
        half = size // 2
        if self.heads is None:
            self._halve(half)
        cut = len(x) - (size - half)
        if (same := self.heads.get(x[:half])) is not None:
            same.near(x[half:], found)
        if cut >= 0 and (same := self.tails.get(x[cut:])) is not None:
            same.near(x[:cut], found)


class Halves:
    """Automaton over the first halves of words, or over their second halves."""

    def __init__(self, words: list[str], second: bool):
        self.second = second
        held: dict[str, dict[int, Rests]] = {}
        for w in words:
            cut = len(w) // 2
            part, rest = (w[cut:], w[:cut]) if second else (w[:cut], w[cut:])
            held.setdefault(part, {}).setdefault(len(w), Rests()).add(rest, w)
        self.automaton = ahocorasick.Automaton()
        for part, owners in held.items():
            self.automaton.add_word(part, (len(part), owners))
        if held:
            self.automaton.make_automaton()

    def near(self, word: str) -> set[str]:
        """Words of the automaton one edit from ``word`` that keep their half there; second halves only where the first one is not kept."""
        found: set[str] = set()
        if not len(self.automaton):
            return found
        n = len(word)
        for end, (size, owners) in self.automaton.iter(word):
            if (end + 1 != n) if self.second else (end + 1 != size):
                continue
            rest = word[: n - size] if self.second else word[size:]
            for length in (n - 1, n, n + 1):
                if length in owners:
                    owners[length].near(rest, found)
        return {w for w in found if not word.startswith(w[: len(w) // 2])} if self.second else found


def _block(table: pa.Table) -> pa.Table:
    second = table["second"][0].as_py()
    owner = table["owner"].to_pylist()
    word, n = table["word"].to_pylist(), table["n"].to_pylist()
    count = {w: k for w, k, own in zip(word, n, owner, strict=True) if own}
    halves = Halves(list(count), second)
    out: list[list] = [[], [], []]
    for w, own in zip(word, owner, strict=True):
        if not own:
            for v in halves.near(w):
                out[0].append(w)
                out[1].append(v)
                out[2].append(count[v])
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "near_n": pa.array(out[2], pa.int64())})


def near_words(words: DataFrame, *, shard_words: int = 30_000) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart. ``words`` has distinct words of four code points or more and their counts."""
    shards = max(1, -(-words.count() // shard_words))
    ends = F.array(*[F.struct(F.lit(bool(k)).alias("second"), F.pmod(F.xxhash64(F.lit(k), F.substring("word", at, 2)), F.lit(shards)).alias("shard")) for k, at in ((0, 1), (1, -2))])
    visits = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.*")
    parts = visits.groupBy("second", "shard").agg(F.ceil(F.count(F.lit(1)) / shard_words).cast("int").alias("parts"))  # two rows a shard
    spread = visits.join(parts, ["second", "shard"]).withColumn("part", F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
    owns = F.transform(every, lambda j: F.struct(F.lit(True).alias("owner"), F.col("part").alias("i"), j.alias("j")))
    scans = F.transform(every, lambda i: F.struct(F.lit(False).alias("owner"), i.alias("i"), F.col("part").alias("j")))
    blocks = spread.select("second", "shard", "word", "n", F.explode(F.concat(owns, scans)).alias("b")).select("second", "shard", "word", "n", "b.*")
    return blocks.groupBy("second", "shard", "i", "j").applyInArrow(_block, "word string, near string, near_n long")


# --- forms
def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of (word, form); root is what following forms ends at. Forms must not run in circles."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        left = now.select("word", "root", F.struct("root").alias("key"))
        right = now.select(F.struct(F.col("word").alias("root")).alias("key"), F.col("root").alias("further"))
        after = materialise(left.join(right, "key", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "jumps")
        discard(now)
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return now


def variants(words: DataFrame, *, ratio: int = 2, shard_words: int = 30_000) -> DataFrame:
    """A row per word: its form (the most frequent near word, if ``ratio`` times as frequent), the root of its chain, counts."""
    own = materialise(words.select("word", "n"), "words")
    best = near_words(own, shard_words=shard_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near_n = -F.col("best.less")
    has = F.coalesce(near_n >= ratio * F.col("n"), F.lit(False))
    formed = materialise(own.join(best, "word", "left").select("word", "n", F.when(has, F.col("best.near")).alias("form"), F.when(has, near_n).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "formed")
    discard(own)
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark, sf_dir: str) -> DataFrame:
    """All words of all documents with five code points and three occurrences."""
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP12_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 5),
hexed AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
summed AS (SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))))) AS h FROM hexed),
slips AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM summed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
ranked AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM near),
formed AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN r.n >= 2 * w.n THEN r.other END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n, coalesce(r.n_near, 0) AS n_near FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
chain AS (SELECT word, word AS at FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at WHERE e.form IS NULL
"""
