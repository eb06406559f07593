"""Five stages from raw documents to packed training sequences.

Each stage reads what the one before it wrote, works on all of it and, but for the last,
returns the columns of documents. Stages call the operators of ``spanforge.llm`` with
their production parameters; shingles have five words here. A stage starts when its
predecessor's result has been written, so it first deletes the intermediate tables that
the predecessor left in the same run (for stages called one by one: over the same folder; a stage
that is called again leaves what it made before). ``run`` keeps a list of its own, so runs beside
each other do not meet, and deletes a stage's result once the next one is written.

Defined results: a document without a text or with an empty one fails the base counts and
goes; without any labelled document languages reject nothing; of equal or repeated rows,
with an id or without, one stays (the least doc_id, then one of the least text hash);
ties are decided by doc_id and text, then by all columns; texts of any length are read whole, cut
by the operators that need blocks; an empty table gives an empty result; further
columns of whatever names pass through all stages but the last, which gives pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import fertility, language, minhash, packing, passages
from spanforge.llm.storage import recorded, remove, table_path

#: Intermediate tables of the stages of the run that is on, by stage.
_of_run: ContextVar[dict[str, list[str]] | None] = ContextVar("tables of the run", default=None)
#: The same for stages that are called one by one, by the folder that they work on.
_of_folder: dict[str, dict[str, list[str]]] = {}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _of_run.get()
        if left is None:
            left = _of_folder.setdefault(sf_dir, {})
        order = [stage.__name__ for _, stage in STAGES]
        before = order[: order.index(f.__name__)][-1:]
        for name in before:
            remove(spark, *left.pop(name, []))
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        left.setdefault(f.__name__, []).extend(made)
        return out

    return run_one


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and the fertility bands."""
    return fertility.keep_good(docs)


@_stage
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that a model of their own labels recognises; all of them if none has a label."""
    model = language.train(docs)
    return language.keep_recognised(docs, model) if model.languages else docs


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least doc_id."""
    return minhash.keep_one(docs)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; character counts follow."""
    left = passages.drop_repeats(docs, removed_col="removed_spans").select(*[f"`{c}`" for c in docs.columns])
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


@_stage
def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("language ID", languages),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("packing", packs),
]

#: Tokenisers and a trained model decide here, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    token = _of_run.set({})
    try:
        for _, stage in STAGES[:-1]:
            path = table_path(spark, "stage")
            stage(spark, docs, sf_dir).write.parquet(path)
            if before:
                remove(spark, before)
            docs, before = spark.read.parquet(path), path
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _of_run.reset(token)
