"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_recorders: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a local master (tests) gets a folder of its own; a cluster is refused."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recorders:
        paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Paths of the tables made inside, for whoever knows when nothing reads them any more."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [x for x in _recorders if x is not paths]


@contextmanager
def _shuffles_end_with_the_query(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; nothing else reads them."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = table_path(spark, label)
    with _shuffles_end_with_the_query(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of tables that nothing reads any more."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for df in frames:
        remove(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def with_clear_names(df: DataFrame, needed: dict[str, str]) -> DataFrame:
    """Only the named input columns, under names that no extra column can clash with: {own name: input column}."""
    return df.select(*[F.col(f"`{column}`").alias(own) for own, column in needed.items()])


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
