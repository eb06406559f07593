"""Readers and writers of job folders: JSON records, depth arrays, ASCII clouds, workbooks, tables.

Readers use Spark's own file sources, so any store that Spark can open will do; decoding
of whole binary files runs per file in Arrow batches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.text import flatten
from spanforge.sources.store import drop, written

#: Fixed value: the namespace of a workbook's cells.
_CELLS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def read_records(spark: SparkSession, path: str, schema: str, depth: int = 1) -> DataFrame:
    """Pretty-printed JSON files, one record each, with ``job_id`` from the folder ``depth`` levels up and ``failure`` for a malformed file."""
    files = spark.read.text(path, wholetext=True).withColumn("job_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth))
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    broken = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    out = files.select("job_id", parsed.alias("r")).select("r.*", "job_id", F.when(broken, "malformed").alias("failure"))
    return out.drop("_corrupt_record")


def failures(records: DataFrame, expected: DataFrame, name: str, *, job: str = "job_id") -> DataFrame:
    """Per expected job: null, or that its file is missing or malformed."""
    marked = records.select(job, F.coalesce("failure", F.lit("ok")).alias("f"))
    return expected.join(marked, job, "left").withColumn("failure", F.when(F.col("f").isNull(), f"{name} missing").when(F.col("f") != "ok", f"{name} malformed")).drop("f")


def list_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Names of job folders below ``path``, from the files in them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("job_id")).distinct()


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Two-dimensional .npy arrays as pixels: path, row, col, depth. Zero and non-finite ones stay."""
    return depth_pixels(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path))


def depth_pixels(files: DataFrame) -> DataFrame:
    """The pixels of files already read as path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1), strict=True):
                a = np.load(io.BytesIO(raw.as_py()), allow_pickle=False).astype(np.float32)
                for top in range(0, a.shape[0], 64):
                    part = a[top : top + 64]
                    rows, cols = np.indices(part.shape)
                    n = part.size
                    yield pa.record_batch([pa.array([name.as_py()] * n), pa.array((rows.ravel() + top).astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), pa.array(part.ravel())], names=["path", "row", "col", "depth"])

    return files.select("path", "content").mapInArrow(run, "path string, row int, col int, depth float")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """ASCII clouds: path, ord, x, y, z and colours where there are any."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    halves = F.split("value", r"end_header\r?\n", 2)
    rows = text.select("path", F.posexplode(F.split(F.rtrim(halves[1]), r"\r?\n")).alias("ord", "line"))
    cell = F.split(F.trim("line"), r"\s+")
    colour = lambda i: F.get(cell, F.lit(i)).try_cast("smallint")
    return rows.filter(F.trim("line") != "").select("path", F.col("ord").cast("long").alias("ord"), *[F.get(cell, F.lit(i)).try_cast("double").alias(a) for i, a in enumerate("xyz")], *[colour(i + 3).alias(c) for i, c in enumerate("rgb")])


def write_ply(points: DataFrame, path: str) -> None:
    """One ASCII cloud, in the order of ``ord``: a debug export of one view."""
    has_colour = "r" in points.columns
    columns = ["x", "y", "z", *(["r", "g", "b"] if has_colour else [])]
    kinds = [*(f"property float {a}" for a in "xyz"), *([f"property uchar {c}" for c in ("red", "green", "blue")] if has_colour else [])]
    head = "\n".join(["ply", "format ascii 1.0", f"element vertex {points.count()}", *kinds, "end_header"])
    first = points.sparkSession.createDataFrame([(-1, head)], "ord long, value string")
    body = points.select(F.col("ord").cast("long").alias("ord"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value"))
    first.unionByName(body).repartitionByRange(1, "ord").sortWithinPartitions("ord").select("value").write.text(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of .xlsx workbooks: path, sheet, row_no, col_no, value; ``error`` for a file that is none."""
    return workbook_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path))


def workbook_rows(files: DataFrame) -> DataFrame:
    """The cells of files already read as path and content."""
    return files.select("path", "content").mapInPandas(_cells, "path string, sheet string, row_no int, col_no int, value string, error string")


def _cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet", "row_no", "col_no", "value", "error"]
    for part in parts:
        rows: list[tuple] = []
        for path, content in zip(part["path"], part["content"], strict=True):
            try:
                rows += [(path, *cell, None) for cell in workbook_cells(content)]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                rows.append((path, None, None, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=names).astype({"row_no": "Int32", "col_no": "Int32"})


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        have = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in have:
            shared = ["".join(t.text or "" for t in item.iter(f"{_CELLS}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_CELLS}sheet"):
            target = targets[sheet.get(_RELATION)].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for cell in tree.iter(f"{_CELLS}c"):
                at = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
                value = cell.find(f"{_CELLS}v")
                if cell.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_CELLS}t"))
                elif value is None:
                    continue
                else:
                    text = shared[int(value.text)] if cell.get("t") == "s" else value.text
                if at and text:
                    column = 0
                    for letter in at[1]:
                        column = column * 26 + ord(letter) - 64
                    yield sheet.get("name"), int(at[2]), column, text


def fake_camera(spark: SparkSession, height: int, width: int, depth: float) -> DataFrame:
    """A frame of constant depth."""
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"), F.lit(float(depth)).alias("depth"))


def best_profile(profiles: DataFrame, keys: list[str], scores: list[Column]) -> DataFrame:
    """Stream profile with the least tuple of scores."""
    return profiles.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in profiles.columns if c not in keys]), F.struct(*scores)).alias("profile"))


def capture_errors(raw: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Views whose raw and aligned depth are identical or differ in shape; both have row, col, depth."""
    a, b = raw.select(*keys, "row", "col", F.col("depth").alias("a")), aligned.select(*keys, "row", "col", F.col("depth").alias("b"))
    both = a.join(b, [*keys, "row", "col"], "full").groupBy(*keys).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"), F.count_if(F.col("a").isNull()).alias("n_only_b"), F.count_if(F.col("b").isNull()).alias("n_only_a"))
    return both.withColumn("error", F.when(F.col("n_only_a") + F.col("n_only_b") > 0, "shape_mismatch").when(F.col("n_different") == 0, "raw_and_aligned_identical"))


def depth_preview(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Depth stretched between percentiles 2 and 98 to whole numbers 0 to 255; invalid depth is 0."""
    d = F.when((F.col("depth") > 0) & ~F.isnan("depth"), F.col("depth").cast("double"))
    ends = pixels.groupBy(*keys).agg(F.percentile(d, F.array(F.lit(0.02), F.lit(0.98))).alias("e"))
    span = F.col("e")[1] - F.col("e")[0]
    level = F.when(d.isNotNull() & (span > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - F.col("e")[0]) / span))).otherwise(0.0)
    return pixels.join(ends, keys).withColumn("level", F.coalesce((level * 255).cast("int"), F.lit(0))).drop("e")


def write_table(df: DataFrame, path: str) -> None:
    """CSV with sorted, flat columns; lists and maps as JSON text. No part but a full one is written; without rows there is no header."""
    flat = flatten(df)
    nested = {f.name for f in flat.schema.fields if f.dataType.typeName() in ("array", "map")}
    flat.select(*[(F.to_json(f"`{c}`") if c in nested else F.col(f"`{c}`")).alias(c) for c in sorted(flat.columns)]).hint("rebalance").write.csv(path, header=not df.isEmpty())


def replace_partitions(df: DataFrame, path: str, parts: list[str]) -> None:
    """Write ``df`` in place of the partitions that it has rows of; the files of the others stay as they are.

    New files are staged and take a partition's place when the job commits, so a job that
    fails leaves the table as it was.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def merge_rows(changes: DataFrame, path: str, keys: list[str], parts: list[str], *, delete: str | None = None) -> None:
    """Put ``changes`` in place of the rows of the table at ``path`` with the same keys, rewriting only their partitions.

    ``parts`` must follow from the keys. Rows of ``changes`` whose boolean column ``delete`` is true only take theirs
    away. Applied again, the same changes give the same table. The new content is written aside
    first, since a partition cannot be read while it is replaced; a partition that loses
    its last row keeps its folder without rows.
    """
    spark = changes.sparkSession
    new = written(changes, "changes")
    gone = new.select(*parts).distinct()
    old = spark.read.parquet(path)
    kept = old.join(gone, parts, "left_semi").join(new.select(*keys), keys, "left_anti")
    added = new.filter(~F.coalesce(F.col(delete), F.lit(False))).drop(delete) if delete else new
    content = written(kept.unionByName(added, allowMissingColumns=True).select(*old.columns), "content")
    replace_partitions(content, path, parts)
    empty = gone.join(content.select(*parts).distinct(), parts, "left_anti").collect()  # partitions, as many as the table has at most
    for row in empty:
        _drop_files(spark, "/".join([path.rstrip("/"), *[f"{p}={row[p]}" for p in parts]]))
    drop(new, content)


def _drop_files(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(path):
        for found in system.listStatus(path):
            system.delete(found.getPath(), True)


def public_columns(df: DataFrame, prefix: str = "_runtime_") -> DataFrame:
    """Without columns that only serve a run."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Append the predictions that a model gave, with their time."""
    predictions.filter("model is not null").withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def capture_meta(meta: DataFrame, raw: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Capture metadata with the statistics of both depth frames as structs; ``raw`` and ``aligned`` come from depth_stats."""
    side = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    return meta.join(side(raw, "raw_depth"), keys, "left").join(side(aligned, "aligned_depth"), keys, "left")
