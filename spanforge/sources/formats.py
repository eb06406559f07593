"""Captures as formats of their own: ``spark.read.format(...)`` and ``spark.readStream.format(...)``.

Formats read a folder that the driver and the executors see at one place (a mounted store);
``files`` reads the same files through Spark's own file systems. A file is cut into ranges and a
partition takes a run of them, so that small files and small ranges do not make a task each. A stream's offset is the last file that it has taken, by time and name, so files have to
be put in place by renaming, in the order of their times; a restart goes on behind the offset.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows of an array, and bytes of a cloud, that are one range unless options say otherwise.
ROWS, BYTES = 256, 32 << 20
#: Ranges share a partition once there are more; a partition of several has at most ``BYTES``.
PARTITIONS = 256
#: Pixels or points of one batch of rows.
BATCH = 1 << 16


def _folder(options) -> str:
    path = options.get("path") or ""
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def listed(folder: str, ending: str) -> list[tuple[int, str]]:
    """(time, path) of the files below a folder, in order; hidden ones and what writers leave aside do not count."""
    out = []
    for place, folders, files in os.walk(folder):
        folders[:] = [f for f in folders if not f.startswith(("_", "."))]
        out += [(os.stat(os.path.join(place, f)).st_mtime_ns, os.path.join(place, f)) for f in files if f.endswith(ending) and not f.startswith(("_", "."))]
    return sorted(out)


@dataclass
class Range:
    path: str
    start: int
    end: int


@dataclass
class Run(InputPartition):
    ranges: list[Range]


class _Ranges:
    """What batch and stream share: cutting files into ranges and reading one."""

    ending = ""

    def __init__(self, options):
        self.folder = _folder(options)
        self.step = int(options.get("step", 0))

    def ranges(self, path: str) -> list[Range]:
        raise NotImplementedError

    def cut(self, size: int, usual: int, path: str) -> list[Range]:
        step = self.step or usual
        return [Range(path, at, min(at + step, size)) for at in range(0, size, step)]

    def runs(self, paths: Iterable[str]) -> list[Run]:
        """All ranges of the files, in order, dealt out to partitions by their share of a file's bytes."""
        sized = []
        for path in paths:
            own = self.ranges(path)
            places = sum(r.end - r.start for r in own)
            size = os.path.getsize(path)
            sized += [(r, size * (r.end - r.start) / max(1, places)) for r in own]
        most = min(BYTES, sum(n for _, n in sized) / PARTITIONS)
        runs, held = [], 0.0
        for r, n in sized:
            if not runs or held + n > most:
                runs.append(Run([]))
                held = 0.0
            runs[-1].ranges.append(r)
            held += n
        return runs if len(sized) > PARTITIONS else [Run([r]) for r, _ in sized]

    def read_run(self, run: Run) -> Iterator[pa.RecordBatch]:
        for part in run.ranges:
            yield from self.read(part)


class _Depth(_Ranges):
    """Two-dimensional .npy arrays, opened without reading more than the rows of a range."""

    ending = ".npy"

    def ranges(self, path: str) -> list[Range]:
        return self.cut(np.load(path, mmap_mode="r", allow_pickle=False).shape[0], ROWS, path)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        array = np.load(part.path, mmap_mode="r", allow_pickle=False)
        width = array.shape[1]
        rows = max(1, BATCH // max(1, width))
        for top in range(part.start, part.end, rows):
            block = np.asarray(array[top : min(top + rows, part.end)], dtype=np.float32)
            row, col = np.indices(block.shape)
            yield pa.record_batch([pa.array([part.path] * block.size, pa.string()), pa.array((row.ravel() + top).astype(np.int32)), pa.array(col.ravel().astype(np.int32)), pa.array(block.ravel())], names=["path", "row", "col", "depth"])


class _Cloud(_Ranges):
    """ASCII clouds whose vertices come first; a range of bytes reads the lines that start in it."""

    ending = ".ply"

    @staticmethod
    def header(path: str) -> tuple[int, int, list[str], bool]:
        """Where the body starts, the number of vertices, their fields, and whether anything else follows."""
        count, fields, others, of = 0, [], False, ""
        with open(path, "rb") as f:
            if f.readline().strip() != b"ply":
                raise ValueError(f"not a cloud: {path}")
            while line := f.readline():
                words = line.decode().split()
                if words[:1] == ["element"]:
                    of = words[1]
                    if of == "vertex":
                        count = int(words[2])
                    else:
                        others = True
                elif words[:1] == ["property"] and of == "vertex":
                    fields.append(words[-1])
                elif words == ["end_header"]:
                    return f.tell(), count, fields, others
        raise ValueError(f"a cloud without an end of its header: {path}")

    def ranges(self, path: str) -> list[Range]:
        start, count, _, others = self.header(path)
        size = os.path.getsize(path)
        if others:  # vertices have to be counted from the first one
            return [Range(path, start, size)] if count else []
        return [Range(path, r.start + start, r.end + start) for r in self.cut(size - start, BYTES, path)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        start, count, fields, others = self.header(part.path)
        at = [fields.index(a) for a in "xyz"]
        left = count if others else -1
        with open(part.path, "rb") as f:
            if part.start > start:
                f.seek(part.start - 1)
                f.readline()  # the line that starts before belongs to the range before
            else:
                f.seek(start)
            rows: list[list[float]] = []
            places: list[int] = []
            while f.tell() < part.end and left:
                here = f.tell()
                words = f.readline().split()
                if words:
                    rows.append([float(words[i]) for i in at])
                    places.append(here)
                    left -= 1
                if len(rows) >= BATCH:
                    yield self._batch(part.path, places, rows)
                    rows, places = [], []
            if rows:
                yield self._batch(part.path, places, rows)

    @staticmethod
    def _batch(path: str, places: list[int], rows: list[list[float]]) -> pa.RecordBatch:
        x = np.array(rows, dtype=np.float64)
        return pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array(places, pa.int64()), *[pa.array(x[:, i]) for i in range(3)]], names=["path", "ord", "x", "y", "z"])


class _Reader(DataSourceReader):
    def __init__(self, ranges: _Ranges):
        self.of = ranges

    def partitions(self) -> list[Run]:
        return self.of.runs(path for _, path in listed(self.of.folder, self.of.ending))

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.of.read_run(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, ranges: _Ranges):
        self.of = ranges

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.of.folder, self.of.ending)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Run]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.of.runs(at[1] for at in listed(self.of.folder, self.of.ending) if low < at <= high)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.of.read_run(partition)

    def commit(self, end: dict) -> None:
        pass


class DepthFrames(DataSource):
    """``depth_frames``: pixels of the .npy arrays below ``path``; option ``step``, rows of a range."""

    ranges = _Depth

    @classmethod
    def name(cls) -> str:
        return "depth_frames"

    def schema(self) -> str:
        return "path string, row int, col int, depth float"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.ranges(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.ranges(self.options))


class AsciiClouds(DepthFrames):
    """``ascii_clouds``: points of the .ply files below ``path``, ``ord`` their place in the file; option ``step``, bytes of a range."""

    ranges = _Cloud

    @classmethod
    def name(cls) -> str:
        return "ascii_clouds"

    def schema(self) -> str:
        return "path string, ord bigint, x double, y double, z double"


@dataclass
class Frames(InputPartition):
    first: int
    last: int


class _Camera(DataSourceStreamReader):
    """A camera of constant depth: frame after frame, ``per_batch`` at a time, up to ``frames``."""

    def __init__(self, options):
        self.height, self.width, self.depth = int(options.get("height", 4)), int(options.get("width", 4)), float(options.get("depth", 1.0))
        self.frames, self.per_batch = int(options.get("frames", 1)), int(options.get("per_batch", 1))
        self.given = 0

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        self.given = min(self.frames, self.given + self.per_batch)
        return {"frame": self.given}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self.given = max(self.given, end["frame"])
        return [Frames(i, i + 1) for i in range(start["frame"], end["frame"])]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        size = self.height * self.width
        at = np.arange(size)
        for frame in range(partition.first, partition.last):
            yield pa.record_batch([pa.array(np.full(size, frame, np.int64)), pa.array((at // self.width).astype(np.int32)), pa.array((at % self.width).astype(np.int32)), pa.array(np.full(size, self.depth))], names=["frame", "row", "col", "depth"])

    def commit(self, end: dict) -> None:
        pass


class ConstantCamera(DataSource):
    """``constant_camera``: a stream of frames of one depth, for runs without a device."""

    @classmethod
    def name(cls) -> str:
        return "constant_camera"

    def schema(self) -> str:
        return "frame bigint, row int, col int, depth double"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Camera(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (DepthFrames, AsciiClouds, ConstantCamera):
        spark.dataSource.register(source)
