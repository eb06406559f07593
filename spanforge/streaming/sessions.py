"""Session state as a fold over events: in batch, and as keyed state over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge.functions import constants as K

STATE = "status string, captured_views array<string>, steps map<string,boolean>, n_errors bigint"
OUT = f"job_id string, {STATE}"


def fold(events: DataFrame, *, job: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """State of each job: last status, views in the order of their first capture, last mark of each step, number of errors.

    ``events``: kind (status, view, step, error), name, done. An error sets the status.
    Everything is an aggregate, so a job of any length needs no list of its events but
    the distinct views and steps.
    """
    at = F.struct(*order)
    status = F.when(F.col("kind") == "status", F.col("name")).when(F.col("kind") == "error", F.lit("error"))
    whole = events.groupBy(job).agg(F.max_by(status, F.when(status.isNotNull(), at)).alias("status"), F.count_if(F.col("kind") == "error").alias("n_errors"))
    views = events.filter("kind = 'view'").groupBy(job, "name").agg(F.min(at).alias("at")).groupBy(job).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda v: v["name"]).alias("captured_views"))
    steps = events.filter("kind = 'step'").groupBy(job, "name").agg(F.max_by("done", at).alias("done")).groupBy(job).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "done")))).alias("steps"))
    out = whole.join(views, job, "left").join(steps, job, "left")
    return out.select(job, F.coalesce("status", F.lit("created")).alias("status"), F.coalesce("captured_views", F.array().cast("array<string>")).alias("captured_views"), F.coalesce("steps", F.create_map().cast("map<string,boolean>")).alias("steps"), "n_errors")


def complete_jobs(captured: DataFrame, required: DataFrame, *, job: str = "job_id") -> DataFrame:
    """Jobs whose required views are all captured; ``required`` has an array per job."""
    have = captured.groupBy(job).agg(F.collect_set("view_name").alias("have"))
    return required.join(have, job).filter(F.size(F.array_except("required_views", "have")) == 0).select(job)


def latest_frames(frames: DataFrame, now: Column, *, camera: str = "camera_id", stale_s: float = K.FRAME_STALE_S) -> DataFrame:
    """Last frame of each camera (of equal times the greatest frame) and whether it is too old to use."""
    last = frames.groupBy(camera).agg(F.max(F.struct("ts", "frame")).alias("last")).select(camera, "last.ts", "last.frame")
    return last.withColumn("stale", (now.cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) > stale_s)


class SessionProcessor(StatefulProcessor):
    """Keyed session state; each micro-batch gives the state of the jobs that it touched."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, views, steps, errors = "created", [], {}, 0
        if self.state.exists():
            status, views, steps, errors = self.state.get()
            views, steps = list(views or []), dict(steps or {})
        events = pd.concat(list(rows))
        for e in events.sort_values(["ts", "event_id"]).itertuples():
            if e.kind == "status":
                status = e.name
            elif e.kind == "view":
                views = views if e.name in views else [*views, e.name]
            elif e.kind == "step":
                steps[e.name] = bool(e.done)
            elif e.kind == "error":
                status, errors = "error", errors + 1
        self.state.update((status, views, steps, errors))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "captured_views": [views], "steps": [steps], "n_errors": [errors]})

    def close(self) -> None:
        pass


class PlaneProcessor(StatefulProcessor):
    """Last valid table plane of each camera setting; an invalid fit is answered with the kept one.

    The rows of a setting come in several chunks; those of one micro-batch are put in order
    together, by time and then by capture, before the first one is answered.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plane = handle.getValueState("plane", "plane array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.plane.get()[0]) if self.plane.exists() else None
        captures, planes, reused = [], [], []
        for r in pd.concat(list(rows)).sort_values(["captured_at", "capture_id"]).itertuples():
            captures.append(r.capture_id)
            planes.append(list(r.plane) if r.valid else kept)
            reused.append(not r.valid and kept is not None)
            if r.valid:
                kept = list(r.plane)
        if kept is not None:
            self.plane.update((kept,))
        yield pd.DataFrame({"cache_key": [key[0]] * len(captures), "capture_id": captures, "plane": planes, "reused": reused})

    def close(self) -> None:
        pass


class CompletionProcessor(StatefulProcessor):
    """Gives a job out once, when the last of its required views has come.

    Requirements and views come in any order, late and repeated. A job's state is its required
    views, those captured so far and whether it has been given out: it grows with the names
    of views, not with the events, and chunks of a large job are folded one by one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "required array<string>, captured array<string>, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        required, captured, done = self.state.get() if self.state.exists() else (None, [], False)
        required, captured = set(required) if required is not None else None, set(captured or [])
        for part in rows:
            captured.update(part.loc[part["kind"] == "view", "view_name"].dropna())
            wanted = part.loc[part["kind"] == "require", "view_name"]
            if len(wanted):
                required = (required or set()) | set(wanted.dropna())
        complete = not done and bool(required) and required <= captured
        self.state.update((sorted(required) if required is not None else None, sorted(captured), done or complete))
        if complete:
            yield pd.DataFrame({"job_id": [key[0]], "views": [sorted(required)]})

    def close(self) -> None:
        pass


class FrameProcessor(StatefulProcessor):
    """Newest frame of each camera; a timer marks it stale when no newer one comes in time.

    Frames may come in any order: only a later one, or at the same time one of a greater
    number, replaces the kept one, is given out as fresh and winds the timer up again. With
    event time the timer runs on the stream's watermark, so a replay gives the same rows; with
    processing time it runs on the clock, from the arrival of the frame. A timer already runs
    when the time reaches it; a frame as old as allowed is not stale, so it gets one more millisecond.
    """

    def __init__(self, stale_ms: int, event_time: bool):
        self.stale_ms, self.event_time = stale_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("frame", "ts timestamp, frame bigint, deadline bigint")

    def _row(self, key, ts, frame: int, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"camera_id": [key[0]], "ts": [ts], "frame": [frame], "stale": [stale]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.last.get() if self.last.exists() else None
        best = (pd.Timestamp(kept[0]), kept[1]) if kept else None
        before = best
        for part in rows:
            newest = part.sort_values(["ts", "frame"]).iloc[-1]
            found = (pd.Timestamp(newest["ts"]), int(newest["frame"]))
            best = found if best is None or found > best else best
        if best == before:
            return
        if kept:
            self.handle.deleteTimer(kept[2])
        start = best[0].value // 1_000_000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.last.update((best[0].to_pydatetime(), best[1], start + self.stale_ms))
        self.handle.registerTimer(start + self.stale_ms)
        yield self._row(key, best[0], best[1], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, frame, deadline = self.last.get()
        now = timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        if expiredTimerInfo.getExpiryTimeInMs() not in (deadline, deadline + 1):
            return
        if now > deadline:
            yield self._row(key, pd.Timestamp(ts), frame, True)
        else:
            self.handle.registerTimer(deadline + 1)

    def close(self) -> None:
        pass


def stream_sessions(events: DataFrame) -> DataFrame:
    """Session states over a stream of events (job_id, event_id, ts, kind, name, done); needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(SessionProcessor(), OUT, "Update", "None")


def stream_planes(fits: DataFrame) -> DataFrame:
    """Kept planes over a stream of fits (cache_key, capture_id, captured_at, plane, valid)."""
    return fits.groupBy("cache_key").transformWithStateInPandas(PlaneProcessor(), "cache_key string, capture_id bigint, plane array<double>, reused boolean", "Update", "None")


def stream_completions(rows: DataFrame) -> DataFrame:
    """(job_id, views) of each job at the moment its last required view is there; ``rows`` has job_id, kind (require or view) and view_name."""
    return rows.select("job_id", "kind", "view_name").groupBy("job_id").transformWithStateInPandas(CompletionProcessor(), "job_id string, views array<string>", "Update", "None")


def stream_frames(frames: DataFrame, *, stale_s: float = K.FRAME_STALE_S, event_time: bool = True, delay: str = "0 seconds") -> DataFrame:
    """Newest frames (camera_id, ts, frame) as they change, fresh first and stale once nothing newer has come for ``stale_s``."""
    own = frames.select("camera_id", "ts", "frame")
    mode = "EventTime" if event_time else "ProcessingTime"
    seen = own.withWatermark("ts", delay) if event_time else own
    return seen.groupBy("camera_id").transformWithStateInPandas(FrameProcessor(int(stale_s * 1000), event_time), "camera_id string, ts timestamp, frame bigint, stale boolean", "Update", mode)
