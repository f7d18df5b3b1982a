"""Structured Streaming forms of the capture loop: state lives in the state store and survives a restart."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.operators.motion import Action, Capture, Config, advance

STATE = "phase string, moving boolean, low_since long, accepted_at long, issued long, open long"


class ScheduleProcessor(StatefulProcessor):
    """Folds ticks (session_id, t_ms, score) into accepted captures. One slot, no catching up of missed ticks."""

    def __init__(self, config: Config = Config()):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("capture", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = Capture(*self.value.get()) if self.value.exists() else Capture("RECORDING")
        ticks = pd.concat(list(rows)).sort_values("t_ms", kind="stable")
        out = []
        for t, score in zip(ticks.t_ms.tolist(), ticks.score.tolist(), strict=True):
            now, _ = advance(now, Action("motion", t, score), self.config)
            now, got = advance(now, Action("request", t), self.config)
            if got.accepted:
                now, _ = advance(now, Action("complete", t, token=got.token, success=True), self.config)
                out.append((key[0], t, got.due_ms, got.interval_ms))
        self.value.update(tuple(now))
        yield pd.DataFrame(out, columns=["session_id", "t_ms", "due_ms", "interval_ms"]).astype({"t_ms": "int64", "due_ms": "int64", "interval_ms": "int64"})

    def close(self) -> None:
        pass


def schedule_stream(ticks: DataFrame, config: Config = Config()) -> DataFrame:
    """Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass."""
    return ticks.groupBy("session_id").transformWithStateInPandas(ScheduleProcessor(config), "session_id string, t_ms long, due_ms long, interval_ms long", "Append", "None")


class Request(NamedTuple):
    reason: str
    severity: int | None = None  # of thermal requests


def urgency(r: Request) -> int:
    return -1 if r.severity is None else r.severity


def coalesce(busy: bool, waiting: Request | None, new: Request | None) -> tuple[bool, Request | None, Request | None]:
    """(busy, waiting, dispatched) after a request, or after (``new`` None) what was under way has ended.

    Of requests that come while one is under way a single one waits: the most urgent, and of equal ones the newest.
    """
    if new is None:
        return (waiting is not None, None, waiting) if busy else (False, waiting, None)
    if not busy:
        return True, waiting, new
    return True, max([r for r in (new, waiting) if r is not None], key=urgency), None


class CoalesceProcessor(StatefulProcessor):
    """Folds (session_id, ingest_seq, action offer or complete, reason, thermal) into dispatched requests."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("coalesced", "busy boolean, reason string, severity long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        busy, waiting = False, None
        if self.value.exists():
            busy, reason, severity = self.value.get()
            waiting = None if reason is None else Request(reason, severity)
        out = []
        for r in pd.concat(list(rows)).sort_values("ingest_seq", kind="stable").itertuples():
            severity = None if r.thermal is None or r.thermal != r.thermal else int(r.thermal)
            new = Request(r.reason if severity is None else "THERMAL_CHANGE", severity) if r.action == "offer" else None
            busy, waiting, got = coalesce(busy, waiting, new)
            if got:
                out.append((key[0], r.ingest_seq, *got))
        self.value.update((busy, *(waiting or (None, None))))
        yield pd.DataFrame(out, columns=["session_id", "ingest_seq", "reason", "thermal"]).astype({"ingest_seq": "int64", "thermal": "Int64"})

    def close(self) -> None:
        pass


def coalesce_stream(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").transformWithStateInPandas(CoalesceProcessor(), "session_id string, ingest_seq long, reason string, thermal long", "Append", "None")


class TimeoutProcessor(StatefulProcessor):
    """Emits a session whose pending request (or silence) has lasted ``timeout_ms`` of processing time."""

    def __init__(self, timeout_ms: int = 30_000):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("seen", "t_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max(int(r.t_ms.max()) for r in rows)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        self.value.update((last,))
        yield pd.DataFrame({"session_id": pd.Series([], dtype=str), "last_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"session_id": [key[0]], "last_ms": [self.value.get()[0]]})
        self.value.clear()

    def close(self) -> None:
        pass


def timeout_stream(beats: DataFrame, timeout_ms: int = 30_000) -> DataFrame:
    return beats.groupBy("session_id").transformWithStateInPandas(TimeoutProcessor(timeout_ms), "session_id string, last_ms long", "Append", "ProcessingTime")


def latest_only(batch: DataFrame, by: str = "session_id", at: str = "t_ms") -> DataFrame:
    """Of a micro-batch the last row of each group: older ones are dropped when the reader is behind."""
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    return batch.groupBy(by).agg(F.max_by(row, F.col(at)).alias("r")).select("r.*")


def periodic(samples: DataFrame, starts: DataFrame, every: int = 60_000, by: str = "session_id", at: str = "elapsed_ms", tie: str = "sample_id") -> DataFrame:
    """The first row at or after each deadline of a session; deadlines that passed without a row are skipped."""
    x = samples.join(starts.select(by, F.col("start_elapsed_ms").alias("__start")), by)
    bucket = F.floor((F.col(at) - F.col("__start")) / every)
    row = F.struct(*[F.col(f"`{c}`") for c in samples.columns])
    return x.filter(bucket >= 1).groupBy(by, bucket.alias("__bucket")).agg(F.min_by(row, F.struct(at, tie)).alias("r")).select("r.*")


def count_stream(frames: DataFrame) -> DataFrame:
    """Running counts of sessions, without a rescan: use in update mode."""
    return frames.filter("state = 1").groupBy("session_id").agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"))


def register_stream(batches: DataFrame, catalog_path: str, checkpoint: str):
    """Registers batches of frames in micro-batches: a retry of a batch or of the whole micro-batch changes nothing."""
    from strandline.operators.manifest import accepted_frames, batch_verdicts, explode_batches
    from strandline.schemas import schema

    def write(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        catalog = spark.read.schema(schema("frames")).parquet(catalog_path)
        new = accepted_frames(batch_verdicts(explode_batches(df), catalog))
        full = new.select("archive_id", "id", F.lit(None).cast("string").alias("owner_id"), F.lit(None).cast("string").alias("registering_device_id"), "metadata", F.lit(None).cast("timestamp").alias("committed_at"))
        full.join(catalog.select("archive_id", "id"), ["archive_id", "id"], "left_anti").write.mode("append").parquet(catalog_path)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events in tumbling windows of event time, closed when the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
