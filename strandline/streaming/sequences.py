"""Gapped sequences on a stream: the same rows as the batch form, once the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def earliest_end(start: int, later: list[tuple[int, str]], steps: list[str], gaps: list[int], breaks: frozenset[str]) -> int | None:
    """The earliest end of a sequence that begins at ``start``; ``later`` are times and kinds after it, rising.

    ``reached[k]`` are the times at which step k can have happened, from ``start`` on: each event moves on every step it can follow.
    """
    reached: list[list[int]] = [[start], *[[] for _ in gaps]]
    for t, kind in later:
        if kind in breaks and t > start:
            return None
        for k in range(len(gaps), 0, -1):
            if kind == steps[k] and any(0 < t - s <= gaps[k - 1] for s in reached[k - 1]):
                if k == len(gaps):
                    return None if any(u == t and other in breaks for u, other in later) else t
                reached[k].append(t)
    return None


class SequenceProcessor(StatefulProcessor):
    """Events wait until the watermark has passed the longest match that could begin with them; a timer for each beginning."""

    def __init__(self, steps: list[str], gaps: list[int], breaks: list[str] = ()):
        self.steps, self.gaps, self.breaks = steps, gaps, frozenset(breaks)
        self.used, self.reach = {*steps, *breaks}, sum(gaps)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "t_ms long, event_id long", "kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for t, i, kind in zip(batch.t_ms.tolist(), batch.event_id.tolist(), batch.kind.tolist(), strict=True):
                if kind in self.used:
                    self.events.updateValue((t, i), (kind,))
                    self.handle.registerTimer(t + self.reach + 1)
        yield pd.DataFrame({"key": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "t_ms": pd.Series(dtype="int64"), "sequence_end": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() - self.reach - 1
        held = sorted((t, i, v[0]) for (t, i), v in self.events.iterator())
        out = []
        for t, i, kind in held:
            if t == due and kind == self.steps[0]:
                end = earliest_end(t, [(u, k) for u, _, k in held if t < u <= t + self.reach], self.steps, self.gaps, self.breaks)
                if end is not None:
                    out.append((key[0], i, t, end))
        for t, i, _ in held:
            if t <= due:
                self.events.removeKey((t, i))
        yield pd.DataFrame(out, columns=["key", "event_id", "t_ms", "sequence_end"]).astype("int64")

    def close(self) -> None:
        pass


def sequence_stream(events: DataFrame, steps: list[str], gaps: list[int], breaks: list[str] = (), late: str = "1 second") -> DataFrame:
    """(key, event_id, t_ms, sequence_end) for a stream of (key, event_id, kind, t_ms, ts), where ``ts`` is ``t_ms`` as a timestamp.

    Events may come in any order within ``late``. A key holds the events of its last longest match. Needs the RocksDB state store.
    """
    if len(steps) < 2 or len(gaps) != len(steps) - 1 or min(gaps) < 1 or set(breaks) & set(steps):
        raise ValueError("two steps or more, a positive gap between each two, and breaks that are no steps")
    processor = SequenceProcessor(steps, gaps, breaks)
    marked = events.withWatermark("ts", late).groupBy("key")
    return marked.transformWithStateInPandas(processor, "key long, event_id long, t_ms long, sequence_end long", "Append", "EventTime")
