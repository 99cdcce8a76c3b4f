"""Sequences on streams: a state for each pattern and key, dropped once its window has passed.

Rows wait in a list state until the watermark has passed their time, and are then folded in order of time, so late rows
within the watermark's delay give the same alerts as a table would (`alerts` with `evict`). Rows behind the watermark are
left out. A timer at the end of the window drops the state; keys that fall silent cost nothing after it. State, timers and
what waits are in the checkpoint, so a restart goes on where the last batch ended. The session's state store must be RocksDB
(`rocksdb_state`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sequences import ALERT, Sequence, advance, correlated, of_event, titled

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_state(spark: SparkSession) -> SparkSession:
    """Sets the state store that processors with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return spark


class SequenceProcessor(StatefulProcessor):
    """Folds the rows of one (pattern, key); bounds: (steps, window in seconds) of each pattern."""

    def __init__(self, bounds: list[tuple[int, float]]):
        self.bounds = bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fsm", "step int, first double, ids array<string>")
        self.waiting = handle.getListState("waiting", "t double, ord long, id string, mask int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = [tuple(r) for part in rows for r in zip(part["t"].tolist(), part["ord"].tolist(), part["id"].tolist(), part["mask"].tolist(), strict=True)]
        if got:
            self.waiting.appendList(got)
            self.handle.registerTimer(int(max(r[0] for r in got) * 1000) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, (pattern, own) = timerValues.getCurrentWatermarkInMs() / 1000, key
        steps, window = self.bounds[int(pattern)]
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[3])) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        state, found = None, []
        if self.state.exists():
            step, first, ids = self.state.get()
            state = (int(step), float(first), [str(x) for x in ids])
        for t, _, event_id, mask in ready:
            state, ids = advance(state, t, event_id, mask, steps, window, True)
            if ids:
                found.append((int(pattern), own, t, ids))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(int(rest[-1][0] * 1000) + 1)
        elif rows:
            self.waiting.clear()
        if state is not None and passed - state[1] > window and not (rest and rest[0][0] - state[1] <= window):
            state = None
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(int((state[1] + window) * 1000) + 2)
        if found:
            yield pd.DataFrame(found, columns=["pattern", "key", "t", "event_ids"])

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, patterns: list[Sequence], time: str, order: str, value=of_event, late: str = "1 minute") -> DataFrame:
    """The alerts of a stream of events, as `alerts` gives them for a table with evict."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = correlated(events.withWatermark(time, late), patterns, time, order, value).where("mask > 0").withColumn("key", F.to_json("key"))  # a state's key is a plain value
    bounds = [(len(p.steps), float(p.window_seconds)) for p in patterns]
    found = rows.groupBy("pattern", "key").transformWithStateInPandas(SequenceProcessor(bounds), ALERT.replace("array<string>", "string", 1), "append", "eventTime")
    return titled(found.withColumn("key", F.from_json("key", "array<string>")), patterns)
