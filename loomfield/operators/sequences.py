"""Sequences of events of one key: what the steps are, and the fold that both the batch and the stream run.

A pattern's state is its step, the time that its window began and the ids of the events it took. Rules, in this order:
without a state only an event of the first step opens one. With a state whose window has passed (strictly), it begins anew:
`evict` false: any event of the key sets step 0 and the window at its own time; `evict` true: the state is gone, as it is
once a stream has dropped it. Then an event of the awaited step is taken; others change nothing, and in step 0 an opener
doesn't move the window. The last step gives an alert, and leaves step 0, the window at this event, and the event itself.

Events without a key's value have no state; those without a time neither. Equal times go by `order`, then by steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sequence:
    """key: paths; steps: path to the value, or the values, that an event must have."""

    name: str
    description: str
    window_seconds: float
    key: tuple[str, ...]
    steps: tuple[dict[str, object], ...]
    techniques: tuple[str, ...] = field(default=())
    tactics: tuple[str, ...] = field(default=())


def brute_force(failed: object = 9) -> Sequence:
    """Three failed logins, then one that passes. `failed`: status ids of a failure (2 is what `normalize` gives)."""
    bad, good = {"class_uid": 3002, "status_id": failed}, {"class_uid": 3002, "status_id": 1}
    return Sequence("Brute Force Attack", "Multiple failed authentication attempts followed by success", 300, ("src_endpoint.ip", "user.name"), (bad, bad, bad, good), ("T1110.001",), ("TA0006",))


# The other built-in sequences.
_LOGIN, _SSH = {"class_uid": 3002, "status_id": 1}, {"class_uid": 4001, "activity_id": 1}
LATERAL_MOVEMENT = Sequence("Lateral Movement", "SSH connections from compromised host to multiple internal systems", 600, ("device.hostname", "user.name"), (_LOGIN, _SSH, _SSH, _SSH), ("T1021.004",), ("TA0008",))
PRIVILEGE_ESCALATION = Sequence("Privilege Escalation", "User gains elevated privileges after initial access", 1800, ("user.name",), (_LOGIN, {"class_uid": 1007, "activity_id": 1}, {"class_uid": 3005, "activity_id": 1}), ("T1068",), ("TA0004",))


def built_in(failed: object = 9) -> list[Sequence]:
    return [brute_force(failed), LATERAL_MOVEMENT, PRIVILEGE_ESCALATION]


def of_event(path: str) -> Column:
    """A path's value in a normalised event: numbers of their own columns, else of the event map; user.name is the user."""
    if path in ("class_uid", "activity_id", "status_id", "severity_id", "category_uid"):
        return F.col(path)
    return F.element_at("event", "user") if path == "user.name" else F.element_at("event", path)


def correlated(events: DataFrame, patterns: list[Sequence], time: str, order: str, value: Callable[[str], Column] = of_event) -> DataFrame:
    """pattern (its number), key, t (seconds), ord, id, mask (steps that the event is of) of every event and pattern whose key it has; `time` stays."""

    def holds(step: dict[str, object]) -> Column:
        out = F.lit(True)
        for path, wanted in step.items():
            out = out & value(path).isin(*(wanted if isinstance(wanted, (list, tuple)) else [wanted]))
        return F.coalesce(out, F.lit(False))

    each = []
    for k, p in enumerate(patterns):
        key = F.array(*(value(path).cast("string") for path in p.key))
        mask = sum((F.when(holds(s), 1 << i).otherwise(0) for i, s in enumerate(p.steps)), F.lit(0))
        each.append(F.when(~F.exists(key, lambda x: x.isNull()), F.struct(F.lit(k).alias("pattern"), key.alias("key"), mask.alias("mask"))))
    own = events.where(F.col(time).isNotNull()).select(F.col(time), F.col(time).cast("timestamp").cast("double").alias("t"), F.col(order).cast("long").alias("ord"), F.explode(F.array_compact(F.array(*each))).alias("x"))
    return own.select(time, "x.pattern", "x.key", "t", "ord", F.col("ord").cast("string").alias("id"), "x.mask")


State = tuple[int, float, list[str]]  # step, beginning of the window, ids


def advance(state: State | None, t: float, event_id: str | None, mask: int, steps: int, window: float, evict: bool) -> tuple[State | None, list[str] | None]:
    """The state after an event, and the ids of an alert's events if it gives one."""
    if state is not None and t - state[1] > window:
        state = None if evict else (0, t, [event_id])
    if state is None:
        return ((1, t, [event_id]), None) if mask & 1 else (None, None)
    step, first, ids = state
    if not mask >> step & 1:
        return state, None
    ids = [*ids, event_id]
    if step + 1 < steps:
        return (step + 1, first, ids), None
    return (0, t, [event_id]), ids


ALERT = "pattern int, key array<string>, t double, event_ids array<string>"


def titled(found: DataFrame, patterns: list[Sequence]) -> DataFrame:
    """Alerts of what a fold found: title, description, severity, key, timestamp, event_count, event_ids, techniques, tactics."""
    pick = lambda values: F.element_at(F.array(*values), F.col("pattern") + 1)
    return found.select(
        pick([F.lit(p.name) for p in patterns]).alias("title"), pick([F.lit(p.description) for p in patterns]).alias("description"), F.lit("high").alias("severity"), "key",
        F.col("t").cast("timestamp").alias("timestamp"), F.size("event_ids").alias("event_count"), "event_ids",
        pick([F.array(*map(F.lit, p.techniques)).cast("array<string>") for p in patterns]).alias("techniques"), pick([F.array(*map(F.lit, p.tactics)).cast("array<string>") for p in patterns]).alias("tactics"),
    )


def alerts(events: DataFrame, patterns: list[Sequence], time: str, order: str, value: Callable[[str], Column] = of_event, evict: bool = False) -> DataFrame:
    """The alerts of all patterns over a table. An event goes once to each pattern whose key it has, dealt by pattern and key and
    sorted by time there; the fold holds one state and one batch. With evict, events of no step change nothing and stay behind."""
    rows = correlated(events, patterns, time, order, value).drop(time)
    rows = rows.where("mask > 0") if evict else rows
    bounds = [(len(p.steps), float(p.window_seconds)) for p in patterns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for pattern, key, t, event_id, mask in zip(*(batch.column(c).to_pylist() for c in ("pattern", "key", "t", "id", "mask")), strict=True):
                if (pattern, key) != now:
                    now, state = (pattern, key), None
                state, ids = advance(state, t, event_id, mask, *bounds[pattern], evict)
                if ids:
                    out.append({"pattern": pattern, "key": key, "t": t, "event_ids": ids})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("pattern", pa.int32()), ("key", pa.list_(pa.string())), ("t", pa.float64()), ("event_ids", pa.list_(pa.string()))]))

    dealt = rows.repartition("pattern", "key").sortWithinPartitions("pattern", "key", "t", "ord", "mask")
    return titled(dealt.mapInArrow(run, ALERT), patterns)
