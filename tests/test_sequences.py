"""Sequences: batch against a plain machine of its rules, stream against batch, eviction, restart."""

import itertools
import json
import os
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import sequences as S
from loomfield.streaming import jobs
from loomfield.streaming import sequences as streams

PATTERNS = [
    S.Sequence("three", "", 300, ("who",), ({"kind": "bad"}, {"kind": ["bad", "worse"]}, {"kind": "good"}), ("T1",), ("TA1",)),
    S.Sequence("two", "", 60, ("who", "where"), ({"kind": "good"}, {"kind": "bad"})),
]
START = datetime(2026, 1, 1, tzinfo=UTC)


def _value(path):
    return F.col(path)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 6000, 900))
    rows = [(k, START + timedelta(seconds=int(s)), f"u{rng.integers(6)}", f"h{rng.integers(2)}", str(rng.choice(["bad", "worse", "good", "other"]))) for k, s in enumerate(t)]
    return rows + [(900, START, None, "h0", "bad"), (901, None, "u1", "h0", "bad"), (902, START, "u1", None, None), rows[5], rows[5]]


SCHEMA = "event_id long, ts timestamp, who string, `where` string, kind string"


def _machine(rows, evict):
    """The documented rules, event by event."""
    out = []
    for p in PATTERNS:
        states = {}
        own = [r for r in rows if r[1] is not None and None not in [dict(zip(("event_id", "ts", "who", "where", "kind"), r, strict=True))[k] for k in p.key]]
        mask = lambda r: [r[4] in (s["kind"] if isinstance(s["kind"], list) else [s["kind"]]) for s in p.steps]  # noqa: B023,E731
        for r in sorted(own, key=lambda r: (r[1], r[0])):
            key, fits = tuple(r[2:4][: len(p.key)]), mask(r)
            if key in states and (r[1] - states[key]["first"]).total_seconds() > p.window_seconds:
                if evict:
                    del states[key]
                else:
                    states[key] = {"step": 0, "first": r[1], "n": 1}
            if key not in states:
                if fits[0]:
                    states[key] = {"step": 1, "first": r[1], "n": 1}
                continue
            s = states[key]
            if fits[s["step"]]:
                s["step"], s["n"] = s["step"] + 1, s["n"] + 1
                if s["step"] == len(p.steps):
                    out.append((p.name, key, r[1].timestamp(), s["n"]))
                    states[key] = {"step": 0, "first": r[1], "n": 1}
    return sorted(out)


def _seen(df):
    return sorted((r["title"], tuple(r["key"]), r["timestamp"].timestamp(), r["event_count"]) for r in df.collect())


@pytest.mark.parametrize("evict", [False, True])
def test_batch_follows_the_rules(spark, rows, evict):
    events = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = _machine(rows, evict)
    assert _seen(S.alerts(events, PATTERNS, "ts", "event_id", _value, evict)) == want and len({w[0] for w in want}) == 2


def test_built_in_brute_force(spark):
    made = [(k, START + timedelta(seconds=10 * k), 3002, status, {"user": "amy", "src_endpoint.ip": "10.0.0.1"}) for k, status in enumerate([2, 2, 1, 2, 1])]
    events = spark.createDataFrame(made, "event_id long, ts timestamp, class_uid int, status_id int, event map<string,string>").withColumn("activity_id", F.lit(1))
    got = S.alerts(events, S.built_in(failed=(9, 2)), "ts", "event_id").collect()
    assert [(r["title"], r["event_ids"], r["techniques"], r["severity"]) for r in got] == [("Brute Force Attack", ["0", "1", "3", "4"], ["T1110.001"], "high")]
    assert S.alerts(events, S.built_in(), "ts", "event_id").isEmpty()


_CLOCK = itertools.count(int(time.time()) - 10_000)


def _write(folder, name, rows):
    """Files arrive in the order of their times, which must differ."""
    (folder / name).write_text("\n".join(json.dumps({"event_id": r[0], "ts": r[1] and r[1].isoformat(), "who": r[2], "where": r[3], "kind": r[4]}) for r in rows))
    os.utime(folder / name, (now := next(_CLOCK), now))


def _run(spark, tmp_path):
    events = streams.rocksdb_state(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "src"))
    query = jobs.write_stream(streams.alert_stream(events, PATTERNS, "ts", "event_id", _value, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    return query


def test_stream_gives_what_the_table_gives(spark, rows, tmp_path):
    """Micro-batches whose rows come late within the delay; a restart in the middle; at the end no state is left."""
    (tmp_path / "src").mkdir()
    timed = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    parts = [timed[k : k + 150] for k in range(0, len(timed), 150)]
    for k in range(len(parts) - 1):  # some rows of each part come with the next
        parts[k + 1] = parts[k][-5:] + parts[k + 1]
        parts[k] = parts[k][:-5]
    for k, part in enumerate(parts[:3]):
        _write(tmp_path / "src", f"{k}.json", part[::-1])
    _run(spark, tmp_path)
    half = _seen(spark.read.parquet(str(tmp_path / "out")))
    for k, part in enumerate(parts[3:]):
        _write(tmp_path / "src", f"{k + 3}.json", part[::-1])
    _write(tmp_path / "src", "end.json", [(999, START + timedelta(days=1), None, None, "other")])
    _run(spark, tmp_path)
    got, want = _seen(spark.read.parquet(str(tmp_path / "out"))), _machine(rows, True)
    assert 0 < len(half) < len(got) and got == want
    left = spark.read.format("statestore").option("stateVarName", "fsm").load(str(tmp_path / "check"))
    assert left.isEmpty()
