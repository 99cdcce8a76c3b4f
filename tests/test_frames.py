"""Framing of spooled syslog: any cuts, early segments, restarts, closed connections."""

import numpy as np
import pytest

from loomfield.streaming import frames, jobs

MESSAGES = ["<34>Oct 11 22:14:15 gate su: failed for amy\nwith a second line", "<13>hello there", "<165>1 2026-01-02T03:04:05Z host app: ünï", "<7>x"]


def _counted(m):
    raw = m.encode()
    return str(len(raw)).encode() + b" " + raw


STREAM = b"".join([_counted(MESSAGES[0]), b"<13>by line\n", _counted(MESSAGES[2]), b"2026 is a year, no count\r\n", b"\n\0", _counted(MESSAGES[1]), b"17 is no frame\n", b"<1>last without end"])
WANT = [MESSAGES[0], "<13>by line", MESSAGES[2], "2026 is a year, no count", MESSAGES[1], "17 is no frame", "<1>last without end"]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 50, 10_000])
def test_any_cuts(step):
    got, rest = [], b""
    for k in range(0, len(STREAM), step):
        own, rest = frames.split_frames(rest + STREAM[k : k + step])
        got += own
    own, rest = frames.split_frames(rest, closing=True)
    assert [f.decode() for f in got + own] == WANT and rest == b""


def test_incomplete_frames_at_the_end():
    assert frames.split_frames(b"30 <13>cut off") == ([], b"30 <13>cut off") and frames.split_frames(b"30 <13>cut off", True) == ([b"<13>cut off"], b"")
    assert frames.split_frames(b"12") == ([], b"12") and frames.split_frames(b"") == ([], b"")


def test_stream(spark, tmp_path):
    """Two connections in turn, a segment that comes early, a restart between batches; no state is left of the closed one."""
    src = tmp_path / "src"
    src.mkdir()
    rng = np.random.default_rng(1)
    cuts = [0, *sorted(rng.choice(np.arange(1, len(STREAM)), 5, replace=False).tolist()), len(STREAM)]
    parts = [STREAM[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def run():
        jobs.write_stream(frames.stream_syslog(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted((r["connection"], r["number"], r["frame"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for k in (0, 1, 3):  # 3 is early
        (src / f"a.{k}.seg").write_bytes(parts[k])
    (src / "b.c.0.seg").write_bytes(_counted(MESSAGES[0]) + b"5 <13>")
    (src / "other.txt").write_bytes(b"<1>no segment\n")
    first = run()
    assert ("b.c", 0, MESSAGES[0]) in first
    for k in (2, *range(4, len(parts))):
        (src / f"a.{k}{'.last' if k + 1 == len(parts) else ''}.seg").write_bytes(parts[k])
    (src / "b.c.1.seg").write_bytes(b"y<9>next\n")
    got = run()
    assert [f for c, _, f in got if c == "a"] == WANT and [n for c, n, _ in got if c == "a"] == list(range(7))
    assert [f for c, _, f in got if c == "b.c"] == [MESSAGES[0], "<13>y", "<9>next"]
    left = spark.read.format("statestore").option("stateVarName", "now").load(str(tmp_path / "check")).select("key.connection").collect()
    assert [r["connection"] for r in left] == ["b.c"]
    row = spark.read.parquet(str(tmp_path / "out")).where("connection = 'a' AND number = 0").first()
    assert (row["facility"], row["severity"], row["hostname"], row["tag"]) == (4, 2, "gate", "su") and row["msg"].startswith("failed for amy")
