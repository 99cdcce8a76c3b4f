"""Syslog over TCP, from spooled segments: octet-counted and newline framing, whatever the places at which segments were cut.

A listener writes what a connection sends as files `<connection>.<number>.seg`, numbered from 0; the last is named
`<connection>.<number>.last.seg` and holds a line feed at least, as empty files are not read. Spark's file source makes them replayable. The bytes after the last whole frame are kept in the connection's
state until the next segment comes; segments that come early wait there too. A frame that begins with a number, a blank and
`<` is octet-counted, others end at a line feed; what is left when a connection closes is a frame as well. State goes when
the connection closes. Frames of fewer than `LEAST` characters are left out; bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.logs import parse_syslog_wire
from .sequences import rocksdb_state

LEAST = 4
_COUNTED = re.compile(rb"([1-9]\d{0,8}) <")
_MAYBE = re.compile(rb"[1-9]\d{0,8} ?\Z")  # too short to tell


def split_frames(data: bytes, closing: bool = False) -> tuple[list[bytes], bytes]:
    """(whole frames, what is left); closing: nothing more will come, so nothing is left."""
    frames, at = [], 0
    while at < len(data):
        if data[at] in b"\n\r\0":
            at += 1
            continue
        head = _COUNTED.match(data, at)
        if head:
            begin = head.end() - 1
            end = begin + int(head[1])
            if end > len(data) and not closing:
                break
            frames.append(data[begin:end])
            at = end
            continue
        if not closing and _MAYBE.match(data, at):
            break
        end = data.find(b"\n", at)
        if end < 0:
            if not closing:
                break
            end = len(data)
        frames.append(data[at:end].rstrip(b"\r\0"))
        at = end + 1
    return frames, data[min(at, len(data)) :]


class FrameProcessor(StatefulProcessor):
    """The frames of one connection, in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "segment long, frames long, rest binary")
        self.early = handle.getMapState("early", "segment long", "content binary, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        wanted, number, rest = self.now.get() if self.now.exists() else (0, 0, b"")
        wanted, number, rest = int(wanted), int(number), bytes(rest)
        waiting = {int(k[0]): (bytes(v[0]), bool(v[1])) for k, v in self.early.iterator()} if self.early.exists() else {}
        known = set(waiting)
        for part in rows:
            waiting |= {int(n): (bytes(c), bool(x)) for n, c, x in zip(part["segment"], part["content"], part["last"], strict=True) if n >= wanted}
        out, closed = [], False
        while wanted in waiting and not closed:
            content, closed = waiting.pop(wanted)
            frames, rest = split_frames(rest + content, closed)
            out += [(key[0], number + k, f.decode("utf-8", "replace")) for k, f in enumerate(frames)]
            wanted, number = wanted + 1, number + len(frames)
        if closed:
            self.now.clear()
            self.early.clear()
        else:
            self.now.update((wanted, number, rest))
            for n in known - set(waiting):
                self.early.removeKey((n,))
            for n in set(waiting) - known:
                self.early.updateValue((n,), waiting[n])
        if out:
            yield pd.DataFrame(out, columns=["connection", "number", "frame"])

    def close(self) -> None:
        pass


def stream_segments(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """connection, segment, last, content of the segment files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.seg").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^(.+?)\.(\d+)(\.last)?\.seg$", k)
    return files.where(name.rlike(r"^.+\.\d+(?:\.last)?\.seg$")).select(part(1).alias("connection"), part(2).cast("long").alias("segment"), (part(3) != "").alias("last"), "content")


def stream_syslog(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """connection, number, frame, and the parts of the syslog header, of all frames; `msg` is what a normaliser reads."""
    segments = stream_segments(rocksdb_state(spark), path, files_per_batch)
    frames = segments.groupBy("connection").transformWithStateInPandas(FrameProcessor(), "connection string, number long, frame string", "append", "none")
    return frames.where(F.length("frame") >= LEAST).withColumns(parse_syslog_wire(F.col("frame")))
