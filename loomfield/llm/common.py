"""Helpers that the text operators share: the shared folder, and words and hashes of Arrow batches.

Word finding and hashing run over the bytes of a whole Arrow batch at once, so a task's cost is a few
numpy passes over its text rather than a Python loop over its words.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 20  # bytes hashed at a time

# The delimiter classes of the two kinds of word.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
IS_WORD = {"space": ~_SPACE, "alnum": ~_PUNCT}
WORD_RE = {"space": r"[^\x20\x09-\x0D]+", "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset: below a new local one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loomfield-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    schema = df.schema
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _FOLDERS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more: all that was made of them has been written itself."""
    for table in tables:
        if (path := _FOLDERS.pop(table, None)) is not None:
            spark = table.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of the Arrow batches that go to Python workers: their number of rows says nothing about long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def quoted(name: str) -> str:
    """A column's name as select() and col() read it, whatever stands in it."""
    return f"`{name.replace('`', '``')}`"


def packed(names: Iterable[str]) -> Column:
    """A struct of the named columns; one that is never empty."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in names), F.lit(0).alias("__"))


def unpacked(name: str, struct: str = "doc") -> Column:
    return F.col(f"{struct}.{quoted(name)}")


def fields(struct: DataType, rest: str, name: str = "doc") -> StructType:
    """The schema of a struct, then of the columns of rest; a struct's own names may be any."""
    return StructType([StructField(name, struct), *StructType.fromDDL(rest).fields])


def ascii_lower(text: Column) -> Column:
    """A-Z only: F.lower would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def py_crc32_of_id(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of kept bytes that don't cross texts: (starts, ends, first), text i having spans first[i]:first[i + 1]."""
    w = keep[buf]
    at_start, at_end = w.copy(), w.copy()
    at_start[1:] &= ~w[:-1]
    at_end[:-1] &= ~w[1:]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    at_start[heads] |= w[heads]
    at_end[tails] |= w[tails]
    starts, ends = np.flatnonzero(at_start), np.flatnonzero(at_end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial by prefix sums, then mixed. Spans are in order."""
    out, i = np.empty(len(starts), U64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        s0, s, e = starts[i], starts[i:j] - starts[i], ends[i:j] - starts[i]
        p, q = _power(max(_SPAN, int(e[-1])) + 1)
        part = buf[s0 : s0 + e[-1]].astype(U64) + U64(1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(part * p[: len(part)], out=total[1:])
        out[i:j] = (total[e] - total[s]) * q[s]
        i = j
    return mix(out ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def hash_runs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run h[first[i]:first[i + 1]], in order."""
    n = len(first) - 1
    p, q = _power(max(_SPAN, len(h)) + 1)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    a, b = first[:-1], first[1:]
    return mix(((total[b] - total[a]) * q[a] if n else np.zeros(0, U64)) ^ ((b - a).astype(U64) * U64(0xD6E8FEB86659FD93)))


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, text) of every window of width words inside a text."""
    counts = np.diff(first)
    if not len(h) or len(h) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(h) - width + 1
    out = np.zeros(n, U64)
    for k in range(width):
        out = out * U64(_P) + h[k : k + n]
    text = np.repeat(np.arange(len(counts)), counts)
    inside = text[:n] == text[width - 1 :]
    at = np.flatnonzero(inside)
    return mix(out[at]), at, text[at]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` text bytes, or one text: bounds what a task holds."""
    _, offsets = text_buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run values[first[i]:first[i + 1]], empty runs included."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
