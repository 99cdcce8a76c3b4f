"""Benchmark decontamination by an FM-index of each training shard.

A shard is a slice of a task's documents (a few MB). Its words are reduced to the benchmark's alphabet: each benchmark
word is a symbol, every other word and every document's end a separator, and runs too short to hold any window are left
out (they can match nothing). Over that sequence the task builds a suffix array, its Burrows-Wheeler transform as a
wavelet matrix with rank directories, and suffix positions sampled by text position. All windows of the benchmark are
searched backwards together; each occurrence is located by walking to the nearest sampled position, and the spans are
merged into each document's hit words.

The benchmark goes to the tasks in blocks of about `BLOCK_BYTES` of text, so what is broadcast stays bounded whatever its
size; with more than one block the documents are scanned once for each and the spans are merged by row.

Windows are `WIDTH` consecutive words of an item; an item of fewer words, but not none, is one window. Null text has no
words. A null item_id counts as the empty string; repeated item_ids count once. An empty benchmark hits nothing.
Documents are judged row by row, so null or repeated doc_ids are no special case and tied rows fare alike.
Very long texts are searched whole. Empty table: empty result. Extra columns are carried in `doc`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, documents, fields, hash_spans, packed, pieces, spans, text_buffers, unpacked, written

WIDTH = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 6 << 20
SAMPLE = 8


class BitRank:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """rank and access of symbols, a bit level at a time from the highest."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n, self.depth = len(symbols), max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        for k in reversed(range(self.depth)):
            bit = (symbols >> k) & 1
            self.levels.append(BitRank(bit))
            self.zeros.append(int((bit == 0).sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place i."""
        begin, end = np.zeros_like(i), i
        for level, zeros, k in zip(self.levels, self.zeros, reversed(range(self.depth)), strict=True):
            one, a, b = (symbol >> k) & 1 == 1, level.ones(begin), level.ones(end)
            begin, end = np.where(one, zeros + a, begin - a), np.where(one, zeros + b, end - b)
        return end - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, a = level.get(i), level.ones(i)
            out = (out << 1) | one
            i = np.where(one, zeros + a, i - a)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that still share a rank are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.append(True, text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    k = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            return order
        own = order[tied]
        later = np.where(own + k < n, rank[np.minimum(own + k, n - 1)], -1)
        again = np.lexsort((later, rank[own]))
        own, later = own[again], later[again]
        group = rank[own]
        order[tied] = own
        fresh = np.append(True, (group[1:] != group[:-1]) | (later[1:] != later[:-1]))
        head[tied] = fresh
        rank[own] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        k *= 2


class FMIndex:
    """Of a sequence of symbols below size, 0 being the separator."""

    def __init__(self, text: np.ndarray, size: int, sample: int = SAMPLE):
        text, size = np.append(text + 1, 0).astype(np.int64), size + 1  # the end is a symbol of its own
        self.n, order = len(text), suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], size)
        self.below = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        marked = order % sample == 0
        self.marked, self.places = BitRank(marked.astype(np.uint8)), order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the patterns, rows of a matrix of which lengths places are used."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, lengths[live] - back] + 1
            lo[live], hi[live] = self.below[c] + self.bwt.rank(c, lo[live]), self.below[c] + self.bwt.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.marked.get(rows[live])
            at = live[done]
            out[at] = (self.places[self.marked.ones(rows[at])] + steps[at]) % self.n
            live = live[~done]
            c = self.bwt.access(rows[live])
            rows[live] = self.below[c] + self.bwt.rank(c, rows[live])
            steps[live] += 1
        return out


class Windows:
    """The windows of a block of items, as symbols of its own alphabet."""

    def __init__(self, items: list[tuple[str, str]], width: int = WIDTH):
        buf, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
        buf = LOWER[buf]
        s, e, first = spans(buf, offsets, IS_WORD["alnum"])
        h = hash_spans(buf, s, e)
        self.alphabet = np.unique(h)
        symbol = np.searchsorted(self.alphabet, h) + 1
        of: dict[tuple[int, ...], set[str]] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:], strict=True):
            for i in range(a, max(a + 1, b - width + 1) if b > a else a):
                of.setdefault(tuple(symbol[i : min(i + width, b)].tolist()), set()).add(item)
        keys = sorted(of)
        self.items = [sorted(of[k]) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.patterns = np.zeros((len(keys), width), np.int64)
        for row, k in zip(self.patterns, keys, strict=True):
            row[: len(k)] = k


def scan(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, bench: Windows) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(hit flag of each word, (text, window) pairs) of a shard; buf is lower-case, words are starts:ends."""
    hit, pairs = np.zeros(len(starts), bool), []
    if not len(bench.patterns) or not len(starts):
        return hit, pairs
    h = hash_spans(buf, starts, ends)
    at = np.minimum(np.searchsorted(bench.alphabet, h), len(bench.alphabet) - 1)
    known = bench.alphabet[at] == h
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.append(True, ~known[1:] | ~known[:-1] | (text[1:] != text[:-1]))
    run_first = np.flatnonzero(breaks)
    run_size = np.diff(np.append(run_first, len(h)))
    keep = np.repeat(known[run_first] & (run_size >= bench.lengths.min()), run_size)
    word = np.flatnonzero(keep)
    if not len(word):
        return hit, pairs
    place = np.arange(len(word)) + np.cumsum(breaks[word]) - 1  # a separator before each later run
    sequence = np.zeros(place[-1] + 1, np.int64)
    sequence[place] = at[word] + 1
    index = FMIndex(sequence, len(bench.alphabet) + 1)
    lo, hi = index.search(bench.patterns, bench.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return hit, pairs
    counts = (hi - lo)[found]
    window = np.repeat(found, counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[found], counts)
    begin = word[np.searchsorted(place, index.locate(rows))]
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + bench.lengths[window], -1)
    both = np.unique(np.stack([text[begin], window]), axis=1)
    return np.cumsum(cover)[:-1] > 0, list(zip(*both.tolist(), strict=True))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[str, str]]] | tuple:
    """The items in blocks; each is fetched only when it is asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.where(part == k).distinct() if n > 1 else items.distinct() for k in range(n)]


def _merge(n_words: int, parts: list[tuple[np.ndarray, set[str]]]) -> tuple[int, int, str]:
    hit = np.zeros(n_words, bool)
    items: set[str] = set()
    for flags, names in parts:
        hit[flags] = True
        items |= names
    return int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_NONE = hashlib.sha256(b"").hexdigest()
_DIGEST = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(doc: pa.Array, words: np.ndarray, rows: dict[int, tuple[int, int, str]]) -> pa.RecordBatch:
    hit, items, digest = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [_NONE] * len(words)
    for t, (a, b, c) in rows.items():
        hit[t], items[t], digest[t] = a, b, c
    return pa.RecordBatch.from_arrays([doc, pa.array(words.astype(np.int64)), pa.array(hit), pa.array(items), pa.array(digest, pa.string()), pa.array(hit > 0)], names=["doc", *(f.split()[0] for f in _DIGEST.split(", "))])


def _hits(part: pa.RecordBatch, bench: Windows) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[str]]]]:
    """Words of each text; hit word numbers and items of each text that has any."""
    buf, offsets = text_buffers(part.column("text"))
    low = LOWER[buf]
    s, e, first = spans(low, offsets, IS_WORD["alnum"])
    hit, pairs = scan(low, s, e, first, bench)
    out: dict[int, tuple[np.ndarray, set[str]]] = {}
    for t, w in pairs:
        if t not in out:
            out[t] = (np.flatnonzero(hit[first[t] : first[t + 1]]), set())
        out[t][1].update(bench.items[w])
    return np.diff(first), out


def find(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A struct `doc` of docs' columns (or those named), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    src = docs.select(packed(docs.columns if columns is None else columns).alias("doc"), F.col("text").alias("text"))
    kind, parts = src.schema["doc"].dataType, blocks(benchmark, block_bytes)
    if len(parts) == 1:
        bench = spark.sparkContext.broadcast(Windows([tuple(r) for r in parts[0].collect()]))

        def run(batches):
            for batch in batches:
                for part in pieces(batch, most=SHARD_BYTES):
                    words, hits = _hits(part, bench.value)
                    yield _digest(part.column("doc"), words, {t: _merge(int(words[t]), [x]) for t, x in hits.items()})

        return src.mapInArrow(run, fields(kind, _DIGEST))
    numbered = written(src.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for block in parts:
        bench = spark.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()]))

        def emit(batches, bench=bench):
            for batch in batches:
                for part in pieces(batch, most=SHARD_BYTES):
                    _, hits = _hits(part, bench.value)
                    at = sorted(hits)
                    yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(at, pa.int64())), pa.array([hits[t][0] for t in at], pa.list_(pa.int64())), pa.array([sorted(hits[t][1]) for t in at], pa.list_(pa.string()))], names=["row", "words", "items"])

        own = written(numbered.select("row", "text").mapInArrow(emit, "row long, words array<long>, items array<string>"))
        bench.unpersist()
        found = own if found is None else found.unionByName(own)
    joined = numbered.join(found.groupBy("row").agg(F.collect_list(F.struct("words", "items")).alias("found")), "row", "left")

    def merge(batches):
        for batch in batches:
            for part in pieces(batch, most=SHARD_BYTES):
                buf, offsets = text_buffers(part.column("text"))
                words = np.diff(spans(LOWER[buf], offsets, IS_WORD["alnum"])[2])
                lists = part.column("found")
                rows = {int(t): _merge(int(words[t]), [(np.asarray(x["words"], np.int64), set(x["items"])) for x in lists[int(t)].as_py()]) for t in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))}
                yield _digest(part.column("doc"), words, rows)

    return joined.mapInArrow(merge, fields(kind, _DIGEST))


def _cut(text: str, bench: Windows) -> str:
    """text without hit spans, searched again until none is left: cutting can bring words together."""
    while True:
        buf, offsets = text_buffers(pa.array([text], pa.string()))
        low = LOWER[buf]
        s, e, first = spans(low, offsets, IS_WORD["alnum"])
        hit, _ = scan(low, s, e, first, bench)
        if not hit.any():
            return text
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        kept, pos = [], 0
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            kept.append(buf[pos : s[a]].tobytes())
            pos = int(e[b - 1])
        text = b"".join([*kept, buf[pos:].tobytes()]).decode()


def remove(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the merged spans of benchmark windows; a document of which no word is left goes. n_chars follows."""
    spark, out = docs.sparkSession, docs.select(packed(c for c in docs.columns if c != "text").alias("doc"), F.col("text"), F.lit(False).alias("changed"), F.lit(False).alias("again"))
    kind, parts = out.schema["doc"].dataType, blocks(benchmark, block_bytes)

    def sweep(rows: DataFrame) -> DataFrame:
        for block in parts:
            bench = spark.sparkContext.broadcast(Windows([tuple(r) for r in block.collect()]))

            def run(batches, bench=bench):
                for batch in batches:
                    for part in pieces(batch, most=SHARD_BYTES):
                        _, hits = _hits(part, bench.value)
                        text, changed, again = (part.column(c).to_pylist() for c in ("text", "changed", "again"))
                        for t in hits:
                            text[t], changed[t], again[t] = _cut(text[t], bench.value), True, True
                        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(text, pa.string()), pa.array(changed, pa.bool_()), pa.array(again, pa.bool_())], names=["doc", "text", "changed", "again"])

            rows = rows.mapInArrow(run, fields(kind, "text string, changed boolean, again boolean"))
        return rows

    out, done = sweep(out), None
    # A cut made for one block can bring words of another together: rows that a pass changed are searched in all blocks again.
    while len(parts) > 1:
        out = written(out)
        rest = out.where("not again")
        done = rest if done is None else done.unionByName(rest)
        if out.where("again").isEmpty():
            out = done
            break
        out = sweep(out.where("again").withColumn("again", F.lit(False)))
    columns = {c: F.col("text") if c == "text" else unpacked(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.where(~F.col("changed") | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")).select(*(x.alias(c) for c, x in columns.items()))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=["doc_id"])
    return out.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
