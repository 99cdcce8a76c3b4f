"""Language-model scoring with a bigram trie in Elias-Fano form.

The model is a Dirichlet-smoothed bigram model over the training words, one end after each text included:

    p(v | u) = (c(u v) + MU * p(v)) / (c(u) + MU),     p(v) = (c(v) + 1) / (N + V + 1)

The logarithm of a text's probability is a sum over its bigrams of log(c(u v) + MU p(v)), which only needs what is known
about v, less a sum over its contexts of log(c(u) + MU), which only needs what is known about u. So one shuffle is enough:
every token goes, with the word before it, to the shard of its own word; the shard counts its training bigrams, builds its
part of the trie, looks up all its tokens, and sends back one number for each text. Tokens travel packed: a block of some
thousand texts sends each shard one binary row.

A shard's trie has two levels. Words (hashes) are a monotone sequence; each has a pointer to its range of preceding words,
a second monotone sequence. Within a range the words before are sorted and, with the range's number above them, make the
whole level monotone. All three are stored in Elias-Fano form; a look-up finds the word by successor search, reads two
pointers, and finds the preceding word by successor search relative to its range. Smoothed values are quantised to 256
levels per kind. Levels are flat arrays, written to a file of the task's temporary folder and mapped from there.

A word of more than 1 / (4 shards) of the training tokens is dealt out by the word before it as well, and its count travels
in a broadcast of at most 4 * shards entries. Word identity is a 64-bit hash; a preceding word keeps 40 of its bits.

Null text: the empty text, one end. Null doc_id: its remainder is that of the empty text. Repeated rows count, and are
scored, each. No training texts: c is 0 everywhere, N = V = 0.
Very long texts are scored whole. Empty table: empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, U64, crc32_of_id, documents, hash_spans, pieces, py_crc32_of_id, spans, text_buffers, written

FOLDS, HELD = 7, 2
MU = 20.0
SHARD_TOKENS, SHARDS_PER_TASK = 1_000_000, 4
HELD_BYTES = 64 << 20  # of a task's sums
BLOCK_BYTES = 8 << 20
END, START = U64(0x8F5C28F5C28F5C29), U64(0x3C6EF372FE94F82B)
_LOW40 = U64((1 << 40) - 1)


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits in unary; access, and first place not below a value."""

    def __init__(self, values: np.ndarray, top: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, int(top // max(n, 1)).bit_length() - 1)
        values = values.astype(U64)
        self.low = _pack(values & U64((1 << self.low_bits) - 1), self.low_bits)
        high = (values >> U64(self.low_bits)).astype(np.int64)
        bits = np.zeros((n + int(top >> self.low_bits) + 2) // 64 * 64 + 64, np.uint8)
        bits[high + np.arange(n)] = 1
        self.high = np.packbits(bits, bitorder="little").view(U64)
        self.ones = np.append(0, np.cumsum(np.bitwise_count(self.high), dtype=np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Place of the rank-th one (or zero) from 0."""
        before = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        word = np.searchsorted(before, rank, "right") - 1
        bits = self.high[word] if one else ~self.high[word]
        left, at = (rank - before[word]).astype(np.int64), np.zeros(len(rank), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> at.astype(U64)) & U64((1 << step) - 1)).astype(np.int64)
            over = left >= count
            left, at = np.where(over, left - count, left), np.where(over, at + step, at)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(U64)
        return (high << U64(self.low_bits)) | _unpack(self.low, i, self.low_bits)

    def successor(self, value: np.ndarray) -> np.ndarray:
        """First place whose value is not below value, n if there is none."""
        high = (value >> U64(self.low_bits)).astype(np.int64)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = self._select(high, False) - high
        low = value & U64((1 << self.low_bits) - 1)
        while True:  # halve the bucket of equal high bits
            open_ = begin < end
            if not open_.any():
                return begin
            mid = (begin + end) // 2
            less = open_ & (_unpack(self.low, np.where(open_, mid, 0), self.low_bits) < low)
            begin, end = np.where(less, mid + 1, begin), np.where(open_ & ~less, mid, end)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values) * bits // 64 + 2, U64)
    if bits:
        at = np.arange(len(values)) * bits
        word, shift = at >> 6, (at & 63).astype(U64)
        np.bitwise_or.at(out, word, values << shift)
        spill = shift + U64(bits) > U64(64)
        np.bitwise_or.at(out, word[spill] + 1, values[spill] >> (U64(64) - shift[spill]))
    return out


def _unpack(packed: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), U64)
    at = i * bits
    word, shift = at >> 6, (at & 63).astype(U64)
    over = np.where(shift == 0, U64(0), packed[word + 1] << ((U64(64) - shift) & U64(63)))
    return ((packed[word] >> shift) | over) & U64((1 << bits) - 1)


def _quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, code book): the values themselves if they are few, else levels evenly spread between their ends."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(levels)
    distinct = np.unique(values)
    if len(distinct) <= levels:
        return np.searchsorted(distinct, values).astype(np.uint8), np.pad(distinct, (0, levels - len(distinct)))
    book = np.linspace(distinct[0], distinct[-1], levels)
    return np.rint((values - book[0]) / (book[1] - book[0])).astype(np.uint8), book


class Trie:
    """A shard: words, their counts' logarithms, and the words before them with smoothed values."""

    def __init__(self, word: np.ndarray, count: np.ndarray, pair_word: np.ndarray, before: np.ndarray, pair_count: np.ndarray, tokens: float, kinds: float, folder: str):
        """word sorted; pairs sorted by (number of their word, word before)."""
        p = (count + 1.0) / (tokens + kinds + 1)
        self.words = EliasFano(word, (1 << 64) - 1) if len(word) else None
        self.pointers = EliasFano(np.searchsorted(pair_word, np.arange(len(word) + 1)), max(len(pair_word), 1))
        top = max(len(word), 1) << 40
        self.before = EliasFano((pair_word.astype(U64) << U64(40)) | before, top)
        self.unseen, self.unseen_book = _quantise(np.log10(MU * p))
        self.context, self.context_book = _quantise(np.log10(count + MU))
        self.pair, self.pair_book = _quantise(np.log10(pair_count + MU * p[pair_word]) if len(pair_word) else np.zeros(0))
        levels = [self.pointers, self.before] + ([self.words] if self.words else [])
        for k, level in enumerate(levels):
            for name in ("low", "high", "ones"):
                setattr(level, name, _mapped(getattr(level, name), f"{folder}/{k}-{name}"))

    def look_up(self, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the smoothed bigram count, found) of words that are in the shard's word level, given by number."""
        begin, end = self.pointers.get(word).astype(np.int64), self.pointers.get(word + 1).astype(np.int64)
        want = (word.astype(U64) << U64(40)) | before
        at = self.before.successor(want)
        found = (at >= begin) & (at < end)
        inside = np.where(found, at, 0)
        if self.before.n:
            found &= self.before.get(inside) == want
        return np.where(found, self.pair_book[self.pair[inside]] if len(self.pair) else 0.0, self.unseen_book[self.unseen[word]]), found

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, present) of words by successor search."""
        if self.words is None:
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(self.words.successor(words), self.words.n - 1)
        return at, self.words.get(at) == words


def _mapped(array: np.ndarray, path: str) -> np.ndarray:
    array.tofile(path)
    return np.memmap(path, array.dtype, "r", shape=array.shape) if array.size else array


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, token before it, text) of all tokens, ends included."""
    buf, offsets = text_buffers(part.column("text"))
    buf = LOWER[buf]
    s, e, first = spans(buf, offsets, IS_WORD["space"])
    h, n = hash_spans(buf, s, e), len(offsets) - 1
    size = np.diff(first) + 1
    begin = np.append(0, np.cumsum(size))
    token = np.full(begin[-1], END, U64)
    token[np.arange(len(h)) + np.repeat(np.arange(n), size - 1)] = h
    before = np.empty_like(token)
    before[1:], before[begin[:-1]] = token[:-1], START
    return token, before, np.repeat(np.arange(n), size)


def _train(ids: list) -> np.ndarray:
    return np.array([py_crc32_of_id(x) % FOLDS != HELD for x in ids], bool)


def _shard_of(token: np.ndarray, before: np.ndarray, shards: int, heavy: np.ndarray) -> np.ndarray:
    h = token
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, token), len(heavy) - 1)
        h = np.where(heavy[at] == token, token ^ (before * U64(0x9E3779B97F4A7C15)), token)
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _count_words(batches):
    """Training counts of each slice's distinct words; the sums of a whole task are combined before the shuffle."""
    for batch in batches:
        for part in pieces(batch):
            token, _, text = _tokens(part)
            word, count = np.unique(token[_train(part.column("doc_id").to_pylist())[text]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count.astype(np.int64))], names=["word", "n"])


def _pack_tokens(token, before, text, train) -> bytes:
    """Tokens of one block and shard: distinct words, how many tokens each has, then each token's text and word before."""
    order = np.lexsort((text, token))
    token, before, text = token[order], before[order], text[order]
    word, n = np.unique(token, return_counts=True)
    low = (before & _LOW40).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    mark = (text * 2 + train[text]).astype("<u2" if len(train) < 1 << 15 else "<u4")
    return b"".join(x.tobytes() for x in (np.array([len(word), len(token), mark.itemsize], "<i8"), word.astype("<u8"), n.astype("<u4"), mark, low))


def _unpack_tokens(blob: bytes) -> tuple[np.ndarray, ...]:
    words, tokens, wide = np.frombuffer(blob, "<i8", 3)
    at = 24
    word = np.frombuffer(blob, "<u8", words, at)
    n = np.frombuffer(blob, "<u4", words, at := at + 8 * words)
    mark = np.frombuffer(blob, f"<u{wide}", tokens, at := at + 4 * words).astype(np.int64)
    low = np.zeros((tokens, 8), np.uint8)
    low[:, :5] = np.frombuffer(blob, np.uint8, 5 * tokens, at + wide * tokens).reshape(-1, 5)
    return word, n, mark >> 1, mark & 1, low.view("<u8").reshape(-1)


def _blocks(shards: int, heavy):
    def run(batches):
        task, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in pieces(batch, most=BLOCK_BYTES):
                ids, name = part.column("doc_id").to_pylist(), (task << 32) | block
                block += 1
                token, before, text = _tokens(part)
                train, shard = _train(ids), _shard_of(token, before, shards, heavy.value[0])
                order = np.argsort(shard, kind="stable")
                edge = np.searchsorted(shard[order], np.arange(shards + 1))
                row = np.bincount(text, minlength=len(ids)).astype("<i8")
                yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "shard": pa.array([-1 - name % 64], pa.int32()), "data": pa.array([row.tobytes()], pa.binary()), "ids": pa.array([ids], pa.list_(part.column("doc_id").type))})
                for k in np.flatnonzero(np.diff(edge)):
                    own = order[edge[k] : edge[k + 1]]
                    data = _pack_tokens(token[own], before[own], text[own], train)
                    yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "shard": pa.array([k], pa.int32()), "data": pa.array([data], pa.binary()), "ids": pa.array([None], pa.list_(part.column("doc_id").type))})

    return run


def _score_shard(rows: list[tuple[int, bytes]], heavy: tuple[np.ndarray, np.ndarray], tokens: float, kinds: float):
    """(block, per text: sum log10(c + 1), known tokens, model's part) of a shard's rows."""
    read = [_unpack_tokens(data) for _, data in rows]
    all_words = np.concatenate([np.repeat(r[0], r[1]) for r in read])
    train = np.concatenate([r[3] for r in read]).astype(bool)
    before = np.concatenate([r[4] for r in read])
    level, number = np.unique(all_words, return_inverse=True)
    own = np.bincount(number[train], minlength=len(level)).astype(np.float64)
    if len(heavy[0]):
        at = np.minimum(np.searchsorted(heavy[0], level), len(heavy[0]) - 1)
        own = np.where(heavy[0][at] == level, heavy[1][at], own)
    keys = (number.astype(U64) << U64(40)) | before
    pairs, pair_count = np.unique(keys[train], return_counts=True)
    del keys, all_words
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(level, own, (pairs >> U64(40)).astype(np.int64), pairs & _LOW40, pair_count.astype(np.float64), tokens, kinds, folder)
        begin = 0
        for (block, _), r in zip(rows, read, strict=True):
            end, text = begin + len(r[2]), r[2]
            place, _ = trie.numbers(r[0])
            word = np.repeat(place, r[1])
            value, _ = trie.look_up(word, before[begin:end])
            ends = np.repeat(r[0] == END, r[1])
            value = value - np.where(ends, 0.0, trie.context_book[trie.context[word]])
            c, n = own[word], int(text.max()) + 1
            yield block, np.stack([np.bincount(text, x, n) for x in (np.log10(c + 1), (c > 0).astype(np.float64), value)])
            begin = end
        del trie
    del read


def _shards(heavy, tokens: float, kinds: float, id_list: pa.DataType):
    names = ["block", "data", "sizes", "ids"]

    def emit(sums):
        for block, part in sums.items():
            texts = np.flatnonzero(part.any(0))
            data = np.array([len(texts)], "<i8").tobytes() + b"".join(x.astype(k).tobytes() for x, k in zip((texts, *part[:, texts]), ("<u4", "<f8", "<u4", "<f4"), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([None], pa.binary()), pa.array([None], id_list)], names=names)
        sums.clear()

    def flush(shard, rows, sums):
        """Adds a shard's part to the task's sums, which go out when they have grown."""
        if rows and shard >= 0:
            for block, part in _score_shard(rows, heavy.value, tokens, kinds):
                if block in sums and sums[block].shape[1] >= part.shape[1]:
                    sums[block][:, : part.shape[1]] += part
                else:
                    part[:, : sums[block].shape[1] if block in sums else 0] += sums.get(block, part[:, :0])
                    sums[block] = part
            if sum(x.nbytes for x in sums.values()) > HELD_BYTES:
                yield from emit(sums)

    def run(batches):
        shard, rows, sums = -1, [], {}
        for batch in batches:
            head = batch.filter(pa.compute.less(batch.column("shard"), 0))
            if head.num_rows:
                yield pa.RecordBatch.from_arrays([head.column("block"), pa.nulls(head.num_rows, pa.binary()), head.column("data"), head.column("ids")], names=names)
            batch = batch.filter(pa.compute.greater_equal(batch.column("shard"), 0))
            for block, k, data in zip(batch.column("block").to_pylist(), batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if k != shard:
                    yield from flush(shard, rows, sums)
                    shard, rows = k, []
                rows.append((block, data))
        yield from flush(shard, rows, sums)
        yield from emit(sums)

    return run


def _finish(tokens: float, kinds: float, start_count: float, id_type: pa.DataType):
    base = np.log10(tokens + kinds + 1)

    def run(batches):
        for batch in batches:
            for sizes, ids, parts in zip(batch.column("sizes").to_pylist(), batch.column("ids").to_pylist(), batch.column("parts"), strict=True):
                n = len(ids)
                size, log_c, known, model = np.frombuffer(sizes, "<i8"), np.zeros(n), np.zeros(n), np.zeros(n)
                for part in parts.as_py() or ():
                    k = int(np.frombuffer(part, "<i8", 1)[0])
                    at = np.frombuffer(part, "<u4", k, 8)
                    log_c[at] += np.frombuffer(part, "<f8", k, 8 + 4 * k)
                    known[at] += np.frombuffer(part, "<u4", k, 8 + 12 * k)
                    model[at] += np.frombuffer(part, "<f4", k, 8 + 16 * k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(size), pa.array(known.astype(np.int64)), pa.array(log_c - size * base), pa.array(model - np.log10(start_count + MU))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", "text")
    counts = written(src.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("word") == int(END.view(np.int64))).first()
    shards = max(1, -(-int(tokens * FOLDS / (FOLDS - 1)) // SHARD_TOKENS))
    rows = counts.where(F.col("n") > tokens / (4 * shards)).collect()  # at most 4 * shards words
    rows.sort(key=lambda r: r["word"] % (1 << 64))
    heavy = spark.sparkContext.broadcast((np.array([r["word"] % (1 << 64) for r in rows], U64), np.array([r["n"] for r in rows], np.float64)))
    id_type = src.limit(0).toArrow().schema.field("doc_id").type
    packed = src.mapInArrow(_blocks(shards, heavy), f"block long, shard int, data binary, ids array<{kind}>")
    dealt = packed.repartition(-(-shards // SHARDS_PER_TASK), "shard").sortWithinPartitions("shard", "block")
    scored = dealt.mapInArrow(_shards(heavy, float(tokens), float(kinds), pa.list_(id_type)), f"block long, data binary, sizes binary, ids array<{kind}>")
    blocks = scored.groupBy("block").agg(F.collect_list("data").alias("parts"), F.max("sizes").alias("sizes"), F.first("ids", ignorenulls=True).alias("ids"))
    out = blocks.mapInArrow(_finish(float(tokens), float(kinds), float(ends["n"]) if ends else 0.0, id_type), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (crc32_of_id(F.col("doc_id")) % FOLDS == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
