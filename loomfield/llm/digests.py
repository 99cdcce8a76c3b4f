"""Document fingerprints from improbable features: rare byte windows in chained Bloom filters.

A feature is a window of `WINDOW` bytes. Every window's entropy (by its byte counts) falls in one of `BINS` + 1 bins; over
all windows of all texts (`rarity`) the bins are ranked, the rarest first, and this rank is the window's. In every run of
`WINDOW` windows the rarest (the first of equals) gets a point; windows with `POINTS` or more points are features. Windows
below `DULL` of the highest entropy (repeated bytes) never are. A text's distinct features go, in order, through `HASHES`
bits each into Bloom filters of `BITS` bits; after `FILL` features the next filter of the chain begins.

Two fingerprints are compared filter by filter: the bits they share, less those expected by chance, over the most that
they could share, less the same. Each filter of the shorter chain takes its best partner in the other; the likeness is
the mean, weighted by features (of both ways, if the chains are equally long). Equal fingerprints have likeness 1.

The texts' order is by doc_id (null counts as the least number), then by the text's hash. Texts travel once: ranges of doc_id are dealt out as
buckets of about `BUCKET` bytes and sorted there; the first text of a bucket goes to the bucket before as well, as the next
of its last text. A bucket's rows stream through its task.

Null text counts as empty. An empty text has the fingerprint "" (likeness 1 to itself, 0 to others); one
without a feature of its own (shorter than a window, or dull) is one as a whole. Very long texts are taken whole; their chains are compared some filters at a time. Repeated rows and
doc_ids stand next to each other. One document is its own next. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fields, hash_spans, packed, pieces, text_buffers

WINDOW, POINTS, BINS, DULL = 32, 8, 1000, 0.1
BITS, HASHES, FILL = 2048, 5, 160
PIECE, CHUNK, BUCKET, MOST_BUCKETS = 2 << 20, 1 << 16, 4 << 20, 8192  # beyond so many buckets they grow; their rows are sorted on disk
_LEAST = -(1 << 63)
_PLOGP = np.array([0, *(round(k * np.log2(k) * 2**20) for k in range(1, WINDOW + 1))], np.int64)


def entropy_bins(buf: np.ndarray) -> np.ndarray:
    """The entropy bin of the window that starts at each of buf's places but the last WINDOW - 1."""
    n, steps = len(buf) - WINDOW + 1, np.diff(_PLOGP)
    out = np.zeros(max(0, n), np.int16)
    for a in range(0, n, CHUNK):
        x = buf[a : a + CHUNK + WINDOW]
        later, before = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)  # how often a byte comes again within a window
        for d in range(1, WINDOW):
            same = x[d:] == x[:-d]
            later[:-d] += same
            before[d:] += same
        m = min(CHUNK, n - a)
        total = np.empty(m, np.int64)
        total[0] = _PLOGP[np.bincount(x[:WINDOW])].sum()
        np.cumsum(steps[before[WINDOW : WINDOW + m - 1]] - steps[later[: m - 1]], out=total[1:])
        total[1:] += total[0]
        out[a : a + m] = np.rint(BINS * (1 - total / _PLOGP[WINDOW]))
    return out


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of n places start a window that doesn't leave its text."""
    edge = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    fits = sizes >= WINDOW
    np.add.at(edge, offsets[:-1][fits], 1)
    np.add.at(edge, offsets[1:][fits] - WINDOW + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy bin, over all windows of docs' texts: 0 is the rarest; dull bins have BINS + 1."""

    def count(batches):
        seen = np.zeros(BINS + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, most=PIECE):
                buf, offsets = text_buffers(part.column("text"))
                bins = entropy_bins(buf)
                seen += np.bincount(bins[_inside(offsets, len(bins))], minlength=BINS + 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bin", "n"])

    counts = np.zeros(BINS + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS + 1 rows at most
        counts[r["bin"]] = r["n"]
    ranks = np.empty(BINS + 1, np.int16)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BINS + 1)
    ranks[: int(BINS * DULL)] = BINS + 1
    return ranks


def features(buf: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each feature, first): text i has features first[i]:first[i + 1], in order, each once."""
    n_texts, n = len(offsets) - 1, max(0, len(buf) - WINDOW + 1)
    if n:
        inside = _inside(offsets, n)
        rank = np.where(inside, ranks[entropy_bins(buf)], BINS + 2)
        points = np.zeros(n, np.int32)
        for a in range(0, n, CHUNK):
            m = min(CHUNK, n - a)
            key = rank[a : a + m + WINDOW - 1].astype(np.int32) << 17
            key |= np.arange(len(key), dtype=np.int32)
            key = np.append(key, np.full(m + WINDOW - 1 - len(key), np.iinfo(np.int32).max, np.int32))
            width = 1
            while width < WINDOW:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            best = (key & 0x1FFFF)[inside[a : a + m]]
            got = np.bincount(best)
            points[a : a + len(got)] += got.astype(np.int32)
        at = np.flatnonzero((points >= POINTS) & (rank <= BINS))
        text, h = np.searchsorted(offsets, at, "right") - 1, hash_spans(buf, at, at + WINDOW)
    else:
        text, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    has = np.zeros(n_texts, bool)
    has[text] = True
    short = np.flatnonzero((np.diff(offsets) > 0) & ~has)
    if len(short):
        text, h = np.concatenate([text, short]), np.concatenate([h, hash_spans(buf, offsets[short], offsets[short + 1])])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    order = np.lexsort((np.arange(len(h)), h, text))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    kept = np.sort(order[fresh])
    return h[kept], np.searchsorted(text[kept], np.arange(n_texts + 1))


def filters(h: np.ndarray) -> np.ndarray:
    """The Bloom filters of a text's features, a row each, as 64-bit words."""
    bits = np.zeros((-(-len(h) // FILL), BITS), np.uint8)
    for k in range(HASHES):
        bits[np.arange(len(h)) // FILL, ((h >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def likeness(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> float:
    """Of two chains of filters with n_a and n_b features, from 0 to 1."""
    if not n_a or not n_b:
        return float(n_a == n_b)
    if n_a == n_b and np.array_equal(a, b):
        return 1.0
    if len(a) > len(b):
        a, n_a, b, n_b = b, n_b, a, n_a
    ones_a, ones_b = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    step = max(1, (1 << 18) // max(1, len(b)))
    for i in range(0, len(a), step):
        shared = np.zeros((len(a[i : i + step]), len(b)))
        for k in range(0, len(b), 4096):
            shared[:, k : k + 4096] = np.array([np.bitwise_count(x & b[k : k + 4096]).sum(1) for x in a[i : i + step]])
        chance = np.outer(ones_a[i : i + step], ones_b) / BITS
        part = np.clip((shared - chance) / np.maximum(np.minimum.outer(ones_a[i : i + step], ones_b) - chance, 1e-9), 0, 1)
        best_a[i : i + step] = part.max(1)
        best_b = np.maximum(best_b, part.max(0))
    sizes = [np.append(np.full(len(x) - 1, FILL), n - FILL * (len(x) - 1)) for x, n in ((a, n_a), (b, n_b))]
    one = float(best_a @ sizes[0] / n_a)
    return one if len(a) < len(b) else (one + float(best_b @ sizes[1] / n_b)) / 2


def digest(chain: np.ndarray, n: int) -> str:
    """A chain as text: the number of features, and the filters in base64."""
    return f"{n}:{base64.b64encode(chain.tobytes()).decode()}" if n else ""


def parsed(text: str) -> tuple[np.ndarray, int]:
    """The chain and number of features of a fingerprint."""
    if not text:
        return np.zeros((0, BITS // 64), np.uint64), 0
    n, chain = text.split(":")
    return np.frombuffer(base64.b64decode(chain), np.uint64).reshape(-1, BITS // 64), int(n)


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """A struct `doc` of docs' columns but text, and the text's fingerprint under the ranks of `rarity`."""
    src = docs.select(packed(c for c in docs.columns if c != "text").alias("doc"), F.col("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, most=PIECE):
                buf, offsets = text_buffers(part.column("text"))
                h, first = features(buf, offsets, ranks)
                marks = [digest(filters(h[a:b]), int(b - a)) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(marks, pa.string())], names=["doc", "fingerprint"])

    return src.mapInArrow(run, fields(src.schema["doc"].dataType, "fingerprint string"))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list[int | None], texts: list[str], ranks: np.ndarray) -> pa.RecordBatch:
    """Rows of the documents ids; texts has one more: the next of the last."""
    n = len(ids)
    own = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    buf, offsets = text_buffers(pa.array(texts + own, pa.string()))
    h, first = features(buf, offsets, ranks)
    sizes = np.diff(first).tolist()
    chains = [filters(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    marks = [digest(c, k) for c, k in zip(chains, sizes, strict=True)]
    near = lambda i, j: likeness(chains[i], sizes[i], chains[j], sizes[j])
    columns = [
        ids, [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode()).hexdigest() for t in own], marks[:n], marks[n + 1 :],
        [near(i, n + 1 + i) for i in range(n)], [near(i, i + 1) for i in range(n)],
    ]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, _OUT.split(", "), strict=True)], names=[f.split()[0] for f in _OUT.split(", ")])


def _bucket(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts (key, tie) are not above a row, by halving."""
    if not cuts:
        return F.lit(0)
    keys, ties = (F.lit([c[k] for c in cuts]) for k in (0, 1))

    def halve(span: Column, _: Column) -> Column:
        at = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        cut, low = F.get(keys, at), span["lo"] < span["hi"]
        above = (cut > key) | (cut == key) & (F.get(ties, at) > tie)
        return F.struct(F.when(low & ~above, at + 1).otherwise(span["lo"]).alias("lo"), F.when(low & above, at).otherwise(span["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda x: x["lo"])


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET) -> DataFrame:
    """bucket, spare, doc_id, text, sorted within partitions: each row's next stands below it, in its bucket; spare rows are only a next."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    key, tie = F.coalesce("doc_id", F.lit(_LEAST)), F.xxhash64("text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(min(MOST_BUCKETS, max(1, -(-size // bucket_bytes))))
    at = (rows.agg(F.approx_percentile(key, [k / n for k in range(1, n)], 10 * n)).first()[0] or []) if n > 1 else []
    # A doc_id that fills several quantiles is cut by the texts' hashes.
    cuts = [(d, _LEAST + (k << 64) // len(same)) for d, same in ((d, list(g)) for d, g in itertools.groupby(at)) for k in range(len(same))]
    ranged = rows.withColumns({"key": key, "tie": tie}).withColumn("bucket", _bucket(F.col("key"), F.col("tie"), cuts))
    heads = ranged.groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("head")).orderBy("bucket").collect()  # MOST_BUCKETS + 1 rows at most
    before = [(r["bucket"], r["head"]["key"], r["head"]["tie"], k, (k or len(heads)) - 1) for k, r in enumerate(heads)]
    table = spark.createDataFrame(before, "bucket int, head_key long, head_tie long, slot int, before int")
    own = F.struct(F.col("slot").alias("bucket"), F.lit(False).alias("spare"))
    placed = F.when((F.col("key") == F.col("head_key")) & (F.col("tie") == F.col("head_tie")), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("spare")))).otherwise(F.array(own))
    dealt = ranged.join(F.broadcast(table), "bucket").select(F.explode(placed).alias("at"), "key", "tie", "doc_id", "text").select("at.*", "key", "tie", "doc_id", "text")
    return dealt.repartitionById(max(1, len(heads)), F.col("bucket")).sortWithinPartitions("bucket", "spare", "key", "tie").select("bucket", "spare", "doc_id", "text")


def compare_with_next(docs: DataFrame, ranks: np.ndarray, bucket_bytes: int = BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its next
        for batch in batches:
            for part in pieces(batch, most=PIECE):
                ids, texts, buckets, spare = (part.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "spare"))
                if last is not None:
                    ids, texts, buckets, spare = [last[0], *ids], [last[1], *texts], [last[2], *buckets], [False, *spare]
                ends = [k for k in range(len(ids)) if spare[k]]
                start = 0
                for end in [*ends, len(ids) - 1]:
                    if end > start:
                        yield _compared(ids[start:end], texts[start : end + 1], ranks)
                    start = end + 1
                last = None if spare[-1] else (ids[-1], texts[-1], buckets[-1])

    return with_next(docs, bucket_bytes).mapInArrow(run, _OUT)


def op12_rare_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return compare_with_next(docs, rarity(docs))
