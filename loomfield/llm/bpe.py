"""Byte-level BPE encoding and decoding.

A text of at most `CHUNK` characters is pre-tokenised whole. A longer one is cut into chunks that overlap by `OVERLAP`
characters and are spread over the cluster. Each chunk is pre-tokenised by itself, from a place that need not be a
boundary, so its first pre-tokens may be wrong; but what follows a boundary depends on the text after it alone. So two
neighbours are stitched at the first place in their overlap where both have a boundary, and from there the later chunk is
right. Boundaries too near a chunk's end, where the rest of the text could still change them, are not used. If an overlap
has no common boundary (one run of letters or blanks longer than the overlap), that text is encoded in one piece.
Between the stitches the pre-tokens are merged by rank; a task remembers pre-tokens it has merged, up to `REMEMBERED`.
Decoding concatenates the raw bytes of the ids.

Null text is the empty text: no tokens. Documents are encoded row by row, so null or repeated ids are no special case.
Empty table: empty result. Extra columns are carried in `doc` or `row`, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fields, packed, pieces, unpacked, written

CHUNK, OVERLAP, MARGIN = 32_768, 512, 8
REMEMBERED = 300_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one pre-token: of all neighbouring parts the pair of lowest rank is merged, the leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    parts, none = [piece[i : i + 1] for i in range(len(piece))], len(ranks) + 1
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    pairs = [ranks.get(a + b, none) for a, b in pairwise(parts)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return tuple(ranks[p] for p in parts)


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap and linked neighbours, for pre-tokens of any length."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or parts[i] != left or parts[j] != right:
            continue
        parts[i] += parts[j]
        live[j], after[i] = False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return tuple(ranks[parts[i]] for i in range(n) if live[i])


class Encoder(dict):
    """Pre-token to ids, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        ids = merge(piece.encode(), self.ranks)
        self[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        return array("I", chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))))

    def encode_between(self, text: str, start: int, end: int) -> array:
        out = array("I")
        for m in self.pattern.finditer(text, start):
            if m.start() >= end:
                break
            out.extend(self[m.group()])
        return out

    def boundaries(self, text: str, more: bool) -> list[int]:
        """Ends of pre-tokens that no text after this one can change; more: whether there is any."""
        last = len(text) - MARGIN * more
        return [m.end() for m in self.pattern.finditer(text) if m.end() <= last]

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


class Shipped:
    """A vocabulary as a broadcast (a few MB, whatever the data) and its encoder in each worker."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.value = spark.sparkContext.broadcast((ranks, pattern))
        self.key = uuid.uuid4().hex

    def get(self) -> Encoder:
        if self.key not in _encoders:
            _encoders.clear()
            _encoders[self.key] = Encoder(*self.value.value)
        return _encoders[self.key]


def _little(ids: array) -> bytes:
    return np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if len(ids) else b""


def _joined(parts: str) -> Column:
    """The parts' bytes one after the other; through hex, as joining strings is linear."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, columns: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """A struct `doc` of docs' columns (or those named), n_tokens, ids_sha256, decoded_sha256 and ids (little-endian uint32)."""
    spark, ship = docs.sparkSession, Shipped(docs.sparkSession, ranks, pattern)
    src = docs.select(packed(docs.columns if columns is None else columns).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    schema = fields(src.schema["doc"].dataType, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")

    def whole(batches):
        encoder = ship.get()
        for batch in batches:
            for part in pieces(batch):
                rows = [encoder.encode(t) for t in part.column("text").to_pylist()]
                ids = [_little(r) for r in rows]
                digests = ([len(r) for r in rows], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(encoder.decode(r)).hexdigest() for r in rows])
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(digests[0], pa.int64()), pa.array(digests[1], pa.string()), pa.array(digests[2], pa.string()), pa.array(ids, pa.binary())], names=["doc", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    short = src.where(F.length("text") <= chunk).mapInArrow(whole, schema)
    long = written(src.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "at": pa.array([k], pa.int64()), "more": [k + chunk < len(text)], "text": pa.array([text[k : k + chunk + overlap]], pa.string())})

    def pre_tokenise(batches):
        encoder = ship.get()
        for batch in batches:
            heads, tails = [], []
            for at, more, text in zip(*(batch.column(c).to_pylist() for c in ("at", "more", "text")), strict=True):
                ends = encoder.boundaries(text, more and len(text) == chunk + overlap)
                heads.append([at + e for e in ends if e < overlap])
                tails.append([at + e for e in ends if e >= chunk] if more else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    chunks = long.select("row", "text").mapInArrow(cut, "row long, at long, more boolean, text string").repartition("row", "at")
    chunks = written(chunks.mapInArrow(pre_tokenise, "row long, at long, more boolean, text string, head array<long>, tail array<long>"))
    by_row = Window.partitionBy("row").orderBy("at")
    cuts = chunks.select("row", "at", "more", "head", F.lag("tail").over(by_row).alias("tail"))
    cuts = cuts.withColumn("start", F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("tail", "head"))))
    cuts = cuts.withColumn("end", F.when(F.col("more"), F.lead("start").over(by_row)).otherwise(F.lit((1 << 62)).cast("long")))
    lost = cuts.groupBy("row").agg(F.max(F.col("start").isNull() | F.col("end").isNull()).alias("lost"))
    todo = chunks.select("row", "at", "text").join(cuts.select("row", "at", "start", "end"), ["row", "at"]).join(lost.where("not lost").select("row"), "row")

    def encode_pieces(batches):
        encoder = ship.get()
        for batch in batches:
            out = []
            for at, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("at", "text", "start", "end")), strict=True):
                ids = encoder.encode_between(text, start - at, end - at)
                out.append((_little(ids), encoder.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("at"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["row", "at", "ids", "decoded"])

    parts = todo.mapInArrow(encode_pieces, "row long, at long, ids binary, decoded binary").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ids", "decoded"))).alias("parts"))
    stitched = parts.select("row", _joined("parts.ids").alias("ids"), F.sha2(_joined("parts.decoded"), 256).alias("decoded_sha256"))
    stitched = long.select("row", "doc").join(stitched, "row").select("doc", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256", "ids")
    rest = long.join(lost.where("lost").select("row"), "row").select("doc", "text").mapInArrow(whole, schema)
    return short.unionByName(stitched).unionByName(rest)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the bytes of its ids (little-endian uint32)."""
    ship = Shipped(encoded.sparkSession, ranks, "")
    src = encoded.select(packed(encoded.columns).alias("row"), F.col(ids).alias("ids"))

    def run(batches):
        encoder = ship.get()
        for batch in batches:
            raw = [encoder.decode(array("I", np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(raw, pa.binary())], names=["row", "decoded"])

    return src.mapInArrow(run, fields(src.schema["row"].dataType, "decoded binary", "row")).select(*(unpacked(c, "row").alias(c) for c in encoded.columns), "decoded")


def public_vocabulary(name: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), *public_vocabulary(), columns=["doc_id"]).select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
