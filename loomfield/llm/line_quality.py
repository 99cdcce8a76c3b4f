"""Quality rules: base text rules, and lines that too many documents of one host share.

A line's normal form is its lower-cased (A-Z) words, joined by single blanks. For every host the job counts in
how many distinct texts each normalised line stands (exact copies of a text count once, so a document is not
convicted by its own copies). A line in more than `min_texts` texts, however many the host has, is above the
limit and is removed, save in the one text that holds it first (smallest text hash). A document is depleted, and
rejected, when more than `max_removed` of its words stand in removed lines.

Two passes over the text: the first emits (host, line, text) hashes into a two-level count, so a hot host or line is
combined before it is shuffled; the second applies the lines. The lines above the limits are a sliver of all lines;
they are broadcast if at most `BROADCAST_LINES`, else joined to the documents by a row number.

Null text: no words, base_failed, not kept. Null host: a host of its own. Null or repeated doc_id: every row is
judged by its own text, repeated rows alike. Empty table: empty result. Extra columns are left out of the verdicts and
kept by `clean`, whatever their names. Very long texts are taken whole. Ties: a line that stands first in several texts of
one hash stands in equal texts, which all keep it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    IS_WORD, LOWER, U64, documents, fields, hash_runs, hash_spans, mix, packed, pieces, small_batches, spans, sums, text_buffers, unpacked, windows, written,
)

MIN_TEXTS, MAX_REMOVED = 20, 0.5
BROADCAST_LINES = 500_000  # 16 bytes each
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SLICE = 1 << 20  # text bytes that a task takes apart at a time

# The symbols that are counted.
SYMBOLS = "#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


class _Lines:
    """Words, lines and hashes of a slice of texts."""

    def __init__(self, texts: pa.Array):
        self.buf, self.offsets = text_buffers(texts)
        self.starts, self.ends, self.first = spans(self.buf, self.offsets, IS_WORD["space"])
        low = LOWER[self.buf]
        self.low_hash = hash_spans(low, self.starts, self.ends)
        line_s, line_e, line_first = spans(self.buf, self.offsets, _NOT_NEWLINE)
        word_a, word_b = np.searchsorted(self.starts, line_s), np.searchsorted(self.starts, line_e)
        full = word_b > word_a
        self.line_s, self.line_e = line_s[full], line_e[full]
        self.line_text = np.repeat(np.arange(len(line_first) - 1), np.diff(line_first))[full]
        self.line_words = (word_b - word_a)[full]
        self.line_word = np.append(word_a[full], len(self.starts)) if full.any() else np.zeros(1, np.int64)
        self.line_hash = hash_runs(self.low_hash, self.line_word)
        self.n = len(self.offsets) - 1
        self.text_key = hash_spans(self.buf, self.offsets[:-1], self.offsets[1:])


def _host_key(hosts: pa.Array) -> np.ndarray:
    """A hash of each host; null differs from empty."""
    buf, offsets = text_buffers(hosts)
    h = hash_spans(buf, offsets[:-1], offsets[1:])
    return np.where(hosts.is_null().to_numpy(zero_copy_only=False), U64(0x5851F42D4C957F2D), h)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_lines(batches):
    for batch in batches:
        for part in pieces(batch, most=SLICE):
            x, host = _Lines(part.column("text")), _host_key(part.column("host"))
            keys = np.unique(np.stack([mix(x.line_hash ^ host[x.line_text]), x.line_text.astype(U64)]), axis=1) if x.n and len(x.line_hash) else np.zeros((2, 0), U64)
            at = keys[1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([_signed(keys[0]), _signed(x.text_key[at])], names=["line", "text_key"])


def lines_above_limit(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """line (a hash of host and normalised line), first_text: lines of docs(text, host) above the limit."""
    src = docs.select("text", F.col("host").cast("string").alias("host"))
    lines = src.mapInArrow(_emit_lines, "line long, text_key long")
    counts = lines.groupBy("line").agg(F.countDistinct("text_key").alias("texts"), F.min("text_key").alias("first_text"))
    return counts.where(F.col("texts") > min_texts).select("line", "first_text")


_FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, removed_words long, kept_text string"


def _features(x: _Lines, removed: np.ndarray, rewrite: bool, originals: pa.Array) -> list[pa.Array]:
    """removed: of each line of x, whether it goes."""
    words = np.diff(x.first)
    lead = np.append(np.int32(0), np.cumsum((x.buf & 0xC0) != 0x80, dtype=np.int32))  # code points before each byte
    in_words = sums(lead[x.ends] - lead[x.starts], x.first)
    marks = np.append(np.int32(0), np.cumsum(_IS_SYMBOL[x.buf], dtype=np.int32))
    symbols = marks[x.offsets[1:]] - marks[x.offsets[:-1]]
    del lead, marks
    raw = hash_spans(x.buf, x.line_s, x.line_e)
    order = np.lexsort((raw, x.line_text))
    same = (raw[order][1:] == raw[order][:-1]) & (x.line_text[order][1:] == x.line_text[order][:-1]) if len(order) else np.zeros(0, bool)
    dup = np.bincount(x.line_text[order][1:][same], minlength=x.n) if len(order) else np.zeros(x.n, np.int64)
    h = hash_spans(x.buf, x.starts, x.ends)
    win, at, text = windows(h, x.first, WINDOW)
    win = mix(win ^ (text.astype(U64) * U64(0x9FB21C651E98DF25)))
    order = np.argsort(win, kind="stable")
    eq = win[order][1:] == win[order][:-1]
    twice = np.zeros(len(win), bool)
    twice[order[1:][eq]] = True
    twice[order[:-1][eq]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeat = sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), x.first)
    gone = np.bincount(x.line_text[removed], x.line_words[removed], x.n).astype(np.int64)
    texts: list[str | None] = [None] * x.n
    if rewrite:
        texts = originals.to_pylist()
        for t in np.unique(x.line_text[removed]):
            own, pos, out = (x.line_text == t) & removed, x.offsets[t], []
            for s, e in zip(x.line_s[own], x.line_e[own], strict=True):
                out.append(x.buf[pos:s])
                pos = min(e + 1, x.offsets[t + 1])
            out.append(x.buf[pos : x.offsets[t + 1]])
            texts[t] = np.concatenate(out).tobytes().decode()
    return [*(pa.array(np.asarray(c, np.int64)) for c in (words, in_words, symbols, dup, repeat, gone)), pa.array(texts, pa.string())]


def _apply(keep: list[str], lookup, rewrite: bool):
    def run(batches):
        names = [*keep, *(f.split()[0] for f in _FEATURES.split(", "))]
        for batch in batches:
            for part in pieces(batch, "__text", SLICE):
                x = _Lines(part.column("__text"))
                removed = lookup(x, part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *_features(x, removed, rewrite, part.column("__text"))], names=names)

    return run


def judge(docs: DataFrame, text: str = "text", host: str = "source", min_texts: int = MIN_TEXTS, max_removed: float = MAX_REMOVED, rewrite: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A struct `doc` of docs' columns (or those named), the features, base_failed, depleted and kept; with rewrite, kept_text and no text in `doc`."""
    spark = docs.sparkSession
    small_batches(spark)
    above = written(lines_above_limit(docs.select(F.col(text).alias("text"), F.col(host).alias("host")), min_texts))
    keep = ["doc"]
    own = [c for c in (docs.columns if columns is None else columns) if not (rewrite and c == text)]  # the text goes once
    src = docs.select(packed(own).alias("doc"), F.col(text).alias("__text"), F.col(host).cast("string").alias("__host"))
    schema = fields(src.schema["doc"].dataType, _FEATURES)
    if above.count() <= BROADCAST_LINES:
        table = above.toPandas().sort_values("line")
        known = spark.sparkContext.broadcast((table["line"].to_numpy(np.int64), table["first_text"].to_numpy(np.int64)))

        def lookup(x, part):
            lines, first = known.value
            key = mix(x.line_hash ^ _host_key(part.column("__host"))[x.line_text]).view(np.int64)
            if not len(lines):
                return np.zeros(len(key), bool)
            at = np.minimum(np.searchsorted(lines, key), len(lines) - 1)
            return (lines[at] == key) & (first[at] != x.text_key[x.line_text].view(np.int64))

        out = src.mapInArrow(_apply(keep, lookup, rewrite), schema)
    else:
        numbered = written(src.withColumn("__row", F.monotonically_increasing_id()))

        def emit(batches):
            for batch in batches:
                for part in pieces(batch, "__text", SLICE):
                    x = _Lines(part.column("__text"))
                    key = mix(x.line_hash ^ _host_key(part.column("__host"))[x.line_text])
                    row = part.column("__row").to_numpy()[x.line_text]
                    yield pa.RecordBatch.from_arrays([pa.array(row), _signed(key), _signed(x.text_key[x.line_text])], names=["__row", "line", "text_key"])

        hit = numbered.select("__row", "__text", "__host").mapInArrow(emit, "__row long, line long, text_key long").join(above, "line").where("text_key != first_text")
        gone = hit.groupBy("__row").agg(F.collect_set("line").alias("__gone"))

        def lookup(x, part):
            key = mix(x.line_hash ^ _host_key(part.column("__host"))[x.line_text]).view(np.int64)
            lists, removed = part.column("__gone"), np.zeros(len(key), bool)
            for t in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                own = x.line_text == t
                removed[own] = np.isin(key[own], np.asarray(lists[int(t)].as_py(), np.int64))
            return removed

        out = numbered.join(gone, "__row", "left").drop("__row").mapInArrow(_apply(keep, lookup, rewrite), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("depleted", F.col("removed_words") > max_removed * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents of docs, without the lines above their limits; n_chars, where there is such a column, follows."""
    out = judge(docs, text, host, rewrite=True, **limits).where("kept")
    columns = {c: F.col("kept_text") if c == text else unpacked(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("removed_words") == 0, columns["n_chars"]).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(x.alias(c) for c, x in columns.items()))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), columns=["doc_id"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
