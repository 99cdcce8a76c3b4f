"""Ranked lexical search, reversed: the asked items are indexed, and documents stream through that index.

An inverted index over the items' terms (a term's postings: items and how often each holds it) goes to every task, in
blocks of items of about `BLOCK_BYTES` of text, so what is broadcast is bounded whatever the number of items. Documents are
passed twice for a block: once for the statistics (documents with terms, all terms, and in how many documents each asked
term stands; counted by task, summed by Spark), once for the scores. A task streams each document's term counts through
the postings and keeps a bounded heap of the best documents for each item; heaps are merged in groups of `MERGE` tasks,
then over all, so no task gathers more than `MERGE` heaps of an item at once.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. Scores are 64-bit
integers. Null text has no terms, like an empty one; such documents are counted nowhere and never found. Very long texts
are taken whole. Repeated rows are documents of their own; equal scores come by ascending doc_id, null last, so ties
between rows of one doc_id differ in nothing that is returned. Equal items (id and text) are one; items of one id and
different texts are searched each for itself, as is a null item_id. No items, or no documents: an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, documents, hash_spans, pieces, spans, text_buffers, written

TOP, BLOCK_BYTES, PIECE, MERGE = 20, 4 << 20, 4 << 20, 256
CELLS = 4 << 20  # scores, or postings, that a task holds at a time
UNIT = 1_000_000_000


def _terms(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term, first): text i has terms first[i]:first[i + 1]."""
    buf, offsets = text_buffers(column)
    low = LOWER[buf]
    starts, ends, first = spans(low, offsets, IS_WORD["alnum"])
    return hash_spans(low, starts, ends), first


class Index:
    """Postings of a block of items: term t stands in items item[first[t]:first[t + 1]], count times in each."""

    def __init__(self, texts: list[str]):
        h, bounds = _terms(pa.array(texts, pa.string()))
        self.n_items = len(texts)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        key, self.count = np.unique(term.astype(np.int64) * max(1, len(texts)) + owner, return_counts=True)
        self.item = key % max(1, len(texts))
        self.first = np.searchsorted(key // max(1, len(texts)), np.arange(len(self.vocabulary) + 1))

    def pairs(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text; text, term and count of each asked term that a text holds, by text)."""
        h, first = _terms(column)
        sizes = np.diff(first)
        if not len(h) or not len(self.vocabulary):
            none = np.zeros(0, np.int64)
            return sizes, none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        text = np.repeat(np.arange(len(sizes)), sizes)[known]
        key, tf = np.unique(text * len(self.vocabulary) + at[known], return_counts=True)
        return sizes, key // len(self.vocabulary), key % len(self.vocabulary), tf


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The best `top` (score, doc) of each item, over all that was offered; a doc is (is null, id)."""

    def __init__(self, n_items: int, top: int):
        self.top, self.least = top, np.ones(n_items, np.int64)  # a score below the item's least is of no use
        self.rows, self.held = [], 0

    def offer(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        self.rows.append((item, score, null, doc))
        self.held += len(item)
        if self.held > 4 * self.top * len(self.least) + 100_000:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        item, score, null, doc = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.top]
        full = place == self.top - 1
        self.least[item[full]] = score[order[full]]
        out = (item[place < self.top], score[kept], null[kept], doc[kept])
        self.rows, self.held = [out], len(kept)
        return out


def _scored(index: Index, w: np.ndarray, n_docs: int, n_terms: int, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, scores by text and item) of a slice, some texts at a time."""
    sizes, text, term, tf = index.pairs(column)
    norm = 12 * (75 + 25 * sizes.astype(np.int64) * n_docs // max(1, n_terms))
    gain = w[term] * (UNIT * tf // (1000 * tf + norm[text]))
    fans = index.first[term + 1] - index.first[term]
    i, most = 0, max(1, CELLS // max(1, index.n_items))
    total = np.append(0, np.cumsum(fans))
    while i < len(text):
        t0 = int(text[i])
        j = int(np.searchsorted(text, t0 + most))  # whole texts
        j = max(int(np.searchsorted(text, t0, "right")), min(j, int(np.searchsorted(text, text[min(len(text) - 1, int(np.searchsorted(total, total[i] + CELLS)))]))))
        n = fans[i:j]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.first[term[i:j]], n)
        scores = np.zeros((int(text[j - 1]) - t0 + 1) * index.n_items, np.int64)
        np.add.at(scores, np.repeat(text[i:j] - t0, n) * index.n_items + index.item[place], np.repeat(gain[i:j], n) * index.count[place])
        yield t0, scores.reshape(-1, index.n_items)
        i = j


def _blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """Distinct item_id, text in parts of about block_bytes; each is fetched only when it is asked for."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of every item."""
    spark, out = docs.sparkSession, None
    kind = items.schema["item_id"].dataType
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _blocks(items, block_bytes):
        rows = sorted(block.collect(), key=lambda r: (r["item_id"] is None, str(r["item_id"]), r["text"]))
        index = spark.sparkContext.broadcast(Index([r["text"] for r in rows]))

        def count(batches, index=index):
            docs_with, n_docs, n_terms = np.zeros(len(index.value.vocabulary), np.int64), 0, 0
            for batch in batches:
                for part in pieces(batch, most=PIECE):
                    sizes, _, term, _ = index.value.pairs(part.column("text"))
                    n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
                    docs_with += np.bincount(term, minlength=len(docs_with))
            seen = np.flatnonzero(docs_with)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], seen])), pa.array(np.concatenate([[n_docs, n_terms], docs_with[seen]]).astype(np.int64))], names=["term", "n"])

        counts = {r["term"]: r["n"] for r in asked.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, n_terms = counts.pop(-2, 0), counts.pop(-1, 0)
        w = np.zeros(len(index.value.vocabulary), np.int64)
        for term, df in counts.items():
            w[term] = weight(n_docs, df)
        weights = spark.sparkContext.broadcast(w)

        def score(batches, index=index, weights=weights, n_docs=n_docs, n_terms=n_terms):
            heaps = Heaps(index.value.n_items, top)
            for batch in batches:
                for part in pieces(batch, most=PIECE):
                    ids = part.column("doc_id")
                    null, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                    for t0, scores in _scored(index.value, weights.value, n_docs, n_terms, part.column("text")):
                        text, item = np.nonzero(scores >= heaps.least)
                        heaps.offer(item, scores[text, item], null[t0 + text], doc[t0 + text])
            item, best, null, doc = heaps.settle()
            lot = np.full(len(item), TaskContext.get().partitionId() // MERGE, np.int32)
            for i in range(0, len(item), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(item[s]), pa.array(lot[s]), pa.array(best[s]), pa.array(doc[s], mask=null[s])], names=["item", "lot", "score", "doc_id"])

        heaps = asked.mapInArrow(score, "item long, lot int, score long, doc_id long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "lot"], ["item"]):
            heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item long, item_id {kind.simpleString()}")
        found = heaps.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items: bounded like its index
        out = found if out is None else written(out).unionByName(found)
    return out


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS size FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS n_terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
