"""Quality classifier: a linear SVM on n-gram indicators that are scaled by class log-count ratios.

Tokens are lower-cased (A-Z) words and runs of ASCII symbols; features are hashed indicators of tokens, of pairs of
neighbouring tokens, and of the n-gram shapes "x x" and "x y x y". Each feature's value is its log-count ratio between the classes; a hinge-loss linear model is
fitted on the unit-length rows by dual coordinate descent, and its margin is mapped to 0..1 by a logistic curve that is
fitted on a tenth of the sample that the descent hasn't seen.

Fitting uses at most `MAX_ROWS` labelled rows (see `labelled.sample`), and of those, in the order of their ids' hashes, as
many as have `MAX_FEATURES` features together: rows are taken whole or not at all, long ones too. Features are made on the
executors, the descent runs on the driver over index lists of that total length. Scoring is one map over all documents with the weights broadcast:
2**BITS floats, whatever the input's size.

Empty or null text: no features, the score of the intercept alone. No usable labels of one class: every score is the
share of the class that there is (0.5 if none). Null doc_id: counts as the empty text for the fold. Repeated rows:
scored alike. Very long texts: all their features count. Ties: of several texts of one doc_id the least is fitted. Empty
table: no rows. Other columns of either table, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, U64, discard, documents, hash_spans, mix, pieces, spans, text_buffers, written
from .labelled import held_out, sample

MAX_ROWS = 8_000
BITS = 18
MAX_FEATURES = 6_000_000  # of all rows of the sample together
EPOCHS, COST = 12, 1.0
THRESHOLD = 0.3

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[c for c in range(0x21, 0x7F) if not IS_WORD["alnum"][c] and not chr(c).isupper()]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each distinct feature of each text, in order."""
    buf, offsets = text_buffers(texts)
    buf = LOWER[buf]
    n, s, e = len(offsets) - 1, [], []
    for keep in (IS_WORD["alnum"], _IS_SYMBOL):
        a, b, _ = spans(buf, offsets, keep)
        s.append(a), e.append(b)
    s, e = np.concatenate(s), np.concatenate(e)
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    h, first = hash_spans(buf, s, e), np.searchsorted(s, offsets)
    text = np.repeat(np.arange(n), np.diff(first))
    pair = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])[text[:-1] == text[1:]] if len(h) else h
    mask = U64((1 << BITS) - 1)
    twice = text[:-1][(text[:-1] == text[1:]) & (h[:-1] == h[1:])]
    beats = text[:-3][(text[:-3] == text[3:]) & (h[:-3] == h[2:-1]) & (h[1:-2] == h[3:])] if len(h) > 3 else text[:0]
    ids = np.concatenate([h & mask, pair & mask, np.full(len(twice), 1, U64), np.full(len(beats), 2, U64)]).astype(np.int64)
    of = np.concatenate([text, text[:-1][text[:-1] == text[1:]], twice, beats]) if len(h) else text
    keys = np.unique((of.astype(np.int64) << BITS) | ids)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _rows(batches):
    for batch in batches:
        for part in pieces(batch, most=2 << 20):
            text, feature = features(part.column("text"))
            first = np.searchsorted(text, np.arange(part.num_rows + 1))
            lists = [feature[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "label", "features"])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, slope, intercept): score = 1 / (1 + exp(-(slope * margin + intercept)))."""
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return np.zeros(size, np.float32), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    sign = np.where(labels == 1, 1.0, -1.0)
    counts = {1: np.ones(size), -1: np.ones(size)}
    for x, y in zip(rows, sign, strict=True):
        counts[int(y)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    held = np.arange(len(rows)) % 10 == 0 if len(rows) >= 100 else np.zeros(len(rows), bool)
    values = [ratio[x] / max(np.linalg.norm(ratio[x]), 1e-9) for x in rows]
    weight, bias = np.zeros(size), 0.0
    alpha, cost = np.zeros(len(rows)), COST * np.where(sign > 0, len(rows) / (2 * (sign > 0).sum()), len(rows) / (2 * (sign < 0).sum()))
    order, rng = np.flatnonzero(~held), np.random.default_rng(7)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            x, v = rows[i], values[i]
            gradient = sign[i] * (weight[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # a row has length 1, its constant 1 more
            if (step := (new - alpha[i]) * sign[i]) != 0:
                weight[x] += step * v
                bias += step
                alpha[i] = new
    margin = np.array([weight[x] @ v + bias for x, v in zip(rows, values, strict=True)])
    use = held if held.sum() >= 50 and len(set(labels[held].tolist())) == 2 else np.ones(len(rows), bool)
    slope, intercept, target = 1.0, 0.0, (labels[use] * (use.sum() - 1) + 0.5) / use.sum()
    for _ in range(500):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(slope * margin[use] + intercept, -30, 30)))
        g, w = p - target, p * (1 - p) + 1e-6
        m = margin[use]
        hess = np.array([[w @ (m * m) + 1e-3, w @ m], [w @ m, w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([g @ m, g.sum()]))
        slope, intercept = slope - 0.5 * step[0], intercept - 0.5 * step[1]
        if np.abs(step).max() < 1e-7:
            break
    return np.stack([weight, ratio], 1).astype(np.float32), float(slope), float(intercept + slope * bias)


def score_texts(texts: pa.Array, model: tuple[np.ndarray, float, float]) -> np.ndarray:
    table, slope, intercept = model
    text, feature = features(texts)
    if table.ndim == 1:
        return np.full(len(texts), 1 / (1 + np.exp(-intercept)))
    weight, ratio = table[feature, 0], table[feature, 1]
    norm = np.sqrt(np.bincount(text, ratio * ratio, len(texts)))
    margin = np.bincount(text, weight * ratio, len(texts)) / np.maximum(norm, 1e-9)
    return 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> DataFrame:
    """doc_id, score of every document."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = written(sample(docs, labels, label, max_rows).mapInArrow(_rows, f"doc_id {kind}, label int, features array<int>").withColumn("turn", F.xxhash64("doc_id")))
    sizes = rows.select("turn", F.size("features").alias("n")).toPandas().sort_values("turn")  # of at most max_rows rows
    fits = sizes["turn"][sizes["n"].cumsum() <= max_features]
    got = rows.where(F.col("turn") <= int(fits.iloc[-1])).drop("turn").toPandas().sort_values("doc_id") if len(fits) else rows.limit(0).toPandas()
    discard(rows)
    model = spark.sparkContext.broadcast(fit([np.asarray(x, np.int64) for x in got["features"]], got["label"].to_numpy(np.int64)))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, most=4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(part.column("text"), model.value), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
