"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

A word enters the network as a learned vector of its hash bucket, the mean of learned vectors of its character n-grams,
and fixed inputs: its own class log-odds and, for n-grams of each length in `GRAMS`, the largest log-odds, counted on the sample (in training,
on the other parts of the sample than the text's own, so that they mean the same as in a new text).
Every text is cut into windows of `WINDOW` words, a new one each `STRIDE` words, to its end; the network scores all of
them, and the text's score is that of its highest window. Training is by hand in numpy (back-propagation through time,
Adam): each epoch takes the windows that score highest now, as a toxic text needs one toxic window and a clean one none.
Parts are dealt at random within each class; small samples get more epochs, so that there are at least `STEPS` steps.

Fitting uses at most `MAX_ROWS` labelled rows, of at most `MAX_CHARS` characters each (see `labelled.sample`), on the
driver; scoring is one map over all whole texts, with a model of fixed size broadcast. Inputs are the text alone.

Empty or null text: one window without words. No labels of one class: every score is that class's absence (0.5 where
there are no labels). Null doc_id counts as the empty text for the fold. Repeated rows are scored alike.
Very long texts are scored in all their windows. Empty table: empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_WORD, LOWER, U64, documents, hash_spans, mix, pieces, spans, text_buffers
from .labelled import held_out, sample

MAX_ROWS, MAX_CHARS = 3_000, 100_000
WINDOW, STRIDE = 16, 8
HIDDEN, ATTENTION, LEARNED, BITS, LEARNED_BITS = 8, 8, 4, 16, 10
GRAMS = (4, 6, 8)  # bytes, with a mark before and behind the word
LOW = (1 << LEARNED_BITS) - 1
FIXED = 1 + len(GRAMS)
INPUTS = 2 * LEARNED + FIXED
EPOCHS, STEPS, BATCH, RATE, PARTS, DROP = 5, 300, 64, 0.01, 4, 0.9  # at least so many epochs, and so many batches in all
THRESHOLD = 0.5


class Words:
    """The distinct words of some texts, their n-grams, and the windows of the texts."""

    def __init__(self, texts: pa.Array):
        buf, offsets = text_buffers(texts)
        buf = LOWER[buf]
        s, e, self.first = spans(buf, offsets, IS_WORD["alnum"])
        keys, at, self.word = np.unique(hash_spans(buf, s, e), return_index=True, return_inverse=True)
        self.bucket = (keys & U64((1 << BITS) - 1)).astype(np.int64)
        size = (e - s)[at] + 2
        byte_first = np.append(0, np.cumsum(size + GRAMS[-1]))
        marked = np.zeros(byte_first[-1], U64)
        marked[byte_first[:-1]] = 1
        inner = np.arange((size - 2).sum()) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
        marked[inner + np.repeat(byte_first[:-1] + 1, size - 2)] = buf[inner + np.repeat(s[at], size - 2)].astype(U64) + U64(2)
        marked[byte_first[:-1] + size - 1] = 1
        self.gram_first, self.gram = [], []
        for length in GRAMS:
            count = np.maximum(size - length + 1, 1)
            first = np.append(0, np.cumsum(count))
            step = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(byte_first[:-1], count)
            gram = np.full(len(step), length, U64)
            for k in range(length):
                gram = gram * U64(0x9E3779B97F4A7C15) + marked[step + k]
            self.gram_first.append(first)
            self.gram.append((mix(gram) & U64((1 << BITS) - 1)).astype(np.int64))
        n = np.diff(self.first)
        self.windows = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        self.window_first = np.append(0, np.cumsum(self.windows))
        self.window_text = np.repeat(np.arange(len(n)), self.windows)
        place = np.arange(self.window_first[-1]) - np.repeat(self.window_first[:-1], self.windows)
        self.window_at = self.first[self.window_text] + place * STRIDE
        self.window_size = np.clip(self.first[self.window_text + 1] - self.window_at, 0, WINDOW)

    def inputs(self, model: dict[str, np.ndarray]) -> np.ndarray:
        """One row for each distinct word, and a row of zeros for no word."""
        out = np.zeros((len(self.bucket) + 1, INPUTS), np.float32)
        if len(self.bucket):
            out[:-1, :LEARNED] = model["words"][self.bucket & LOW]
            first, gram = self.gram_first[0], self.gram[0]
            out[:-1, LEARNED : 2 * LEARNED] = np.add.reduceat(model["grams"][gram & LOW], first[:-1]) / np.diff(first)[:, None]
            out[:-1, 2 * LEARNED] = model["word_odds"][self.bucket]
            for k, (first, gram) in enumerate(zip(self.gram_first, self.gram, strict=True)):
                out[:-1, 2 * LEARNED + 1 + k] = np.maximum.reduceat(model["gram_odds"][gram], first[:-1])
        return out

    def cells(self, windows: np.ndarray) -> np.ndarray:
        """The distinct-word number at each place of the windows; that of no word behind their ends."""
        at = self.window_at[windows, None] + np.arange(WINDOW)
        live = np.arange(WINDOW) < self.window_size[windows, None]
        return np.where(live, self.word[np.where(live, at, 0)], len(self.bucket)) if len(self.word) else np.full((len(windows), WINDOW), len(self.bucket))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
    model = {k: draw(1 << LEARNED_BITS, LEARNED) for k in ("words", "grams")}
    for d in "fb":
        model |= {f"x{d}": draw(INPUTS, 3 * HIDDEN) * 0.5, f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return model | {"att": draw(2 * HIDDEN, ATTENTION), "att_c": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION), "out": draw(2 * HIDDEN), "out_c": np.zeros(1, np.float32)}


def _gru(x: np.ndarray, live: np.ndarray, h_weight: np.ndarray, tape: list | None) -> np.ndarray:
    """x: (time, window, 3 * HIDDEN) projected inputs. States (time, window, HIDDEN); a dead place keeps the state."""
    states, h, k = np.zeros((*x.shape[:2], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32), HIDDEN
    for t in range(len(x)):
        gates = _sigmoid(x[t, :, : 2 * k] + h @ h_weight[:, : 2 * k])
        reset, update = gates[:, :k], gates[:, k:]
        new = np.tanh(x[t, :, 2 * k :] + (reset * h) @ h_weight[:, 2 * k :])
        after = np.where(live[t][:, None], h + update * (new - h), h)
        if tape is not None:
            tape.append((h, reset, update, new))
        states[t] = h = after
    return states


def forward(model: dict[str, np.ndarray], inputs: np.ndarray, cells: np.ndarray, size: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """The logit of each window."""
    live = np.arange(WINDOW)[:, None] < size
    at = cells.T
    states = []
    for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
        steps: list = []
        x = (inputs @ model[f"x{d}"] + model[f"c{d}"])[at[order]]
        out = _gru(x, live[order], model[f"h{d}"], steps if tape is not None else None)
        states.append(out[order])
        if tape is not None:
            tape[d] = steps
    both = np.concatenate(states, axis=2)
    hidden = np.tanh(both @ model["att"] + model["att_c"])
    score = np.where(live, hidden @ model["att_v"], np.float32(-1e9))
    weight = np.exp(score - score.max(0)) * live
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = (weight[:, :, None] * both).sum(0)
    if tape is not None:
        tape |= {"live": live, "at": at, "both": both, "hidden": hidden, "weight": weight, "pooled": pooled}
    return pooled @ model["out"] + model["out_c"]


def backward(model: dict[str, np.ndarray], inputs: np.ndarray, tape: dict, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of all parameters, and "inputs": that of the word inputs."""
    k, both, weight, hidden, live, at = HIDDEN, tape["both"], tape["weight"], tape["hidden"], tape["live"], tape["at"]
    g = {"out": tape["pooled"].T @ d_logit, "out_c": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * model["out"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = (both * d_pooled).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["att_v"] = np.einsum("tba,tb->a", hidden, d_score)
    d_hidden = d_score[:, :, None] * model["att_v"] * (1 - hidden * hidden)
    g["att"], g["att_c"] = np.einsum("tbh,tba->ha", both, d_hidden), d_hidden.sum((0, 1))
    d_both = d_both + d_hidden @ model["att"].T
    g["inputs"] = np.zeros_like(inputs)
    for d, order, part in (("f", slice(None), slice(0, k)), ("b", slice(None, None, -1), slice(k, 2 * k))):
        d_states, alive, own = d_both[order][:, :, part], live[order], at[order]
        hw, d_h = model[f"h{d}"], np.zeros((both.shape[1], k), np.float32)
        d_hw, d_x = np.zeros_like(hw), np.zeros((len(own), both.shape[1], 3 * k), np.float32)
        for t in reversed(range(len(own))):
            h, reset, update, new = tape[d][t]
            d_h = d_h + d_states[t]
            on = d_h * alive[t][:, None]
            d_new = on * update * (1 - new * new)
            d_update = on * (new - h) * update * (1 - update)
            d_rh = d_new @ hw[:, 2 * k :].T
            d_reset = d_rh * h * reset * (1 - reset)
            gates = np.concatenate([d_reset, d_update], axis=1)
            d_hw[:, : 2 * k] += h.T @ gates
            d_hw[:, 2 * k :] += (reset * h).T @ d_new
            d_x[t] = np.concatenate([gates, d_new], axis=1)
            d_h = (d_h - on) + on * (1 - update) + d_rh * reset + gates @ hw[:, : 2 * k].T
        g[f"h{d}"] = d_hw
        flat, cell = d_x.reshape(-1, 3 * k), own.reshape(-1)
        g[f"c{d}"] = flat.sum(0)
        per_word = np.stack([np.bincount(cell, flat[:, j], len(inputs)) for j in range(3 * k)], axis=1).astype(np.float32)
        g[f"x{d}"] = inputs.T @ per_word
        g["inputs"] += per_word @ model[f"x{d}"].T
    return g


class _Odds:
    """Smoothed log-odds of toxic texts for each bucket, by the number of texts that hold it."""

    def __init__(self, labels: np.ndarray, part: np.ndarray):
        self.labels, self.part = labels, part
        self.count = np.zeros((PARTS, 2, 1 << BITS), np.float32)

    def add(self, bucket: np.ndarray, text: np.ndarray) -> None:
        """All buckets of some whole texts, repeats included."""
        pair = np.unique((bucket << 32) | text)
        bucket, text = pair >> 32, pair & 0xFFFFFFFF
        np.add.at(self.count, (self.part[text], self.labels[text], bucket), 1)

    def seen_from(self, part: int | None) -> np.ndarray:
        """Counted on the other parts of the sample; None: on all."""
        use = [k for k in range(PARTS) if k != part]
        rate = [(self.count[use, c].sum(0) + 1) / (((self.labels == c) & np.isin(self.part, use)).sum() + 2) for c in (0, 1)]
        return np.clip(np.log(rate[1] / rate[0]), -3, 6).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, share: float, seed: int = 11) -> dict[str, np.ndarray]:
    """share: the toxic share of all labelled rows, as the sample has more."""
    rng = np.random.default_rng(seed)
    model = _start(rng)
    model |= {"word_odds": np.zeros(1 << BITS, np.float32), "gram_odds": np.zeros(1 << BITS, np.float32), "shift": np.zeros(1)}
    if len(set(labels.tolist())) < 2:
        model["out"][:], model["shift"][0] = 0, np.log((share + 1e-3) / (1 - share + 1e-3)) if len(labels) else 0
        return model
    words = Words(pa.array(texts, pa.string()))
    part = np.zeros(len(labels), np.int64)
    for value in (0, 1):  # each class over all parts, whatever the order of the rows
        own = rng.permutation(np.flatnonzero(labels == value))
        part[own] = np.arange(len(own)) % PARTS
    word_odds, gram_odds = _Odds(labels, part), _Odds(labels, part)
    for i in range(0, len(texts), 100):  # a few texts at a time
        lo, hi = words.first[i], words.first[min(i + 100, len(texts))]
        text = np.searchsorted(words.first, np.arange(lo, hi), "right") - 1
        pair = np.unique((words.word[lo:hi] << 32) | text)
        word, text = pair >> 32, pair & 0xFFFFFFFF
        word_odds.add(words.bucket[word], text)
        grams, holders = [], []
        for first_gram, gram in zip(words.gram_first, words.gram, strict=True):
            n = np.diff(first_gram)[word]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            grams.append(gram[np.repeat(first_gram[word], n) + inner]), holders.append(np.repeat(text, n))
        gram_odds.add(np.concatenate(grams), np.concatenate(holders))
    n_words, part_of = len(words.bucket), part[words.window_text]
    trained = [k for k in model if k not in ("word_odds", "gram_odds", "shift")]
    first, second = ({k: np.zeros_like(model[k]) for k in trained} for _ in range(2))
    step, live = 0, np.arange(WINDOW)
    seen = np.stack([words.inputs(model | {"word_odds": word_odds.seen_from(c), "gram_odds": gram_odds.seen_from(c)}) for c in range(PARTS)])
    chosen_rows = len(labels) + 2 * int((labels == 0).sum())
    for epoch in range(max(EPOCHS, -(-STEPS * BATCH // chosen_rows))):
        learned = words.inputs(model)[:, : 2 * LEARNED]
        score = np.zeros(len(part_of), np.float32)
        for c in range(PARTS):
            seen[c][:, : 2 * LEARNED] = learned
            own = np.flatnonzero(part_of == c)
            if epoch:
                score[own] = logits(model, words, seen[c], own)
            else:
                score[own] = np.where(words.window_size[own, None] > live, seen[c][words.cells(own)][:, :, -FIXED:].sum(2), -9).max(1)
        rank = np.lexsort((-score, words.window_text))
        top = rank[words.window_first[:-1]]
        next_top = rank[np.minimum(words.window_first[:-1] + 1, words.window_first[1:] - 1)]
        some = words.window_first[:-1] + (rng.random(len(texts)) * words.windows).astype(np.int64)
        clean = labels == 0
        chosen = np.concatenate([top, next_top[clean], some[clean]])
        target = np.concatenate([labels, np.zeros(2 * clean.sum(), np.int64)]).astype(np.float32)
        shuffled = rng.permutation(len(chosen))
        for i in range(0, len(shuffled), BATCH):
            own = chosen[shuffled[i : i + BATCH]]
            cells = words.cells(own)
            used, local = np.unique(cells + part_of[own, None] * (n_words + 1), return_inverse=True)
            spot = np.flatnonzero(used % (n_words + 1) < n_words)
            real = used[spot] % (n_words + 1)
            x = np.zeros((len(used), INPUTS), np.float32)
            spans_of = [words.gram[0][words.gram_first[0][w] : words.gram_first[0][w + 1]] for w in real]
            sizes = np.array([len(z) for z in spans_of], np.int64)
            grams = np.concatenate(spans_of) if len(real) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(real)), sizes)
            bucket, grams = words.bucket[real] & LOW, grams & LOW
            x[spot, :LEARNED] = model["words"][bucket]
            for j in range(LEARNED):
                x[spot, LEARNED + j] = np.bincount(owner, model["grams"][grams, j], len(real)) / np.maximum(sizes, 1)
            kept = (rng.random((len(spot), 1)) >= DROP).astype(np.float32)
            x[spot, : 2 * LEARNED] *= kept / (1 - DROP)
            x[spot, -FIXED:] = seen[used[spot] // (n_words + 1), real, -FIXED:]
            tape: dict = {}
            p = _sigmoid(forward(model, x, local.reshape(cells.shape), words.window_size[own], tape))
            g = backward(model, x, tape, ((p - target[shuffled[i : i + BATCH]]) / len(own)).astype(np.float32))
            d_x = g.pop("inputs")[spot] * (kept / (1 - DROP))
            g["words"] = np.stack([np.bincount(bucket, d_x[:, j], 1 << LEARNED_BITS) for j in range(LEARNED)], 1)
            d_gram = d_x[owner, LEARNED : 2 * LEARNED] / np.maximum(sizes, 1)[owner, None]
            g["grams"] = np.stack([np.bincount(grams, d_gram[:, j], 1 << LEARNED_BITS) for j in range(LEARNED)], 1)
            step += 1
            for k in trained:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
                model[k] = (model[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    score = np.zeros(len(part_of), np.float32)
    learned = words.inputs(model)[:, : 2 * LEARNED]
    for c in range(PARTS):
        seen[c][:, : 2 * LEARNED] = learned
        own = np.flatnonzero(part_of == c)
        score[own] = logits(model, words, seen[c], own)
    best = np.maximum.reduceat(score, words.window_first[:-1]).astype(np.float64)
    model["shift"][0] = _shift(best, labels, share)
    model["word_odds"], model["gram_odds"] = word_odds.seen_from(None), gram_odds.seen_from(None)
    return model


def _shift(best: np.ndarray, labels: np.ndarray, share: float) -> float:
    """What to add to texts' logits so that their mean probability is the toxic share, each class weighted as it is in all rows."""
    mean = labels.mean()
    weight = np.where(labels == 1, share / mean, (1 - share) / (1 - mean))
    low, high = -20.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        if (weight / (1 + np.exp(-np.clip(best + middle, -30, 30)))).sum() < share * len(labels):
            low = middle
        else:
            high = middle
    return middle


def logits(model: dict[str, np.ndarray], words: Words, inputs: np.ndarray, windows: np.ndarray | None = None, most: int = 8_192) -> np.ndarray:
    windows = np.arange(len(words.window_at)) if windows is None else windows
    out = np.zeros(len(windows), np.float32)
    for i in range(0, len(out), most):
        own = windows[i : i + most]
        out[i : i + most] = forward(model, inputs, words.cells(own), words.window_size[own])
    return out


def score_texts(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    words = Words(texts)
    best = np.maximum.reduceat(logits(model, words, words.inputs(model)), words.window_first[:-1])
    return 1 / (1 + np.exp(-np.clip(best.astype(np.float64) + model["shift"][0], -30, 30)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score of every document."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    got = sample(docs.where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS), labels, label, max_rows).toPandas().sort_values("doc_id")
    share = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double"))).first()[0]
    model = spark.sparkContext.broadcast(fit(got["text"].tolist(), got["label"].to_numpy(np.int64), 0.5 if share is None else share))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, most=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(part.column("text"), model.value), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
