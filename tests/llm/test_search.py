"""Ranked search, fingerprints and spelling variants against brute force, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.llm import digests, lexical, variants

WORDS = "alpha beta Gamma delta Épsilon zeta eta theta iota kappa λάμδα mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, `a.b` string, item_id long, n string, rank int, `back``tick` int"


def _rows(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, int(rng.integers(1, 90)))) for _ in range(n)]
    rows = [(k, t, "x", 1, "y", 2, 3) for k, t in enumerate(texts)]
    more = [None, "", " .,;\n", texts[0], texts[0].upper(), "word " * 60_000, "é" * 50, "a" * 400]
    rows += [(n + k, t, None, None, None, None, None) for k, t in enumerate(more)]
    return rows + [(None, texts[1], None, None, None, None, None), rows[2], rows[2]]


@pytest.fixture(scope="module")
def rows():
    return _rows(5, 120)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))


def _search(rows, items, top):
    bags = [(d, Counter(_terms(t))) for d, t, *_ in rows]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in _terms(text) if t in b)
            scores += [(-score, d is None, d)] if score > 0 else []
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta beta GAMMA"), (1, "alpha beta beta GAMMA"), (2, "λάμδα word épsilon Épsilon"), (3, None), (4, ""), (None, "rho sigma tau"), (5, "nowhere"), (1, "pi")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_search(spark, docs, rows, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(docs, items, 7, block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == _search(rows, ITEMS, 7)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).isEmpty() and lexical.search(docs, items.limit(0)).isEmpty()


def test_heaps_prune():
    """More rows than the heaps hold, offered in parts: what is kept is the best of all."""
    rng = np.random.default_rng(2)
    item, score, doc = rng.integers(0, 5, 400_000), rng.integers(1, 50, 400_000), rng.permutation(400_000)
    heaps = lexical.Heaps(5, 20)
    for k in range(0, 400_000, 30_000):
        s = slice(k, k + 30_000)
        keep = score[s] >= heaps.least[item[s]]
        heaps.offer(item[s][keep], score[s][keep], np.zeros(keep.sum(), bool), doc[s][keep])
    got = sorted(zip(*(x.tolist() for x in heaps.settle()), strict=True))
    want = [(i, s, False, d) for i in range(5) for s, d in sorted(((s, d) for s, d, j in zip(score.tolist(), doc.tolist(), item.tolist(), strict=True) if j == i), key=lambda x: (-x[0], x[1]))[:20]]
    assert got == sorted(want)


def test_entropy_of_windows():
    b = np.random.default_rng(0).integers(97, 110, 150_000).astype(np.uint8)
    got = digests.entropy_bins(b)
    for i in (0, 1, 65_535, 65_536, 70_000, len(got) - 1):
        p = np.unique(b[i : i + digests.WINDOW], return_counts=True)[1] / digests.WINDOW
        assert abs(got[i] + 1000 * (p * np.log2(p)).sum() / 5) < 0.51


def _slow_features(text: bytes, ranks) -> list[bytes]:
    """The windows that are features, one by one."""
    n = len(text) - digests.WINDOW + 1
    if n > 0:
        rank = [ranks[int(b)] for b in digests.entropy_bins(np.frombuffer(text, np.uint8))]
        points = Counter(min(range(i, min(n, i + digests.WINDOW)), key=lambda j: (rank[j], j)) for i in range(n))
        found = dict.fromkeys(text[i : i + digests.WINDOW] for i in sorted(points) if points[i] >= digests.POINTS and rank[i] <= digests.BINS)
        if found:
            return list(found)
    return [text] if text else []


def test_features_by_brute_force(docs, rows):
    """Whatever stands beside a text in a task, its features are those of the text alone."""
    ranks = digests.rarity(docs)
    texts = [(t or "").encode() for _, t, *_ in rows if len(t or "") < 5000]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    h, first = digests.features(buf, offsets, ranks)
    for k, t in enumerate(texts):
        want = _slow_features(t, ranks)
        alone = [int(digests.hash_spans(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in want]
        assert h[first[k] : first[k + 1]].tolist() == alone


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 3000])
def test_next_and_edited(docs, rows, bucket_bytes):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in ordered]
    halves = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    got = digests.compare_with_next(docs, digests.rarity(docs), bucket_bytes).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got) == sorted((r[0] is not None, r[0] or 0, len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(ordered, texts, halves, strict=True))
    marks = defaultdict(set)
    by_id = {r[0]: r[1] or "" for r in ordered}
    for r in got:
        marks[by_id[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(m) == 1 for m in marks.values())
    alone = {r["doc"]["doc_id"]: r["fingerprint"] for r in digests.fingerprints(docs, digests.rarity(docs)).collect()}
    assert all(alone[r["doc_id"]] == r["fingerprint"] for r in got)


def test_likeness(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (40, 300, 3000, 3000)]
    texts += [t[: len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:3], texts[1:], strict=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = {r["doc"]["doc_id"]: digests.parsed(r["fingerprint"]) for r in digests.fingerprints(docs, digests.rarity(docs)).collect()}
    near = lambda a, b: digests.likeness(*marks[a], *marks[b])
    assert all(near(k, k) == 1 for k in marks) and near(2, 3) < 0.12 and near(0, 2) < 0.3
    assert all(0.3 < near(k, 4 + k) < 0.75 and near(k, 4 + k) == near(4 + k, k) for k in range(3))
    assert digests.likeness(*digests.parsed(""), *digests.parsed("")) == 1 and digests.likeness(*digests.parsed(""), *marks[0]) == 0


def test_digest_of_nothing(docs):
    none = docs.limit(0)
    assert digests.compare_with_next(none, digests.rarity(none)).isEmpty()


def _variants(rows):
    seen = Counter()
    for d, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = _lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            k = h % len(run)
            seen[run[:k] + run[k + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 7 and c >= 2}
    rest, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            rest[k, w[:k] + w[k + 1 :]].add(w)
            if (s := w[:k] + w[k + 1 :]) in n:
                near[w].add(s), near[s].add(w)
    for group in rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def test_variants(spark):
    """Runs of one letter, accents, chains of forms, ties, and words beyond the trie's depth."""
    rng = np.random.default_rng(4)
    base = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "übermäßig", "überméßig", "straightforward", "xbcdefgh" * 5, "xbcdefgh" * 5 + "q", "y" * 39, "y" * 40, "y" * 41, "longest" * 30, "Abcdefg", "ÀÉÎÕÜàé"]
    words = []
    for w in base:
        words += [w] * int(rng.integers(2, 6))
        for _ in range(12):
            k, c = int(rng.integers(len(w))), str(rng.choice(list("abyzé")))
            words += [str(rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]]))] * int(rng.integers(1, 4))
    words += ["straightforward"] * 300 + ["straightforwad"] * 30 + ["straightforwa"] * 3
    rng.shuffle(words)
    rows = [(k // 2 if k % 7 else None, " ".join(words[k * 9 : k * 9 + 9]), "x") for k in range(len(words) // 9 + 1)] + [(900, None, "x"), (901, "", "x"), (902, "1 2 short", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `word.n` string")
    got = variants.variants(variants.counted_words(docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == _variants(rows) and len(got) == len({r[0] for r in got})
    assert any(r["root"] != (r["form"] or r["word"]) for r in got)


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.counted_words(none)).select(F.count(F.lit(1))).first()[0] == 0
