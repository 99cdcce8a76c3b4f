"""The contract's columns of quality rules, licence scans, language model and decontamination against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomfield.llm import decontaminate, licenses, line_quality, lm_trie

WORDS = "alpha BETA gamma cc by general public License all rights reserved Ünder ß δέλτα eta, x#y $5 50% <b> a|b c".split(" ")
SPACES = ["\x20", "\x20", "\n", "\t", "\x0b", "\r\n", "\x1f", "  "]


def _text(rng, n):
    return "".join(str(rng.choice(WORDS)) + str(rng.choice(SPACES)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    texts = [_text(rng, int(rng.integers(0, 120))) for _ in range(60)]
    line = "one two three four five six seven eight nine\n"
    texts += [None, "", " \n\t", line * 6, line * 2 + "x\n\n\n" + line, "CC-BY cc by Cc  BY, cc\nby", "all rights reserved " * 3, "α" * 30, "word " * 60_000, texts[3], texts[3].upper()]
    out = [(k, t, "web", 1, 2) for k, t in enumerate(texts)]
    return out + [(None, texts[5], None, None, None), out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, `a.b` int").repartition(4)


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))


def _same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def _quality(t):
    words, lines = _spaced(t), (t or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if _spaced(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= set(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_quality_rules(docs, rows):
    out = line_quality.judge(docs, columns=["doc_id"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    _same([r[:7] for r in out], [(d, *_quality(t)) for d, t, *_ in rows])
    assert not any(r["kept"] and r["base_failed"] for r in out)


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _licences(t):
    words, places, labels = _plain(t), [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(docs, rows):
    out = licenses.scan(docs, ["doc_id"]).select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    _same([r[:6] for r in out], [(d, *_licences(t)) for d, t, *_ in rows])
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in out)


def test_language_model_base(docs, rows):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = lambda t: [*_spaced(_lower(t)), None]
    counts = Counter(w for d, t, *_ in rows if not held(d) for w in tokens(t))
    n, kinds = counts.total(), len(counts)
    want = {}
    for d, t, *_ in rows:
        own = tokens(t)
        want.setdefault((d, len(own)), (held(d), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in own)))
    got = lm_trie.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, c, s = want[r["doc_id"], r["n_tokens"]]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (a, b, c) and abs(r["base_score"] - s) < 1e-6 * max(1, abs(s)) and r["score"] <= 0


ITEMS = [("q1", " ".join(f"w{k}" for k in range(14))), ("q2", "rights reserved alpha"), ("q3", "cc by"), ("q4", None), (None, ""), ("q1", " ".join(f"w{k}" for k in range(14))), ("q5", "absent words here")]


def _leaks(t, windows):
    words, hit, items = _plain(t), set(), set()
    for item, w in windows:
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                hit |= set(range(i, i + len(w)))
                items.add(item)
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("items", [ITEMS, []])
def test_decontamination(spark, docs, rows, items):
    planted = (500, "before " + " ".join(f"W{k}" for k in range(2, 13)) + " after", "web", 1, 2)
    windows = [(i or "", w) for i, t in set(items) if (own := _plain(t)) for w in ([own] if len(own) < 10 else [own[k : k + 10] for k in range(len(own) - 9)])]
    more = docs.unionByName(spark.createDataFrame([planted], docs.schema))
    out = decontaminate.find(more, spark.createDataFrame(items, "item_id string, text string"), columns=["doc_id"]).select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    small = [r for r in [*rows, planted] if len(r[1] or "") < 10_000]
    big = {r[0] for r in rows} - {r[0] for r in small}
    _same([r for r in out if r["doc_id"] not in big], [(d, *_leaks(t, windows)) for d, t, *_ in small])
    assert any(r["contaminated"] for r in out) == bool(items)
