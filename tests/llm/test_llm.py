"""Small fixtures against brute force: nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomfield.llm import bpe, decontaminate, labelled, licenses, line_quality, line_templates, lm_trie, sharding, simhash, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) if n else ""


ROWS = [(1, _text(1, 60), "en", "s", 0), (2, _text(1, 60), "en", "s", 0), (2, _text(1, 60), "en", "s", 0), (3, None, "en", None, None), (4, "", "en", "s", 0), (None, _text(5, 40), None, "t", 1), (6, "one\ntwo words\n" + _text(6, 300), "en", "t", 2)]
SCHEMA = "doc_id long, text string, lang string, source string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, _text(1, 60)[:80]), (2, "rho sigma"), (3, None), (None, "")], "item_id long, text string")


def test_elias_fano():
    values = np.sort(np.random.default_rng(0).integers(0, 10**6, 500)).astype(np.uint64)
    level, asked = lm_trie.EliasFano(values, 10**6), np.arange(0, 10**6, 997).astype(np.uint64)
    assert (level.get(np.arange(500)) == values).all() and (level.successor(asked) == np.searchsorted(values, asked)).all()


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = rng.integers(0, 4, 150)
        index, patterns = decontaminate.FMIndex(text, 4), rng.integers(1, 4, (9, 3))
        for p, a, b in zip(patterns, *index.search(patterns, np.full(9, 3)), strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(148) if (text[i : i + 3] == p).all()]


def test_bpe_round_trip(spark, docs):
    ranks, pattern = bpe.public_vocabulary()
    got = bpe.encode(docs, ranks, pattern, ["doc_id"], chunk=64, overlap=16).collect()
    assert len(got) == len(ROWS)
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)


def test_sharding(spark, docs):
    got = sharding.assign(docs, 4).toPandas()
    assert len(got) == len(ROWS) and all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 1 for _, t, *_ in ROWS)


def test_simhash_groups(spark, docs):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.groups(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (6, 6)} <= got


def test_large_shards_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) ^ (int(c) & 7) for a, b, c in rng.integers(0, 60, (120, 3))})
    nodes = spark.createDataFrame([(v, v.to_bytes(8)) for v in values], "node long, fp binary")
    from loomfield.llm.components import components

    monkeypatch.setattr(simhash, "LARGEST", 10)
    roots = {r["node"]: r["root"] for r in components(simhash.block_links(nodes, 2)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {v: roots.get(v, v) for v in values} == {v: find(v) for v in values}


def test_near_dedup_keeps_one(spark, docs):
    assert sorted(r["doc_id"] or 0 for r in simhash.dedup(docs).collect()) == [0, 1, 3, 6]


def test_near_dedup_beyond_the_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    assert sorted(r["doc_id"] or 0 for r in simhash.dedup(docs).collect()) == [0, 1, 3, 6]


def test_quality(spark, docs):
    rows = {r["doc"]["doc_id"]: r for r in line_quality.judge(docs, columns=["doc_id"]).collect()}
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[3]["kept"]
    assert rows[1]["n_words"] == 60 and rows[1]["kept"]
    assert line_quality.clean(docs).columns == docs.columns


def test_line_removal(spark):
    rows = [(i, f"shared boilerplate line here\nown{i} " + _text(100 + i, 30), "h") for i in range(30)]
    kept = line_quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(kept) == 30 and sum("boilerplate" in r["text"] for r in kept) == 1


def test_line_templates(spark):
    rows = [(i, f"{_text(200 + i, 9)}\nrequest {i} took {i} ms on node{i}\n{_text(300 + i, 9)}") for i in range(15)] + [(99, None)]
    got = line_templates.strip_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_dropped"] == (0 if r["text"] is None else 1) and "request" not in (r["text"] or "") for r in got)


def test_decontamination(spark, docs, benchmark):
    got = decontaminate.find(docs, benchmark, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and {r["doc"]["doc_id"] for r in got if r["n_items"] and "1"} >= {1, 2}
    blocks = decontaminate.find(docs, benchmark, ["doc_id"], block_bytes=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, blocks))
    assert not decontaminate.find(decontaminate.remove(docs, benchmark), benchmark, ["doc_id"]).where("contaminated").count()


def test_licenses(spark):
    rows = [(1, "All rights reserved. CC BY cc-by 4"), (2, "x y\nLicensed under the Apache License, Version 2.0."), (3, None), (4, "")]
    got = {r["doc"]["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 5, "cc-by,reserved")
    assert got[2]["labels"] == "apache-2.0" and got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[4]["labels"] == ""


def test_language_model(spark, docs):
    rows = lm_trie.score(docs).collect()
    words = {i: re.findall(r"\S+", t or "") for i, t, *_ in ROWS}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    total = sum(len(re.findall(r"\S+", t or "")) + 1 for i, t, *_ in ROWS if not held(i))
    assert all(r["train_tokens"] == total and r["n_tokens"] == len(words[r["doc_id"]]) + 1 and r["held_out"] == held(r["doc_id"]) for r in rows)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity._start(rng).items()}
    x, cells, size = rng.normal(size=(9, toxicity.INPUTS)), rng.integers(0, 9, (5, toxicity.WINDOW)), np.array([16, 3, 0, 7, 16])
    tape: dict = {}
    out = toxicity.forward(model, x, cells, size, tape)
    grad = toxicity.backward(model, x, tape, out)
    for k in ("xf", "hb", "att", "out"):
        at = tuple(int(rng.integers(0, s)) for s in model[k].shape)
        sides = []
        for step in (1e-3, -2e-3):
            model[k][at] += step
            sides.append(float((toxicity.forward(model, x, cells, size) ** 2).sum() / 2))
        model[k][at] += 1e-3
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[k][at]) < 1e-3


def test_empty_tables(spark, docs, benchmark):
    none = docs.where("false")
    assert lm_trie.score(none).count() == sharding.assign(none).count() == simhash.groups(none).count() == simhash.dedup(none).count() == 0
    assert line_quality.clean(none).count() == line_templates.dedup(none).count() == decontaminate.remove(none, benchmark).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.classify(docs, labels).count() == len(ROWS) and labelled.sample(docs, labels, "toxic", 10).count() == 0
    assert len(toxicity.score_texts(pa.array([], pa.string()), {})) == 0


def _star(seed: int, copies: int, edited: float) -> list[str]:
    """A text of 200 shingles and copies of it, each edited on its own."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 204)]
    out = [" ".join(base)]
    for k in range(copies):
        words, at = list(base), int(rng.integers(0, 204 - round(204 * edited)))
        for i in range(at, at + round(204 * edited)):
            words[i] = f"c{k}x{i}"
        out.append(" ".join(words))
    return out


def _brute_groups(texts: list[str], similarity: float = 0.8) -> dict[int, int]:
    sets, root = [set(simhash.shingle_hashes(t, simhash.WIDTH).tolist()) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and len(a & b) >= similarity * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return dict(enumerate(root))


def test_near_dedup_finds_a_stars_centre(spark):
    texts = [t for seed in (1, 2) for t in _star(seed, 200, 0.07)]
    order = np.random.default_rng(0).permutation(len(texts)).tolist()
    rows = spark.createDataFrame([(i, texts[k]) for i, k in enumerate(order)], "doc_id long, text string")
    wanted = len(set(_brute_groups(texts).values()))
    assert wanted == 2 and simhash.dedup(rows).count() == wanted


def test_line_templates_in_blocks(spark):
    """Boilerplate of several lines, or between blank lines, goes; lines of near copies of one text stay."""
    block = [f"This is line {k} of a footer" for k in ("one", "two", "three")]
    rows = [(i, "\n".join([_text(400 + i, 30), *block, _text(500 + i, 30)])) for i in range(12)]
    rows += [(100 + i, f"{_text(600 + i, 30)}\n\nread more about us here\n\n{_text(700 + i, 30)}") for i in range(12)]
    copy = [f"line {'abcdefghijklmnopqrst'[k]} " + _text(800 + k, 12) for k in range(20)]
    rows += [(200 + i, "\n".join([*copy[: i % 20], _text(900 + i, 13), *copy[i % 20 + 1 :]])) for i in range(60)]
    got = {r["doc"]["doc_id"]: r["n_dropped"] for r in line_templates.strip_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 3 if i < 100 else 1 if i < 200 else 0 for i, _ in rows}


def test_near_dedup_recall_at_any_size(spark, monkeypatch):
    """Pairs of Jaccard 0.8; the table says that it has six million rows."""
    texts = [t for seed in range(150) for t in _edited_pair(seed)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row AS doc_id", "text")
    monkeypatch.setattr(type(rows), "count", lambda self: 6_000_000)
    assert 300 - len(simhash.similar_groups(rows).collect()) >= 0.94 * 150


def _edited_pair(seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 404)]
    other = [*words[:150], *(f"e{i}" for i in rng.integers(0, 10**9, 40)), *words[190:]]
    return [" ".join(words), " ".join(other)]


def test_licenses_many_notices(spark):
    """Common words of one notice aren't crowded out by the rare words of another."""
    notices = [words for _, words, _ in licenses.TEMPLATES]
    filler = [(k, f"the work is licensed under version 2 0 of this license as is apache gnu general public by nc sa cc {k}") for k in range(1, 40)]
    rows = [(0, "\n\n".join(notices)), *filler, (99, None)]
    got = {r["doc"]["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got[0]["labels"] == ",".join(sorted({label for label, _, _ in licenses.TEMPLATES} | {"cc-by", "gpl"})) and got[0]["score"] == 1.0
    assert got[99]["labels"] == ""


def test_line_removal_in_a_hot_host(spark):
    """Lines in 1, 2 and 4 percent of a host's 3,000 texts go as they would in a small host."""
    rows = [(i, "\n".join([f"own{i} " + _text(i, 30), *(f"passage in {p} percent" for p in (1, 2, 4) if i % (100 // p) == 0)]), "h") for i in range(3000)]
    kept = line_quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(kept) == 3000 and [sum(f"in {p} percent" in r["text"] for r in kept) for p in (1, 2, 4)] == [1, 1, 1]


def test_decontamination_across_blocks(spark):
    """An item inside another one, of another block: cutting one brings the other together."""
    items = ["alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu", "nu xi omicron pi", "rho sigma tau upsilon"]
    rows = [(i * 5 + j, "first {0} {1} {2} {3} last".format(*a.split()[:2], b, " ".join(a.split()[2:]))) for i, a in enumerate(items) for j, b in enumerate(items) if a != b]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert all(r["text"].split() == ["first", "last"] for r in decontaminate.remove(docs, bench, block_bytes=8).collect())
