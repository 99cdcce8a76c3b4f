"""Methods against brute force: BK-tree searches, fingerprint links, near copies, packing."""

import re

import numpy as np
import xxhash

from loomfield.llm import sharding, simhash


def test_bk_tree_prunes():
    """4,000 unrelated fingerprints: one tree, far fewer distances than all pairs, and every planted neighbour found."""
    rng = np.random.default_rng(7)
    values = [int(x) for x in rng.integers(0, 2**63, 4000)]
    values += [v ^ (1 << int(a)) ^ (1 << int(b)) for v, a, b in zip(values[:50], rng.integers(0, 60, 50), rng.integers(0, 60, 50), strict=True)]
    tree = simhash.Tree()
    links = simhash.links_of_shard(values, list(range(len(values))), 2, tree)
    assert {(4000 + k, k) for k in range(50)} <= set(links) and len(links) == 50
    assert tree.looked < len(values) ** 2 / 20


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_groups_by_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"W{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(6)]
    for k in range(40):
        own = texts[k % 6].split()
        own[int(rng.integers(len(own)))] = "changed"
        texts.append(" ".join(own))
    texts += [None, "", "two words", "TWO words", "\tÄÖ x\n", texts[0] * 30]
    bits = [_fingerprint(t) for t in texts]
    want = _components(len(texts), lambda i, j: (bits[i] ^ bits[j]).bit_count() <= 2)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"].hex(), r["component_id"]) for r in simhash.groups(rows).collect()}
    assert got == {k: (f"{bits[k]:016x}", want[k]) for k in range(len(texts))}


def test_near_copies_of_one_text(spark):
    """Copies that are each edited in a place of their own: alike to the original, hardly to each other."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(base)]
    for _ in range(30):
        own, at = list(base), int(rng.integers(20, 260))
        own[at : at + 14] = [f"e{x}" for x in rng.integers(0, 10**9, 14)]
        texts.append(" ".join(own))
    texts += [" ".join(f"c{x}" for x in rng.integers(0, 10**9, 200)) for _ in range(20)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    want = _components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "row AS doc_id", "text")
    assert sorted(r["row"] for r in simhash.similar_groups(rows).collect()) == sorted(set(want))


def test_packing_keeps_groups_whole(spark):
    rng = np.random.default_rng(10)
    rows = [(k, " ".join(["word"] * int(rng.integers(1, 60))) + f" {k % 90}", "x") for k in range(300)] + [(k, "\n \t", "x") for k in range(300, 306)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.assign(docs, 8).toPandas().merge(docs.toPandas()[["doc_id", "text"]], on="doc_id")
    assert (got.groupby("text")["shard"].nunique() == 1).all()
    assert all(int(w) == len(t.split()) for w, t in zip(got["words"], got["text"], strict=True))
    assert got.groupby("shard")["size"].sum().max() <= 1.1 * got["size"].sum() / 8
