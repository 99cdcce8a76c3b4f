"""The BK-trees of the pipeline's near-duplicate stage: the same as one by one, against brute force, and through a task."""

import numpy as np
import pyarrow as pa
import pytest

from loomfield.llm import simhash

SIZES = [1, 2, 3, 40, 300, 1, 120]


def _prints(seed: int, n: int, groups: int) -> np.ndarray:
    """n prints of 512 bits around `groups` centres, up to 60 bits from them; some lie between two centres' groups."""
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2, (groups, 512))[rng.integers(0, groups, n)]
    for row in out:
        row[rng.choice(512, int(rng.integers(0, 61)), replace=False)] ^= 1
    return np.packbits(out.astype(np.uint8), axis=1).view(">u8").astype(np.uint64)


def _bits(row: np.ndarray) -> int:
    return int.from_bytes(row.astype(">u8").tobytes())


def test_trees_are_those_grown_one_by_one():
    edge = np.cumsum([0, *SIZES])
    prints = np.concatenate([_prints(k, n, max(1, n // 20)) for k, n in enumerate(SIZES)])
    forest = simhash.Forest(prints.T, edge)
    edges, looked, pairs = set(), 0, set()
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        tree, bits = simhash.Tree(), [_bits(row) for row in prints[i:j]]
        for x in range(j - i - 1, -1, -1):
            before = tree.looked
            pairs |= {(i + x, j - 1 - y, (bits[x] ^ tree.values[y]).bit_count()) for y in tree.within(bits[x], 96)}
            looked += tree.looked - before
            tree.add(bits[x])
        edges |= {(j - 1 - k, d, j - 1 - child) for k, of in enumerate(tree.children) for d, child in of.items()}
        assert pairs >= {(i + x, i + y, d) for x in range(j - i) for y in range(x + 1, j - i) if (d := (bits[x] ^ bits[y]).bit_count()) <= 96}
    assert set(zip((forest.edges // forest.step).tolist(), (forest.edges % forest.step).tolist(), forest.kids.tolist(), strict=True)) == edges
    blocks = list(forest.within(96))
    found = [p for block in blocks for p in zip(*(c.tolist() for c in block), strict=True)]
    assert set(found) == pairs and len(found) == len(pairs) > 300 and forest.looked == looked
    some = np.array([n == 40 for n in SIZES])
    assert {p for block in forest.within(96, some) for p in zip(*(c.tolist() for c in block), strict=True)} == {p for p in pairs if edge[3] <= p[0] < edge[4]}


def test_the_home_of_a_pair_is_one_key_that_both_have():
    """Of keys that differ in up to four bits, in one band: -1 if the two share none."""
    rng, homes = np.random.default_rng(8), 0
    for _ in range(4_000):
        low = int(rng.integers(0, 1 << simhash.KEY_BITS))
        high = low ^ sum(1 << int(k) for k in rng.choice(6, int(rng.integers(0, 5)), replace=False))
        flips = [sum(1 << int(k) for k in rng.choice(6, simhash.FLIPS, replace=False)) for _ in "ab"]
        own, other = ({v} | {v ^ (1 << k) for k in range(6) if f >> k & 1} for v, f in ((low, flips[0]), (high, flips[1])))
        (home,) = simhash._home(*(np.array([[v]], np.uint32) for v in (low, high, *flips))).tolist()
        assert home in own & other if own & other else home == -1
        homes += home >= 0
    assert 500 < homes < 3_500


def test_unrelated_texts_seldom_meet():
    """Of 3,000 unrelated fingerprints a pair meets in one of 512 shards; it was one in 32 with keys of twelve bits."""
    rng, shards = np.random.default_rng(9), {}
    for node in range(3_000):
        for key in simhash.band_keys(b"", rng.binomial(200, 0.5, 512), 200)[0]:
            shards.setdefault(key, []).append(node)
    met = sum(len(n) * (len(n) - 1) // 2 for n in shards.values())
    assert met < 3_000 * 2_999 / 2 / 400


def test_bits_are_counted_as_one_by_one():
    rng = np.random.default_rng(10)
    for n in (0, 1, 254, 255, 256, 4_081, 9_000):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        words = [h if k == 0 else simhash.mix(h + np.array([k * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64)) for k in range(8)]
        want = [int(((w >> np.uint64(63 - b)) & np.uint64(1)).sum()) for w in words for b in range(64)]
        assert simhash.bit_counts(h, 8).tolist() == want and simhash.bit_counts(h).tolist() == want[:64]


def test_search_passes_by_other_groups():
    """Two groups of 1,000 near copies: a search stays in its own, but for the root."""
    prints = _prints(1, 2_000, 2)
    forest = simhash.Forest(prints.T, np.array([0, 2_000]))
    found = sum(len(x) for x, _, _ in forest.within(130))
    assert found > 900_000 and forest.looked < 2_000 * 1_999 / 2 * 0.6


@pytest.mark.parametrize("held", [0, 1 << 22])
def test_task_reports_what_trees_find(monkeypatch, held):
    grown = []

    class Seen(simhash.Forest):
        def __init__(self, *args):
            super().__init__(*args)
            grown.append(self)

    monkeypatch.setattr(simhash, "Forest", Seen)
    monkeypatch.setattr(simhash, "HELD", held)
    prints = np.unique(np.concatenate([_prints(k, 60, 4) for k in range(3)]), axis=0)
    rng, rows = np.random.default_rng(3), []
    prints = prints[rng.permutation(len(prints))]
    margins = [rng.integers(-90, 91, 512) for _ in prints]
    for node, (row, margin) in enumerate(zip(prints, margins, strict=True)):
        bits = np.unpackbits(row.astype(">u8").view(np.uint8)).astype(np.int64)
        keys, flips = simhash.band_keys(b"", np.where(bits == 1, 100 + np.abs(margin), 100 - np.abs(margin)), 200)
        rows += [(key, node, row.astype(">u8").tobytes() + flips) for key in keys]
    rows.sort(key=lambda r: r[:2])
    key, node, fp = zip(*rows, strict=True)
    batches = [
        pa.RecordBatch.from_arrays([pa.array(key[i : i + 500], pa.int64()), pa.array(key[i : i + 500], pa.int64()), pa.array(node[i : i + 500], pa.int64()), pa.array(fp[i : i + 500], pa.binary()), pa.array(node[i : i + 500], pa.int64())], names=["key", "own", "node", "fp", "root"])
        for i in range(0, len(rows), 500)
    ]
    out = [r for b in simhash._near_of_partition(96, 61, (0, 1_000))(iter(batches)) for r in b.to_pylist()]
    met, by_key = set(), {}
    for k, n, _ in rows:
        by_key.setdefault(k, []).append(n)
    for ns in by_key.values():
        met |= {(a, b) for a in ns for b in ns if a < b}
    bits = [_bits(row) for row in prints]
    near = {(a, b): d for a, b in met if (d := (bits[a] ^ bits[b]).bit_count()) <= 96}

    def roots(links):
        root = list(range(len(bits)))
        for a, b in links:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        return root

    sure = [(r["a"], r["b"]) for r in out if r["sure"]]
    pairs = {(r["a"], r["b"]) for r in out if r["sure"] is False}
    root = roots(p for p, d in near.items() if d <= 61)
    assert roots(sure) == root and not any(r["b"] is None for r in out)
    left = {p for p, d in near.items() if d > 61 and root[p[0]] != root[p[1]]}
    assert pairs <= {p for p, d in near.items() if d > 61} and left <= pairs and left and sure
    assert grown and sum(f.looked for f in grown) > 0
