"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit set where over half of the text's word shingles have it set in their XXH64 (seed 42; further
words of a longer fingerprint come from mixing that hash). Distinct fingerprints are dealt into shards, and every shard
grows one BK-tree of its fingerprints: a node's children are keyed by their integer Hamming distance to it, and a search
at distance d from a node follows only the edges d - radius .. d + radius. Each fingerprint is searched before it is
added; of the nodes within the radius it is linked to one of each group not linked with it yet, so that a shard of n
fingerprints reports at most n - 1 links. That is enough where being within the radius is the link itself. Where links
are verified afterwards (near-duplicates by Jaccard similarity), spanning links would hide a true partner behind a false
one: there the same trees, grown and searched for many shards at a time (`Forest`), give all pairs within the radius, and
shards report them in rounds (`verified_components`). A radius of a fifth of the bits prunes what is far from a group of
near copies for them, and the group for others, but no unrelated text for another.

Which fingerprints meet in a shard:

* `shards="blocks"` (exact, small radius): the 64 bits are cut into blocks; two fingerprints that differ in at most
  `radius` bits agree in all but `radius` of them, so a shard is made for each way to choose the others. With more
  fingerprints, more and longer keys.
* `shards="bands"` (large radius, longer fingerprints; `dedup`): keys of `KEY_BITS` bits from several bands, each key also with
  each one of the band's least certain bits flipped (the bits whose count is nearest half). The keys' length doesn't follow
  the number of rows, so recall is the same at every size (a test holds it above 0.94 at Jaccard 0.8); shards grow instead,
  and with them the comparisons a row, and large ones are cut. Two unrelated texts meet in one of 512 shards on average; with
  eight keys of 12 bits, each with both of two bits flipped, they met in one of 32.

The trees travel to shards by a shuffle rather than a broadcast, because their size grows with the data. A shard of more
than `LARGEST` fingerprints is never taken as a whole: with blocks and radius 2 its fingerprints are linked exactly by
the keys "one bit flipped" (two within 2 bits share one, and all that share one are within 2 bits); otherwise it is cut
into parts, and each pair of parts is a shard of its own.

Null text: no words. No words: fingerprint zero, linked like any other. Equal fingerprints are one node, so copies never
meet in pairs. Null doc_id: the row is in its group, and the least known id names it (null where none is known).
Repeated rows are copies. Very long texts are taken whole. Empty table: empty result. Extra columns are kept by `dedup`,
whatever their names, and ignored elsewhere.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, discard, documents, mix, packed, pieces, small_batches, unpacked, written
from .components import components, joined, rooted

SEED = 42
LARGEST = 4_096
# Of the pipeline stage: five words, 512 bits. Texts of Jaccard similarity 0.8 differ in 77 of them, with a deviation of 8:
# up to 61 bits they are taken as similar, up to 96 their shingles are compared.
WIDTH, WORDS, SURE, RADIUS, SIMILARITY = 5, 8, 61, 96, 0.8
LARGEST_NEAR = 16_384
BANDS, KEY_BITS, FLIPS = 16, 17, 3  # a band for each half word of the fingerprint
FIRST_PAIRS = 8  # of a node in a shard, in the first round
HELD = 1 << 22  # a batch's shards may have half as many pairs for those found to be held between the two uses of them
BROADCAST_ROWS = 2_000_000  # row numbers of 8 bytes
BROADCAST_PAIRS = 400_000  # of four longs


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of width lower-cased words, repeats included; fewer words: of the whole sequence."""
    w = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, U64)
    if len(w) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], U64)
    runs = map(b" ".join, zip(*(itertools.islice(w, k, None) for k in range(width)), strict=False))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, runs, repeat(SEED))), ">u8").astype(U64)


def bit_counts(h: np.ndarray, words: int = 1) -> np.ndarray:
    """How many hashes have each bit set, highest bit first, for words * 64 bits."""
    out, steps = np.zeros(words * 64, np.int64), np.array([k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(1, words)], U64)
    for i in range(0, len(h), 255 * 16):
        part = h[i : i + 255 * 16, None]
        rows = np.unpackbits(np.concatenate([part, mix(part + steps)], axis=1).astype(">u8").view(np.uint8), axis=1)
        for j in range(0, len(rows), 255):  # sums of bytes
            out += np.add.reduce(rows[j : j + 255], axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str | None, width: int, words: int = 1) -> tuple[bytes, np.ndarray, int]:
    """(big-endian bytes, bit counts, number of shingles)."""
    h = shingle_hashes(text, width)
    counts = bit_counts(h, words)
    return np.packbits(2 * counts > len(h)).tobytes(), counts, len(h)


class Tree:
    """A BK-tree with children keyed by distance. `looked` counts the distances taken."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.looked = 0

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            self.looked += 1
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """The nodes within radius, by order of their adding: edges outside distance ± radius can't lead to one."""
        stack, out = [0] if self.values else [], []
        while stack:
            at = stack.pop()
            self.looked += 1
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                out.append(at)
            stack += [child for k, child in self.children[at].items() if d - radius <= k <= d + radius]
        return out


def links_of_shard(values: list[int], nodes: list[int], radius: int, tree: Tree | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the shard's links."""
    tree, parent, out = tree or Tree(), list(range(len(values))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = find(other), find(k)
            if a != b:
                parent[b] = a
                out.append((nodes[k], nodes[other]))
        tree.add(value)
    return out


def _shards_of_partition(radius: int):
    """Rows (key, node, fp) come sorted by key; a key's rows are held until the next key begins."""

    def flush(keys: np.ndarray, nodes: np.ndarray, fps: list[bytes]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for a, b in zip(edge[:-1][np.diff(edge) > 1], edge[1:][np.diff(edge) > 1], strict=True):
            out += links_of_shard([int.from_bytes(x) for x in fps[a:b]], nodes[a:b].tolist(), radius)
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches):
        keys, nodes, fps = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            keys = np.append(keys, batch.column("key").to_numpy())
            nodes = np.append(nodes, batch.column("node").to_numpy())
            fps += batch.column("fp").to_pylist()
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            yield batch_of(flush(keys[:last], nodes[:last], fps[:last]) if last else [])
            keys, nodes, fps = keys[last:], nodes[last:], fps[last:]
        yield batch_of(flush(keys, nodes, fps) if len(keys) else [])

    return run


def _sizes(keyed: DataFrame, largest: int) -> tuple[DataFrame, DataFrame]:
    """key, n of the usual and of the large shards of more than one node."""
    sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return sizes.where(F.col("n") <= largest), sizes.where(F.col("n") > largest)


def _paired_parts(keyed: DataFrame, large: DataFrame, largest: int) -> DataFrame:
    """Each large shard cut into parts, and a shard for each pair of parts."""
    own = keyed.join(large, "key").withColumn("parts", F.ceil(2 * F.col("n") / largest).cast("long")).withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts"))
    pair = F.struct(F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.xxhash64("key", pair).alias("key"), "node", "fp", F.col("key").alias("own"))


def links_in_shards(keyed: DataFrame, radius: int, by_flips: bool) -> DataFrame:
    """a, b: a spanning forest of the links inside each shard of keyed(key long, node long, fp binary)."""
    keyed = written(keyed)
    usual, large = _sizes(keyed, LARGEST)
    links = keyed.join(usual, "key", "left_semi")
    if not large.isEmpty():
        if by_flips:
            hot = keyed.join(large, "key")
            word = F.conv(F.hex("fp"), 16, -10).cast("long")
            variants = F.concat(F.array(F.col("bits")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("bits").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
            flips = hot.select("node", word.alias("bits")).distinct().select("node", F.explode(variants).alias("variant"))
            hubs = flips.groupBy("variant").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
            more = flips.join(hubs.select("variant", "hub"), "variant").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        else:
            more, links = None, links.unionByName(_paired_parts(keyed, large, LARGEST).drop("own"))
    else:
        more = None
    found = links.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shards_of_partition(radius), "a long, b long")
    return found if more is None else found.unionByName(more)


_COUNTS, _LANES, _ONES = {8: U64}, U64(0x00FF00FF00FF00FF), U64(0x0001000100010001)


class Forest:
    """BK-trees of long fingerprints, one a shard, grown and searched for all shards of a batch at a time: the trees that `Tree` grows.

    prints: a row for each word, a column for each fingerprint; columns edge[k]:edge[k + 1] are shard k. A shard's last column is
    added first: a fingerprint is searched before it is added, so a column's search meets later ones only. The edges of all trees
    are one sorted array of parent and distance. `looked` counts the distances that searches took.
    """

    def __init__(self, prints: np.ndarray, edge: np.ndarray):
        self.rows, self.edge, self.step, self.looked = np.ascontiguousarray(prints.T), edge, 128 * len(prints), 0
        self.last = np.repeat(edge[1:] - 1, np.diff(edge))
        at = np.flatnonzero(np.arange(len(self.last)) < self.last)[::-1]
        below, edges, kids = self.last[at], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):  # a level: of those at a parent's distance the first to come is its child, the others go on below it
            found, first, of = np.unique(below * self.step + self.distances(at, below), return_index=True, return_inverse=True)
            edges.append(found)
            kids.append(at[first])
            below = at[first][of]
            at, below = at[at != below], below[at != below]
        order = np.argsort(np.concatenate(edges))
        self.edges, self.kids = np.concatenate(edges)[order], np.concatenate(kids)[order]
        self.inner = np.zeros(len(self.last), bool)
        self.inner[self.edges // self.step] = True

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 1 << 12):
            apart = self.rows.take(x[i : i + (1 << 12)], axis=0)
            apart ^= self.rows.take(y[i : i + (1 << 12)], axis=0)
            bits = np.bitwise_count(apart).view(_COUNTS.get(apart.shape[1], np.uint8))
            if bits.dtype == U64:  # eight bytes of up to 64: two in a lane, then the sum of the four lanes in the highest
                bits = ((bits & _LANES) + ((bits >> U64(8)) & _LANES)) * _ONES >> U64(48)
            out[i : i + (1 << 12)] = bits.sum(1, dtype=np.int64) if bits.shape[1] > 1 else bits[:, 0]
        return out

    def within(self, radius: int, shards: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, distance) of the pairs within radius, x before y, all of an x in one block; of all shards or those marked."""
        sizes = np.diff(self.edge)
        own = np.repeat(sizes, sizes)
        todo = np.flatnonzero((np.arange(len(own)) < self.last) & (True if shards is None else np.repeat(shards, sizes)))
        block = np.cumsum(own[todo]) >> 16
        for x in np.split(todo, np.flatnonzero(np.diff(block)) + 1):
            yield self._search(x, radius)

    def _search(self, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, out = self.last[x], [(x[:0], x[:0], x[:0].astype(np.int16))]
        while len(x):  # a level: edges outside distance ± radius can't lead to one within radius
            d = self.distances(x, y)
            self.looked += len(d)
            near, on = d <= radius, self.inner[y]
            out.append((x[near], y[near], d[near].astype(np.int16)))
            x, y, d = x[on], y[on] * self.step, d[on]
            first = np.searchsorted(self.edges, y + np.maximum(d - radius, 0))
            many = np.searchsorted(self.edges, y + np.minimum(d + radius, self.step - 1), "right") - first
            x, y = np.repeat(x, many), self.kids[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
            x, y = x[y > x], y[y > x]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def merged(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """labels, each the first row of its row's component, after the links (x, y) too."""
    while (apart := labels[x] != labels[y]).any():
        x, y, labels = x[apart], y[apart], labels.copy()
        np.minimum.at(labels, np.maximum(labels[x], labels[y]), np.minimum(labels[x], labels[y]))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def sure_labels(n: int, blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], sure: int) -> np.ndarray:
    """The first row of each of n rows' components, where rows within `sure` bits are linked."""
    labels = np.arange(n)
    for x, y, d in blocks:
        labels = merged(labels, x[d <= sure], y[d <= sure])
    return labels


def _several(groups: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Whether a shard holds rows of several groups."""
    return np.minimum.reduceat(groups, edge[:-1]) != np.maximum.reduceat(groups, edge[:-1])


def _home(low: np.ndarray, high: np.ndarray, low_flips: np.ndarray, high_flips: np.ndarray) -> np.ndarray:
    """The one key, of those that two nodes share, in whose shard their pair counts; -1 if they share none. Of each node its
    key and the bits of which one may be flipped, a column for each band; low is the node with the lesser number."""
    differ = low ^ high
    bits, either = np.bitwise_count(differ), differ & ~(low_flips | high_flips) == 0
    shared = either & ((bits < 2) | (bits == 2) & (differ & low_flips != 0) & (differ & high_flips != 0))
    band, rows = shared.argmax(1), np.arange(len(low))
    low, differ, bits, low_flips, high_flips = (x[rows, band] for x in (low, differ, bits, low_flips, high_flips))
    own = differ & ~high_flips  # low's flip is what high can't flip; of two that both can, the lesser bit
    both = differ & low_flips
    own = np.where((bits == 2) & (own == 0), both & (~both + np.uint32(1)), own)
    return np.where(shared.any(1), (band.astype(np.int64) << 48) | (low ^ own), -1)


def _flips(places: np.ndarray) -> np.ndarray:
    """The bits that may be flipped, from their places, of five bits each."""
    return sum((np.uint32(1) << ((places >> np.uint32(5 * k)) & np.uint32(31)) for k in range(FLIPS)), np.zeros(places.shape, np.uint32))


def near_pairs(blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], owns: np.ndarray, keys: np.ndarray, flips: np.ndarray, groups: np.ndarray, sure: int, ranks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, more): of the pairs in blocks those above sure bits whose groups differ and that count in the shard of key `own`, of
    each row those of its pairs with later rows that stand in ranks (first, end) by distance; the rows that have further ones."""
    a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x, y, d in blocks:
        x, y, d = x[d > sure], y[d > sure], d[d > sure]
        here = _home(keys[x], keys[y], flips[x], flips[y]) == owns[x]
        x, y, d = x[here], y[here], d[here]
        order = np.lexsort((y, d, x))
        x, y = x[order], y[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        apart = groups[x] != groups[y]
        more.append(x[apart & (rank >= ranks[1])])
        take = apart & (rank >= ranks[0]) & (rank < ranks[1])
        a.append(x[take])
        b.append(y[take])
    return np.concatenate(a), np.concatenate(b), np.concatenate(more)


def _near_of_partition(radius: int, sure: int, ranks: tuple[int, int]):
    """Rows (key, own, node, fp, root) come sorted by key, then node. Out: a, b, sure of links within `sure` bits, of which a task reports a
    forest, and of pairs within radius between their components; of a shard that has more of those its key and nulls."""

    def edges_of(keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))

    def run(batches):
        above: dict[int, int] = {}  # of the nodes that the task has linked so far

        def find(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        def batch_of(keys: np.ndarray, owns: np.ndarray, nodes: np.ndarray, fps: list[np.ndarray], roots: np.ndarray) -> pa.RecordBatch:
            data, edge = np.concatenate(fps), edges_of(keys)
            open_ = np.repeat(_several(roots, edge), np.diff(edge))
            data, keys, owns, nodes, roots = (x[open_] for x in (data, keys, owns, nodes, roots))
            links, pairs, again = [], np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
            if len(keys):
                prints, of, edge = data[:, : -4 * BANDS].copy().view(">u8").astype(U64), data[:, -4 * BANDS :].copy().view("<u4").astype(np.uint32), edges_of(keys)
                bands, flips = of & np.uint32((1 << KEY_BITS) - 1), _flips(of >> np.uint32(KEY_BITS))
                forest = Forest(prints.T, edge)
                if (np.diff(edge) ** 2).sum() <= HELD:  # searched once
                    near = list(forest.within(radius))
                    labels = sure_labels(len(nodes), near, sure)
                else:
                    near, labels = None, sure_labels(len(nodes), forest.within(sure), sure)
                rows = np.flatnonzero(labels != np.arange(len(labels)))
                for x, y in zip(nodes[rows].tolist(), nodes[labels[rows]].tolist(), strict=True):
                    if (u := find(x)) != (v := find(y)):
                        above[u] = v
                        links.append((x, y))
                _, first, of = np.unique(roots, return_index=True, return_inverse=True)
                groups = merged(labels, np.arange(len(roots)), first[of])  # a component may join several roots, and a root several components
                blocks = near or forest.within(radius, _several(groups, edge))
                x, y, more = near_pairs(blocks, owns, bands, flips, groups, sure, ranks)
                pairs, again = np.unique(np.stack([nodes[x], nodes[y]]), axis=1), np.unique(keys[more])
            columns = [
                pa.array([*pairs[0].tolist(), *(x for x, _ in links), *again.tolist()], pa.int64()), pa.array([*pairs[1].tolist(), *(y for _, y in links), *[None] * len(again)], pa.int64()),
                pa.array([False] * pairs.shape[1] + [True] * len(links) + [None] * len(again), pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sure"])

        held, fps = [np.zeros(0, np.int64) for _ in range(4)], []
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.append(x, batch.column(c).to_numpy()) for x, c in zip(held, ("key", "own", "node", "root"), strict=True)]
            fps.append(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                keys, owns, nodes, roots = (x[:last] for x in held)
                ready = np.concatenate(fps)
                yield batch_of(keys, owns, nodes, [ready[:last]], roots)
                held, fps = [x[last:] for x in held], [ready[last:]]
        if fps:
            keys, owns, nodes, roots = held
            yield batch_of(keys, owns, nodes, fps, roots)

    return run


def verified_components(keyed: DataFrame, radius: int, sure: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root as `components` gives them, of all pairs (a, b) that meet in a shard of keyed(key long, node long, fp binary)
    and lie within `sure` bits, or within radius and are kept by verify.

    A pair counts in one shard only of those where it meets. A round takes of each node and shard the nearest pairs that are
    not in one component yet. Shards in which a node has more such pairs are searched once more with the new components,
    for those further away and eight times as many a node, until no shard has any left: no pair is given up, and a dense
    group is one component long before its pairs are all looked at. Shards of neighbouring keys are searched by one task,
    so that a group that fills several is reported once by it.
    """
    keyed = written(keyed)
    large = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGEST_NEAR))
    shards, used = keyed.withColumn("own", F.col("key")), [keyed, large]  # not joined with sizes: the rows are shuffled once, and a task leaves shards of one node out
    if not large.isEmpty():  # few keys: no more than the rows by the size
        usual = shards.join(F.broadcast(large.select("key")), "key", "left_anti")
        used.append(shards := written(usual.unionByName(_paired_parts(keyed, large, LARGEST_NEAR))))
    near = F.when(F.col("key") == F.col("own"), F.shiftright("key", KEY_BITS - 3)).otherwise(F.col("key"))
    roots, ranks = None, (0, FIRST_PAIRS)
    while True:
        found = written(rooted(shards, roots).repartition(near).sortWithinPartitions("key", "node").mapInArrow(_near_of_partition(radius, sure, ranks), "a long, b long, sure boolean"))
        now = joined(roots, found.where("sure").select("a", "b"))
        pairs = found.where("not sure").select("a", "b").distinct()
        pairs = written(rooted(rooted(pairs, now, "a", "x"), now, "b", "y").where("x != y").select("a", "b"))
        kept = written(verify(pairs))
        old, roots = {roots, now} - {None}, joined(now, kept)
        again = written(found.where("b is null").select(F.col("a").alias("key")).distinct())
        discard(found, pairs, kept, *old - {roots})
        used.append(again)
        if again.isEmpty():
            discard(*used)
            return roots
        shards, ranks = shards.join(again, "key", "left_semi"), (ranks[1], 8 * ranks[1])


def block_keys(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """The (first bit, bits) blocks of each kind of key, for n fingerprints of 64 bits."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and 64 * (blocks - radius) // blocks < np.log2(max(n, 2)) - 6:
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [[(edges[k], edges[k + 1] - edges[k]) for k in chosen] for chosen in combinations(range(blocks), blocks - radius)]


def block_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links of distinct 64-bit fingerprints nodes(node long: the fingerprint, fp binary) within radius, exactly."""
    keys = []
    for kind, chosen in enumerate(block_keys(nodes.count(), radius)):
        mask = sum(((1 << size) - 1) << first for first, size in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.xxhash64(F.lit(kind), F.col("node").bitwiseAND(F.lit(mask).cast("long"))))
    keyed = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "fp")
    return links_in_shards(keyed, radius, by_flips=radius == 2).distinct()


def _node(fp: bytes) -> int:
    return int(np.frombuffer(fp, ">i8")[0]) if len(fp) == 8 else xxhash.xxh64_intdigest(fp) - (1 << 63)


def fingerprints(docs: DataFrame, id_columns: list[str], width: int = WIDTH, words: int = 1, keys: Callable | None = None) -> DataFrame:
    """id_columns, fp binary, node long of each row of docs; with keys, also keys array<long>, and in fp what they return beside."""
    src = docs.select(*id_columns, "text")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*id_columns).schema)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, most=4 << 20):
                rows = [fingerprint(t, width, words) for t in part.column("text").to_pylist()]
                of, fps = [keys(*r) for r in rows] if keys else [], [r[0] for r in rows]
                columns = [*(part.column(c) for c in id_columns), pa.array([f + of[k][1] if keys else f for k, f in enumerate(fps)], pa.binary()), pa.array([_node(f) for f in fps], pa.int64())]
                if keys:
                    columns.append(pa.array([x for x, _ in of], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*id_columns, "fp", "node", *["keys"] * bool(keys)])

    return src.mapInArrow(run, kinds + "fp binary, node long" + ", keys array<long>" * bool(keys))


def band_keys(fp: bytes, counts: np.ndarray, n: int) -> tuple[list[int], bytes]:
    """Keys from the first `KEY_BITS` bits of each of `BANDS` bands of a long fingerprint, also with each one of their `FLIPS`
    least certain bits flipped; and each band's key and the places of those bits in it, four bytes a band."""
    margin, ones = np.abs(2 * counts - n).reshape(BANDS, -1)[:, :KEY_BITS], (2 * counts > n).reshape(BANDS, -1)[:, :KEY_BITS]
    weak = KEY_BITS - 1 - np.argsort(margin, axis=1, kind="stable")[:, :FLIPS]
    keys = (np.arange(BANDS) << 48) | (ones << np.arange(KEY_BITS - 1, -1, -1)).sum(1)
    out = np.concatenate([keys[:, None], keys[:, None] ^ (1 << weak)], axis=1)
    places = (weak << KEY_BITS + 5 * np.arange(FLIPS)).sum(1)
    return out.ravel().tolist(), (keys & ((1 << KEY_BITS) - 1) | places).astype("<u4").tobytes()


def _jaccard(width: int, similarity: float):
    def run(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                a, b = (np.unique(shingle_hashes(t, width)) for t in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both >= similarity * (len(a) + len(b) - both))
            keep = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return run


def similar_groups(rows: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows to keep of rows(row long, doc_id, text): of each group of texts linked by Jaccard similarity of their shingles
    that of the smallest doc_id (nulls last, then by row)."""
    marked = written(fingerprints(rows, ["row", "doc_id"], width, WORDS, band_keys))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = written(marked.groupBy("node").agg(F.min_by("fp", "row").alias("fp"), F.min_by("keys", "row").alias("keys"), F.min(order).alias("least")))
    where = nodes.select("node", F.col("least.row").alias("row"))
    text_a, text_b = (rows.select(F.col("row").alias(f"row_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(where.toDF("a", "row_a"), "a").join(where.toDF("b", "row_b"), "b")
        left, right = ends.join(text_a, "row_a"), text_b
        if pairs.count() <= BROADCAST_PAIRS:  # then only the texts of pairs are shuffled
            ends = written(ends)
            left, right = text_a.join(F.broadcast(ends), "row_a"), text_b.join(F.broadcast(ends.select("row_b").distinct()), "row_b", "left_semi")
        both = left.join(right, "row_b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(_jaccard(width, similarity), "a long, b long")

    roots = verified_components(nodes.select(F.explode("keys").alias("key"), "node", "fp"), RADIUS, SURE, verify)
    best = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    keep = written(best.select(F.col("least.row").alias("row")))
    discard(marked, nodes, roots)
    return keep


def dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates.

    The rows to drop are fewer than those to keep. Up to `BROADCAST_ROWS` of them are broadcast, so that no text is
    shuffled for it; more of them are joined by row number. Both ways keep the same rows.
    """
    small_batches(docs.sparkSession)
    base = written(docs.select(F.monotonically_increasing_id().alias("row"), packed(docs.columns).alias("doc")))
    keep = similar_groups(base.select("row", "doc.doc_id", "doc.text"), width, similarity)
    drop = written(base.select("row").join(keep, "row", "left_anti"))
    if drop.count() <= BROADCAST_ROWS:
        return base.join(F.broadcast(drop), "row", "left_anti").select(*(unpacked(c).alias(c) for c in docs.columns))
    return base.join(keep, "row", "left_semi").select(*(unpacked(c).alias(c) for c in docs.columns))


def groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of each document: fingerprints of 64 bits, linked within radius bits."""
    rows = written(fingerprints(docs, ["doc_id"], width))
    nodes = written(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    roots = written(components(block_links(nodes.select("node", "fp"), radius)))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
