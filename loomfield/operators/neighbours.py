"""The nearest vectors by cosine, exactly: every asked vector against every row, in cells of a grid of both.

Rows and asked vectors are dealt over cells by a shuffle, so that neither goes through the driver or one task whole. A task
holds its cell's asked vectors and their nearest so far, and passes the rows by in batches. A product of matrices in single
precision finds the pairs that may be among the nearest, with a margin of twice its largest error; those are computed again
in double precision. The work is all pairs, a hundredth of the rows' square for a hundredth of them asked.

Similarities are compared at nine digits, equal ones by id. A zero vector, or one that holds NaN or infinity, has the
similarity NaN to any other, which comes first, and a null vector null, which comes last, as in the SQL. Rows with null id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import best_rows

ASKED, ROWS, LEAST_ROWS = 1 << 15, 1 << 18, 1 << 12  # of a cell: at most some, at most some, no fewer for the sake of more tasks
TILE, HELD = 512, 4_096  # asked vectors and rows multiplied at a time
NO_LABEL = np.iinfo(np.int64).min
GOOD, ODD, NULL = 0, 1, 2  # kinds of a vector; ODD: NaN to any other


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, norms, kinds) of a column of arrays of one length; the length is 0 where all are null."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.unique(pc.list_value_length(column.drop_null()).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:2].tolist()}")
    out = np.zeros((len(column), int(sizes[0]) if len(sizes) else 0))
    if len(sizes):
        out[~null] = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, sizes[0])
    norms = np.zeros(len(out))
    for k in range(out.shape[1]):
        norms += out[:, k] * out[:, k]
    norms = np.sqrt(norms)
    return out, norms, np.where(null, NULL, np.where(np.isfinite(norms) & (norms > 0), GOOD, ODD))


def _least(ids: np.ndarray, n: int) -> np.ndarray:
    """The rows of the n least ids."""
    return np.flatnonzero(ids <= np.unique(ids)[min(n, len(np.unique(ids))) - 1]) if len(ids) else np.zeros(0, np.int64)


class Nearest:
    """The n nearest of the rows that passed by, for each asked vector."""

    def __init__(self, ids: np.ndarray, column: pa.Array, n: int):
        self.ids, self.n = ids, n
        self.vectors, self.norms, self.kinds = _vectors(column)
        self.near = np.full((len(ids), n), -np.inf)  # rounded similarity; NaN as inf, null as -inf
        self.rows, self.labels = np.zeros((len(ids), n), np.int64), np.zeros((len(ids), n), np.int64)
        self.sims, self.filled = np.full((len(ids), n), np.nan), np.zeros(len(ids), np.int64)
        self.unit = self._unit(self.vectors, self.norms, self.kinds)

    @staticmethod
    def _unit(vectors: np.ndarray, norms: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.where((kinds == GOOD)[:, None], vectors / np.where(kinds == GOOD, norms, 1.0)[:, None], 0.0).astype(np.float32)

    def add(self, ids: np.ndarray, labels: np.ndarray, column: pa.Array) -> None:
        vectors, norms, kinds = _vectors(column)
        size, other = self.vectors.shape[1], vectors.shape[1]
        if size and other and size != other:
            raise ValueError(f"vectors of different lengths: {[size, other]}")
        good, odd, null = (np.flatnonzero(kinds == k) for k in (GOOD, ODD, NULL))
        some = np.flatnonzero(kinds != NULL)
        # of rows that are alike to an asked vector only those of the least ids count; one of them may be its own
        last, first, mid = (x[_least(ids[x], self.n + 1)] for x in (null, odd, some))
        every = np.arange(len(ids))
        lowest = every[_least(ids, self.n + 1)]
        for mine, rows in ((GOOD, np.concatenate([first, last])), (ODD, np.concatenate([mid, last])), (NULL, lowest)):
            asked = np.flatnonzero(self.kinds == mine)
            step = max(1, TILE * HELD // max(len(rows), 1))
            for i in range(0, len(asked) if len(rows) else 0, step):
                x, y = np.repeat(asked[i : i + step], len(rows)), np.tile(rows, len(asked[i : i + step]))
                either = (self.kinds[x] == NULL) | (kinds[y] == NULL)
                self._keep(x, ids[y], labels[y], np.where(either, -np.inf, np.inf), np.full(len(x), np.nan))
        asked = np.flatnonzero(self.kinds == GOOD)
        if not len(good) or not len(asked):
            return
        unit, flat, margin = self._unit(vectors[good], norms[good], kinds[good]).T, np.ascontiguousarray(vectors[good].T), (size + 8) * 2.0**-23
        for i in range(0, len(asked), TILE):
            x = asked[i : i + TILE]
            sims = self.unit[x] @ unit
            least = np.where(self.filled[x] == self.n, self.near[x, -1] / 1e9, -np.inf)
            if len(good) > self.n and (least == -np.inf).any():  # the n nearest of the tile itself are at least as near
                sims[self.ids[x][:, None] == ids[good]] = -np.inf
                least = np.maximum(least, np.partition(sims, len(good) - self.n, axis=1)[:, len(good) - self.n].astype(np.float64) - margin)
            a, b = np.nonzero(sims >= (least - margin).astype(np.float32)[:, None])
            a, dot = x[a], np.zeros(len(a))
            mine = self.vectors[x].T
            at = a - x[0] if x[-1] - x[0] == len(x) - 1 else np.searchsorted(x, a)
            for k in range(size):
                dot += flat[k][b] * mine[k][at]
            sim, b = dot / (norms[good[b]] * self.norms[a]), good[b]
            self._keep(a, ids[b], labels[b], np.trunc(sim * 1e9 + np.copysign(0.5, sim)), sim)

    def _keep(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        other = self.ids[x] != ids
        x, ids, labels, near, sims = (c[other] for c in (x, ids, labels, near, sims))
        if not len(x):
            return
        old = np.unique(x)
        a, b = np.nonzero(np.arange(self.n) < self.filled[old][:, None])
        a = old[a]
        x, ids, labels, near, sims = (np.concatenate(c) for c in ((a, x), (self.rows[a, b], ids), (self.labels[a, b], labels), (self.near[a, b] * 1.0, near), (self.sims[a, b], sims)))
        order = np.lexsort((ids, -near, x))
        x = x[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        order, x, rank = order[rank < self.n], x[rank < self.n], rank[rank < self.n]
        self.rows[x, rank], self.labels[x, rank], self.near[x, rank], self.sims[x, rank] = ids[order], labels[order], near[order], sims[order]
        np.maximum.at(self.filled, x, rank + 1)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.ids), HELD):
            a, b = np.nonzero(np.arange(self.n) < self.filled[i : i + HELD][:, None])
            a += i
            near = self.near[a, b]
            labels = self.labels[a, b]
            columns = [pa.array(self.ids[a]), pa.array(self.rows[a, b]), pa.array(labels, mask=labels == NO_LABEL), pa.array(near), pa.array(self.sims[a, b], mask=near == -np.inf)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "vec_id", "label", "near", "sim"])


def _cell(n: int):
    """Rows (asked, vec_id, label, embedding) of one cell, the asked vectors first."""

    def run(batches):
        ids, held, nearest = [], [], None
        for batch in batches:
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            first = int(asked.sum())
            if first:
                ids.append(batch.column("vec_id").slice(0, first).to_numpy())
                held.append(batch.column("embedding").slice(0, first))
            if first < len(asked) and ids:
                nearest = nearest or Nearest(np.concatenate(ids), pa.concat_arrays(held), n)
                for i in range(first, len(asked), HELD):
                    part = batch.slice(i, HELD)
                    nearest.add(part.column("vec_id").to_numpy(), part.column("label").fill_null(NO_LABEL).to_numpy(), part.column("embedding"))
        if nearest:
            yield from nearest.batches()

    return run


def nearest(vectors: DataFrame, asked: Column, n: int) -> DataFrame:
    """query, vec_id, label, sim, rank of the n nearest others of each asked row of vectors(vec_id, label, embedding)."""
    spark, kind = vectors.sparkSession, vectors.schema["label"].dataType
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    n_rows, n_asked = rows.count(), rows.where(asked).count()
    across = max(1, -(-n_asked // ASKED))
    down = max(1, -(-n_rows // ROWS), min(2 * spark.sparkContext.defaultParallelism, n_rows // LEAST_ROWS))
    dealt = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = rows.where(asked).select(F.lit(True).alias("asked"), every(down).alias("down"), dealt(across).alias("across"), "vec_id", "label", "embedding")
    passed = rows.select(F.lit(False).alias("asked"), dealt(down).alias("down"), every(across).alias("across"), "vec_id", "label", "embedding")
    cells = own.unionByName(passed).withColumn("cell", F.col("across") * down + F.col("down")).repartitionById(across * down, "cell")
    found = cells.sortWithinPartitions(F.desc("asked")).select("asked", "vec_id", "label", "embedding").mapInArrow(_cell(n), "query long, vec_id long, label long, near double, sim double")
    return best_rows(found, ["query"], [F.desc("near"), F.asc("vec_id")], n).select("query", "vec_id", F.col("label").cast(kind), "sim", "rank")
