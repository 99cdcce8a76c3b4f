"""Nearest vectors against their SQL, and by comparing all pairs."""

import numpy as np
import pytest
from oracle import compare

from loomfield.operators import neighbours
from loomfield.plans import queries


def _table(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/parts")
    spark.read.parquet(f"{path}/parts").coalesce(1).write.parquet(f"{path}/one")
    (made,) = (path / "one").glob("*.parquet")
    made.rename(path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("cells", [1, 7])
def test_odd_vectors_as_in_the_sql(spark, tmp_path, monkeypatch, cells):
    """Copies, opposite and zero vectors, NaN, null, negative and repeated ids, null labels, in one cell and in many."""
    rng = np.random.default_rng(3)
    common, rows = rng.normal(size=8).astype(np.float32).tolist(), []
    for k in range(1200):
        v = rng.normal(size=8).astype(np.float32).tolist()
        v = common if k % 4 == 0 else [-x for x in common] if k % 50 == 1 else [0.0] * 8 if k in (33, 500, 900) else [float("nan")] * 8 if k in (41, 700) else None if k in (47, 600, 1000) else v
        rows.append((k - 100, v, None if k % 9 == 0 else k % 5))
    rows += [(300, rng.normal(size=8).tolist(), 1), (None, common, 1)]
    if cells > 1:
        monkeypatch.setattr(neighbours, "ROWS", 200)
        monkeypatch.setattr(neighbours, "ASKED", 5)
        monkeypatch.setattr(neighbours, "HELD", 37)
    where = _table(spark, tmp_path, rows)
    assert compare(spark, queries.knn_topk, queries.ORACLE_SQL["knn_topk"], where) == ""


def test_many_vectors_without_a_pair_each_in_the_plan(spark, tmp_path):
    """The pairs are no rows: 40,000 vectors, 400 asked, of which the plan joins none."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40_000, 16)).astype(np.float32)
    where = _table(spark, tmp_path, [(k, v.tolist(), k % 7) for k, v in enumerate(vectors)])
    got = queries.knn(spark, where)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    wide = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1)[:, None]
    sims = wide[::100] @ wide.T
    sims[np.arange(400), np.arange(400) * 100] = -2
    want = np.argsort(-sims, axis=1, kind="stable")[:, :5]
    rows = {(r["query"], r["rank"]): r["vec_id"] for r in got.collect()}
    assert rows == {(100 * q, k + 1): want[q, k] for q in range(400) for k in range(5)}
    assert compare(spark, queries.knn_classify, queries.ORACLE_SQL["knn_classify"], where) == ""


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0], 1)], [(0, None, 1), (100, None, 2), (5, None, 2)], [(0, [1.0], 1), (1, [2.0], None)]])
def test_few_vectors(spark, tmp_path, rows):
    assert compare(spark, queries.knn_topk, queries.ORACLE_SQL["knn_topk"], _table(spark, tmp_path, rows)) == ""
