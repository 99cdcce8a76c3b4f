"""The pipeline's stages one after another on a small hostile table, and the quality classifier on its cases."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from loomfield.llm import bpe, quality_nbsvm


def _prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{'aeiou'[k % 5]}{'klmnprst'[k % 8]}{'aeiou'[k % 3]}{k:x}" for k in rng.integers(0, 50_000, n))


SCHEMA = "doc_id long, text string, lang string, source string, row long, key string, fp string, root long, `a.b` string, `back``tick` int"
NAMES = ["doc_id", "text", "lang", "source", "row", "key", "fp", "root", "a.b", "back`tick"]
PASSAGE = _prose(99, 14)


def _row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, 1, "k", None, None, "dot", 5)


ROWS = [
    *(_row(k, _prose(k, 60 + k)) for k in range(10)),
    _row(20, _prose(3, 63)), _row(3, _prose(3, 63)),  # a copy, a repeated row
    _row(21, _prose(4, 64).replace(_prose(4, 1), "changed", 1)),  # a near copy
    _row(22, f"{_prose(50, 40)} {PASSAGE} {_prose(51, 40)}"),
    _row(23, None), _row(24, ""), _row(25, "too short"), _row(26, "same words again " * 50),
    _row(None, _prose(52, 80), None), _row(27, _prose(53, 60_000)),
]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = str(tmp_path_factory.mktemp("tables")), {}
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
        out[name] = docs
    return out


def test_stages_keep_columns_and_clean_rows(stages):
    ids = {name: sorted((r["doc_id"] is None, r["doc_id"]) for r in df.select("doc_id").collect()) for name, df in stages.items()}
    good = sorted([(False, k) for k in [*range(10), 3, 20, 21, 22, 27]] + [(True, None)], key=lambda x: (x[0], x[1] or 0))
    assert all(df.columns == NAMES for name, df in stages.items() if name != "byte_bpe")
    assert ids["quality_rules"] == good and ids["line_dedup"] == good
    assert ids["near_dedup"] == sorted(set(good) - {(False, 20), (False, 21)}, key=lambda x: (x[0], x[1] or 0)) == ids["decontamination"] == ids["byte_bpe"]


def test_benchmark_passage_goes_and_nothing_else(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[k].collect()} for k in ("near_dedup", "decontamination"))
    assert {k for k in before if before[k] != after[k]} == {22}
    assert after[22].split() == f"{_prose(50, 40)} {_prose(51, 40)}".split()


def test_digests_are_those_of_tiktoken(stages):
    ranks, pattern = bpe.public_vocabulary()
    got = {r["doc_id"]: r for r in stages["byte_bpe"].collect()}
    for r in stages["decontamination"].collect():
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    coder = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in stages["decontamination"].collect():
        ids = coder.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(ids) and got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_quality_on_held_out_rows_and_odd_ones(spark):
    good = [(k, _prose(k, 80), "en", 0.5) for k in range(120)]
    bad = [(k, " ".join(f"buy{x} now!!! $$$" for x in np.random.default_rng(k).integers(0, 30, 40)), "en", 0.5) for k in range(120, 240)]
    odd = [(500, None, None, None), (501, "", "en", 0.1), (None, "a text without an id", "en", 0.1), (502, _prose(9, 50_000), "en", 0.1), (502, _prose(9, 50_000), "en", 0.1)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(240)] + [(None, 1, 1), (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r["doc_id"], r["score"]) for r in quality_nbsvm.classify(docs, labels).collect()]
    assert len(got) == 245 and all(0 <= s <= 1 for _, s in got)
    held = [(k, s) for k, s in got if k is not None and k < 240 and zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 20 and all((s >= 0.3) == (k < 120) for k, s in held)
    scores = {}
    for k, s in got:
        assert scores.setdefault(k, s) == s
    assert scores[500] == scores[501] and scores[502] > 0.5
    assert quality_nbsvm.classify(docs.limit(0), labels).count() == 0
    few = {r["score"] for r in quality_nbsvm.classify(docs, labels, max_features=10).collect()}
    assert few == {0.5}
