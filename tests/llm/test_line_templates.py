"""Line dedup: boilerplate goes whatever its share of a page; near copies of one text are no boilerplate."""

import numpy as np
import pytest

from loomfield.llm import line_templates

NOTICE = "Subscribe to our weekly letter for more stories today\nAll of the content here is owned by its authors\nPlease read the terms of use before you go on"


def _prose(rng, n):
    return " ".join("".join("bcdfghjkmn"[int(d)] + "aeiou"[int(d) % 5] for d in str(k)) for k in rng.integers(0, 10**6, n))


def _stripped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc"]["doc_id"]: (r["n_dropped"], r["text"]) for r in line_templates.strip_templates(docs).collect()}


@pytest.mark.parametrize("own", [8, 20, 28, 32, 60])
def test_boilerplate_goes_at_any_share(spark, own):
    rng = np.random.default_rng(own)
    bodies = [_prose(rng, own) for _ in range(40)]
    got = _stripped(spark, [f"{NOTICE}\n{b}" for b in bodies] + [_prose(rng, 50) for _ in range(20)] + [None, "", NOTICE.split("\n")[0] * 2000])
    assert [got[k] for k in range(40)] == [(3, b) for b in bodies]
    assert all(got[k][0] == 0 for k in range(40, 63)) and got[60][1] is None and got[61][1] == ""


def test_near_copies_stay_whole(spark):
    """60 copies of a page of 12 lines: a word put in, taken out or replaced in each of 5 lines, at any place."""
    rng = np.random.default_rng(1)
    lines = [_prose(rng, 40) for _ in range(12)]
    texts = []
    for _ in range(60):
        own = [line.split() for line in lines]
        for k in rng.choice(12, 5, replace=False):
            at, kind = int(rng.integers(1, 38)), int(rng.integers(3))
            own[k][at : at + (kind > 0)] = [] if kind == 1 else [_prose(rng, 1)]
        texts.append("\n".join(map(" ".join, own)))
    got = _stripped(spark, texts + ["\n".join(lines)] * 5)
    assert all(n == 0 for n, _ in got.values())


def test_boilerplate_beside_copies(spark):
    """Boilerplate of many pages goes from the copies as well; what only copies share stays."""
    rng = np.random.default_rng(2)
    page = "\n".join(_prose(rng, 30) for _ in range(4))
    copies = [f"{NOTICE}\n{page} {_prose(rng, 2)}" for _ in range(50)]
    others = [f"{_prose(rng, 40)}\n{NOTICE}" for _ in range(15)]
    got = _stripped(spark, copies + others)
    assert all(got[k] == (3, copies[k].removeprefix(f"{NOTICE}\n")) for k in range(50))
    assert all(got[k][0] == 3 for k in range(50, 65))
