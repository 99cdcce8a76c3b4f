"""The toxicity model finds planted words, whatever the number and the order of the labelled rows."""

import numpy as np
import pyarrow as pa
import pytest

from loomfield.llm import toxicity

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu", "se") for b in ("la", "ro", "ni", "du") for c in ("", "m", "st", "rin")]


def _rows(seed: int, n: int, toxic) -> tuple[list[str], np.ndarray]:
    rng = np.random.default_rng(seed)
    labels = np.array([int(toxic(k, rng)) for k in range(n)])
    texts = []
    for y in labels:
        own = list(rng.choice(WORDS, int(rng.integers(8, 120))))
        if y:
            own[int(rng.integers(len(own)))] = str(rng.choice(["vileword", "hatefulle"]))
        texts.append(" ".join(own))
    return texts, labels


@pytest.mark.parametrize(("n", "toxic"), [(300, lambda k, r: r.random() < 0.25), (300, lambda k, r: k % 4 == 0), (2000, lambda k, r: k % 4 == 0)])
def test_planted_words(n, toxic):
    texts, labels = _rows(1, n, toxic)
    model = toxicity.fit(texts, labels, float(labels.mean()))
    new, truth = _rows(2, 300, lambda k, r: r.random() < 0.3)
    got = toxicity.score_texts(pa.array([*new, "", None]), model)
    assert ((got >= 0) & (got <= 1)).all() and len(got) == 302
    caught, alarms = (got[:300] >= toxicity.THRESHOLD)[truth == 1].mean(), (got[:300] >= toxicity.THRESHOLD)[truth == 0].mean()
    assert caught > 0.9 and alarms < 0.05, (caught, alarms)
