import random

import numpy as np
import pytest

from tesserae.llm import nbsvm, quality, toxicity
from tests.llm.conftest import odd_rows, words


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, docs_of, module, label):
    rng = random.Random(10)
    bad = ["rotten", "awful", "dreadful"]
    rows, truth = [], {}
    for i in range(600):
        w = words(rng, rng.randrange(20, 60)).split()
        truth[i] = int(rng.random() < 0.4)
        if truth[i]:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
    docs = docs_of(rows + [(i, t) for i, t in odd_rows() if i is None])
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 3] + [(None, 1), (5000, 0), (1, None)], f"doc_id long, {label} int")
    model = module.train(docs, labels)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    held = [i for i in truth if i % 3 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.93
    assert all(0 <= s <= 1 for s in got.values()) and None in got


def test_odd_rows_are_scored(spark, docs_of):
    model = nbsvm.fit([], np.zeros(0), toxicity.FEATURES)
    got = toxicity.score(docs_of(odd_rows()), model, keep=("source",), out="text_score").collect()
    assert len(got) == len(odd_rows()) and all(r.text_score == pytest.approx(0.5) for r in got)


def test_one_class_only(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    docs = docs_of([(1, "abc def"), (2, "ghi")])
    assert all(0.5 < r.score < 1 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect())


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(11)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(40)]
    values = [np.full(len(r), 1 / np.sqrt(len(r))) for r in rows]
    signs = np.where(np.array([r.min() for r in rows]) < 4, 1.0, -1.0)
    w, b = nbsvm.dual_coordinate_descent(rows, values, signs, cost=1.0, rounds=2000)

    def loss(w, b):
        return (w @ w + b * b) / 2 + sum(max(0, 1 - y * (w[r] @ v + b)) for r, v, y in zip(rows, values, signs, strict=True))

    best = loss(w, b)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:50] = rng.normal(0, 0.01, 50)
        assert loss(w + step, b + rng.normal(0, 0.01)) >= best - 1e-3
