import random

import numpy as np

from webstrata.llm import quality as Q


def data(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioustrn") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    out = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        y = int(rng.random() < 0.7)
        if not y:
            own = [own[0]] * 30 if rng.random() < 0.5 else [w.upper() + "!!" for w in own]
        out.append((" ".join(own), y))
    return out


def test_equal_words_have_equal_hashes_wherever_they_stand():
    assert set(Q.ngrams(b"alpha").tolist()) < set(Q.ngrams(b"xx yy alpha zz").tolist())
    repeat = Q.ngrams(b"ab ab ab")
    assert len(repeat) - len(Q.ngrams(b"ab ac ab")) == 2


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = Q.descend([(np.arange(5), v) for v in x], y, np.full(60, 1.0), 5, sweeps=2000)
    full = np.c_[x, np.ones(60)]
    primal = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (full @ w)).sum()
    best = primal(w)
    for _ in range(300):
        assert best <= primal(w + 0.05 * rng.normal(size=6)) + 1e-3


def test_held_out_accuracy(spark):
    rows = data(600, 1)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(rows)] + [(9000, None, "x", "y"), (9001, "", "x", "y"), (9002, "ok " * 100000, "", ""), (9002, "ok " * 100000, "", ""), (None, "a", "", "")], "doc_id long, text string, score string, y string")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(rows)] + [(9000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and sum(r.predicted == rows[r.doc_id][1] for r in held) / len(held) > 0.97
    assert Q.classify(docs.where("false"), labels).count() == 0
    assert Q.classify(docs, labels.where("false")).count() == 605
