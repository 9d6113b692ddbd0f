import random

import numpy as np
import pytest

from webstrata.llm import toxicity as X

BAD = ["wretch", "vermin", "rotter"]


def data(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bdfgklmnaeiou") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    out = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(40)]
        y = int(rng.random() < 0.2)
        for _ in range(4 * y):
            own[rng.randrange(40)] = rng.choice(BAD)
        out.append((" ".join(own), y))
    return out


@pytest.mark.parametrize("many", [0, 20, 10_000])
def test_nearest_is_exact_over_all_terms(monkeypatch, many):
    """Against all cosines of vectors over every word of the examples, written out plainly."""
    monkeypatch.setattr(X, "MANY", many)
    rng, rows = random.Random(0), data(300, 4)
    rows += rows[:5] + [("", 0), ("Alpha", 1)]
    words = sorted({w.lower().encode() for t, _ in rows for w in t.split()})
    idf = np.linspace(1, 3, len(words))
    index = X.build(words, idf, [(t.encode(), y, 1.0, i) for i, (t, y) in enumerate(rows)])
    y = np.array([k for _, k in rows])
    count = np.array([[t.lower().split().count(w.decode()) for w in words] for t, _ in rows], "f8")
    share = [(count[y == k] > 0).mean(axis=0) for k in (0, 1)]
    both = (count > 0).mean(axis=0)
    z2 = (share[1] - share[0]) ** 2 / (both * (1 - both) * (1 / (y == 0).sum() + 1 / (y == 1).sum()) + 1e-12)

    def unit(n):
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * idf * z2 / (z2 + X.SHRINK)
        return v / max(np.sqrt(v @ v), 1e-300)

    plain = np.array([unit(n) for n in count])[index.ids]
    asked = [rng.choice(data(50, 9))[0] for _ in range(60)] + ["", "vermin", "Rotter! unknown"]
    best, sims = index.nearest([index.vector(t.encode()) for t in asked])
    for i, t in enumerate(asked):
        cosine = (plain @ unit(np.array([[w.strip("!") for w in t.lower().split()].count(w.decode()) for w in words], "f8"))).round(9)
        want = [k for k in np.lexsort((np.arange(len(rows)), -cosine)) if cosine[k] > 0][: X.K]
        np.testing.assert_allclose(sims[i, : len(want)], cosine[want], atol=2e-9)
        assert (best[i, len(want) :] == -1).all() and [index.ids[k] for k in best[i, : len(want)]] == [index.ids[k] for k in want]


def test_held_out_accuracy(spark):
    rows = data(700, 1)
    extra = [(9000, None, "x", "y"), (9001, "", "x", "y"), (9002, "vermin " * 100000, "", ""), (9002, "vermin " * 100000, "", ""), (None, "a", "", "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(rows)] + extra, "doc_id long, text string, score string, evidence string")
    labels = spark.createDataFrame([(i, 0, y) for i, (_, y) in enumerate(rows)] + [(9000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = X.classify(docs, labels).collect()
    assert len(got) == 705 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert len(held) > 90 and sum(r.predicted == rows[r.doc_id][1] for r in held) >= len(held) - 1
    assert all(e.label == rows[e.doc_id][1] for r in got for e in r.evidence)
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0} and {r.predicted for r in got if r.doc_id == 9002} == {1}
    assert X.classify(docs.where("false"), labels).count() == 0
    assert X.classify(docs, labels.where("false")).count() == 705
