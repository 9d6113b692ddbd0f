import hashlib
import random
from collections import Counter

import pytest

from webstrata.llm import cws as C


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        out[k] = (t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt)
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["é😀", "l'Été"]
    return [(7 * i - 300, rng.choice([" ", "\n\t"]).join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(1, 400)))) for i in range(n)] + [(90_000, None), (90_001, ""), (90_002, "one"), (90_003, "a " * 20000)]


def test_edits_and_unbiased_likeness(spark):
    rows = corpus(150, 1)
    want = edited(rows)
    got = {r.doc_id: r for r in C.fingerprints(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fingerprint string").repartition(3)).collect()}
    assert got.keys() == want.keys()
    errors = []
    for k, (t, e, nxt) in want.items():
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        if t.split() and nxt.split():
            errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, nxt)]
    assert abs(sum(errors) / len(errors)) < 0.012 and (sum(x * x for x in errors) / len(errors)) ** 0.5 < 0.08
    assert got[90_000].fingerprint == got[90_001].fingerprint and got[90_001].near_next == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(1, "a b c"), (2, "b c a"), (2, "b c a"), (3, "x"), (None, "a b c")]
    got = C.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got}) == 2
    assert C.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = C.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()


@pytest.mark.parametrize("size", [2000, 12_000])
def test_ranges_split_repeated_and_null_ids(spark, monkeypatch, size):
    """However rows are cut into ranges, each row's neighbour is the same; one id or none for all rows doesn't make one range."""
    rows = corpus(120, 2)[:-1]
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else k, t) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, place int").repartition(3)
    whole = sorted(map(tuple, C.fingerprints(df).collect()), key=repr)
    monkeypatch.setattr(C, "RANGE_BYTES", size)
    assert C.ordered(df).groupBy("place").count().count() > 3
    assert sorted(map(tuple, C.fingerprints(df).collect()), key=repr) == whole
