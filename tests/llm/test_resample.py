"""Resampling against a plain version, text by text."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from webstrata.llm import resample

ODD = ["", "one", "Ä b ß", "A-B c.d", "\x00a\x00", "x" * 3000, "日本 語", "\x7f\x80 é" * 4, "don't"]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])], len(words)


def bucket(f):
    return zlib.crc32(f.encode()) % 10000


def plain(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[0]))
    for text in target:
        t.update(map(bucket, features(text)[0]))
    a, b = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        fs, n = features(text)
        got = [math.floor(1000 * math.log((t[x] + 1) * (a + 10000.0) / ((s[x] + 1) * (b + 10000.0)))) for x in map(bucket, fs)]
        weight = sum(got) // len(got) if got else 0
        name = str(i) if i is not None else "null:" + hashlib.sha256((text or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(fit[: 25 * len(fit) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def test_buckets_in_parts():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aB é.\n") for _ in range(rng.choice([0, 1, 5, 60, 300])))
        want = sorted(map(bucket, features(text)[0]))
        for size in (1, 4, 33, 1 << 20):
            assert sorted(resample.buckets_of(text.encode(), size).tolist()) == want, (text, size)


def test_resample(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "delta", "é", "w1", "w2", "w3"]
    make = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, rng.choice([None, *ODD, make(rng.choice([3, 19, 20, 21, 200]))])) for i in range(150)]
    docs += [(1000 + i, docs_text) for i, docs_text in enumerate([make(40)] * 120)]  # a group of copies
    docs += [(None, make(30)), (None, make(25)), (None, None), docs[0], (5, make(50)), (2000, make(20000))]
    target = [make(30) + " gamma gamma", "", None, "W1 w1"]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, weight string, salt int").repartition(3)
    got = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    mine, want = sorted(map(tuple, got), key=key), sorted(plain(docs, target), key=key)
    assert mine == want


def test_ranks_of_rows_with_one_id(spark):
    """A third of all rows in one id: ranks are a gapless count all the same."""
    docs = [(7, "a b c d e f g h i j k l m n o p q r s t u")] * 100 + [(i, f"text {i} " + "word " * 20) for i in range(100, 300)]
    target = spark.createDataFrame([], "text string")
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), target).collect()
    assert len(got) == 300 and sorted(r.rank for r in got if r.rank) == list(range(1, 76))
    best = sorted((r.score for r in got), reverse=True)
    assert all(best[r.rank - 1] == r.score for r in got if r.rank)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, none).count() == 0
    assert [tuple(r)[:3] for r in resample.resample(spark.createDataFrame([(1, None)], none.schema), none).collect()] == [(1, 0, 0)]


def test_counts_over_arrow_batches():
    column = pa.array([resample.buckets_of(b"a b a").tobytes(), b""], pa.binary())
    numbers, size = resample.flat_buckets(column)
    assert len(numbers) == 5 and size.tolist() == [5, 0]
