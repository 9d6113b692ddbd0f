import hashlib
import random

import pytest

from webstrata.llm import substring as S


def brute(rows, width=20):
    first, texts = {}, {k: (t or "").encode().split() for k, t in rows}
    for k in sorted(texts):
        for i in range(len(texts[k]) - width + 1):
            first.setdefault(tuple(texts[k][i : i + width]), (k, i))
    out = {}
    for k, words in texts.items():
        gone = {j for i in range(len(words) - width + 1) if first[tuple(words[i : i + width])] != (k, i) for j in range(i, i + width)}
        out[k] = (len(words), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest())
    return out


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É,", "x y", "q\x1cr"]
    passages = [[rng.choice(words) for _ in range(rng.choice([19, 20, 21, 35, 70]))] for _ in range(8)]
    rows = []
    for i in range(n):
        own: list = []
        for _ in range(rng.randrange(0, 5)):
            own += [rng.choice(words) for _ in range(rng.randrange(0, 30))]
            own += rng.choice(passages)[: rng.choice([10, 19, 20, 100])] if rng.random() < 0.6 else []
        own += ["la"] * rng.choice([0, 0, 0, 21, 60])
        rows.append((1000 - 7 * i, rng.choice([" ", "\n", " \t"]).join(own)))
    return rows + [(5000, None), (5001, ""), (5002, " "), (5003, "la " * 30000), (5004, rows[3][1]), (5005, rows[3][1])]


@pytest.mark.parametrize("flush", [1_000_000, 200])
def test_matches_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(S, "FLUSH", flush)
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, starts string, n_words int").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.digest(df).collect()}
    assert got == brute(rows)


def test_spans_rebuild_the_text(spark):
    rows = corpus(seed=3)
    texts = dict(rows)
    for r in S.deduplicate(spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string"), keep=["source", "text"]).collect():
        words, gone = (texts[r.doc_id] or "").encode().split(), {j for s in r.spans for j in range(s.start, s.start + s.length)}
        assert r.source == "s" and r.text == texts[r.doc_id] and len(gone) == r.n_removed
        assert r.kept.encode() == b" ".join(w for j, w in enumerate(words) if j not in gone)


def test_odd_tables(spark):
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"a{i}" for i in range(30))
    got = S.digest(spark.createDataFrame([(None, text), (3, text), (3, text), (4, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (3, 30), (3, 30), (4, 30)]


def test_rows_that_share_an_id_lose_only_what_repeats_in_them(spark):
    unique = [" ".join(f"u{k}x{i}" for i in range(50)) for k in range(4)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage), (5, unique[0]), (5, f"own {passage} end"), (None, unique[1]), (None, unique[2]), (None, f"{unique[3]} {unique[3]}"), (5, f"own {passage} end")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 25, 0), (5, 50, 0), (5, 27, 25), (5, 27, 25), (0, 50, 0), (0, 50, 0), (0, 100, 50)])
    # the same passage under one id in two texts: one of them keeps it
    two = [r.n_removed for r in S.digest(spark.createDataFrame([(8, f"a {passage}"), (8, f"b {passage}")], "doc_id long, text string")).collect()]
    assert sorted(two) == [0, 25]
