import itertools
import random

import numpy as np

from webstrata.llm import langid as L


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    lengths = np.array([4, 2])
    marginal, pairs = L.forward_backward(e, lengths, t)
    want_pairs = np.zeros((3, 3))
    for b, n in enumerate(lengths):
        total, want, own = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(e[b, i, y] for i, y in enumerate(path)) + sum(t[a, c] for a, c in itertools.pairwise(path)))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
            for a, c in itertools.pairwise(path):
                own[a, c] += p
        np.testing.assert_allclose(marginal[b, :n], want / total)
        want_pairs += own / total
    np.testing.assert_allclose(pairs, want_pairs)


def rows(n, seed):
    rng = random.Random(seed)
    own = {"aa": "the of and thing with".split(), "bb": "le de une éau pour".split(), "cc": "der und schön nicht ein".split()}
    return [(" ".join(rng.choice(own[k]) + rng.choice(["", "s", "t"]) for _ in range(30)), k) for k in (rng.choice(list(own)) for _ in range(n))]


def test_held_out_accuracy_and_switches():
    model = L.fit([(t.encode(), k) for t, k in rows(200, 1)])
    test = rows(200, 2)
    got = model.tag([t.encode() for t, _ in test])
    assert sum(g[0] == k for g, (_, k) in zip(got, test, strict=True)) >= 198
    mixed, score = model.tag([(" the of and thing with" * 6 + " der und nicht" * 3).encode()])[0]
    assert mixed == "aa" and 0.6 < score < 0.9


def test_odd_rows(spark):
    data = [(i, t, k, "s", "x") for i, (t, k) in enumerate(rows(120, 3))]
    data += [(200, None, "aa", "s", "x"), (201, "", None, "s", "x"), (202, "12 34 !?", "bb", None, "x"), (203, "the of " * 20000, "aa", "s", "x"), (203, "the of " * 20000, "aa", "s", "x"), (None, "und der", "cc", "s", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score string")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert L.identify(df).count() == len(data)
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[203].lang_pred == "aa"
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 120]
    assert held and sum(r.lang_pred == data[r.doc_id][2] for r in held) >= len(held) - 1
    empty = df.where("false")
    assert L.identify(empty).count() == 0
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.source.substr(9, 0)).where("lang > 'a'")).collect()} <= {"und"}
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df.lang.substr(9, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")).collect()} == {"und"}


def test_all_of_a_text_without_blanks_counts():
    model = L.fit([(t.encode(), k) for t, k in rows(200, 1)])
    text = "theofandthingwith" * 2 + "derundschönnichtein" * 30
    assert model.tag([text.encode()])[0][0] == "cc"
    runs = L.split_words(("é" * 50 + " ab " + "x" * 33).encode())
    assert b"".join(runs) == ("é" * 50 + "ab" + "x" * 33).encode() and max(map(len, runs)) <= 32 and all(r.decode() for r in runs)


def test_samples_keep_every_label(spark):
    """Twenty thousand copies of one text, three hundred others, and four hundred labels of a row each."""
    from pyspark.sql import functions as F

    from webstrata.llm.common import hashed_sample

    copies = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("xx").alias("lang"))
    others = spark.range(300).select("id", F.concat(F.lit("t"), F.col("id")), F.lit("yy"))
    rare = spark.range(400).select("id", F.lit("r"), F.concat(F.lit("l"), F.col("id")))
    rows = copies.union(others).union(rare)
    got = {r.lang: (r.n, r.w) for r in hashed_sample(rows, "lang", "doc_id", "text", limit=100).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum("weight")).alias("w")).collect()}
    assert len(got) == 402 and got["xx"] == (100, 20_000) and got["yy"] == (100, 300) and got["l3"] == (1, 1)
    assert hashed_sample(rows, "lang", "doc_id", "text", total=804).groupBy("lang").count().where("count > 2").count() == 0
    model = L.fitted(rows.where("lang < 'l' or lang > 'm'"), F.lit(True))
    assert model.langs == ["xx", "yy"]


def test_long_texts_are_learned_from_all_over():
    text = " ".join(f"w{i}" for i in range(40 * 1000)).encode()
    runs = L.some_runs(text)
    assert len(runs) == L.FIT_RUNS and runs[0].startswith(b"w0 ") and runs[-1].endswith(b" w39999")
    assert L.some_runs(b"a b") == [b"a b"] and L.some_runs(b"") == []
