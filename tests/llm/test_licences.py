"""Licence places against trying every template at every position, and base phrases against a plain search."""

import random
import re

import pyarrow as pa
import pytest

from webstrata.llm import licences as L


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def base_places(ws):
    return sorted((i, label) for phrase, label in L.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split())


def every_position(ws, t, coverage=L.COVERAGE, slack=L.SLACK):
    """(met, exactly in place, position) of each position at which template t is good enough, by looking at all of them."""
    body, out = t.text.split(), []
    keys = [[i for i in range(len(ws)) if ws[i : i + len(k.split())] == k.split()] for k in t.keys]
    for d in range(-len(body) + 1, len(ws)):
        met = sum(any(0 <= d + q + s < len(ws) and ws[d + q + s] == w for s in range(-slack, slack + 1)) for q, w in enumerate(body))
        if met >= coverage * len(body) - 1e-9 and all(any(d - slack <= i <= d + len(body) + slack - len(k.split()) for i in found) for k, found in zip(t.keys, keys, strict=True)):
            out.append((met, sum(0 <= d + q < len(ws) and ws[d + q] == w for q, w in enumerate(body)), d))
    return out


def chosen(found, size):
    out = []
    for _, _, d in sorted(found, key=lambda x: (-x[0], -x[1], x[2])):
        if all(abs(d - e) >= size for e in out):
            out.append(d)
    return sorted(out)


def noisy(rng, text):
    ws = text.split()
    for _ in range(rng.randint(0, max(1, len(ws) // 8))):
        at = rng.randrange(len(ws))
        ws[at : at + 1] = rng.choice([[], [ws[at], "odd"], ["other"], ["the"]])
    return " ".join(ws)


def samples(seed):
    rng = random.Random(seed)
    fill = ["the", "license", "of", "software", "free", "word", "Mit", "é", "x9", "version", "2", "public"]
    for _ in range(60):
        parts = [" ".join(rng.choices(fill, k=rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 3)):
            parts += [noisy(rng, rng.choice(L.TEMPLATES).text), " ".join(rng.choices(fill, k=rng.randint(0, 20)))]
        yield rng.choice([" ", ", ", "\n- "]).join(parts).replace(" license ", " License ")
    yield from ["", "MIT license", "mit-license mit  LICENSE", "gnu general public license general public license", "MIT" * 500, "license " * 300 + "released under the MIT license", "a" * 9000 + " Apache License"]


@pytest.mark.parametrize("size", [16, 1 << 21])
@pytest.mark.parametrize("weighted", [False, True])
def test_places(monkeypatch, size, weighted):
    texts = list(samples(size))
    whole = L.pieces
    monkeypatch.setattr(L, "pieces", lambda d, a, letter: whole(d, a, letter, size))
    rng = random.Random(1)
    index = L.Index(L.TEMPLATES, L.BASE, {w: rng.random() for t in L.TEMPLATES for w in t.text.split()} if weighted else {})
    total, places = L.scan_batch(index, pa.array(texts), L.COVERAGE, L.SLACK)
    hits = 0
    for text, n, found in zip(texts, total.tolist(), places, strict=True):
        ws = words(text)
        assert n == len(ws)
        assert [(p["first_word"], p["label"]) for p in found if p["method"] == "base"] == base_places(ws)
        want = []
        for t in L.TEMPLATES:
            good = every_position(ws, t)
            size_of = len(t.text.split())
            for d in chosen(good, size_of):
                want.append((max(d, 0), t.label, max(m for m, _, e in good if e == d) / size_of))
        got = [(p["first_word"], p["label"], p["coverage"]) for p in found if p["method"] == "template"]
        assert sorted(got) == sorted(want), text
        hits += len(got)
    assert hits > 60


def test_digest(spark):
    rows = [(1, "Released under the MIT License. Licensed under the Apache License, Version 2.0", "a"), (2, None, "b"), (3, "", "c"), (None, "licensed under CC BY-NC 4.0", "d"), (1, "this work is licensed under the GNU General Public License, version 3", "e"), (9, "mit. license apache-license MIT  license", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted((tuple(r)[:8] for r in L.digest(docs).collect()), key=lambda r: (r[0] or 0, r[6]))
    assert got == [
        (None, 7, 0, None, None, "", "cc-by-nc", 1.0), (1, 13, 2, 3, 8, "apache,mit", "apache,apache-2.0,mit", 1.0), (1, 12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 1.0),
        (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (9, 6, 3, 0, 4, "apache,mit", "apache,mit", 1.0),
    ]
    assert L.digest(spark.createDataFrame([], docs.schema)).count() == 0


def test_frequencies_are_of_all_documents(spark):
    index = L.Index(L.TEMPLATES, L.BASE)
    docs = spark.createDataFrame([("license license",), ("MIT license",), (None,), ("none",)], "text string").repartition(3)
    n, df = L.frequencies(docs, index)
    assert n == 4 and df["license"] == 2 and df["mit"] == 1 and df["software"] == 0


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "all rights are kept by nobody at all")], "doc_id long, text string")
    found = L.find(docs, [L.Template("nobody", "all rights are kept by nobody", ("kept by nobody",))], []).first()
    assert [tuple(p) for p in found.places] == [("nobody", "template", 0, 5, 1.0)]
