"""The filter audit against a plain simulation of every order, and the scan against Python's own string functions."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from webstrata.llm import audit, scan

ODD = ["", " ", "\t\n", "A", "é É", "a\xa0b c", "x" * 5000, "Word " * 300, "a b a b", "日本 語 日本", "#1", "A&B|C", "\x0b\x0c\x1c\x85", "tab\tbed\nline", "\x00 \x00", "One two  three "]


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(re.findall(r"[#$%&*|]", text)), len(text)


def texts(rng, n):
    return [" ".join(rng.choice(["the", "The", "of", "é", "word", "x#", "12", "longer-word"]) + rng.choice(["", "", str(rng.randint(0, 30))]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("bits", [0, 2, 64])
def test_measures(monkeypatch, size, bits):
    """Pieces of any size, and word hashes so short that they collide."""
    rng = random.Random(size)
    rows = [*ODD, *texts(rng, 60), None, "a" * 300 + " " + "b c " * 200]
    whole, hashes = scan.pieces, scan.word_hashes
    monkeypatch.setattr(audit, "pieces", lambda d, a, letter: whole(d, a, letter, size))
    monkeypatch.setattr(audit, "word_hashes", lambda *x: hashes(*x) & np.uint64((1 << bits) - 1))
    for column in (pa.array(rows, pa.string()), pa.array(["skipped", *rows], pa.large_string())[1:]):
        m = audit.measures(column)
        assert list(zip(*(m[k].tolist() for k in ("words", "distinct", "capitals", "symbols", "points")), strict=True)) == [plain(t or "") for t in rows]


def test_pieces_hold_every_byte_once():
    rng = random.Random(3)
    for _ in range(50):
        rows = ["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 9, 200]))) for _ in range(rng.randint(0, 6))]
        data, at = scan.texts_of(pa.array(rows, pa.string()))
        got = list(scan.pieces(data, at, scan.BETWEEN_SPACE, rng.choice([1, 5, 50])))
        assert b"".join(p.data.tobytes() for p in got) == "".join(rows).encode()
        words = Counter((p.first + r, bytes(p.data[s:e]).decode()) for p in got for s, e, r in zip(*map(np.ndarray.tolist, p.words(scan.BETWEEN_SPACE)), strict=True))
        assert words == Counter((i, w) for i, t in enumerate(rows) for w in t.split())


def simulated(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        w, d, c, s, n = plain(text or "")
        fails = {"A": w < 200, "B": 100 * d < 50 * w, "C": 100 * c > 3 * n, "D": s > 0, "E": i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)}
        rows.append((lang or "", i, fails))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            everyone, gone = list(left), []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[2][f]]
                again = sum(r[2][f] for r in gone)
                left = [r for r in left if not r[2][f]]
                gone += here
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), again, sum(r[2][f] and sum(r[2].values()) == 1 for r in everyone), sum(r[1] in good for r in here), sum(r[1] in toxic for r in here)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_audit(spark):
    rng = random.Random(11)
    some = [*ODD, *texts(rng, 40)]
    docs = [(i, rng.choice(some), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(i, t, lang) for i, t, lang in docs[:10]]  # repeated rows
    docs += [(7, "another text of id 7", "en"), (None, some[3], "en"), (None, some[3], "de"), (None, None, None), (151, None, "fr"), (152, "", "fr")]
    docs += [(1000 + i, "Hot TEXT #1", "en") for i in range(200)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, mask string, part int").repartition(3)
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got.collect()} == simulated(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert audit.audit(one, labels).where("removed = 1").count() == 120
