import random

import numpy as np
import pytest
import xxhash

from webstrata.llm import simhash as S


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius, level in ((3, 0), (3, 1), (3, 2), (3, 3), (5, 0), (5, 1)):
        masks = S.covering_masks(radius, level)
        assert len(masks) == 2 ** (radius + 1) - 1 and min((m & (1 << 64) - 1).bit_count() for m in masks) >= 20
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, radius + 1)))
            assert any(m & d == 0 for m in masks)


def test_fingerprint():
    for t in ("", " \t", "One", "a b", "a B c", "Äb cd Éf gh", "x y z x y z x y z", "q\x0bw e\x1cr t" * 50, None):
        assert int.from_bytes(S.simhash(t.encode() if t is not None else None), "big") == plain(t)


def components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [1024, 8])
def test_components_match_all_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(150)] + [rng.getrandbits(64) for _ in range(50)] + [0, 0, 7]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    monkeypatch.setattr(S, "fingerprints", lambda docs, width: docs.select("doc_id", "fp"))
    got = S.near_duplicates(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()
    want = components(dict(enumerate(values)))
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{v:016x}" for i, v in enumerate(values)}


def test_odd_rows(spark):
    rows = [(5, None, "a"), (6, "", "a"), (7, " ", None), (8, "one two three four", "x"), (9, "ONE  two\nthree four", "x"), (9, "ONE  two\nthree four", "x"), (10, "w " * 50000, "")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (9, 8), (10, 10)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_are_alike_and_originals_stay(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([30, 300]))
        for k in range(rng.choice([1, 1, 4])):
            own = list(base)
            for _ in range(k * len(base) // 300):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n := n + 1, " ".join(own)))
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = [r.doc_id for r in S.drop_copies(df).collect()]
    gone = {k for k, _ in rows} - set(stay)
    rolling = S.Rolling(S.BASES[0])
    sets = {k: S.shingle_set((t or "").encode(), 5, rolling) for k, t in rows}
    near = lambda a, b: S.jaccard(sets[a], sets[b]) >= 0.8
    assert 502 in gone and 501 in gone and 500 not in gone
    assert all(any(near(k, o) for o in sets if o not in gone and o < k) for k in gone)
    alike = [k for k in sets if any(o < k and near(k, o) for o in sets)]
    assert len([k for k in alike if k not in gone]) <= 0.1 * len(alike)
    assert len(stay) == len(set(stay)) and S.drop_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("batch", [16 << 20, 20_000])
def test_no_copy_of_a_large_family_stays(spark, monkeypatch, batch):
    monkeypatch.setattr(S, "BATCH", batch, raising=False)
    rng = random.Random(8)
    base, rows = [f"w{rng.randrange(9999)}" for _ in range(300)], []
    for k in range(30):  # each edited in ten places, most of them under 0.8 to each other
        own = list(base)
        for i in rng.sample(range(300), 10):
            own[i] = f"x{k}y{i}"
        rows += [(n, " ".join(own[: 300 - 2 * (n - 4 * k)])) for n in range(4 * k, 4 * k + 3)] + [(4 * k + 3, " ".join(own))]
    for k in range(120, 200, 2):  # edited so often that word pairs differ in many bits
        own = [f"v{rng.randrange(9999)}" for _ in range(60)]
        rows += [(k, " ".join(own)), (k + 1, " ".join([*own[:30], "new", *own[30:], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stay = [r.doc_id for r in S.drop_copies(df).collect()]
    gone = {k for k, _ in rows} - set(stay)
    rolling = S.Rolling(S.BASES[0])
    sets = {k: S.shingle_set(t.encode(), 5, rolling) for k, t in rows}
    stay, want = sorted(set(sets) - gone), []
    for k in sorted(sets):
        if not any(S.jaccard(sets[k], sets[o]) >= 0.8 for o in want):
            want.append(k)
    near = lambda k, o: S.jaccard(sets[k], sets[o]) >= 0.8
    assert len(stay) > 60 and not any(near(k, o) for k in stay for o in stay if o < k)
    assert all(any(near(k, o) for o in stay) for k in gone)
    assert batch < 1 << 20 or stay == want


def test_rows_go_for_their_texts_only(spark):
    """Rows that share an id or have none; columns of any name."""
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(7)]
    rows = [(None, t) for t in texts[:5]] + [(7, t) for t in texts[5:]]
    schema = "doc_id long, text string, digest int, fp int, node int, root int, gone int, count int, least_id int, `_h` int"
    df = spark.createDataFrame([(*r, *[n] * 8) for n, r in enumerate(rows)], schema)
    assert S.drop_copies(df).count() == 7 and S.drop_copies(df).columns == df.columns
    # of copies, the row of the least id; of rows equal in id and text, one
    more = spark.createDataFrame([(*r, *[50 + n] * 8) for n, r in enumerate([(3, texts[0]), (3, texts[0]), (None, texts[1]), (None, None), (9, "")])], schema)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in S.drop_copies(df.unionByName(more)).collect())
    assert got == sorted([(False, 3, texts[0]), *[(True, 0, t) for t in texts[1:5]], (False, 7, texts[5]), (False, 7, texts[6]), (False, 9, "")])


def test_buckets_of_the_last_level_are_small():
    """Whatever masks a bucket was dealt by, few positions are kept by none of them, so few fingerprints can share it."""
    kept = np.zeros(1, np.uint64)
    for level in range(S.LEVELS):
        masks = np.array([m & (1 << 64) - 1 for m in S.covering_masks(S.RADIUS, level)], np.uint64)
        kept = (kept[:, None] | masks[None, :]).ravel()
    free = 64 - np.bitwise_count(kept)
    assert free.max() <= 13
