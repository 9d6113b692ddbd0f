import random
import zlib

import numpy as np

from webstrata.llm import packing as P
from webstrata.llm.tokens import vocabulary_path


def test_best_fit_takes_the_fullest_bin_with_room():
    bins, fill = [[0], [1]], [5, 7]
    P.best_fit([2, 3], [5, 7, 3, 9], 10, bins, fill)
    assert bins == [[0], [1, 2], [3]] and fill == [5, 10, 9]


def test_islands_give_whole_packings_no_worse_than_best_fit_decreasing():
    rng = random.Random(3)
    size = [rng.randrange(300, 1400) for _ in range(600)]
    order = sorted(range(600), key=lambda i: -size[i])
    plain, fill = [], []
    P.best_fit(order, size, 2048, plain, fill)
    best = P.evolve(size, 2048, 1, [plain], generations=60)
    assert sorted(i for g in best for i in g) == list(range(600))
    assert max(sum(size[i] for i in g) for g in best) <= 2048 and len(best) <= len(plain)
    assert sorted(map(sorted, P.from_bytes(P.to_bytes(best, 600)))) == sorted(map(sorted, best))


def test_pack_is_exact_and_gapless(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "BLOCK", 64)
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma<|endoftext|>x", "ñandú", "don't", "x" * 40]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 30, 200]))) for _ in range(150)] + [None, "", " \n", "same text"] + ["same text"] * 20
    rows = [(i if i < 160 else 7, t, "en", "s", 5) for i, t in enumerate(texts)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string, key string, block long"), capacity=256).collect()
    library = Tokenizer.from_file(vocabulary_path())
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k, s, len(x), zlib.crc32(x.tobytes())) for k, s in enumerate(range(0, len(ids), 256)) for x in [ids[s : s + 256]]]
    assert sorted(r[:5] for r in map(tuple, got)) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 256) + 4


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crossover_beats_best_fit_decreasing():
    """Sizes that fill bins only in threes: best fit decreasing needs more bins, which whole well-filled bins of the parents mend."""
    rng = random.Random(1)
    size = []
    for _ in range(30):
        a, b = rng.randrange(380, 490), rng.randrange(250, 300)
        size += [a, b, 1000 - a - b]
    order = sorted(range(len(size)), key=lambda i: -size[i])
    plain, fill = [], []
    P.best_fit(order, size, 1000, plain, fill)
    best = [P.evolve(size, 1000, seed, [plain], generations=400) for seed in (1, 2)]
    best = min((P.evolve(size, 1000, seed + 2, best, generations=400) for seed in (1, 2)), key=len)
    assert sorted(i for g in best for i in g) == list(range(90)) and max(sum(size[i] for i in g) for g in best) <= 1000
    assert 30 <= len(best) < len(plain), (len(best), len(plain))


def test_words_that_share_a_hash_keep_their_own_ids():
    """Thue-Morse words and their complements fall together under any polynomial hash modulo a power of two."""
    encode = P.encoder(vocabulary_path()).encode
    library = P.encoder(vocabulary_path()).by_library
    texts = []
    for n in (512, 1024, 2048):
        word = "".join("ab"[k.bit_count() % 2] for k in range(n))
        texts += [word, word.translate(str.maketrans("ab", "ba"))]
    texts += [" ".join(["one", *texts, "two", *texts[::-1]]), "three"]
    for _ in range(2):
        assert [bytes(x) for x in encode([t.encode() for t in texts])] == [library(t) for t in texts]


def test_a_packing_at_the_bound_is_not_searched_again():
    size = [600, 400] * 50
    best = [[2 * k, 2 * k + 1] for k in range(50)]
    assert P.evolve(size, 1000, 1, [[[i] for i in range(100)], best]) is best
