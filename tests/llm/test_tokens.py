import random

import pytest

from webstrata.llm.tokens import PairMerger, count_tokens, vocabulary_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def texts():
    rng = random.Random(7)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 3 + "ABCXYZ0123456789'.,!?-<|>éüßñΣσςİ日本語́  \u0085\x1c\x1f​😀"
    out = ["", "   ", "It's we'll I'd 'stuff ''s", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|endoftext|", "a" * 3000, "ababab" * 500, "ΑΣ ΑΣΑ", "é x", "1234567"]
    return out + ["".join(rng.choice(alphabet + " \n\t") for _ in range(rng.randrange(200))) for _ in range(400)]


def test_counts_match_the_library(library):
    one = PairMerger(vocabulary_path())
    for text in texts():
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert sum(map(one, text.encode().split())) == want, repr(text)


def test_defined_for_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "y"), (3, "hello world", "y"), (None, "word " * 3000, None)]
    out = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == [(0, 15000, 3000, True), (1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False)]
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_batches_match_the_library(library, monkeypatch):
    from webstrata.llm import bpe

    monkeypatch.setattr(bpe, "CHUNK", 500)
    encoder = bpe.BatchEncoder(vocabulary_path(), limit=300)
    import itertools

    anagrams = ["".join(p) for n in (3, 5, 6) for p in itertools.permutations("abtheo"[:n])] + ["abba", "baab", "onno", "noon"]
    all_texts = texts() + [" ".join(anagrams), ".".join(anagrams)] + [" ".join(["the", "Thtionha,", "loweiä"] * 30)]
    for k in range(0, len(all_texts), 50):
        part = all_texts[k : k + 50]
        for text, data in zip(part, encoder.encode([t.encode() for t in part]), strict=True):
            assert memoryview(data).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_known_in_any_case_and_before_any_sign(library):
    """Case and the signs after a word make no new words, but composition, special tokens and signs that are no letters are kept apart."""
    from webstrata.llm import bpe

    encoder = bpe.BatchEncoder(vocabulary_path())
    text = "étant ÉTANT Étant, étant. étant!! été ÉTÉ; word Word WORD, (word) word's WORD'S"
    odd = "H̱a ẖa á, Á, <|endoftext|> <|ENDOFTEXT|> x<|endoftext|>, a×, A÷. …! a…! İ, K K"
    for t in (text, odd, f"{text} {odd}"):
        assert memoryview(encoder.encode([t.encode()])[0]).cast("I").tolist() == library.encode(t, add_special_tokens=False).ids
    known = encoder.memo.n
    encoder.encode(["eTANT, ÉTANT# WORD. Word) été. ÉTÉ!!".encode()])
    assert encoder.memo.n == known + 2  # etant and #
