"""Language identification by a linear-chain conditional random field over words.

A word's emission score adds the weights of its affixes, n-grams and lexicon entry; learned transitions tie
neighbouring words together, and forward-backward gives each word a distribution over languages, also in text that
switches between them. A document's language is the one with the most probability over its words that have letters;
its score is that share. Words over LONGEST bytes, such as text without blanks, are cut into runs, each a word of its own.

The model is fitted on FIT_DOCS labelled documents at most (more only where that many languages need one each), split
evenly between languages and chosen by a hash of their id and text. A text's words are cut into sequences of SEQUENCE, of
which FIT_RUNS, evenly placed over all of it, are learned from; all of every text is tagged. Some sequences switch language
half-way, so that transitions are learned rather than assumed. Weights live in a hashed table of half a megabyte a
language, so the broadcast model does not grow with the rows.

Null text and text without a letter are `und` with score 0; with no labelled rows every text is; languages that tie go by
their names' order; very long texts are tagged whole; empty tables give empty results; repeated rows give one row each;
rows of null id are not held out; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, claim, crc_mod, cut, hashed_sample

FIT_DOCS, FIT_RUNS, SEQUENCE, TABLE, PASSES = 1600, 48, 40, 1 << 17, 3
LETTER = re.compile(r"[^\W\d_]")


STRIP = b".,;:!?\"'()[]{}<>|#*$%&-_"
WIDTHS, PRIME, SPREAD = (6, 10, 16, 32), np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
LONGEST = WIDTHS[-1]


def core(word: bytes) -> bytes:
    """What of a word gives features: in lower case, without marks around it; empty if no letter is left."""
    w = word.lower().strip(STRIP)
    return w if w.isalpha() or LETTER.search(w.decode("utf-8", "replace")) else b""


def split_words(text: bytes) -> list[bytes]:
    """The words of a text; longer ones than LONGEST are cut, between characters, into runs of at most LONGEST bytes."""
    words = text.split()
    if not words or len(max(words, key=len)) <= LONGEST:
        return words
    out = []
    for w in words:
        at = 0
        while len(w) - at > LONGEST:
            end = at + LONGEST
            while end > at + LONGEST - 3 and w[end] & 0xC0 == 0x80:
                end -= 1
            out.append(w[at:end])
            at = end
        out.append(w[at:])
    return out


def features(words: list[bytes], width: int) -> np.ndarray:
    """Table positions (len(words), F) of the features of words of 1 to `width` bytes: the word itself, affixes of 1 to 4 bytes, n-grams of 1 to 3 bytes. TABLE stands for none."""
    n = np.array([min(len(w), width) for w in words], "i8")[:, None]
    raw = np.frombuffer(b"".join(w[:width].ljust(width + 4, b"\0") for w in words), np.uint8).reshape(-1, width + 4).astype("u8") + np.uint64(1)
    at = np.arange(width)[None, :]
    columns, run = [], np.zeros((len(words), width), "u8")
    place = lambda h, kind: (((h * PRIME + np.uint64(kind)) * SPREAD) >> np.uint64(47)).astype("i8")  # noqa: E731  17 bits
    rows = np.arange(len(words))
    for k in range(1, 5):
        run = run * PRIME + raw[:, k - 1 : width + k - 1]  # the k bytes from each place on
        if k < 4:
            columns.append(np.where(at + k <= n, place(run, k), TABLE))
        fits = n[:, 0] >= k
        columns.append(np.where(fits, place(run[:, 0], 10 + k), TABLE)[:, None])
        columns.append(np.where(fits, place(run[rows, np.maximum(n[:, 0] - k, 0)], 20 + k), TABLE)[:, None])
    whole = np.zeros(len(words), "u8")
    for i in range(width):
        whole = np.where(i < n[:, 0], whole * PRIME + raw[:, i], whole)
    columns.append(place(whole, 30)[:, None])
    return np.concatenate(columns, axis=1)


def by_width(words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers and features of the non-empty words, in groups of about equal width."""
    size, low = np.array([len(w) for w in words], "i8"), 0
    for width in WIDTHS:
        where = np.flatnonzero((size > low) & ((size <= width) | (width == WIDTHS[-1]))).tolist()
        for i in range(0, len(where), 4096):
            part = where[i : i + 4096]
            yield part, features([words[k] for k in part], width)
        low = width


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, expect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of padded sequences (B, T, L) and the summed expected transitions (L, L); sequences are sorted longest first."""
    b, t, n = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    m = np.exp(transition - transition.max())
    live = np.searchsorted(-lengths, -np.arange(t), side="left")  # sequences longer than each position
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((b, t))
    for i in range(t):
        k = live[i]
        a = e[:k, 0] / n if i == 0 else (alpha[:k, i - 1] @ m) * e[:k, i]
        scale[:k, i] = s = a.sum(axis=1)
        alpha[:k, i] = a / s[:, None]
    for i in range(t - 2, -1, -1):
        k = live[i + 1]
        beta[:k, i] = (beta[:k, i + 1] * e[:k, i + 1] / scale[:k, i + 1, None]) @ m.T
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(axis=2, keepdims=True), 1e-300)
    if t > 1 and expect:
        mask = (np.arange(1, t)[None, :] < lengths[:, None])[..., None]
        right = beta[:, 1:] * e[:, 1:] / scale[:, 1:, None] * mask
        pairs = np.einsum("bti,btj->ij", alpha[:, :-1], right) * m
    else:
        pairs = np.zeros_like(m)
    return marginal, pairs


class Tagger:
    """A fitted model: hashed emission weights (TABLE + 1, L; the last row is zero) and transitions (L, L)."""

    def __init__(self, langs: list[str], weights: np.ndarray, transition: np.ndarray):
        self.langs, self.weights, self.transition = langs, weights, transition
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: list[bytes]) -> None:
        """Keep the emissions of these words, and whether each has a letter, in a bounded memo."""
        if len(self.known) + len(words) > 300_000:
            self.known.clear()
        cores = [core(w) for w in words]
        out = np.zeros((len(words), len(self.langs) + 1), "f4")
        for where, index in by_width(cores):
            out[where, :-1] = self.weights[index].sum(axis=1)
            out[where, -1] = 1
        data, size = out.tobytes(), out.shape[1] * 4
        self.known.update(zip(words, [data[i : i + size] for i in range(0, len(data), size)], strict=True))

    def emissions(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [split_words(t or b"") for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        new = {w for words, got in zip(split, found, strict=True) if None in got for w, x in zip(words, got, strict=True) if x is None}
        if new:
            self.learn(list(new))
        known, out = self.known, []
        for words, got in zip(split, found, strict=True):
            data = b"".join([known[w] if x is None else x for w, x in zip(words, got, strict=True)] if None in got else got)
            out.append(np.frombuffer(data, "f4").reshape(-1, len(self.langs) + 1))
        return out

    def __getstate__(self):
        return self.langs, self.weights, self.transition

    def __setstate__(self, state):
        self.__init__(*state)

    def tag(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language and score of each whole text."""
        return [x for i in range(0, len(texts), 512) for x in self.tag_some(texts[i : i + 512])]

    def tag_some(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        width = len(self.langs) + 1
        data = [x for i in range(0, len(texts), 128) for x in self.emissions(texts[i : i + 128])]
        order = sorted(range(len(texts)), key=lambda i: -len(data[i]))
        at = 0
        while at < len(order) and len(data[order[at]]):
            longest = len(data[order[at]])
            group = order[at : at + max(1, min(512, 150_000 // longest))]
            at += len(group)
            lengths = np.array([len(data[i]) for i in group])
            if not lengths[-1]:
                group, lengths = group[: int((lengths > 0).sum())], lengths[lengths > 0]
            e = np.zeros((len(group), longest, width), "f8")
            for k, i in enumerate(group):
                e[k, : len(data[i])] = data[i]
            marginal, _ = forward_backward(e[..., :-1], lengths, self.transition, expect=False)
            share = (marginal * e[..., -1:]).sum(axis=1)
            counted = share.sum(axis=1)
            for k, i in enumerate(group):
                if counted[k] > 0:
                    best = int(share[k].argmax())
                    out[i] = (self.langs[best], float(share[k, best] / counted[k]))
        return out


def fit(rows: list[tuple[bytes, str]], seed: int = 0) -> Tagger:
    """A tagger from (text, language) rows by stochastic gradient ascent on the chains' log-likelihood."""
    rng = random.Random(seed)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Tagger([], np.zeros((TABLE + 1, 0)), np.zeros((0, 0)))
    n, place = len(langs), {lang: k for k, lang in enumerate(langs)}
    runs: dict[int, list] = defaultdict(list)
    for text, lang in rows:
        words = split_words(text)
        runs[place[lang]] += [words[i : i + SEQUENCE] for i in range(0, len(words), SEQUENCE)]
    chains = []
    for k, own in runs.items():
        for run in own:
            other = rng.choice(list(runs)) if rng.random() < 0.3 else k
            tail = rng.choice(runs[other])[: SEQUENCE // 2] if other != k else []
            head = run[: SEQUENCE // 2] if tail else run
            if head:
                chains.append(([*head, *tail], [k] * len(head) + [other] * len(tail)))
    names = sorted({w for words, _ in chains for w in words})
    memo: dict[bytes, np.ndarray] = dict.fromkeys(names, np.zeros(0, "i8"))
    for where, index in by_width([core(w) for w in names]):
        memo.update((names[k], x[x < TABLE]) for k, x in zip(where, index, strict=True))
    weights, transition = np.zeros((TABLE + 1, n)), np.zeros((n, n))
    g_w, g_t = np.full((TABLE + 1, n), 1e-2), np.full((n, n), 1e-2)
    for _ in range(PASSES):
        rng.shuffle(chains)
        for at in range(0, len(chains), 64):
            part = sorted(chains[at : at + 64], key=lambda c: -len(c[0]))
            lengths = np.array([len(w) for w, _ in part])
            flat = [memo[w] for words, _ in part for w in words]
            size = np.array([len(f) for f in flat])
            index = np.concatenate(flat)
            owner = np.repeat(np.arange(len(flat)), size)
            score = np.zeros((len(flat), n))
            for k in range(n):
                score[:, k] = np.bincount(owner, weights=weights[index, k], minlength=len(flat))
            mask = np.arange(lengths[0])[None, :] < lengths[:, None]
            e = np.zeros((*mask.shape, n))
            e[mask] = score
            marginal, pairs = forward_backward(e, lengths, transition)
            gold = np.array([y for _, ys in part for y in ys])
            error = -marginal[mask]
            error[np.arange(len(gold)), gold] += 1
            seen = np.zeros((n, n))
            for _, ys in part:
                np.add.at(seen, (ys[:-1], ys[1:]), 1)
            touched, back = np.unique(index, return_inverse=True)
            grad = np.stack([np.bincount(back, weights=error[owner, k], minlength=len(touched)) for k in range(n)], axis=1)
            g_w[touched] += grad**2
            weights[touched] += 0.3 * grad / np.sqrt(g_w[touched])
            step = seen - pairs
            g_t += step**2
            transition += 0.1 * step / np.sqrt(g_t)
    return Tagger(langs, weights.astype("f4"), transition)


def some_runs(text: bytes) -> list[bytes]:
    """At most FIT_RUNS runs of SEQUENCE words, evenly placed over a text; all of them if there are no more."""
    words = split_words(text)
    at = np.arange(0, len(words), SEQUENCE)
    if len(at) > FIT_RUNS:
        at = at[np.linspace(0, len(at) - 1, FIT_RUNS).astype(int)]
    return [b" ".join(words[i : i + SEQUENCE]) for i in at.tolist()]


def fitted(docs: DataFrame, learn: Column, limit: int = FIT_DOCS) -> Tagger:
    """Fit on about `limit` rows of docs (doc_id, text, lang) for which `learn` holds, as many of each language as can be and one at least."""
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    picked = hashed_sample(rows, "lang", "doc_id", "text", total=limit)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [(r, lang) for t, lang in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True) for r in some_runs(t)]
            yield pa.record_batch([pa.array([r for r, _ in runs], pa.binary()), pa.array([x for _, x in runs], pa.string())], names=["run", "lang"])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [pair for b in tables for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = fit(sorted(data))
        yield pa.record_batch([pa.array([model.langs]), pa.array([model.weights.tobytes()]), pa.array([model.transition.tobytes()])], names=["langs", "weights", "transition"])

    sample = cut(picked.select("text", "lang").mapInArrow(shorten, "run binary, lang string"))
    row = sample.coalesce(1).mapInArrow(run, "langs array<string>, weights binary, transition binary").first()
    if row is None:
        return fit([])
    n = len(row["langs"])
    return Tagger(list(row["langs"]), np.frombuffer(row["weights"], "f4").reshape(TABLE + 1, n), np.frombuffer(row["transition"], "f8").reshape(n, n))


def predict(docs: DataFrame, model: Tagger, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score; no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # TABLE x languages weights, whatever the data's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(shared.value.known)
        for batch in batches:
            got = shared.value.tag(as_bytes(batch.column(batch.num_columns - 1)))
            cols = [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.record_batch(cols, names=[*names, "lang_pred", "score"])

    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double").select(*[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rows that are not held out."""
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = fitted(docs, ~held_out)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
