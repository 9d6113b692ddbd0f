"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are all words of the examples, in lower case and without marks around them; words that no example has match nothing.
Inverse document frequencies are counted over all documents. Plain TF-IDF can't tell the classes where texts share most
words, so a term's weight also has a factor z^2 / (z^2 + SHRINK), where z tells how much its document frequencies differ
between the classes: no term is left out, but those that say nothing about the label weigh little.

Examples lie in an inverted index of blocks of BLOCK examples. Terms of few examples have plain postings, which every query
reads whole; terms of many examples have, for each block, their weights and the greatest of them. A query's cosines with
the first kind and the maxima of the second bound what each block can reach. The most promising blocks are completed first;
then all blocks that can still reach the K-th best cosine, so the K nearest are exact. Their labels vote by cosine; a
logistic curve, fitted on the examples' own leave-one-out votes, makes votes into calibrated scores. The nearest examples
come along as evidence.

At most FIT_ROWS labelled documents a class are examples, chosen by a hash of doc_id and text; all of every text is used.

Null text counts as empty; a text without a known term is voted on by the examples that have none either; examples of one
cosine go by their class, leading term and text; without examples of both classes every score is their share of label 1
(zero without any); very long texts count by all their words; an empty table gives an empty result; repeated rows give one
row each; rows of null id are scored and not held out; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, claim, crc_mod, cut, labelled
from .langid import STRIP
from .quality import logistic

FIT_ROWS, SHRINK, BLOCK, K, MANY, GROUP = 2500, 64.0, 64, 15, 150, 64


def term_of(word: bytes) -> bytes:
    return word.lower().strip(STRIP)


class Terms:
    """Numbers and counts of a text's known terms; what each word stands for is kept in a bounded memo."""

    def __init__(self, words: list[bytes]):
        self.number = {w: i for i, w in enumerate(words)}
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words, known = text.split(), self.known
        got = list(map(known.get, words))
        if None in got:
            if len(known) > 600_000:
                known.clear()
            number = self.number
            for w, x in zip(words, got, strict=True):
                if x is None:
                    known[w] = number.get(term_of(w), -1)
            got = [known[w] if x is None else x for w, x in zip(words, got, strict=True)]
        at, n = np.unique(np.array(got, "i4"), return_counts=True)
        return (at[1:], n[1:]) if len(at) and at[0] < 0 else (at, n)


def class_factor(df: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How much of a term's weight counts: z^2 / (z^2 + SHRINK) for the z of two proportions. df is (2, terms), n the examples of each class."""
    n = np.maximum(n, 1).astype("f8")
    share = df.sum(axis=0) / n.sum()
    z2 = (df[1] / n[1] - df[0] / n[0]) ** 2 / (share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12)
    return z2 / (z2 + SHRINK)


@dataclass
class Index:
    """The examples by term and block."""

    terms: list[bytes]
    weight_of: np.ndarray  # of each term
    y: np.ndarray
    weight: np.ndarray
    ids: list
    empty: float  # the vote for texts without a term
    slope: float = 1.0
    shift: float = 0.0
    first: np.ndarray = field(default=None, repr=False)  # term: where its postings begin
    whom: np.ndarray = field(default=None, repr=False)  # postings: example
    much: np.ndarray = field(default=None, repr=False)  # postings: weight
    row: np.ndarray = field(default=None, repr=False)  # term: row of `dense`, -1 if it has few examples
    dense: np.ndarray = field(default=None, repr=False)  # (block, term of many examples, place in the block): weight
    most: np.ndarray = field(default=None, repr=False)  # (term of many examples, block): greatest weight
    counts: Terms = field(default=None, repr=False)

    def __getstate__(self):
        """The postings alone: blocks are laid out again where the index is used."""
        return self.__dict__ | {"counts": None, "row": None, "dense": None, "most": None, "terms": b"\n".join(self.terms)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.terms = self.terms.split(b"\n") if len(self.first) > 1 else []
        self.lay_out()

    def lay_out(self) -> None:
        blocks, size = max(1, -(-len(self.y) // BLOCK)), np.diff(self.first)
        many = np.flatnonzero(size > MANY)
        self.row = np.full(len(size), -1, "i4")
        self.row[many] = np.arange(len(many))
        self.dense = np.zeros((blocks, len(many), BLOCK))
        for r, t in enumerate(many.tolist()):
            own = slice(self.first[t], self.first[t + 1])
            self.dense[self.whom[own] // BLOCK, r, self.whom[own] % BLOCK] = self.much[own]
        self.most = self.dense.max(axis=2).T.copy()

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if self.counts is None:
            self.counts = Terms(self.terms)
        at, n = self.counts(text)
        v = (1 + np.log(n)) * self.weight_of[at] if len(at) else np.empty(0)
        size = np.sqrt(v @ v) if len(v) else 0.0
        return (at, v / size) if size > 0 else (at[:0], v[:0])

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each vector, numbers (-1 if none) and cosines of the K nearest examples with a cosine above 0, ties by number; exact."""
        n, blocks = len(vectors), self.most.shape[1]
        at = np.concatenate([a for a, _ in vectors]) if n else np.empty(0, "i4")
        v = np.concatenate([x for _, x in vectors]) if n else np.empty(0)
        who = np.repeat(np.arange(n), [len(a) for a, _ in vectors])
        rare = self.row[at] < 0
        size = (self.first[at + 1] - self.first[at])[rare]
        posting = np.repeat(self.first[at][rare] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(who[rare], size) * (blocks * BLOCK) + self.whom[posting]
        s = np.bincount(cell, weights=np.repeat(v[rare], size) * self.much[posting], minlength=n * blocks * BLOCK).astype("f8").reshape(n, blocks, BLOCK)
        common = np.zeros((n, len(self.most)))
        common[who[~rare], self.row[at[~rare]]] = v[~rare]
        bound = s.max(axis=2) + common @ self.most
        done = np.zeros((n, blocks), bool)

        def complete(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                asks = np.flatnonzero(wanted[:, b])
                s[asks, b] += common[asks] @ self.dense[b]
            done[wanted] = True

        lead = np.argpartition(-bound, min(1, blocks - 1), axis=1)[:, :2]
        some = np.zeros((n, blocks), bool)
        some[np.arange(n)[:, None], lead] = True
        complete(some & (bound > 0))
        if skip is not None:
            s[np.arange(n), skip // BLOCK, skip % BLOCK] = -np.inf
        full = np.where(done[:, :, None], s, 0.0).reshape(n, -1)
        k = min(K, full.shape[1])
        kth = -np.partition(-full, k - 1, axis=1)[:, k - 1]
        complete(~done & (bound > 0) & (bound >= kth[:, None] - 1e-9))
        full = np.where(done[:, :, None], s, 0.0).reshape(n, -1).round(9)
        kth = -np.partition(-full, k - 1, axis=1)[:, k - 1]
        best, sims = np.full((n, K), -1), np.zeros((n, K))
        for i in range(n):
            near = np.flatnonzero((full[i] >= kth[i]) & (full[i] > 0))
            near = near[np.lexsort((near, -full[i, near]))[:K]]
            best[i, : len(near)], sims[i, : len(near)] = near, full[i, near]
        return best, sims

    def vote(self, best: np.ndarray, sims: np.ndarray) -> np.ndarray:
        w = np.where(best >= 0, sims**4 * self.weight[best], 0.0) if len(self.weight) else np.zeros(sims.shape)
        prior = 0.01  # a weak vote for the rest, so that far examples alone don't decide
        y = self.y[best] if len(self.y) else np.zeros(sims.shape)
        return ((w * y).sum(axis=1) + prior * self.empty) / (w.sum(axis=1) + prior)

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple]]]:
        votes, evidence = np.empty(len(texts)), []
        for i in range(0, len(texts), GROUP):
            best, sims = self.nearest([self.vector(t or b"") for t in texts[i : i + GROUP]])
            votes[i : i + GROUP] = self.vote(best, sims)
            evidence += [[(self.ids[b], float(s), int(self.y[b])) for b, s in zip(*row, strict=True) if b >= 0] for row in zip(best[:, :3].tolist(), sims[:, :3].tolist(), strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.slope * votes + self.shift, -30, 30))), evidence


def build(words: list[bytes], idf: np.ndarray, data: list[tuple]) -> Index:
    """The index of examples (text or its (terms, counts), y, weight, id), its votes calibrated by leaving each example out."""
    index = Index(words, idf, np.empty(0), np.empty(0), [], 0.0)
    index.counts = Terms(words)
    counted = [d[0] if isinstance(d[0], tuple) else index.counts(d[0]) for d in data]
    y = np.array([d[1] for d in data], "i8")
    df = np.zeros((2, len(words)))
    for (at, _), k in zip(counted, y, strict=True):
        df[k, at] += 1
    both = len(y) > 0 and 0 < y.sum() < len(y)
    index.weight_of = idf * class_factor(df, np.bincount(y, minlength=2)) if both else np.asarray(idf, "f8")
    vectors = []
    for at, n in counted:
        v = (1 + np.log(n)) * index.weight_of[at]
        size = np.sqrt(v @ v) if len(v) else 0.0
        vectors.append((at, v / size) if size > 0 else (at[:0], v[:0]))
    # like examples next to each other make blocks' maxima tight
    order = sorted(range(len(data)), key=lambda i: (y[i], int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, i))
    data, vectors, y = [data[i] for i in order], [vectors[i] for i in order], y[order]
    index.y, index.weight, index.ids = y.astype("f8"), np.array([d[2] for d in data], "f8"), [d[3] for d in data]
    none = np.array([not len(at) for at, _ in vectors], bool)
    share = index.weight[none]
    index.empty = float((share @ index.y[none] + 0.5 * (index.weight @ index.y / max(index.weight.sum(), 1e-9))) / (share.sum() + 0.5)) if len(data) else 0.0
    term = np.concatenate([at for at, _ in vectors]).astype("i8") if vectors else np.empty(0, "i8")
    much = np.concatenate([v for _, v in vectors]) if vectors else np.empty(0)
    whom = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
    order = np.argsort(term, kind="stable")
    index.whom, index.much = whom[order].astype("i4"), much[order]
    index.first = np.r_[0, np.cumsum(np.bincount(term, minlength=len(words)))].astype("i8")
    index.lay_out()
    if both:
        votes = np.empty(len(data))
        for i in range(0, len(data), GROUP):
            votes[i : i + GROUP] = index.vote(*index.nearest(vectors[i : i + GROUP], np.arange(i, min(i + GROUP, len(data)))))
        index.slope, index.shift = logistic(votes, y, index.weight)
    else:
        share = float(np.clip(index.y.mean(), 0.001, 0.999)) if len(data) else 0.001
        index.slope, index.shift = 0.0, float(np.log(share / (1 - share)))
    return index


def frequencies(docs: DataFrame, words: list[bytes]) -> tuple[int, np.ndarray]:
    """Over all of docs: how many there are, and in how many each term is. A row a task is shuffled, and only sums come back."""
    shared = docs.sparkSession.sparkContext.broadcast(b"\n".join(words))  # the terms of a bounded number of examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.split(b"\n")
        counts, total, n = Terms(own), np.zeros(len(own), "i8"), 0
        claim(counts.known)
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                total[counts(t or b"")[0]] += 1
                n += 1
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.r_[-1, own], pa.int32()), pa.array(np.r_[n, total[own]], pa.int64())], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(len(words), "i8")
    df[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), df


def fitted(docs: DataFrame, sample: DataFrame) -> bytes:
    """The pickled index over a bounded sample (text, y, weight, doc_id) with the idf of docs. Texts are taken apart where they lie; one task
    gets their terms with counts."""

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(map(term_of, t.split())) for t in as_bytes(batch.column(0))]
            terms = [sorted(w for w in c if w) for c in counted]
            n = [[c[w] for w in t] for c, t in zip(counted, terms, strict=True)]
            yield pa.record_batch([pa.array(terms, pa.list_(pa.binary())), pa.array(n, pa.list_(pa.int32())), *batch.columns[1:]], names=["terms", "n", "y", "weight", "doc_id"])

    apart = cut(sample.select("text", "y", "weight", "doc_id").mapInArrow(take_apart, f"terms array<binary>, n array<int>, y int, weight double, doc_id {sample.schema['doc_id'].dataType.simpleString()}"))
    words = sorted(apart.select(F.explode("terms").alias("term")).distinct().toArrow()["term"].to_pylist())
    n, df = frequencies(docs, words)
    idf = np.log((n + 1) / (df + 1)) + 1
    shared = docs.sparkSession.sparkContext.broadcast((b"\n".join(words), idf))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        names, data = names.split(b"\n") if len(weights) else [], []
        number = {w: i for i, w in enumerate(names)}
        for b in batches:
            for terms, k, y, w, i in zip(*[b.column(c).to_pylist() for c in range(5)], strict=True):
                data.append(((np.array([number[t] for t in terms], "i4"), np.array(k, "i8")), y, w, i))
        data.sort(key=lambda d: (d[3], d[1], d[0][0].tolist()))
        yield pa.record_batch([pa.array([pickle.dumps(build(names, weights, data))], pa.binary())], names=["index"])

    row = apart.coalesce(1).mapInArrow(make, "index binary").first()
    return bytes(row["index"]) if row else pickle.dumps(build(words, idf, []))


@lru_cache(maxsize=1)
def unpickled(data: bytes) -> Index:
    """A worker lays the index out once, not once a task."""
    return pickle.loads(data)


def score(docs: DataFrame, index: bytes) -> DataFrame:
    """doc_id, score and evidence (the three nearest examples) of every whole text, by a pickled index; no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # 2 * FIT_ROWS examples at most
    rows = docs.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    nearest = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = unpickled(shared.value)
        own.counts = own.counts or Terms(own.terms)
        claim(own.counts.known)
        for batch in batches:
            scores, evidence = own.scores(as_bytes(batch.column(1)))
            near = pa.array([[{"doc_id": i, "cosine": s, "label": y} for i, s, y in e] for e in evidence], nearest)
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), near], names=["doc_id", "score", "evidence"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence; learned from labelled rows that are not held out."""
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    index = fitted(docs, labelled(docs, labels, "toxic", ~held_out, FIT_ROWS))
    return score(docs, index).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
