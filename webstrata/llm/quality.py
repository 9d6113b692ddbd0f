"""Document quality by naive Bayes support vectors.

Features are indicators of n-grams: of 1 to 4 bytes, of one and two words, and of word bigrams and trigrams that repeat
a word, in a hashed table. Each indicator is scaled by its class log-count ratio, a document's vector has length one, and
a linear hinge-loss model is fitted to the vectors by dual coordinate descent. A logistic curve, fitted on rows that the
descent did not see, turns margins into scores.

It is fitted on at most FIT_ROWS labelled documents a class, chosen by a hash of doc_id and text. Whole texts become sets of
table positions where they lie; the one task that fits gets these, of 16 KB a text at most. The model is a table of fixed
size.

Null text counts as empty; texts without n-grams get the score of the bias alone; without labelled rows of both classes
every score is the share of label 1 (or one half); a score of the threshold counts as 1; texts of any length are read
whole; an empty table gives an empty result; repeated rows give one row each; rows of null id are not held out; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, crc_mod, cut, labelled

FIT_ROWS, BITS, COST, SWEEPS = 2500, 17, 4.0, 8
P1, P2, P3 = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


POWERS: list[np.ndarray] = [np.empty(0, "u8")] * 2


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, n at least."""
    if n > len(POWERS[0]):
        POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(2 * n, np.uint64(p))], dtype="u8") for p in (int(P3), pow(int(P3), -1, 1 << 64))]
    return POWERS


def ngrams(text: bytes) -> np.ndarray:
    """Table positions of a text's n-grams, with repeats."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, "i8")
    place = lambda h, kind: (((h + np.uint64(kind)) * P2) >> np.uint64(64 - BITS)).astype("i8")
    x = raw.astype("u8") + np.uint64(1)
    out, run = [], x
    for n in range(1, 5):
        if n > 1:
            if len(run) < 2:
                break
            run = run[:-1] * P1 + x[n - 1 :]
        out.append(place(run * P3, n))
    inside = ~BLANKS[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if len(starts):
        ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
        mixed = (x * P3 ^ (x * P3 >> np.uint64(29))) * P2  # a value of each byte
        # a polynomial of the bytes' values, from prefix sums, so that equal words have equal hashes wherever they stand
        up, down = powers(len(x))
        total = np.r_[np.uint64(0), np.cumsum(mixed * up[: len(x)], dtype="u8")]
        word = (total[ends] - total[starts]) * down[starts]
        word ^= word >> np.uint64(32)
        out.append(place(word * P3, 11))
        if len(word) > 1:
            out.append(place((word[:-1] * P1 + word[1:]) * P3, 12))
            same = word[:-1] == word[1:]
            if same.any():
                out.append(place(np.array([1], "u8") * P3, 13))
                if (same[:-1] & same[1:]).any():
                    out.append(place(np.array([2], "u8") * P3, 13))
    return np.concatenate(out)


@dataclass
class Model:
    """`pull` holds, for each position, its weight times its ratio (real) and its squared ratio (imaginary)."""

    pull: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        board, out = np.zeros(len(self.pull), "c8"), np.empty(len(texts))
        for k, t in enumerate(texts):
            at = ngrams(t or b"")
            board[at] = self.pull[at]  # repeats write the same value: an indicator
            s = board.sum(dtype="c16")
            board[at] = 0
            out[k] = s.real / np.sqrt(max(s.imag, 1e-12)) + self.bias
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def descend(rows: Vectors | list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, sweeps: int = SWEEPS, seed: int = 0) -> np.ndarray:
    """Weights of a linear model with hinge loss, by dual coordinate descent; the last weight is the bias."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in map(rows.__getitem__, range(len(rows)))])
    for _ in range(sweeps):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[size]) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                alpha[i] = new
                w[at] += step * y[i] * v
                w[size] += step * y[i]
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return w


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve that makes margins m into probabilities of y = 1, by Newton's method with smoothed targets."""
    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ m + 1e-3 * a, d.sum()])
        hess = np.array([[h @ (m * m) + 1e-3, h @ m], [h @ m, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def shut(at: np.ndarray) -> bytes:
    """A set of table positions: as numbers or, where that is shorter, as one bit a position."""
    if len(at) <= 1 << (BITS - 5):
        return b"n" + at.astype("<u4").tobytes()
    bits = np.zeros(1 << BITS, bool)
    bits[at] = True
    return b"b" + np.packbits(bits).tobytes()


def opened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4", offset=1).astype("i8") if data[:1] == b"n" else np.flatnonzero(np.unpackbits(np.frombuffer(data, "u1", offset=1)))


class Vectors:
    """Unit vectors of shut sets, scaled by the ratio and made when asked for, so that memory holds the sets alone."""

    def __init__(self, sets: list[bytes], ratio: np.ndarray):
        self.sets, self.ratio = sets, ratio

    def __len__(self) -> int:
        return len(self.sets)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = opened(self.sets[i])
        v = self.ratio[at]
        return at, v / np.sqrt(max(float(v @ v), 1e-12))


def fit(sets: list[bytes], y: np.ndarray, weight: np.ndarray) -> Model:
    """The model of shut sets of positions, their labels and weights."""
    size = 1 << BITS
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(y[0] * 0.98 + 0.01)
        return Model(np.zeros(size, "c8"), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.ones((2, size))
    for s, k in zip(sets, y, strict=True):
        counts[k, opened(s)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = Vectors(sets, ratio)
    signs = np.where(y == 1, 1.0, -1.0)
    balance = len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1)
    cost = COST * balance[y]
    probe = np.arange(len(y)) % 4 == 0  # every fourth row is kept for the curve
    part = np.flatnonzero(~probe)
    w = descend(Vectors([sets[i] for i in part], ratio), signs[part], cost[part], size)
    m = np.array([w[at] @ v + w[size] for at, v in map(rows.__getitem__, np.flatnonzero(probe).tolist())])
    slope, shift = logistic(m, y[probe], weight[probe])
    return Model((w[:size] * ratio + 1j * ratio**2).astype("c8"), float(w[size]), slope, shift)


def fitted(sample: DataFrame) -> Model:
    """The model of a bounded sample (text, y, weight), fitted in one task on the texts' sets of positions; only its weights come back."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([shut(np.unique(ngrams(t))) for t in as_bytes(b.column(0))], pa.binary()), b.column(1), b.column(2)], names=["positions", "y", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted(row for b in batches for row in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True))
        order = np.random.default_rng(1).permutation(len(data))
        m = fit([data[i][0] for i in order], np.array([data[i][1] for i in order], "i8"), np.array([data[i][2] for i in order]))
        yield pa.record_batch([pa.array([m.pull.tobytes()]), pa.array([[m.bias, m.slope, m.shift]])], names=["pull", "rest"])

    sets = cut(sample.select("text", "y", "weight").mapInArrow(shorten, "positions binary, y int, weight double"))
    row = sets.coalesce(1).mapInArrow(run, "pull binary, rest array<double>").first()
    return Model(np.frombuffer(row["pull"], "c8"), *row["rest"]) if row else fit([], np.empty(0, "i8"), np.empty(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text; no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.scores(as_bytes(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted; learned from labelled rows that are not held out."""
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fitted(labelled(docs, labels, "quality", ~held_out, FIT_ROWS))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
