"""Exact substring deduplication with fixed-block anchors.

A window is `width` consecutive words of one text. Every text is cut into non-overlapping blocks of half a window; any
window holds at least one whole block. The blocks are the index, and every rolling run of a block's length, of every
text, probes it. A block that some other run equals is a hit. Hits are then extended: the windows that hold a hit block
are compared by a 96-bit hash of all their words, a window stays only at its first place in (doc_id, start) order, and
the runs of the others are the maximal exact repeats. Words that such a window covers are removed.

Probes travel as sorted hashes, packed by partition; only blocks carry their place. Within a task equal hashes are
merged first, so a passage that a third of all texts share sends one entry a task. Partitions are as many as the text
needs, and a task holds one of them. No pairs are ever made.

A document is an id with a text: rows that share an id, or have none, are told apart by their text's 64-bit hash, which
also orders them, so that a row loses only what stands in it. Rows equal in id and text are one document, and get the same
removals. Null ids are the earliest. Null text has no words; texts shorter than a window lose nothing; texts of any length
are read whole; an empty table gives an empty result; extra columns are ignored unless named in `keep`.

Windows are told apart by 96 bits, not by their words: of 10^13 windows, some 100 TB of text, two different ones of some
pair fall together with a probability of about 0.0006 by calculation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, claim

WIDTH, FLUSH, PART_BYTES = 20, 1_000_000, 12 << 20
U = np.uint64
#: Odd bases of the two rolling hashes, and their inverses modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of all runs of some number of words, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        make = lambda b: np.cumprod(np.r_[U(1), np.full(n, U(b))], dtype="u8")
        self.up, self.down = make(self.base), make(self.inverse)

    def __call__(self, words: np.ndarray, width: int) -> np.ndarray:
        n = len(words)
        if n >= len(self.up):
            self.grow(2 * n)
        total = np.r_[U(0), np.cumsum(words * self.up[:n], dtype="u8")]
        h = (total[width:] - total[:-width]) * self.down[: n - width + 1]
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(32))


def word_hashes(text: bytes | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, (text or b"").split())), ">u8").astype("u8")


def planes(x: np.ndarray) -> bytes:
    """An array by byte planes, which shuffle compression then shrinks."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def unplanes(data: list[bytes], kind: str, diff: bool = False) -> np.ndarray:
    size, out = np.dtype(kind).itemsize, []
    for d in data:
        if d:
            x = np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(size, -1).T).view(kind).ravel()
            out.append(np.cumsum(x, dtype=kind) if diff else x)
    return np.concatenate(out) if out else np.empty(0, kind)


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0)) if len(x) else x


def slices(part: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, n)))


PROBES = "part int, runs binary, hash binary, doc binary, tie binary, start binary, sure_doc binary, sure_tie binary, sure_start binary"


def places(docs: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places in order of reading, so that steps are mostly zero."""
    return planes(steps(docs)), planes(steps(ties)), planes(starts)


def read_places(group: pa.Table, prefix: str = "") -> list[np.ndarray]:
    docs, ties, starts = (group[prefix + c].to_pylist() for c in ("doc", "tie", "start"))
    return [unplanes(docs, "i8", diff=True), unplanes(ties, "i8", diff=True), unplanes(starts, "u4")]


def probe_rows(hashes: np.ndarray, docs: np.ndarray, ties: np.ndarray, starts: np.ndarray, block: int, n_parts: int) -> pa.RecordBatch:
    """The probes and blocks of one task's share, by partition. Blocks that repeat within it are sure hits and travel as such."""
    order = np.argsort(hashes, kind="stable")
    h, aligned = hashes[order], starts[order] % block == 0
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    many = np.diff(np.r_[first, len(h)]) > 1
    repeated = np.repeat(many, np.diff(np.r_[first, len(h)]))
    sure = np.array_split(np.sort(order[repeated & aligned]), n_parts)
    lone = np.zeros(len(h), bool)
    lone[first[~many]] = True
    blocks, runs = order[lone & aligned], order[first[many | ~aligned[first]]]
    part_of = lambda i: (hashes[i] % U(n_parts)).astype("i4")
    local = lambda i: (hashes[i] >> U(32)).astype("u4")
    names = ["part", "runs", "hash", "doc", "tie", "start", "sure_doc", "sure_tie", "sure_start"]
    out: list[list] = [[] for _ in names]
    for p, (r, b) in enumerate(zip(slices(part_of(runs), n_parts), slices(part_of(blocks), n_parts), strict=True)):
        b = np.sort(blocks[b])  # in order of place
        own = sure[p]
        row = (p, planes(steps(np.sort(local(runs[r])))), planes(local(b)), *places(docs[b], ties[b], starts[b]), *places(docs[own], ties[own], starts[own]))
        for col, v in zip(out, row, strict=True):
            col.append(v)
    return pa.record_batch([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=names)


HITS = "key long, tie long, starts binary"


def by_doc(docs: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> pa.Table:
    """One row a document, with its starts."""
    order = np.lexsort((starts, ties, docs))
    docs, ties, starts = docs[order], ties[order], starts[order]
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1])]) if len(docs) else np.empty(0, int)
    own = [x.tobytes() for x in np.split(starts, first[1:])] if len(first) else []
    return pa.table({"key": pa.array(docs[first], pa.int64()), "tie": pa.array(ties[first], pa.int64()), "starts": pa.array(own, pa.binary())})


def hit_blocks(group: pa.Table) -> pa.Table:
    runs = unplanes(group["runs"].to_pylist(), "u4", diff=True)
    hashes = unplanes(group["hash"].to_pylist(), "u4")
    both = np.sort(np.r_[runs, hashes])
    hit = np.searchsorted(both, hashes, "right") - np.searchsorted(both, hashes, "left") > 1
    return by_doc(*(np.r_[x[hit], sure] for x, sure in zip(read_places(group), read_places(group, "sure_"), strict=True)))


WINDOWS = "part int, hash binary, more binary, doc binary, tie binary, start binary, sure_doc binary, sure_tie binary, sure_start binary"


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    span = 1
    while 2 * span <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def sorted_windows(h: np.ndarray, more: np.ndarray, docs: np.ndarray, ties: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of windows by hash and place, which of them are the first of their kind, and those that are not at the place of the first."""
    order = np.lexsort((starts, ties, docs, more, h))
    if not len(order):
        return order, np.zeros(0, bool), order
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    late = (docs[order] != docs[lead]) | (ties[order] != ties[lead]) | (starts[order] != starts[lead])
    return order, new, order[late]


def window_rows(h: np.ndarray, more: np.ndarray, docs: np.ndarray, ties: np.ndarray, starts: np.ndarray, part: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """The first of equal windows of one task's share, by partition; the others are surely repeats and travel as such."""
    order, new, late = sorted_windows(h, more, docs, ties, starts)
    firsts, sure = order[new], np.array_split(np.sort(late), n_parts)
    names = ["part", "hash", "more", "doc", "tie", "start", "sure_doc", "sure_tie", "sure_start"]
    out: list[list] = [[] for _ in names]
    for p, s in enumerate(slices(part[firsts], n_parts)):
        s, own = np.sort(firsts[s]), sure[p]
        row = (p, h[s].tobytes(), more[s].tobytes(), *places(docs[s], ties[s], starts[s]), *places(docs[own], ties[own], starts[own]))
        for col, v in zip(out, row, strict=True):
            col.append(v)
    return pa.record_batch([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]], names=names)


def later_windows(group: pa.Table) -> pa.Table:
    h = np.frombuffer(b"".join(group["hash"].to_pylist()), "u8")
    more = np.frombuffer(b"".join(group["more"].to_pylist()), "u4")
    own = read_places(group)
    late = sorted_windows(h, more, *own)[2]
    return by_doc(*(np.r_[sure, x[late]] for x, sure in zip(own, read_places(group, "sure_"), strict=True)))


class Share:
    """Arrays of a task, handed on whenever there are enough."""

    def __init__(self, width: int):
        self.columns: list[list[np.ndarray]] = [[] for _ in range(width)]
        self.n = 0

    def add(self, *arrays: np.ndarray) -> None:
        for c, a in zip(self.columns, arrays, strict=True):
            c.append(a)
        self.n += len(arrays[0])

    def take(self) -> list[np.ndarray]:
        out, self.columns, self.n = [np.concatenate(c) for c in self.columns], [[] for _ in self.columns], 0
        return out


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places a run of `width` from any of the starts covers."""
    edge = np.zeros(n + 1, "i4")
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def deduplicate(docs: DataFrame, keep: list[str] | None = None, width: int = WIDTH, as_is: bool = False) -> DataFrame:
    """doc_id, the columns `keep`, n_words, n_removed, kept (the words that stay, joined by one space) and spans (start and
    length, in words, of the removed runs). With `as_is`, a text that loses nothing is kept as it is, blanks included."""
    spark, block = docs.sparkSession, width // 2
    bounded_batches(spark)
    extra = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(min(64, 1 + size // (1 << 16)), 1 + size // PART_BYTES)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        rolling, share = Rolling(BASES[0]), Share(4)
        for batch in batches:
            for key, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                words = word_hashes(text)
                if len(words) >= width:
                    h = rolling(words, block)
                    share.add(h, np.full(len(h), key, "i8"), np.full(len(h), tie, "i8"), np.arange(len(h), dtype="u4"))
                    if share.n > FLUSH:
                        yield probe_rows(*share.take(), block, n_parts)
        if share.n:
            yield probe_rows(*share.take(), block, n_parts)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        one, two, share = Rolling(BASES[0]), Rolling(BASES[1]), Share(6)
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            for key, tie, text, starts in zip(col["key"].to_pylist(), col["tie"].to_pylist(), as_bytes(col["text"]), col["starts"].to_pylist(), strict=True):
                words, blocks = word_hashes(text), np.unique(np.frombuffer(b"".join(starts), "u4")).astype("i8")
                n = len(words) - width + 1
                if n < 1:
                    continue
                at = np.flatnonzero(covered(np.clip(blocks[blocks < len(words)] - (width - block), 0, None), n + width, width - block + 1)[:n])
                # equal windows have the same least block hash, and neighbours mostly do: they travel, and return, together
                part = (least(one(words, block), width - block + 1)[at] % U(n_parts)).astype("i4")
                share.add(one(words, width)[at], (two(words, width)[at] >> U(32)).astype("u4"), np.full(len(at), key, "i8"), np.full(len(at), tie, "i8"), at.astype("u4"), part)
                if share.n > FLUSH:
                    yield window_rows(*share.take(), n_parts)
        if share.n:
            yield window_rows(*share.take(), n_parts)

    names = [f.name for f in rows.schema if f.name.startswith("k") and f.name != "key"]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            ids, kept, n_words, n_removed, spans = [], [], [], [], []
            for key, text, starts in zip(col["key"].to_pylist(), as_bytes(col["text"]), col["starts"].to_pylist(), strict=True):
                words = text.split()
                n, found = len(words), []
                ids.append(None if key == -(1 << 63) else key)
                n_words.append(n)
                if starts:
                    at = np.frombuffer(b"".join(starts), "u4").astype("i8")
                    out = covered(at[at + width <= n], n, width)
                    edges = np.flatnonzero(np.diff(np.r_[False, out, False]))
                    found = [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                n_removed.append(n - len(words))
                kept.append(text if as_is and len(words) == n else b" ".join(words))
                spans.append(found)
            made = [pa.array(ids, pa.int64()), *[col[c] for c in names], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)]
            yield pa.record_batch(made, names=["doc_id", *names, "n_words", "n_removed", "kept", "spans"])

    # one plan: both joins take the same columns, so that they read the same exchange of the texts
    collected = lambda hits: hits.groupBy("key", "tie").agg(F.collect_list("starts").alias("starts"))
    hits = collected(rows.select("key", "tie", "text").mapInArrow(probe, PROBES).groupBy("part").applyInArrow(hit_blocks, HITS))
    windows = rows.join(hits, ["key", "tie"]).mapInArrow(extend, WINDOWS)
    late = collected(windows.groupBy("part").applyInArrow(later_windows, HITS))
    out = rows.join(late, ["key", "tie"], "left").mapInArrow(remove, f"doc_id long, {shape + ', ' if shape else ''}n_words long, n_removed long, kept string, spans array<struct<start: int, length: int>>")
    return out.select("doc_id", *[F.col(a).alias(c) for a, c in zip(names, keep or [], strict=True)], "n_words", "n_removed", "kept", "spans")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: doc_id, n_words, n_removed, kept_sha256, and the spans."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "spans")
