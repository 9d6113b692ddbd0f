"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

Pieces are dealt at random into blocks of bounded size. Each block is solved by several islands at once: a population
of packings in which a crossover injects whole well-filled bins of one parent into another, drops the bins that then
hold a piece twice, lets displaced pieces replace smaller ones where they fill a bin better, and puts the rest back by best
fit. Between epochs every island sends its elite to the
next one of its block. Blocks end with a few loosely filled bins; those are released, dealt into new blocks and packed
again, and that second packing counts only where it needs fewer bins.

Null text counts as empty (one token, the separator); very long texts are cut into pieces of a sequence each; an empty
table gives an empty result; repeated rows are packed as often as they occur; pieces of one length go by id, piece and
checksum; extra columns are ignored. No group is larger than a block, whatever ids or texts repeat.
"""

from __future__ import annotations

import gc
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BatchEncoder
from .common import as_bytes, bounded_batches, claim, cut
from .tokens import vocabulary_path

CAPACITY, BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS, SWAPS = 2048, 4096, 3, 3, 6, 24, 200
Packing = list[list[int]]  # bins, each a list of item numbers


@lru_cache(maxsize=1)
def encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)


def tokenised(docs: DataFrame, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a key that deals pieces evenly, also where ids repeat."""
    path = vocabulary or vocabulary_path()
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row, end = encoder(path).encode, 0, b"\0\0\0\0"
        claim(encoder(path).memo)
        gc.disable()  # no cycles arise here, and looking for them in many short lists costs a tenth of the time
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for at in range(0, len(ids), 256):
                got = encode([t or b"" for t in texts[at : at + 256]])
                for doc_id, data in zip(ids[at : at + 256], got, strict=True):
                    data += end
                    for piece, k in enumerate(range(0, len(data), 4 * capacity)):
                        x = data[k : k + 4 * capacity]
                        row += 1
                        for col, v in zip(cols, (doc_id, piece, k // 4, len(x) // 4, zlib.crc32(x), row), strict=True):
                            col.append(v)
            kinds = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = docs.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(cut_up, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")
    return out.withColumn("key", F.xxhash64("doc_id", "piece", "row")).drop("row")


def best_fit(items: list[int], size: list[int], capacity: int, bins: Packing, fill: list[int]) -> None:
    """Put items, in this order, into the fullest bin that has room, opening bins where none has. Changes bins and fill."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, used in enumerate(fill):
        if used < capacity:
            by_room.setdefault(capacity - used, []).append(b)
            mask |= 1 << (capacity - used)
    for i in items:
        s = size[i]
        if above := mask >> s:
            room = s + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
            fill[b] += s
        else:
            b, room = len(bins), capacity
            bins.append([i])
            fill.append(s)
        if left := room - s:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left


def fitness(bins: Packing, fill: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, the squares of the fills favour full and empty bins over half-full ones."""
    return -len(bins), sum((f / capacity) ** 2 for f in fill)


def exchange(displaced: list[int], size: list[int], capacity: int, bins: Packing, fill: list[int], rng: random.Random) -> list[int]:
    """Displaced pieces take the places of one or two smaller ones in bins that they fill better; returns what is displaced then.
    Small pieces are left over, which best fit places more easily. At most SWAPS bins are looked at. Changes bins and fill."""
    loose = [b for b, used in enumerate(fill) if used < capacity]
    displaced.sort(key=size.__getitem__)
    sizes = [size[i] for i in displaced]
    for b in rng.sample(loose, min(len(loose), SWAPS)):
        if not displaced:
            break
        own, room, best = bins[b], capacity - fill[b], (0, None, None)
        few = rng.sample(own, 8) if len(own) > 8 else own
        for out in [*combinations(few, 1), *combinations(few, 2)]:
            gone = size[out[0]] if len(out) == 1 else size[out[0]] + size[out[1]]
            at = bisect_right(sizes, gone + room) - 1
            if at >= 0 and sizes[at] - gone > best[0]:
                best = (sizes[at] - gone, out, at)
                if best[0] == room:
                    break
        if best[1]:
            put = displaced.pop(best[2])
            bins[b] = [*(i for i in own if i not in best[1]), put]
            fill[b] += best[0]
            displaced += best[1]
            displaced.sort(key=size.__getitem__)
            sizes = [size[i] for i in displaced]
    return displaced


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, rng: random.Random) -> tuple[Packing, list[int]]:
    """A child of a with a random run of b's best-filled bins."""
    ranked = sorted(b, key=lambda g: -sum([size[i] for i in g]))
    share = max(1, len(b) // rng.choice((3, 4, 6, 8)))
    injected = rng.sample(ranked[: max(share, (len(b) * 3) // 4)], share)
    taken = {i for g in injected for i in g}
    bins, displaced = [list(g) for g in injected], []
    for g in a:
        if taken.isdisjoint(g):
            bins.append(list(g))
        else:
            displaced += [i for i in g if i not in taken]
    fill = [sum([size[i] for i in g]) for g in bins]
    loose = sorted((k for k, used in enumerate(fill) if used < capacity - 8), key=fill.__getitem__)[:2]
    for k in sorted(loose, reverse=True):  # a small mutation: the loosest bins are dealt again too
        displaced += bins.pop(k)
        fill.pop(k)
    displaced = exchange(displaced, size, capacity, bins, fill, rng)
    displaced.sort(key=lambda i: -size[i])
    best_fit(displaced, size, capacity, bins, fill)
    return bins, fill


def evolve(size: list[int], capacity: int, seed: int, elite: list[Packing], population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing of one island after some generations; it ends early at the bound that no packing can beat."""
    rng = random.Random(seed)
    n, bound = len(size), -(-sum(size) // capacity)
    pool = []
    for bins in elite:
        if len(bins) == bound:
            return bins
        pool.append((bins, [sum(size[i] for i in g) for g in bins]))
    while len(pool) < population:
        noise = 0.0 if not pool else 0.02 * len(pool)
        order = sorted(range(n), key=lambda i: -size[i] * (1 + noise * rng.random()))
        bins, fill = [], []
        best_fit(order, size, capacity, bins, fill)
        pool.append((bins, fill))
        if len(bins) == bound:
            return bins
    scored = sorted(((fitness(b, f, capacity), b) for b, f in pool), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -scored[0][0][0] <= bound:
            break
        i, j = rng.sample(range(len(scored)), 2)
        child, fill = crossover(scored[i][1], scored[j][1], size, capacity, rng)
        score = fitness(child, fill, capacity)
        if score > scored[-1][0] and all(score != s for s, _ in scored):
            scored[-1] = (score, child)
            scored.sort(key=lambda x: x[0], reverse=True)
    return scored[0][1]


def to_bytes(bins: Packing, n: int) -> bytes:
    out = np.empty(n, "<i4")
    for b, g in enumerate(bins):
        out[g] = b
    return out.tobytes()


def from_bytes(data: bytes) -> Packing:
    which = np.frombuffer(data, "<i4")
    order = np.argsort(which, kind="stable")
    return [g.tolist() for g in np.split(order, np.flatnonzero(np.diff(which[order])) + 1)] if len(which) else []


STATE = "block long, island int, sizes binary, best binary, bins long, score double"


def solved(block: int, island: int, sizes: bytes, elite: list[bytes], capacity: int, epoch: int) -> dict:
    size = np.frombuffer(sizes, "<i4").tolist()
    bins = evolve(size, capacity, hash((block, island, epoch)), [from_bytes(e) for e in elite])
    score = fitness(bins, [sum(size[i] for i in g) for g in bins], capacity)
    return {"block": block, "island": island, "sizes": sizes, "best": to_bytes(bins, len(size)), "bins": len(bins), "score": score[1]}


def as_batch(rows: list[dict]) -> pa.Table:
    kinds = (("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.binary()), ("best", pa.binary()), ("bins", pa.int64()), ("score", pa.float64()))
    return pa.Table.from_pylist(rows, schema=pa.schema(kinds))


ORDER = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]


def packed(pieces: DataFrame, capacity: int, n: int, level: int) -> DataFrame:
    """Pieces with block, bin, used (what their bin holds), rank (of their bin in its block, least filled first) and offset."""
    blocks = max(1, -(-n // BLOCK))
    # the key's upper half deals out each level anew
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(blocks)))
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def begin(group: pa.Table) -> pa.Table:
        group = group.sort_by(ORDER)
        sizes = np.array(group["length"].to_numpy(), "<i4").tobytes()
        return as_batch([solved(group["block"][0].as_py(), group["island"][0].as_py(), sizes, [], capacity, 0)])

    def go_on(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [solved(r["block"], r["island"], r["sizes"], [r["best"], r["guest"]], capacity, epoch) for r in batch.to_pylist()]
                yield from as_batch(rows).to_batches()

        return run

    def lay(group: pa.Table, best: pa.Table) -> pa.Table:
        group = group.sort_by(ORDER)
        which, size = np.frombuffer(best["best"][0].as_py(), "<i4"), group["length"].to_numpy()
        used = np.bincount(which, weights=size).astype("i8")
        rank = np.empty(len(used), "i8")
        rank[np.argsort(used, kind="stable")] = np.arange(len(used))
        order = np.argsort(which, kind="stable")
        ends = np.cumsum(size[order])
        first = np.r_[True, np.diff(which[order]) != 0] if len(order) else np.zeros(0, bool)
        base = np.repeat((ends - size[order])[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
        offset = np.empty(len(order), "i8")
        offset[order] = ends - size[order] - base
        for name, values in (("bin", which.astype("i8")), ("used", used[which]), ("rank", rank[which]), ("offset", offset)):
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "key", "block"]
    islands = dealt.select("block", "length", "doc_id", "piece", "ids_crc32", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = cut(islands.groupBy("block", "island").applyInArrow(begin, STATE))
    for epoch in range(1, EPOCHS):
        guest = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("best").alias("guest"))
        state = cut(state.join(guest, ["block", "island"]).mapInArrow(go_on(epoch), STATE))
    best = state.groupBy("block").agg(F.max_by("best", F.struct(-F.col("bins"), F.col("score"), F.col("island"))).alias("best"))
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, key long, block long, bin long, used long, rank long, offset long"
    return dealt.select(*columns).groupBy("block").cogroup(best.groupBy("block")).applyInArrow(lay, out)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = cut(tokenised(docs, capacity, vocabulary))
    n = pieces.count()
    first = cut(packed(pieces, capacity, n, 0))
    # what can be packed better together with other blocks' rest: a block's loosest bins, and any with much room
    loose = (F.col("rank") < 4) | (F.col("used") < capacity * 0.97)
    loose &= F.col("used") < capacity
    again = first.where(loose).select("doc_id", "piece", "start", "length", "ids_crc32", "key")
    m, made = first.where(loose).agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
    place = lambda df, level: df.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(level).cast("long") * F.lit(1 << 60) + F.col("block") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"), "offset")
    if not m:
        return place(first, 0)
    second = cut(packed(again, capacity, m, 1))
    if second.where(F.col("offset") == 0).count() >= made:
        return place(first, 0)
    return place(first.where(~loose), 0).unionByName(place(second, 1))
