"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has bit i where more than half of the text's shingle hashes have it. Covering masks: each of the 64
positions gets a non-zero code of radius + 1 bits, and mask v keeps the positions whose code has odd parity with v. The
codes of at most `radius` differing positions span less than the whole space, so some v is orthogonal to all of them:
under that mask the two fingerprints are equal, and the pair surely meets in a bucket of table v. Buckets hold distinct
fingerprints only. One with more than BUCKET of them is dealt again under further masks (the same argument holds at
each level), so no task compares all pairs of a large group; at the last level, what is left is compared in blocks.
A bucket gives a spanning forest of its links, never its pairs.

Null or blank text has fingerprint zero; shorter texts than a shingle hash their whole word sequence; an empty table
gives an empty result; repeated rows give one row each; rows of null id take no part in naming a component unless it
has no other id; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, claim, cut, parts
from .components import connected
from .substring import BASES, Rolling, word_hashes

BITS, RADIUS, BUCKET, LEVELS = 64, 3, 4096, 4
DIGEST = "_digest_of_text"
BANDS, ROWS, BATCH = 42, 6, 16 << 20


def simhash(text: bytes | None, width: int = 3) -> bytes:
    """The fingerprint, as 8 bytes from the highest bit on."""
    words = (text or b"").lower().split()  # bytes.lower() and split() know ASCII only, as is meant here
    if not words:
        return bytes(8)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest, ends = xxhash.xxh64_digest, starts[min(width, len(words)) :]
    data = b"".join([digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[:n])])  # noqa: B905
    counts = np.unpackbits(np.frombuffer(data, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); no shuffle."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for batch in batches:
            data = b"".join(simhash(t, width) for t in as_bytes(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(np.frombuffer(data, ">i8").astype("i8"))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """2 ** (radius + 1) - 1 masks, as signed longs; each keeps about half of the positions. Levels differ by a permutation."""
    n = (1 << (radius + 1)) - 1
    best: list[int] = []
    for turn in range(1 if n < BITS else 40):  # of random codes, those whose lightest mask is heaviest
        rng = random.Random(f"covering {level} {turn}")
        code = [i % n + 1 for i in range(BITS)] if n < BITS else rng.sample(range(1, n + 1), BITS)
        rng.shuffle(code)
        masks = [sum(1 << i for i in range(BITS) if (code[i] & v).bit_count() % 2) for v in range(1, n + 1)]
        best = max(best, masks, key=lambda m: min((x.bit_count() for x in m), default=0))
    return [m - (1 << 64) if m >> 63 else m for m in best]


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member) of the components of at most `radius` differing bits among x, in blocks of rows."""
    x = np.sort(x)
    label = np.arange(len(x))
    while True:
        new = label.copy()
        for k in range(0, len(x), 512):
            near = np.bitwise_count((x[k : k + 512, None] ^ x[None, :]).view(np.uint64)) <= radius
            new[k : k + 512] = np.where(near, label[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(x)))
            return x[moved], x[label[moved]]
        label = new


def bucket_links(rows: DataFrame, radius: int, last: bool) -> DataFrame:
    """Over rows (fp, bucket): links (a, b) with again = false, and the rows of buckets over BUCKET as (fp, bucket) with again = true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "again"]
        held_fp, held_bucket, giant = np.empty(0, "i8"), np.empty(0, "i8"), None

        def done(fp: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
            size = np.diff(np.r_[first, len(bucket)])
            two = first[size == 2]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius] if len(two) else two
            a, b = [fp[two]], [fp[two + 1]]
            for s, n in zip(first[size > 2], size[size > 2], strict=True):
                if n > BUCKET and not last:
                    yield pa.record_batch([pa.array(fp[s : s + n]), pa.array(bucket[s : s + n]), pa.array(np.ones(n, bool))], names=names)
                else:
                    x, y = forest(fp[s : s + n], radius)
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], names=names)

        for batch in batches:
            fp, bucket = np.concatenate([held_fp, batch.column(0).to_numpy()]), np.concatenate([held_bucket, batch.column(1).to_numpy()])
            if not len(fp):
                continue
            if giant is not None:  # the rest of a bucket that is dealt again
                k = int(np.searchsorted(bucket != giant, True))
                if k:
                    yield pa.record_batch([pa.array(fp[:k]), pa.array(bucket[:k]), pa.array(np.ones(k, bool))], names=names)
                fp, bucket = fp[k:], bucket[k:]
                if not len(fp):
                    held_fp, held_bucket = fp, bucket
                    continue
                giant = None
            start = int(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[-1])  # the last bucket may go on
            yield from done(fp[:start], bucket[:start])
            held_fp, held_bucket = fp[start:], bucket[start:]
            if len(held_fp) > BUCKET and not last:
                giant = held_bucket[0]
                yield pa.record_batch([pa.array(held_fp), pa.array(held_bucket), pa.array(np.ones(len(held_fp), bool))], names=names)
                held_fp, held_bucket = held_fp[:0], held_bucket[:0]
        yield from done(held_fp, held_bucket)

    dealt = rows.repartition(parts(rows), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long, again boolean")


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that chains of at most `radius` differing bits connect."""
    rows, found = distinct.select("fp", F.lit(0).cast("long").alias("bucket")), None
    for level in range(LEVELS):
        tables = [F.xxhash64("bucket", F.lit(v), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for v, m in enumerate(covering_masks(radius, level))]
        rows = rows.select("fp", F.explode(F.array(*tables)).alias("bucket"))
        out = cut(bucket_links(rows, radius, level == LEVELS - 1))
        edges = out.where("not again").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rows = out.where("again").select(F.col("a").alias("fp"), F.col("b").alias("bucket")).distinct()
        if rows.isEmpty():
            break
    return found


def grouped(prints: DataFrame, key: str, radius: int = RADIUS) -> DataFrame:
    """fp and component_id, the least `key` that links reach, for each fingerprint of prints (key, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    root = connected(links(distinct, radius)).withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return cut(rooted.join(named, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach)."""
    prints = cut(fingerprints(docs, width))
    by_print = grouped(prints, "doc_id", radius)
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, width: int, rolling: Rolling) -> np.ndarray:
    """Hashes of the distinct word shingles, in lower case; of the whole sequence if it is shorter."""
    words = word_hashes((text or b"").lower())
    return np.unique(rolling(words, min(width, len(words)))) if len(words) else words


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest_of(docs: DataFrame) -> DataFrame:
    """docs with the digest of the text, null text as empty; rows of one text have one digest, whatever their ids."""
    return docs.withColumn(DIGEST, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, digest, fp (the fingerprint of word pairs) and BANDS hashes, each of ROWS least values of the word shingles; no shuffle."""
    bounded_batches(docs.sparkSession)
    factor = np.random.default_rng(1).integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype="u8") * np.uint64(2) + np.uint64(1)

    def bands(text: bytes, rolling: Rolling) -> np.ndarray:
        x, least = shingle_set(text, width, rolling).astype("u8"), np.full(BANDS * ROWS, ~np.uint64(0))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        for k in range(0, len(x), 1024):
            np.minimum(least, (x[None, k : k + 1024] * factor).min(axis=1), out=least)
        return least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        rolling = Rolling(BASES[0])
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = as_bytes(batch.column(2))
            least = np.stack([bands(t, rolling) for t in texts]).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype="u8"), least.shape[:2])
            for i in range(ROWS):
                key = (key ^ (key >> np.uint64(32)) ^ least[:, :, i]) * np.uint64(0xBF58476D1CE4E5B9)
            fp = np.frombuffer(b"".join(simhash(t, 2) for t in texts), ">i8").astype("i8")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp), pa.array(list(key.view("i8")), pa.list_(pa.int64()))], names=["doc_id", "digest", "fp", "bands"])

    rows = digest_of(docs).select("doc_id", F.col(DIGEST), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, digest string, fp long, bands array<long>")


class Stays:
    """Shingle sets, found again by the least fifth of their hashes: sets of similarity `least` or more share one of these."""

    def __init__(self, least: float):
        self.least, self.sets, self.where = least, [], {}

    def prefix(self, x: np.ndarray) -> list[int]:
        return x[: len(x) - math.ceil(self.least * len(x) - 1e-9) + 1].tolist() or [-1]

    def alike(self, x: np.ndarray) -> bool:
        seen: set[int] = set()
        for h in self.prefix(x):
            for k in self.where.get(h, ()):
                if k not in seen:
                    seen.add(k)
                    y = self.sets[k]
                    if min(len(x), len(y)) >= self.least * max(len(x), len(y)) - 1e-9 and jaccard(x, y) >= self.least:
                        return True
        return False

    def add(self, x: np.ndarray) -> None:
        for h in self.prefix(x):
            self.where.setdefault(h, []).append(len(self.sets))
        self.sets.append(x)


def judged(rows: DataFrame, width: int, least: float) -> DataFrame:
    """Over rows (root, chunk, kind, digest, text, least_id): alike, for each text but those of kind 0, which are known to stay. Kind 1 is
    compared with these; kind 2, by rising least_id, with all that stay of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        rolling, group, stays = Rolling(BASES[0]), None, Stays(least)
        for batch in batches:
            names, out = [], []
            for root, chunk, kind, digest, text in zip(*(batch.column(i).to_pylist() for i in range(4)), as_bytes(batch.column(4)), strict=True):
                if group != (root, chunk):
                    group, stays = (root, chunk), Stays(least)
                x = shingle_set(text, width, rolling)
                alike = kind > 0 and stays.alike(x)
                if kind != 1 and not alike:
                    stays.add(x)
                if kind:
                    names.append(digest)
                    out.append(alike)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(out, pa.bool_())], names=["digest", "alike"])

    dealt = rows.select("root", "chunk", "kind", "digest", "text", "least_id").repartition(parts(rows), "root", "chunk")
    ordered = dealt.sortWithinPartitions("root", "chunk", "kind", F.col("least_id").asc_nulls_last(), "digest")
    return cut(ordered.select("root", "chunk", "kind", "digest", "text").mapInArrow(run, "digest string, alike boolean"))


def alike_texts(texts: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Digests that go, of the distinct texts (digest, fp, bands) of candidate groups: texts whose shingles have a Jaccard similarity of
    `least` or more with those of a text that stays. rows (digest, least_id, text) has each text once.

    Of a group, a share of about BATCH bytes, chosen by hash, is decided first, in order of ids: each text is compared,
    exactly, with those before it that stay. The others are compared with all that stay of these, in chunks, and those left
    are a group again, until none is left. So no pairs are made, nothing goes without an exact comparison, no two that stay
    in a group are alike, and a hot group of near copies is spread over tasks and gone after a round or two; a group of
    texts that only chain together takes a round for every BATCH bytes that stay."""
    node = F.xxhash64("digest")  # texts that share a hash by chance are only candidates more
    banded = cut(texts.select(node.alias("a"), F.explode("bands").alias("band")))
    heads = cut(banded.groupBy("band").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("band", "b"))
    alike = banded.join(heads, "band").where("a <> b").select("a", "b")
    prints = cut(texts.select(node.alias("a"), "fp"))
    near = prints.join(grouped(prints, "a", radius=5), "fp").select("a", F.col("component_id").alias("b")).where("a <> b")
    root = cut(connected(alike.unionByName(near)))
    members = rows.withColumn("node", node).join(root, "node").select("digest", "least_id", "text", "root")
    left, out, none, turn = cut(members), None, F.lit(0), 0
    while True:
        size = F.octet_length("text") + F.lit(64)
        sizes = cut(left.groupBy("root").agg(F.sum(size).alias("total"), F.min("digest").alias("one")))
        share = F.pmod(F.xxhash64("digest", F.lit(turn)), F.lit(1 << 30)) < F.lit(float(BATCH << 30)) / F.col("total")
        dealt = left.join(sizes, "root").withColumns({"first": (F.col("total") <= BATCH) | share | (F.col("digest") == F.col("one")), "chunks": F.ceil(F.col("total") / BATCH).cast("int")})
        now = judged(dealt.where("first").withColumns({"chunk": none, "kind": F.lit(2)}), width, least)
        gone = now.where("alike").select("digest")
        out = gone if out is None else out.unionByName(gone)
        rest = dealt.where("not first")
        if rest.isEmpty():
            return out
        stay = dealt.join(now.where("not alike").select("digest"), "digest").select("root", F.explode(F.sequence(none, F.col("chunks") - 1)).alias("chunk"), none.alias("kind"), "digest", "text", "least_id")
        others = rest.select("root", F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"), "digest", "text", "least_id")
        then = judged(stay.unionByName(others), width, least)
        out = out.unionByName(then.where("alike").select("digest"))
        left, turn = cut(left.join(then.where("not alike").select("digest"), "digest").select(*left.columns)), turn + 1


def drop_copies(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, without copies: of equal texts the row of the least doc_id stays, and a text goes when its
    word shingles have a Jaccard similarity of `least` or more with those of a text that stays.

    Fingerprints of word pairs within five bits, and least hashes of the shingles - ROWS of them equal in one of BANDS bands -
    make candidate groups, which are then compared exactly. Rows are told apart by their text and id together, so rows
    that share an id, or have none, go only for their texts; null ids come after all others. Texts of fewer words than a shingle
    are one shingle; null text counts as empty and is one text; rows equal in id and text are one row, of whose other
    columns the least stay; very long texts are compared whole; an empty table gives an empty result."""
    columns = docs.columns
    sketched = cut(sketches(docs, width))
    by_text = cut(sketched.groupBy("digest").agg(F.min("doc_id").alias("least_id")))
    mine = F.col("doc_id").eqNullSafe(F.col("least_id"))
    texts = sketched.join(by_text, "digest").where(mine).select("digest", "fp", "bands")
    rows = digest_of(docs.select("doc_id", "text")).withColumnRenamed(DIGEST, "digest")
    rows = rows.join(by_text, (rows["digest"] == by_text["digest"]) & rows["doc_id"].eqNullSafe(by_text["least_id"])).select(rows["digest"], "least_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeats = cut(sketched.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"))
    some = not repeats.isEmpty()
    if some:  # rows of one id and text
        texts = texts.groupBy("digest", "fp").agg(F.min("bands").alias("bands"))
        rows = rows.groupBy("digest", "least_id").agg(F.min("text").alias("text"))
    gone = cut(alike_texts(texts, rows, width, least).distinct().withColumn("gone", F.lit(True)))
    judged_rows = sketched.select("doc_id", "digest").join(by_text, "digest").join(gone, "digest", "left")
    going = cut(judged_rows.where(F.col("gone") | ~mine).select("doc_id", "digest"))  # not distinct: so the join of a hot text can be split
    marked = digest_of(docs)
    same = lambda other: (marked[DIGEST] == other["digest"]) & marked["doc_id"].eqNullSafe(other["doc_id"])
    if not some:
        return marked.join(going, same(going), "left_anti").select(*columns)
    out = marked.join(going.unionByName(repeats), same(going.unionByName(repeats)), "left_anti").select(*columns)
    kept = cut(repeats.join(going, repeats["digest"].eqNullSafe(going["digest"]) & repeats["doc_id"].eqNullSafe(going["doc_id"]), "left_anti"))
    twice = marked.join(kept, same(kept), "left_semi").groupBy(DIGEST, "doc_id").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return out.unionByName(twice)
