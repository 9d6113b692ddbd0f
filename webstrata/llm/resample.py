"""Importance resampling towards a target distribution, with identical texts collapsed first.

Features are the runs of one and two words of a text, hashed into BUCKETS buckets. Equal texts are grouped by their full text;
features are computed once a group, as one 16-bit bucket number each, and counted as often as the group has rows. A bucket's
gain is the log ratio of its smoothed shares in the target and in all rows; a text's weight is the mean gain of its
features. Weights go back to the rows by the text's SHA-256; then each row adds Gumbel noise of its own, hashed from its id,
and the highest scores are drawn: a weighted sample without replacement.

Ranks come from one exchange by range and the rows' places in their partitions, so no task sees more than its range; only one
number a partition, and the 10 000 gains, are held by the driver.

Null text has no features and shares the group of empty texts; a text without features weighs 0 and, with fewer than
LEAST_WORDS words, is never drawn; ties go to the smaller id, rows of no id last, and between rows of one id and score to
any; a null id's noise is hashed from its text; very long texts are hashed part by part; an empty target leaves smoothing
alone; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut
from .scan import ALPHANUMERIC, LOWER

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
PART = 1 << 20
#: Bytes to what they count as: A-Z in lower case, bytes that are in no word to blanks.
FOLD = bytes(int(LOWER[b]) if ALPHANUMERIC[LOWER[b]] else 32 for b in range(256))


def word_runs(text: bytes, size: int = PART) -> Iterator[list[bytes]]:
    """The words of a text, some `size` bytes at a time."""
    start = 0
    while start < len(text):
        part = text[start : start + size].translate(FOLD)
        while start + len(part) < len(text) and b" " not in part:  # a word longer than that
            more = text[start + len(part) : start + 2 * len(part)]
            part += more.translate(FOLD)
        stop = len(part) if start + len(part) >= len(text) else part.rindex(b" ") + 1
        yield part[:stop].split()
        start += stop


def buckets_of(text: bytes, size: int = PART) -> np.ndarray:
    """The bucket of every feature of a text, 16 bits each: first the words of a part, then its pairs."""
    out, before = [], []
    for words in word_runs(text, size):
        if not words:
            continue
        one = list(map(crc32, words))
        spaced = list(map(crc32, repeat(b" "), before + one[:-1]))  # checksums of each first word with the blank
        two = list(map(crc32, words if before else words[1:], spaced))
        out.append(np.array(one + two, "u4") % BUCKETS)
        before = one[-1:]
    return np.concatenate(out).astype("<u2") if out else np.zeros(0, "<u2")


def collapsed(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, n (rows with this text), n_features and buckets of each distinct text."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = as_bytes(batch.column(0))
            found = [buckets_of(t) for t in own]
            digests = pa.array([hashlib.sha256(t).digest() for t in own], pa.binary())
            yield pa.record_batch([digests, batch.column(1), pa.array([len(b) for b in found], pa.int64()), pa.array([b.tobytes() for b in found], pa.binary())], names=["digest", "n", "n_features", "buckets"])

    groups = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return groups.mapInArrow(run, "digest binary, n long, n_features long, buckets binary")


def flat_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u2"), np.array([len(r) // 2 for r in rows], "i8")


def bucket_counts(groups: DataFrame) -> np.ndarray:
    """How many features fall into each bucket, repeats and copies counted: one partial count a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, "i8")
        for batch in batches:
            numbers, size = flat_buckets(batch.column(1))
            total += np.bincount(numbers, weights=np.repeat(batch.column(0).to_numpy(), size), minlength=BUCKETS).astype("i8")
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype("i4")), pa.array(total[some])], names=["bucket", "n"])

    counted = groups.select("n", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, "i8")
    for row in counted.collect():  # at most BUCKETS rows
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, rounded down."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], "i8")


def weights(groups: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n_features and weight of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, size = flat_buckets(batch.column(2))
            sums = np.concatenate([np.zeros(1, "i8"), np.cumsum(gain[numbers])])
            end = np.cumsum(size)
            mean = (sums[end] - sums[end - size]) // np.maximum(size, 1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(mean)], names=["digest", "n_features", "weight"])

    return groups.select("digest", "n_features", "buckets").mapInArrow(run, "digest binary, n_features long, weight long")


def noise(name: Column) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a name's SHA-256."""
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, fits, salt) with the rank of those drawn. `salt` tells rows of one id apart."""
    order = [F.desc("fits"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("salt")]
    place = F.monotonically_increasing_id()  # the partition's number, and 33 bits for the row's within it
    placed = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place))
    sizes = placed.groupBy(F.shiftright("place", 33).cast("int").alias("range")).agg(F.count("*").alias("n"), F.count_if("fits").alias("fits")).orderBy("range").collect()
    before, starts = 0, []
    for row in sizes:  # one row a partition
        starts.append((row.range, before))
        before += row.n
    drawn = percent * sum(row.fits for row in sizes) // 100
    table = F.broadcast(scored.sparkSession.createDataFrame(starts, "range int, start long"))
    at = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    rows = placed.withColumn("range", F.shiftright("place", 33).cast("int")).join(table, "range")
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (at <= drawn), at).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """Every row of docs: doc_id, n_features, weight, score and rank (null if not drawn)."""
    groups = cut(collapsed(docs, text_col))
    gain = gains(bucket_counts(groups), bucket_counts(collapsed(target, text_col)))
    weight = weights(groups, gain)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    rows = docs.select("doc_id", digest.alias("digest"))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.lower(F.hex("digest")))))
    # n words make 2n - 1 features
    scored = rows.join(weight, "digest").select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(name)).alias("score"), (F.col("n_features") >= 2 * least_words - 1).alias("fits"), F.monotonically_increasing_id().alias("salt"))
    return ranked(cut(scored), percent)


SQL = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
texts AS (SELECT text, count(*) AS n, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
          FROM (SELECT coalesce(text, '') AS text FROM documents UNION ALL SELECT coalesce(text, '') FROM benchmark) GROUP BY 1),
features AS (SELECT text, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM texts),
per AS (SELECT text, f, count(*) AS k FROM features GROUP BY 1, 2),
codes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM per)),
hashed AS (SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(x) // 2 + 1), lambda i: ((instr('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i]) - 1)::BIGINT)), lambda c, b: xor(tab[xor(c % 256, b) + 1], c // 256)), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM codes, crc),
per_bucket AS (SELECT text, bucket, sum(k)::BIGINT AS k FROM per JOIN hashed USING (f) GROUP BY 1, 2),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), b AS (SELECT coalesce(text, '') AS text FROM benchmark),
s AS (SELECT bucket, sum(k)::BIGINT AS s FROM d JOIN per_bucket USING (text) GROUP BY 1), t AS (SELECT bucket, sum(k)::BIGINT AS t FROM b JOIN per_bucket USING (text) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT text, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS total FROM per_bucket JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
  ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || sha256(text))), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (text)),
final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score, n_features >= {2 * LEAST_WORDS - 1} AS fits FROM scored),
placed AS (SELECT *, row_number() OVER (ORDER BY fits DESC, score DESC, doc_id NULLS LAST) AS place FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= (SELECT {PERCENT} * count(*) // 100 FROM final WHERE fits) THEN place END AS rank FROM placed
"""
