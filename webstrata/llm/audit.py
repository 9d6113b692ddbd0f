"""An audit of how text filters interact: what each removes alone, in every order, and on average over the orders.

Five filters: A few words, B few distinct words, C many capitals, D symbols, E a text that a smaller id has. One scan of the
Arrow buffers counts words, capitals, symbols and code points by byte classes and prefix sums; distinct words are counted by
hashes sorted within a document and compared byte by byte where equal (a document in which two words share a hash is counted
again by its words). Each document's failures are a mask of five bits. Texts leave that scan as SHA-256 digests: E compares
digests, first within groups of equal rows, so a text that a third of all rows have is a few rows when it is compared.
Masks are counted by part and label, and every order is read off these counts.

Null text is empty; a null language and an empty one are the part ''; a null id has no smaller id, so it doesn't fail E and
has no labels; rows of one id and text don't fail E by each other; a document counts as good or toxic if any label row of its
id says so; very long texts are scanned in pieces; an empty table gives no rows; other columns are ignored, whatever their
names. Each part has all 600 rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .scan import BETWEEN_SPACE, byte_table, distinct_words, pieces, texts_of, word_hashes

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words, per cent of words, per cent of code points
CAPITALS, POINTS = byte_table((65, 90)), ~byte_table((0x80, 0xBF))
SYMBOLS = byte_table(*((ord(c), ord(c)) for c in "#$%&*|"))


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each row."""
    data, at = texts_of(column)
    out = {k: np.zeros(len(at) - 1, "i8") for k in ("words", "distinct", "capitals", "symbols", "points")}
    long: dict[int, list[tuple[np.ndarray, ...]]] = {}  # a long text's distinct words, part by part
    for p in pieces(data, at, BETWEEN_SPACE):
        rows = slice(p.first, p.first + len(p.at) - 1)
        for name, marked in (("capitals", CAPITALS), ("symbols", SYMBOLS), ("points", POINTS)):
            out[name][rows] += p.counts(marked)
        starts, ends, row = p.words(BETWEEN_SPACE)
        out["words"][rows] += np.bincount(row, minlength=len(p.at) - 1)
        hashes = word_hashes(p.data, starts, ends)
        one, doubtful = distinct_words(p.data, starts, ends, row, hashes)
        if len(p.data) < at[p.first + 1] - at[p.first]:
            place = p.place + starts
            some = np.arange(len(starts)) if len(doubtful) else one
            long.setdefault(p.first, []).append((place[some], p.place + ends[some], hashes[some]))
            continue
        out["distinct"][rows] = np.bincount(row[one], minlength=len(p.at) - 1)
        for r in doubtful.tolist():
            out["distinct"][p.first + r] = len(set(bytes(p.data[p.at[r] : p.at[r + 1]]).split()))
    for r, parts in long.items():
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        one, doubtful = distinct_words(data, starts, ends, np.zeros(len(starts), "i8"), hashes)
        out["distinct"][r] = len(set(bytes(data[at[r] : at[r + 1]]).split())) if len(doubtful) else len(one)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row: id, part, n_words, n_distinct, n_capitals, n_symbols, n_chars, the failures of A to D as bits, SHA-256 of the text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column(2))
            fails = (m["words"] < LEAST_WORDS, 100 * m["distinct"] < LEAST_DISTINCT * m["words"], 100 * m["capitals"] > MOST_CAPITALS * m["points"], m["symbols"] > 0)
            mask = sum(f.astype("i4") << i for i, f in enumerate(fails))
            data, at = texts_of(batch.column(2))
            digests = pa.array([hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(m[k]) for k in ("words", "distinct", "capitals", "symbols", "points")), pa.array(mask, pa.int32()), digests], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ["id", "part", "n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars", "mask", "digest"]
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part string, n_words long, n_distinct long, n_capitals long, n_symbols long, n_chars long, mask int, digest binary")


def with_copies(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts n of rows (id, digest, mask and keys) by keys and mask, where bit 4 of mask is now set for texts that a smaller id has.

    Equal rows are counted together first, then ids of a text by keys, so only a few rows a text meet at its least id."""
    group = ["digest", "mask", *keys]
    by_id = rows.groupBy("id", *group).agg(F.count("*").alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    by_text = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min(named).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    ours = F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    counted = by_text.withColumn("first", first).withColumn("ours", ours)
    kinds = F.array(F.struct(F.col("mask").alias("mask"), F.col("ours").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("ours")).alias("n")))
    return counted.select(*keys, F.explode(kinds).alias("k")).where("k.n > 0").groupBy(*keys, "k.mask").agg(F.sum("k.n").alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (id, ...) with good and toxic. Null ids match nothing and are spread over all tasks."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).withColumn("label_salt", F.lit(0))
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), (F.monotonically_increasing_id() % 4096 + 1).cast("int")).otherwise(0))
    key = F.when(F.col("salt") == 0, F.col("id")).otherwise(F.lit(0))
    joined = salted.withColumn("key", key).join(known, (F.col("key") == F.col("label_id")) & (F.col("salt") == F.col("label_salt")), "left")
    return joined.select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def order_table() -> list[tuple]:
    """For each order, step and mask: whether documents of the mask are kept after the step, removed in it, or removed before and failing it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order, 1):
            before = sum(1 << x for x in order[: step - 1])
            for mask in range(1 << len(FILTERS)):
                fails, gone = mask >> f & 1, int(mask & before > 0)
                share = 120 // mask.bit_count() if fails else 0  # of the orders, those in which this filter comes first among the failing
                out.append((name, step, mask, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(mask == 1 << f), share))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    Four exchanges, all of rows of about 60 bytes; no text is shuffled."""
    facts = with_labels(scan(docs).select("id", "part", "mask", "digest"), labels)
    by_mask = with_copies(facts, "part", "good", "toxic").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    # 120 orders x 5 steps x 32 masks, whatever the data
    orders = docs.sparkSession.createDataFrame(order_table(), "filter_order string, step int, mask int, keep int, remove int, again int, alone int, share int")
    total = lambda what, of: F.sum(F.col(what) * F.col(of)).cast("long")
    return by_mask.join(F.broadcast(orders), "mask").groupBy("part", "filter_order", "step").agg(
        total("keep", "n").alias("kept"), total("remove", "n").alias("removed"), total("again", "n").alias("redundant"), total("alone", "n").alias("unique_fails"),
        total("remove", "good").alias("good_lost"), total("remove", "toxic").alias("toxic_lost"), total("share", "n").alias("shapley"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < step THEN 1 << (ascii(filter_order[i]) - 65) ELSE 0 END)) AS before
          FROM orders, LATERAL (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT part, filter_order, step, n, good, toxic, (mask & bit::BIGINT) > 0 AS fails, (mask & before::BIGINT) > 0 AS gone, mask = bit AS alone, bit_count(mask::BIGINT) AS bits FROM c, steps)
SELECT part, filter_order, step::INTEGER AS step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN fails THEN n * 120 // bits ELSE 0 END)::BIGINT AS shapley
FROM s GROUP BY 1, 2, 3
"""
