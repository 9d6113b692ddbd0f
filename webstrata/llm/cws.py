"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For sample k every term draws r and c from Gamma(2, 1) and
b from the uniform distribution, all from a hash of term and k; with t = floor(ln(weight) / r + b) its value is
ln c - r * (t - b + 1), and the sample is the (term, t) of the least value. Two texts agree in a sample with a
probability equal to the generalised Jaccard similarity of their weights, so the share of equal samples estimates it.

The gamma draws come from tables of quantiles (a scalar subquery each, so plans stay small). Value and (term, t) are
packed into one long, which makes the samples plain minima that aggregate in generated code.

Rows are dealt into ranges of doc_id and, where ids repeat or are null, of the text's hash, with about as many bytes each; a
text needed by its neighbour in another range is sent there too. That one exchange serves the order, the edited texts and
all aggregates. Tasks sort and aggregate their range, which can spill.

Null text counts as empty and, like any text without words, has the fingerprint of no terms, which equals only itself;
an empty table gives an empty result; a single document is its own next; rows that repeat a doc_id are neighbours in the
order of their texts' hashes; rows of null id come last; very long texts are whole; extra columns are ignored. Rows equal in
id and text are in one range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, R_STEPS, C_STEPS = 64, 12, 16  # samples; bits of the quantile tables of r and ln c
#: Text in a range, the most ranges (tasks), and sampled rows a range. Beyond 300 GB ranges grow, to 1 GB at 100 TB; their sorts spill.
RANGE_BYTES, MOST_RANGES, SAMPLED = 3 << 20, 100_000, 20


def gamma_quantiles(bits: int) -> list[float]:
    """The quantiles of Gamma(2, 1) at the middles of 2 ** bits equal steps: roots of 1 - (1 + x) exp(-x) = u, by Newton's method."""
    out, x, n = [], 0.001, 1 << bits
    for i in range(n):
        u = (i + 0.5) / n
        for _ in range(60):
            step = (1 - (1 + x) * math.exp(-x) - u) / (x * math.exp(-x))
            x = max(x - step, x / 4)
            if abs(step) < 1e-12 * max(x, 1e-3):
                break
        out.append(x)
    return out


def tables(df: DataFrame) -> tuple[Column, Column]:
    """Scalar subqueries: arrays of r and of ln c."""
    spark = df.sparkSession
    r, c = gamma_quantiles(R_STEPS), [math.log(x) for x in gamma_quantiles(C_STEPS)]
    one = spark.createDataFrame([(r, c)], "r array<double>, c array<double>").coalesce(1)
    return one.select("r").scalar(), one.select("c").scalar()


def packed(term: Column, weight: Column, k: int, r_of: Column, c_of: Column) -> Column:
    """Value and (term, t) of one sample as a long that orders by value: 47 bits of the value, 16 of the pair."""
    h = F.xxhash64(term, F.lit(k))
    r = F.get(r_of, h.bitwiseAND(F.lit((1 << R_STEPS) - 1)).cast("int"))
    c = F.get(c_of, F.shiftrightunsigned(h, R_STEPS).bitwiseAND(F.lit((1 << C_STEPS) - 1)).cast("int"))
    b = F.shiftrightunsigned(h, R_STEPS + C_STEPS).cast("double") / float(1 << (64 - R_STEPS - C_STEPS))
    t = F.floor(weight / r + b)
    # ln c is over -6 and under 3, r under 12, ln(weight) at most 22: the sum is positive and under 128
    order = ((c - r * (t - b + 1.0) + 64.0) * float(1 << 40)).cast("long")
    # the low bits of b are spare: they name the term
    pair = F.shiftrightunsigned(h, R_STEPS + C_STEPS).bitwiseXOR(t.cast("long")).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.shiftleft(order, 16).bitwiseOR(pair)


def word_list(text: str) -> Column:
    """The words of a text, and empty strings between blanks; plain replacement and a one-letter split are faster than a pattern."""
    out = F.col(text)
    for blank in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.split(out, " ")


def range_cuts(rows: DataFrame, n: int, count: int) -> list[tuple[int, int]]:
    """About n - 1 values of (key, tie) that cut rows into ranges of about equal bytes, from a hashed sample of some SAMPLED rows a range."""
    if n < 2:
        return []
    share = min(1.0, SAMPLED * n / max(count, 1))
    picked = F.pmod(F.xxhash64("key", "tie", F.lit("cut")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = sorted(rows.where(picked).select("key", "tie", (F.octet_length("text") + 8).alias("size")).collect())
    out, held, room = [], 0, sum(r["size"] for r in sample) / n
    for key, tie, bytes_ in sample:
        if held >= room and (key, tie) != (out[-1] if out else None):
            out.append((key, tie))
            held = 0
        held += bytes_
    return out


def ordered(docs: DataFrame) -> DataFrame:
    """Rows (place, doc_id, text, edited) in ranges `place`, with their number `row` there; ghosts of neighbours stay, marked."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    size, count = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, min((size or 0) // RANGE_BYTES, MOST_RANGES))
    cuts = range_cuts(rows, n, count)
    # how many cuts a row reaches, in two steps of about the square root of their number; range 0 has the least ids
    step = max(1, round(len(cuts) ** 0.5))
    kind = "array<struct<key: bigint, tie: bigint>>"
    one = docs.sparkSession.createDataFrame([(cuts[step - 1 :: step], cuts)], f"wide {kind}, every {kind}").coalesce(1)
    wide, every = one.select("wide").scalar(), one.select("every").scalar()
    reached = lambda x: F.size(F.filter(x, lambda c: F.struct("key", "tie") >= c))
    rows = rows.select("*", wide.alias("wide"), every.alias("every")).withColumn("wide", reached(F.col("wide")))
    rows = rows.withColumn("place", F.col("wide") * step + reached(F.slice("every", F.col("wide") * step + 1, step))).drop("wide", "every")
    # each range's first row is the next of the last row of the range above, and the very first that of the very last
    tops = sorted((r["place"], r["top"]["key"], r["top"]["tie"]) for r in rows.groupBy("place").agg(F.max(F.struct("key", "tie")).alias("top")).collect())
    target = [(key, tie, tops[(i + 1) % len(tops)][0]) for i, (_, key, tie) in enumerate(tops)]
    ghosts = docs.sparkSession.createDataFrame(target, "key long, tie long, above int")  # a row a range
    both = rows.join(F.broadcast(ghosts), ["key", "tie"], "left")
    own, other = (F.struct(at.alias("at"), F.lit(g).alias("ghost")) for at, g in ((F.col("place"), False), (F.col("above"), True)))
    both = both.withColumn("to", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, other))))
    return both.select(F.col("to.at").alias("place"), F.col("to.ghost").alias("ghost"), "doc_id", "key", "text", "tie").repartition(max(n, 1), "place")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    rows = ordered(docs)
    order = Window.partitionBy("place").orderBy("ghost", F.desc("key"), F.desc("tie"), "doc_id")
    rows = rows.select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    rows = rows.select("place", "row", "ghost", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    # every text is a row from here on; a ghost is needed for its own fingerprint only
    texts = rows.select("place", "row", F.explode(F.expr("if(ghost, array(struct(0 AS version, text AS body)), array(struct(0 AS version, text AS body), struct(1 AS version, edited AS body)))")).alias("v"))
    words = texts.select("place", "row", "v.version", F.explode(word_list("v.body")).alias("word"))
    # empty strings are a term without weight, which no sample takes; so every text has a row
    term = F.when(F.col("word") != "", F.xxhash64("word"))
    weights = words.groupBy("place", "row", "version", term.alias("term")).agg(F.count("*").cast("double").alias("n"))
    weights = weights.select("place", "row", "version", "term", F.when(F.col("term").isNotNull(), F.ln("n")).alias("weight"))
    r_of, c_of = tables(docs)
    weights = weights.select("*", r_of.alias("r_of"), c_of.alias("c_of"))  # one subquery each, not one a sample
    least = [F.min(packed(F.col("term"), F.col("weight"), k, F.col("r_of"), F.col("c_of"))).alias(f"m{k}") for k in range(samples)]
    minima = weights.groupBy("place", "row", "version").agg(*least)
    hexes = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"m{k}").bitwiseAND(F.lit(0xFFFF).cast("long")))), 4, "0") for k in range(samples)])
    prints = minima.select("place", "row", "version", hexes.alias("print"))
    facts = rows.select("place", "row", "ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    none = F.lit("-" * 4 * samples)
    both = prints.groupBy("place", "row").agg(F.max(F.when(F.col("version") == 0, F.col("print"))).alias("a"), F.max(F.when(F.col("version") == 1, F.col("print"))).alias("b"))
    # likenesses before the join: up to here all rows are where their range is
    follow = Window.partitionBy("place").orderBy("row")
    both = both.select("place", "row", F.coalesce("a", none).alias("fingerprint"), F.coalesce("b", none).alias("edited_fingerprint"))
    both = both.withColumn("next_fingerprint", F.lead("fingerprint").over(follow))
    near = both.select("place", "row", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next_fingerprint", samples).alias("near_next"))
    return facts.where("not ghost").join(near, ["place", "row"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    same = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return F.coalesce(total / float(samples), F.lit(0.0))
