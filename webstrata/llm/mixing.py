"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of copies that brings its share of the text's bytes to its target weight. A document's
count inverts the Poisson distribution of that mean at a uniform number hashed from doc_id, text and seed, so it can be
computed anywhere and again. Documents are exploded by their counts, and all copies are sorted by a hash: a global shuffle.

Target weights not given are in proportion to the square root of a source's bytes. Null sources are one source; sources
without text get no copies beyond a rate of one; a weight of zero, or none among those given, drops its source, so weights
of no present source give an empty result; a null id counts as the text 'null', and its rows are told apart by their texts,
as are rows that repeat an id; an empty table gives an empty result; only rows equal in id and text get the same count and
tie in the order; null text is empty; texts count, and are hashed, by all their bytes. The result's columns copy and
order_key replace columns of these names; all others, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED, EPOCHS = 17, 1.0


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """source_key, rate and cdf (the Poisson distribution function at 0, 1, ...) of each source."""
    mass = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_key")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("double").alias("mass"))
    if weights is None:
        wanted = mass.withColumn("weight", F.sqrt("mass"))
    else:
        given = docs.sparkSession.createDataFrame(sorted(weights.items()), "source_key string, weight double")
        wanted = mass.join(F.broadcast(given), "source_key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    wanted = cut(wanted)
    all_mass, all_weight = wanted.agg(F.sum("mass"), F.sum("weight")).first()
    wanted_mass = F.try_divide(F.lit(float(epochs)) * F.lit(all_mass) * F.col("weight"), F.lit(all_weight))
    rate = F.when(F.col("mass") > 0, F.coalesce(wanted_mass, F.lit(0.0)) / F.col("mass")).otherwise(F.lit(float(epochs)))
    if weights is not None:
        rate = F.when(F.col("weight") > 0, rate).otherwise(0.0)
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    start = F.struct((-F.col("rate")).alias("log_p"), F.exp(-F.col("rate")).alias("total"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.ln(F.greatest("rate", F.lit(1e-300))) - F.ln(k.cast("double"))
        total = s["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    out = wanted.select("source_key", rate.alias("rate"))
    return out.select("source_key", "rate", F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"].alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as drawn, with copy (from 1) and order_key, in the order of order_key."""
    table = cut(rates(docs, weights, epochs)).select("source_key", "cdf")
    few = table.count() <= 100_000
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    # the row travels as one struct, so its columns' names can't meet those made here
    own = [c for c in docs.columns if c.lower() not in ("copy", "order_key")]
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in own]).alias("row")
    keyed = docs.select(row, F.coalesce("source", F.lit("")).alias("source_key"), name.alias("name"), uniform(name, F.lit(str(seed))).alias("u"))
    joined = keyed.join(F.broadcast(table) if few else table, "source_key")
    # the copies' numbers: those k for which the uniform reaches the distribution function at k - 1
    numbers = F.filter(F.transform("cdf", lambda c, k: F.when(c <= F.col("u"), k + 1)), lambda k: k.isNotNull())
    drawn = joined.select("row", "name", F.explode(numbers).alias("copy"))
    key = F.md5(F.concat_ws(":", "name", F.col("copy").cast("string"), F.lit(str(seed))).cast("binary"))
    return drawn.select("row.*", "copy", key.alias("order_key")).orderBy("order_key")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "source", "copy", "order_key")


SQL = f"""
WITH mass AS (SELECT coalesce(source, '') AS source_key, coalesce(sum(strlen(text)), 0)::DOUBLE AS mass FROM documents GROUP BY 1),
rates AS (SELECT source_key, CASE WHEN mass > 0 THEN {EPOCHS} * sum(mass) OVER () * sqrt(mass) / sum(sqrt(mass)) OVER () / mass ELSE {EPOCHS} END AS rate FROM mass),
steps AS (SELECT source_key, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(rate) - ln(greatest(k, 1)) END) OVER (PARTITION BY source_key ORDER BY k)) AS p
          FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 21) AS BIGINT))) AS k)),
cdf AS (SELECT source_key, k, sum(p) OVER (PARTITION BY source_key ORDER BY k) AS f FROM steps),
lists AS (SELECT source_key, list(f ORDER BY k) AS fs FROM cdf GROUP BY 1),
named AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS name FROM documents),
drawn AS (SELECT doc_id, source, name, fs, ('0x' || substr(md5(name || ':{SEED}'), 1, 13))::BIGINT / {float(1 << 52)} AS u
          FROM named JOIN lists ON coalesce(source, '') = source_key)
SELECT doc_id, source, copy::INTEGER AS copy, md5(name || ':' || copy || ':{SEED}') AS order_key
FROM (SELECT doc_id, source, name, unnest(range(1, len(list_filter(fs, lambda f: f <= u)) + 1)) AS copy FROM drawn)
"""
