import duckdb
from pyspark.sql import functions as F

from webstrata.llm import mixing as M


def table(spark, n=4000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.expr("if(id % 11 = 0, null, repeat('ab ', cast(id % 50 as int)))").alias("text"), F.expr("case when id % 3 = 0 then 'big' when id % 50 = 1 then 'tiny' when id % 7 = 0 then null else 'mid' end").alias("source"), F.lit("x").alias("copy_"))


def test_matches_sql(spark):
    got = sorted((r.doc_id, r.source or "", r.copy, r.order_key) for r in M.query(table(spark)).collect())
    con = duckdb.connect()
    con.register("documents", table(spark).toPandas())
    want = con.sql(M.SQL).fetchall()
    assert got == sorted((a, b or "", c, d) for a, b, c, d in want)


def test_weights_and_order(spark):
    docs = table(spark, 40_000)
    out = M.mix(docs, {"big": 0.5, "mid": 0.5}, epochs=2.0).select("source", F.octet_length("text").alias("n"), "order_key").collect()
    mass = {}
    for r in out:
        mass[r.source] = mass.get(r.source, 0) + (r.n or 0)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert set(mass) == {"big", "mid"} and abs(mass["big"] / total - 1) < 0.05 and abs(mass["mid"] / total - 1) < 0.05
    assert [r.order_key for r in out] == sorted(r.order_key for r in out)


def test_odd(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    df = spark.createDataFrame([(None, "a b", None), (1, None, "s"), (1, "", "s")], "doc_id long, text string, source string")
    assert all(r.copy >= 1 for r in M.mix(df, epochs=8.0).collect())


def test_clashing_columns(spark):
    docs = table(spark, 300)
    want = sorted((r.doc_id, r.copy, r.order_key) for r in M.mix(docs).collect())
    df = docs.withColumns({c: F.lit("x") for c in ("rate", "cdf", "copy", "source_key", "order_key", "weight", "mass")})
    got = M.mix(df)
    assert set(got.columns) == set(df.columns) and sorted((r.doc_id, r.copy, r.order_key) for r in got.collect()) == want


def test_internal_names_stay(spark):
    docs = table(spark, 200)
    names = ["_source", "_u", "_source_key", "_cdf", "row", "name", "u", "cdf", "source_key"]
    got = M.mix(docs.withColumns({c: F.lit(c) for c in names}))
    assert sorted((r.doc_id, r.copy, r.order_key) for r in got.collect()) == sorted((r.doc_id, r.copy, r.order_key) for r in M.mix(docs).collect())
    assert all(r[c] == c for r in got.limit(5).collect() for c in names)


def test_weights_of_nothing(spark):
    """Weights that are all zero, or that name no present source, draw nothing."""
    docs = table(spark, 200)
    for weights in ({"big": 0.0, "mid": 0.0}, {"elsewhere": 1.0}, {"big": 0.0, "elsewhere": 2.0}):
        assert M.mix(docs, weights).count() == 0
    assert {r.source for r in M.mix(docs, {"mid": 1.0, "big": 0.0}, epochs=3.0).collect()} == {"mid"}


def test_null_ids_draw_one_by_one(spark):
    """Rows without an id are told apart by their texts: Poisson counts and keys of their own."""
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text of a row "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    rows = M.mix(docs, epochs=2.0).groupBy("text").agg(F.count("*").alias("n")).collect()
    counts = [r.n for r in rows] + [0] * (400 - len(rows))
    mean = sum(counts) / 400
    assert 1.7 < mean < 2.3 and 1.4 < sum((c - mean) ** 2 for c in counts) / 400 < 2.7 and {0, 1, 2, 3, 4} <= set(counts)
    keys = [r.order_key for r in M.mix(docs, epochs=2.0).collect()]
    assert len(set(keys)) == len(keys) == sum(counts)
    repeated = docs.withColumn("doc_id", F.lit(7).cast("long"))
    assert len({r.text: r for r in M.mix(repeated, epochs=2.0).collect()}) < 400


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 400_000, "a"), (2, "short", "b")], "doc_id long, text string, source string")
    got = M.mix(df, {"a": 1.0, "b": 0.00001}).groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    assert {r.source: r.n for r in got}.get("a", 2_000_000) % 2_000_000 == 0
