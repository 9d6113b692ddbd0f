"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline"))])
def test_against_duckdb(spark, con, name):
    df, want = entry.queries()[name](spark, DATA), con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


ODD_TITLES = [
    "<title>a &quot;b&quot; &amp;lt; &lt;c&gt; &amp;amp</title>", "<title>cut &amp</title>", "<title>&nbsp;&#65; \u00a0</title>", "<title>\n\tx \u3000</title>", "<title> x\r\ny </title>", "<TITLE lang='a'>X</Title>", "<title>open", "<title", "<title><title>y</title>", "<title>x</title >y</title>",
    "<!-- <title>c</title> --><title>d</title>", "<script>'<title>s</title>'</script><title>t</title>", "<svg><title>v</title></svg><title>w</title>", "<titles>z</title>", "<t\u0131tle>i</title>", "<title></title>", "", None, "no title", "<title>a</title><title>b</title>",
]


def test_titles_as_sql_reads_them(spark, tmp_path):
    rows = [(i, f"https://a.example/{i}", html) for i, html in enumerate(ODD_TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = dict(tuple(r) for r in entry.queries()["page_titles_parsed"](spark, str(tmp_path)).select("page_id", "title").collect())
    assert got == dict(con.sql(entry.oracle_sql()["page_titles_parsed"]).fetchall())
