"""Whole exports: nested rows are those of the tables, and lines are read and sent once."""

import duckdb
import pytest

import __spark_entry__ as entry
from webstrata.operators import export
from webstrata.plans import exports, nested
from webstrata.plans.bridge import Star

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Secrets of neighbouring orders that share an id, an order of over 400 lines, repeated lines, lines without part or supplier."""
    out, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in "region nation customer supplier orders".split():
        con.sql(f"COPY (FROM '{DATA}/{t}.parquet') TO '{out}/{t}.parquet'")
    con.sql(f"COPY (FROM '{DATA}/part.parquet' UNION ALL SELECT * REPLACE (p_partkey + 1000000 AS p_partkey, p_size + 1 AS p_size) FROM '{DATA}/part.parquet') TO '{out}/part.parquet'")
    con.sql(f"""COPY (FROM '{DATA}/lineitem.parquet' UNION ALL SELECT * REPLACE (l_orderkey - 1 AS l_orderkey, l_partkey + 1000000 AS l_partkey) FROM '{DATA}/lineitem.parquet' WHERE l_orderkey % 3 = 0 AND l_orderkey > 0
      UNION ALL FROM '{DATA}/lineitem.parquet' WHERE l_orderkey % 50 = 1 UNION ALL SELECT * REPLACE (l_partkey + 77777777 AS l_partkey) FROM '{DATA}/lineitem.parquet' WHERE l_orderkey % 40 = 1
      UNION ALL SELECT * REPLACE (l_suppkey + 999999 AS l_suppkey) FROM '{DATA}/lineitem.parquet' WHERE l_orderkey % 40 = 2 UNION ALL SELECT * REPLACE (7 AS l_orderkey) FROM (FROM '{DATA}/lineitem.parquet' LIMIT 450)) TO '{out}/lineitem.parquet'""")
    return str(out)


def lines_of(rows):
    return sorted(r[0] for r in export.json_lines(rows).collect())


def test_nested_rows_are_those_of_tables(spark, odd):
    t = Star(spark, odd)
    ours, want = lines_of(exports.whole(t)), lines_of(export.wide(exports.tables(t)))
    assert len(ours) > 700 and ours == want
    assert any(x.count('"jwt_claims":{') > 1 for x in ours)


@pytest.mark.parametrize("name", ["export_jsonl", "export_parquet", "export_csv"])
def test_lines_are_read_and_sent_once(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("SortMergeJoin") == 0


def test_a_json_line_is_read_back_once(spark):
    plan = entry.queries()["export_jsonl"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan


def test_of_a_nested_satellite_a_row_has_the_first(spark, monkeypatch):
    monkeypatch.setattr(export, "CAP", 2)
    facts = spark.sql("SELECT 1L AS id, 'a.example' AS final_domain, array(named_struct('flag', 1, 'tag', 't', 'value', 'z'), named_struct('flag', 2, 'tag', 's', 'value', 'y'), named_struct('flag', 0, 'tag', 's', 'value', 'x')) AS caa_records, array(named_struct('technology_name', 'N', 'technology_version', '1', 'technology_category', 'c', 'is_implied', true)) AS technologies")
    row = export.wide(export.Nested(url_status=facts)).first()
    assert [tuple(r) for r in row["caa_records"]] == [(0, "s", "x"), (2, "s", "y")] and row["caa_records_count"] == 3
    assert row["technologies"] == [] and row["technologies_count"] == 0 and row["oids"] == []
    assert export.wide(export.Nested(url_status=facts), include_implied=True).first()["technologies_count"] == 1


def test_large_lookups_give_the_same_rows(spark, odd, monkeypatch):
    """Parts and suppliers that are too many to go to every task are joined by their keys."""
    want = lines_of(exports.whole(Star(spark, odd)))
    monkeypatch.setattr(nested, "FEW", 0)
    monkeypatch.setattr(nested, "LINES", 1000)
    assert lines_of(exports.whole(Star(spark, odd))) == want
