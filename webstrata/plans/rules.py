"""Queries over rule packs on whole answers: every channel of technologies, and every way in which a secret rule lets go.

Headers, cookies, records, certificates, scripts and lines of the pages are built from page_id and stand beside or behind the
page's own markup; the SQL says from page_id what has to come out, without a rule pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import extract, secrets, tech
from webstrata.plans.bridge import say
from webstrata.sources.rules import STRICT_END, secret_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(plan):
        QUERIES[name] = lambda spark, sf_dir: plan(spark.read.parquet(f"{sf_dir}/pages.parquet"), F.col("page_id"))
        SQL[name] = sql
        return plan

    return add


@query("page_channels", """WITH t AS (SELECT page_id, page_id % 2 = 0 AS head, page_id % 3 < 2 AS cookie, page_id % 5 = 0 AS script, page_id % 7 = 0 AS dns, page_id % 11 = 0 AS cert, page_id % 13 = 0 AS ext FROM pages)
SELECT page_id, 'Sample Server' AS technology_name, '1.' || page_id AS technology_version, 'Web servers' AS technology_category, false AS is_implied FROM t WHERE head
UNION ALL SELECT page_id, 'Sample Language', CASE WHEN head THEN '8' END, 'Programming languages', NOT cookie FROM t WHERE head OR cookie
UNION ALL SELECT page_id, 'Sample Widgets', CASE WHEN ext THEN '2.' || page_id END, 'JavaScript libraries', false FROM t WHERE script OR ext
UNION ALL SELECT page_id, 'Sample Counter', NULL, 'Analytics', false FROM t WHERE dns OR cert""")
def _(p, k):
    """Headers, cookies (by name and by the beginning of a name), script ids, DNS records, certificate issuers and external scripts."""
    none = F.lit(None).cast("map<string,string>")
    rows = extract.parsed(p.select(
        "page_id", "url", F.concat("html", F.when(k % 5 == 0, '<script id="Sample-Widgets"></script>').otherwise("")).alias("html"),
        F.when(k % 2 == 0, F.create_map(F.lit("SERVER"), say("Sampled/1.", k))).otherwise(none).alias("h"),
        F.when(k % 3 == 0, F.create_map(F.lit("SampleSession"), F.lit("x"))).when(k % 3 == 1, F.create_map(say("smp_", k), F.lit(""))).otherwise(none).alias("c"),
        F.when(k % 7 == 0, F.create_map(F.lit("TXT"), say("Sample-Counter-Site=", k))).otherwise(none).alias("d"), F.when(k % 11 == 0, say("CN=Sample Counter CA ", k)).alias("i"),
        F.when(k % 13 == 0, F.array(F.lit("none"), say('SampleWidgets.boot("2.', k, '")'))).alias("x"),
    ))
    return tech.technologies_of(rows, headers="h", cookies="c", dns="d", issuer="i", external="x")


#: A pack of invented rules, one for each way in which rules find and let go.
PACK = f"""
[allowlist]
regexes = ['^999']
stopwords = ["forbidden"]
[[rules]]
id = "widened-end"
regex = '''(alp_[0-9a-z]{{6,40}}){STRICT_END}'''
keywords = ["alp_"]
[[rules]]
id = "whole-line"
regex = '''bet_[0-9]+'''
keywords = ["BET_"]
[[rules.allowlists]]
regexTarget = "line"
regexes = ['^ignored line ']
[[rules]]
id = "both-needed"
regex = '''gam_([a-z]+)([0-9]+)'''
secretGroup = 2
keywords = ["gam_", "never"]
[[rules.allowlists]]
condition = "AND"
regexes = ['7$']
stopwords = ["1"]
[[rules]]
id = "stopword-for-all"
regex = '''del_(\\w+)'''
keywords = ["del_"]
[[rules]]
id = "whole-match"
regex = '''eps:([0-9]+):(end)'''
keywords = ["eps:"]
[[rules.allowlists]]
regexTarget = "match"
regexes = ['0:end$']
[[rules]]
id = "no-keyword"
regex = '''zet([0-9]+)zet'''
[[rules]]
id = "files-only"
regex = '''zet[0-9]+'''
path = '''\\.tf$'''
"""


@query("page_secret_rules", """WITH t AS (SELECT page_id, page_id::VARCHAR AS k, concat(html, chr(10), '<p>alp_abc', page_id, 'xyz</p>', chr(10), CASE WHEN page_id % 2 = 0 THEN 'ignored' ELSE 'kept' END, ' line ', repeat(' ', 900), 'bet_', page_id, repeat(' ', 700), chr(10), 'gam_ab', page_id, ';', chr(10), 'del_', CASE WHEN page_id % 3 = 0 THEN 'Forbidden' ELSE 'fine' END, page_id, chr(10), 'eps:', page_id, ':end', chr(10), 'zet', page_id, 'zet') AS body FROM pages),
f AS (SELECT *, 'widened-end' AS secret_type, 'alp_abc' || k || 'xyz' AS matched_value, 'alp_abc' || k || 'xyz<' AS whole FROM t
UNION ALL SELECT *, 'whole-line', 'bet_' || k, 'bet_' || k FROM t WHERE page_id % 2 = 1
UNION ALL SELECT *, 'both-needed', k, 'gam_ab' || k FROM t WHERE NOT (k LIKE '%7' AND k LIKE '%1%') AND NOT starts_with(k, '999')
UNION ALL SELECT *, 'stopword-for-all', 'fine' || k, 'del_fine' || k FROM t WHERE page_id % 3 > 0
UNION ALL SELECT *, 'whole-match', k, 'eps:' || k || ':end' FROM t WHERE page_id % 10 > 0 AND NOT starts_with(k, '999')
UNION ALL SELECT *, 'no-keyword', k, 'zet' || k || 'zet' FROM t WHERE NOT starts_with(k, '999')),
p AS (SELECT *, strpos(body, whole) - 1 AS start FROM f)
SELECT page_id, secret_type, matched_value, 'medium' AS severity, 'html_body' AS location, substr(body, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0) + length(whole) + 80) AS context FROM p""")
def _(p, k):
    lines = F.concat_ws("\n", "html", say("<p>alp_abc", k, "xyz</p>"), F.concat(F.when(k % 2 == 0, "ignored").otherwise("kept"), F.lit(" line " + " " * 900 + "bet_"), k.cast("string"), F.lit(" " * 700)), say("gam_ab", k, ";"), F.concat(F.lit("del_"), F.when(k % 3 == 0, "Forbidden").otherwise("fine"), k.cast("string")), say("eps:", k, ":end"), say("zet", k, "zet"))
    return secrets.exposed(p.select("page_id", lines.alias("body")), "page_id", "body", secret_rules(PACK))
