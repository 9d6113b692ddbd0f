"""URL lists: one URL a line; blank lines and lines that begin with # don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.domains import url_domain
from webstrata.functions.scalar import allowed_target, normalized_url


def lines(text: DataFrame) -> DataFrame:
    t = F.trim("value")
    return text.select(t.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """line, url (null where invalid), domain, and whether it may be fetched."""
    return described(lines(spark.read.text(path)))


def described(rows: DataFrame) -> DataFrame:
    return rows.withColumn("url", normalized_url("line")).withColumn("domain", url_domain("url")).withColumn("allowed", F.coalesce(allowed_target("url"), F.lit(False)))


def count_urls(spark: SparkSession, path: str) -> int:
    return lines(spark.read.text(path)).count()
