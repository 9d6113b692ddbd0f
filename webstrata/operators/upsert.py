"""Keyed upsert of observations: the latest of a key wins whole, and only its satellites live on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that is last in `order`. Rows with a null key column never conflict, so all of them stay.

    The window's rank filter becomes a group limit before the shuffle, so a hot key sends one row a task."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    ranked = rows.where(whole).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    won = ranked.where("_rank = 1").drop("_rank")
    nullable = any(rows.schema[k].nullable for k in keys)
    return won.unionByName(rows.where(~whole)) if nullable else won


def satellites_of(winners: DataFrame, satellite: DataFrame, id_col: str = "id", ref: str = "url_status_id") -> DataFrame:
    """The satellite's rows whose observation won; rows of replaced observations go, as on an upsert."""
    return satellite.join(winners.select(F.col(id_col).alias(ref)), ref, "left_semi")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-ignore: the first row of each natural key stays (null keys are equal here, as in a dedupe by coalesce)."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def merge_columns(rows: DataFrame, keys: list[str], order: list[str], updated: list[str]) -> DataFrame:
    """Insert-or-update of some columns: `updated` come from the last row of a key, all others from its first."""
    rest = [c for c in rows.columns if c not in (*keys, *updated, *order)]
    stamp = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.min_by(c, stamp).alias(c) for c in rest], *[F.max_by(c, stamp).alias(c) for c in updated]).select(*keys, *rest, *updated)


def drop_runs(rows: DataFrame, run_ids: list[str]) -> DataFrame:
    """Cascade delete: what belongs to the runs goes; tables are partitioned by run_id, so this prunes folders."""
    return rows.where(~F.coalesce(F.col("run_id"), F.lit("")).isin(run_ids))
