"""Joins: star join of per-key blocks (J-02), lookup join with default (J-04),
and a broadcast helper that only broadcasts a side of *measured* size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound on rows for an explicit broadcast hint; larger sides are left to
# the planner (sort-merge join, or an AQE runtime broadcast from real sizes).
BROADCAST_MAX_ROWS = 2_000_000


def star_join(base: DataFrame, parts: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """J-02: chained left joins on one key. Parts are aggregated per key (1 row per key),
    so output row count equals ``base`` row count and no join can fan out."""
    out = base
    for p in parts:
        out = out.join(p, key, "left")
    return out


def join_groups(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of ``left`` with the columns of their group's row in ``right`` (one row a group).

    A NULL group is a group like any other. Without groups ``right`` is one row, whose values are scalar subqueries of a
    projection: no join, and no row of ``left`` moves."""
    groups = list(groups)
    if not groups:
        one = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_one")).scalar()
        return left.withColumn("_one", one).select(*[f"`{c}`" for c in left.columns], *[F.col("_one")[c].alias(c) for c in right.columns])
    names = {c: f"_r_{c}" for c in groups}
    same = [left[c].eqNullSafe(F.col(r)) for c, r in names.items()]
    return left.join(bounded_broadcast(right.withColumnsRenamed(names)), same, how).drop(*names.values())


def bounded_broadcast(df: DataFrame, bound: int | None = None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast only a side whose size is checked.

    * ``bound`` given (a row bound that holds by construction, e.g. a fixed
      grid or one row per model) and within ``max_rows``: explicit hint.
    * otherwise no hint: the side is an aggregate behind a shuffle, and
      adaptive execution measures its materialized size at run time and turns
      the join into a broadcast only when it is under
      ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond that the
      sort-merge join stays. No extra job recomputes the side to count it.
    """
    if bound is not None and bound <= max_rows:
        return F.broadcast(df)
    return df


def measured_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Eager variant for an already materialized (checkpointed / cached) table: count, then hint."""
    return F.broadcast(df) if df.count() <= max_rows else df


def lookup_join(df: DataFrame, mapping: DataFrame, on: str | Sequence[str] | Column,
                value_col: str, default, out_col: str | None = None) -> DataFrame:
    """J-04: left join to a dictionary table; unmatched rows get ``default`` (N14)."""
    m = bounded_broadcast(mapping)
    joined = df.join(m, on, "left")
    return joined.withColumn(out_col or value_col, F.coalesce(F.col(value_col), F.lit(default)))
