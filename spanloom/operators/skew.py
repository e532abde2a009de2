"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A broadcast table may have so many rows at most; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000
#: Joins of so many rows fit one task even if they all have one key.
ONE_TASK_ROWS = 200_000


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its proven number of rows, ``rows``, is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def null_safe_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """The condition that all ``keys`` are equal, null being equal to null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def hot_split_join(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, total: int, slots: int = 512) -> DataFrame:
    """Inner join of many ``rows`` with one ``per_key`` row a key; hot keys are never shuffled.

    ``size`` is the column of ``per_key`` with the number of ``rows`` of its key and ``total`` the
    number of all rows. A key with more than ``total / slots`` rows is hot; there are fewer than
    ``slots`` of these, whatever the data, so their ``per_key`` rows are broadcast and their
    ``rows`` joined where they lie. The others are joined by a shuffle in which no key is hot.
    Within ``ONE_TASK_ROWS`` rows no key can be hot, and the join is a plain one. Keys must not be null. ``size`` is not returned.
    """
    if total <= ONE_TASK_ROWS:
        return rows.join(per_key.drop(size), keys)
    least = max(1, total // slots)
    hot = F.broadcast(per_key.where(F.col(size) > least).drop(size))
    cold = per_key.where(F.col(size) <= least).drop(size)
    in_hot = rows.join(hot, keys)
    rest = rows.join(F.broadcast(per_key.where(F.col(size) > least).select(*keys)), keys, "left_anti")
    return in_hot.unionByName(rest.join(cold, keys))
