"""Joins beyond the plain equi join: ranked fallback, completion, prefix owner, containment, as-of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fallback_join(left: DataFrame, right: DataFrame, full: list[str], short: list[str], value: str, out: str) -> DataFrame:
    """``left`` with ``out``: ``right``'s least ``value`` on all of ``full``, else that on ``short`` where it has exactly one row.

    Each rule is an equi join of its own on pre-aggregated keys, so ``left`` keeps its rows and no
    OR condition stands in the way of hashing. Null keys match nothing.
    """
    exact = right.groupBy(*full).agg(F.min(value).alias("_exact"))
    lone = right.groupBy(*short).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lone")).where("_n = 1").drop("_n")
    return left.join(exact, full, "left").join(lone, short, "left").withColumn(out, F.coalesce("_exact", "_lone")).drop("_exact", "_lone")


def completed(facts: DataFrame, inventory: DataFrame, keys: list[str], **defaults: Column) -> DataFrame:
    """``facts`` and, for each row of ``inventory`` whose key no fact has, a row with ``defaults`` (null elsewhere)."""
    cond = reduce(lambda a, k: a & inventory[k].eqNullSafe(facts[k]), keys, F.lit(True))
    lacking = inventory.join(facts.select(*keys).distinct(), cond, "left_anti") if not keys else inventory.join(facts.select(*keys).distinct(), keys, "left_anti")
    return facts.unionByName(lacking.select(*keys, *[c.alias(n) for n, c in defaults.items()]), allowMissingColumns=True)


def longest_prefix(paths: DataFrame, path: str, roots: DataFrame, root: str, out: str) -> DataFrame:
    """``paths`` with ``out``: the longest of ``roots`` that is the path or a folder above it, else null.

    A path's folders are exploded and met by an equi join, so no path is compared with all roots.
    ``paths`` must be distinct on ``path``.
    """
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = paths.where(F.col(path).isNotNull()).select(path, F.explode(heads).alias("_r")).join(roots.select(F.col(root).alias("_r")).distinct(), "_r")
    best = hit.groupBy(path).agg(F.max_by("_r", F.length("_r")).alias(out))
    return paths.join(best, path, "left")


def containing(points: DataFrame, intervals: DataFrame, key: str, point: str, start: str, end: str, bucket: int = 64) -> DataFrame:
    """Inner join of each point with the intervals of its ``key`` that contain it (both ends belong).

    Intervals are cut into buckets and met by an equi join on (key, bucket), so a key with many
    points and intervals is no nested loop. Null or reversed bounds contain nothing.
    """
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("int"), F.floor(F.col(end) / bucket).cast("int")))
    )
    at = points.withColumn("_b", F.floor(F.col(point) / bucket).cast("int"))
    return at.join(spans, [key, "_b"]).where(F.col(point).between(F.col(start), F.col(end))).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, out: str) -> DataFrame:
    """``left`` with ``out``: ``right``'s ``value`` (not null) of the greatest ``right_at`` before or at ``at`` within ``keys``, else null.

    One union and one window, no pairs. Ties on the right: the greatest value. Left columns stay.
    """
    cols = left.columns
    kind = right.schema[value].dataType
    tagged = left.withColumns({"_at": F.col(at), "_v": F.lit(None).cast(kind), "_side": F.lit(1)}).unionByName(
        right.select(*keys, F.col(right_at).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, out)


def ranked_match(left: DataFrame, key: str, rules: list[tuple[DataFrame, list[str]]], value: str, out: str) -> DataFrame:
    """``left`` with ``out`` from the first of ``rules`` (a table and its join keys) that has a match; ties: the least value."""
    for i, (table, keys) in enumerate(rules):
        left = left.join(table.groupBy(*keys).agg(F.min(value).alias(f"_m{i}")), keys, "left")
    names = [f"_m{i}" for i in range(len(rules))]
    return left.withColumn(out, F.coalesce(*names)).drop(*names)
