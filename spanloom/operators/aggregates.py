"""Aggregations of index data: collisions, modes, set relations, rates, ladders, folded duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(df: DataFrame, keys: list[str], total: str, first: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the sum of ``total`` and the ``first`` columns of the least row by ``order`` and ``first``."""
    row = F.struct(*order, *first)
    return df.groupBy(*keys).agg(F.sum(total).alias(total), F.min(row).alias("_f")).select(*keys, total, *[F.col("_f")[c].alias(c) for c in first])


def mode_first(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent ``value`` of each key; of equally frequent ones the one met first by ``position``. Nulls don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_p"))
    return counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_p"))).alias("_m")).select(*keys, F.col("_m")[value].alias(value), F.col("_m.n").alias("n"))


def collisions(df: DataFrame, value: str, expression: Column) -> DataFrame:
    """Values that stand for several base expressions: ``value`` and the number of distinct ``bases``, two or more."""
    return df.select(value, expression.alias("_b")).where("_b is not null").groupBy(value).agg(F.countDistinct("_b").alias("bases")).where("bases >= 2")


def set_relation(a: Column, b: Column) -> Column:
    """How two sets relate: equal, subset, superset, overlap or disjoint; null counts as empty."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    only_a, only_b = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    return (
        F.when((only_a == 0) & (only_b == 0), "equal").when(only_a == 0, "subset").when(only_b == 0, "superset")
        .when(F.arrays_overlap(a, b), "overlap").otherwise("disjoint")
    )


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` to six digits, 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many keys have how many distinct values."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).groupBy("n_values").agg(F.count(F.lit(1)).alias("n_keys"))


def value_set_status(kinds: Column, values: Column) -> Column:
    """The status of a group of facts by its kinds and number of distinct values."""
    has = lambda k: F.array_contains(kinds, k)
    return (
        F.when(F.size(kinds) == 0, "NO_TARGET").when((F.size(kinds) == 1) & has("EXTERNAL"), "EXTERNAL")
        .when((values == 1) & has("RESOLVED") & ~has("RUNTIME") & ~has("UNRESOLVED"), "RESOLVED")
        .when((values > 1) | has("RUNTIME"), "RUNTIME").otherwise("UNRESOLVED")
    )


def latest(df: DataFrame, keys: list[str], order: list[Column], out: list[str]) -> DataFrame:
    """The row of each key that is first by ``order``; ``order`` should end with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*keys, *out)
