"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.signed_cells import uncancelled


def copy_differences(
    df: DataFrame, key: str, side: str, sides: tuple[str, str], order: str, fields: dict[str, Column],
) -> DataFrame:
    """One row per key and difference: ``only_<side>`` or the name of a field that differs.

    ``df`` holds both copies; ``side`` says whose a row is. Of several deliveries of a key by one
    side the one with the greatest ``order`` holds (null is least; ties: the greatest fields).
    ``fields`` maps each compared field to its comparable form. Rows of other sides are ignored.

    One shuffle: the deliveries are reduced before it to one row per key and side, so that a key
    delivered very often is no hot group, and all later grouping is local to the key's partition.

    Nulls: a null key is a key like others; null fields are equal to null. An empty table gives no
    rows. Columns that are not named are not read. Result: ``key``, ``difference``, distinct.
    """
    held = F.struct(F.col(order).alias("_at"), *[c.cast("string").alias(f) for f, c in fields.items()])
    a, b = sides
    latest = (
        df.where(F.col(side).isin(a, b))
        .select(F.col(key).alias("_key"), F.col(side).alias("_side"), held.alias("_row"))
        .groupBy("_key")
        .agg(F.max(F.when(F.col("_side") == a, F.col("_row"))).alias("_a"), F.max(F.when(F.col("_side") == b, F.col("_row"))).alias("_b"))
    )
    rows = latest.select(
        "_key",
        F.explode(F.array(F.struct(F.col("_a").alias("row"), F.lit(1).alias("sign")), F.struct(F.col("_b").alias("row"), F.lit(-1).alias("sign")))).alias("_s"),
    ).where("_s.row is not null")
    rows = rows.select("_key", F.col("_s.sign").alias("_sign"), *[F.col("_s.row")[f].alias(f) for f in fields])
    left = uncancelled(rows, ["_key"], list(fields), "_sign")
    what = F.when(F.col("only") > 0, F.array(F.lit(f"only_{a}"))).when(F.col("only") < 0, F.array(F.lit(f"only_{b}"))).otherwise(F.col("fields"))
    return left.select(F.col("_key").alias(key), F.explode(what).alias("difference"))
