"""Differences by signed cells: unpivot rows to (key, field, value), sum signs, keep what is left.

Each row of one side becomes one cell per field with sign +1, each row of the other side with
sign -1, and a marker cell says that the key is there. In the sum over equal cells, what both
sides have cancels. A key whose marker does not cancel is on one side only; else the fields with
cells left over are the ones that differ. Null is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\x00key"


def uncancelled(rows: DataFrame, keys: list[str], fields: list[str], sign: str) -> DataFrame:
    """``keys``, ``only`` (sum of the marker's signs) and ``fields`` (sorted names that differ) of each key that differs.

    ``rows`` holds both sides, one row a key and side at most, with ``sign`` +1 or -1. If ``rows``
    is hash-partitioned on ``keys``, as after a groupBy on them, no row is shuffled here.
    """
    cells = rows.select(
        *keys,
        F.col(sign).alias("_sign"),
        F.explode(
            F.array(
                F.struct(F.lit(MARK).alias("field"), F.lit(None).cast("string").alias("value")),
                *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields],
            )
        ).alias("_cell"),
    )
    sums = cells.groupBy(*keys, F.col("_cell.field").alias("_field"), F.col("_cell.value").alias("_value")).agg(F.sum("_sign").alias("_n"))
    return (
        sums.where("_n != 0")
        .groupBy(*keys)
        .agg(
            F.coalesce(F.max(F.when(F.col("_field") == MARK, F.col("_n"))), F.lit(0)).alias("only"),
            F.array_sort(F.collect_set(F.when(F.col("_field") != MARK, F.col("_field")))).alias("fields"),
        )
    )
