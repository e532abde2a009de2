"""References to records that do not exist, or were not in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import hot_split_join


def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    child_key: dict[str, Column],
    parent_key: dict[str, Column],
    child_at: str,
    parent_from: str,
    parent_to: str,
    parent_table: str,
) -> DataFrame:
    """The rows of ``children`` whose parent is ``missing``, ``later`` or ``deleted``, with ``parent_table`` and ``reason``.

    Both sides' keys go into one long table tagged by side and are grouped by parent table and key
    with partial sums before the shuffle: per key, whether a parent exists, when the first came
    into force and the last went out, and the span of the children's times. Keys whose children
    may all be served are dropped there; only the others meet the children's rows again, hot keys
    by a bounded broadcast (:func:`hot_split_join`), so no key's rows come together in one task.

    ``missing``: no parent has the key. ``later``: all have ``parent_from`` after ``child_at``.
    ``deleted``: all have ``parent_to`` at or before it. A child without a time can only be
    ``missing``; a null ``parent_from`` counts as in force ever since, a null ``parent_to`` as in
    force still. Children and parents with a null part of the key are no references. Repeated rows
    give the same rows again; take distinct ids after it. Empty parents make all children missing.
    The children's other columns stay, but for any of their own named parent_table or reason.
    """
    names = list(child_key)
    set_ = lambda ks: [F.col(k).isNotNull() for k in ks]
    kids = children.select(F.struct(*children.columns).alias("_row"), F.col(child_at).alias("_at"), *[c.alias(f"_k_{n}") for n, c in child_key.items()])
    keys = [f"_k_{n}" for n in names]
    for c in set_(keys):
        kids = kids.where(c)
    elders = parents.select(*[c.alias(f"_k_{n}") for n, c in parent_key.items()], F.col(parent_from).alias("_from"), F.col(parent_to).alias("_to"))
    for c in set_(keys):
        elders = elders.where(c)
    none = F.lit(None).cast("timestamp_ntz")
    tag = F.lit(parent_table).alias("parent_table")
    time = lambda c: F.col(c).cast("timestamp_ntz")
    ever = lambda text: F.lit(text).cast("timestamp_ntz")
    long = elders.select(
        tag, *keys, F.lit(1).alias("_parent"), F.coalesce(time("_from"), ever("0001-01-01 00:00:00")).alias("_from"),
        F.coalesce(time("_to"), ever("9999-12-31 23:59:59.999999")).alias("_to"), F.lit(0).alias("_kids"), none.alias("_at"),
    ).unionByName(
        kids.select(tag, *keys, F.lit(0).alias("_parent"), none.alias("_from"), none.alias("_to"), F.lit(1).alias("_kids"), time("_at").alias("_at"))
    )
    groups = long.groupBy("parent_table", *keys).agg(
        F.max("_parent").alias("_parent"), F.min("_from").alias("_first"), F.max("_to").alias("_last"),
        F.sum("_kids").alias("_kids"), F.min("_at").alias("_min_at"), F.max("_at").alias("_max_at"),
    )
    suspect = groups.where("_kids > 0 and (_parent = 0 or _min_at < _first or _max_at >= _last)")
    total = children.count()
    back = hot_split_join(kids, suspect.select(*keys, "parent_table", "_parent", "_first", "_last", "_kids"), keys, "_kids", total)
    at = time("_at")
    reason = F.when(F.col("_parent") == 0, "missing").when(F.col("_first") > at, "later").when(F.col("_last") <= at, "deleted")
    kept = [c for c in children.columns if c not in ("parent_table", "reason")]
    return back.withColumn("_reason", reason).where("_reason is not null").select(*[F.col("_row")[c].alias(c) for c in kept], "parent_table", F.col("_reason").alias("reason"))
