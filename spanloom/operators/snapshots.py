"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.signed_cells import uncancelled
from spanloom.operators.skew import sized_broadcast
from spanloom.session import Rounds


def snapshot_changes(
    runs: DataFrame, rows: DataFrame, series: list[str], run: str, at: str, size: str, key: str, fields: list[str],
) -> DataFrame:
    """Records ``added``, ``removed`` or ``changed`` between each whole snapshot and the one before it.

    ``runs`` has one row a snapshot: ``series`` and ``run`` name it, ``at`` orders the snapshots of
    a series and ``size`` is its declared number of records. ``rows`` has the records: the run's
    columns, ``key`` and ``fields``. A snapshot counts only if its distinct keys number ``size``.

    Each whole snapshot gives its rows as +1 to itself and as -1 to the next one, so one grouping
    by signed cells classifies all keys and names the fields that differ (``fields``, sorted, of
    changed records). The first snapshot of a series gives no rows of its own.

    Rows are shuffled once, by series and key, with their run as a number and long texts as 128-bit
    digests; before it only (run, key) pairs are counted. Equal digests count as equal texts.

    Defined cases: exact copies count once. A run with several rows in ``runs`` has the latest
    ``at`` (ties: greatest size). Equal ``at`` in a series are ordered by run name. Of several
    rows of a key in one snapshot the greatest holds (long texts by their digests). Null series and
    run values are values like others; rows with a null key count as a record; a null ``size`` never
    counts. Null fields equal null. Empty tables give no rows.
    """
    run_key = [*series, run]
    rounds = Rounds(runs.sparkSession)
    meta = runs.groupBy(*run_key).agg(F.max(F.struct(at, size)).alias("_m"))
    # numbered once and written, so that both passes over the rows see the same numbers
    meta = rounds.cut(meta.select(*run_key, F.col("_m")[at].alias("_at"), F.col("_m")[size].alias("_size"), F.monotonically_increasing_id().alias("_run")), rows=F.count(F.lit(1)))
    n_runs = meta.measured["rows"]

    def numbered(columns: list, numbers: DataFrame) -> DataFrame:
        right = sized_broadcast(numbers.select(*[F.col(k).alias(f"_r_{k}") for k in run_key], *[c for c in numbers.columns if c not in run_key]), n_runs)
        left = rows.select(*run_key, F.col(key).alias("_key"), *columns)
        cond = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in run_key]
        return left.join(right, cond).drop(*run_key, *[f"_r_{k}" for k in run_key])

    counted = numbered([], meta.select(*run_key, "_run")).distinct().groupBy("_run").agg(F.count(F.lit(1)).alias("_n"))
    whole = meta.join(counted, "_run").where("_n = _size")
    one = Window.partitionBy(*series)
    w = one.orderBy(F.col("_at").asc_nulls_first(), F.col(run))
    own = F.when(F.lag("_run").over(w).isNotNull(), F.col("_run"))
    linked = whole.select(*run_key, "_run", F.min("_run").over(one).alias("_series"), own.alias("_own"), F.lead("_run").over(w).alias("_next"))
    linked = rounds.cut(linked.where("_own is not null or _next is not null"))
    kinds = dict(rows.dtypes)
    short = lambda c: F.when(F.octet_length(c) < 16, F.col(c).cast("binary")).otherwise(F.unhex(F.md5(c))) if kinds[c] == "string" else F.col(c)
    placed = numbered([short(f).alias(f"_f{i}") for i, f in enumerate(fields)], linked).repartition("_series", "_key")
    # from here on all grouping is local to the partition of (series, key)
    held = placed.groupBy("_series", "_run", "_own", "_next", "_key").agg(F.max(F.struct(*[f"_f{i}" for i in range(len(fields))])).alias("_row"))
    parts = F.array(F.struct(F.col("_own").alias("to"), F.lit(1).alias("sign")), F.struct(F.col("_next").alias("to"), F.lit(-1).alias("sign")))
    signed = held.select("_series", F.explode(parts).alias("_p"), "_key", "_row").where("_p.to is not null").select(
        "_series", F.col("_p.to").alias("_to"), "_key", F.col("_p.sign").alias("_sign"), *[F.col("_row")[f"_f{i}"].alias(f) for i, f in enumerate(fields)]
    )
    left = uncancelled(signed, ["_series", "_to", "_key"], fields, "_sign")
    change = F.when(F.col("only") > 0, "added").when(F.col("only") < 0, "removed").otherwise("changed")
    named = left.join(sized_broadcast(meta.select(*run_key, F.col("_run").alias("_to")), n_runs), "_to")
    return named.select(*run_key, F.col("_key").alias(key), change.alias("change"), F.when(F.col("only") == 0, F.col("fields")).alias("fields"))
