"""Mixing sources to target shares of tokens.

Every record has a fixed hash. A source's budget is met by taking all its records some whole number
of times and once more those whose hash lies below a threshold. The threshold is found from sums of
tokens by hash bucket, then by sub-bucket of the one bucket on the budget's border, and so on: no
sort, and what reaches the driver is one number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.skew import sized_broadcast
from spanloom.session import Rounds

BITS, LEVELS = 12, 5


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, shares) of a mixture of ``sizes`` (id, source, tokens) by ``targets`` (source, target_share, max_repeats).

    ``total`` is the mixture's size in tokens; by default the largest at which every source that has
    tokens can reach its share within its ``max_repeats``. A source that can't fill its share of a
    given ``total`` is repeated ``max_repeats`` times and falls short, which ``shares`` shows.

    ``records``: id, source, tokens, ``repeats`` (1 or more). ``shares``: one row per target with
    the tokens there are and are mixed, the records taken, and the share reached.

    Defined cases: a null source, or one without a target, is not mixed; a target without records
    reaches 0; null or negative shares and repeats are 0; null tokens are 0. Records of no tokens
    come with their hash like others. A repeated target row counts once (the greatest). The budget
    is met up to the one record on the border, which stays out. Repeated ids are records each.
    """
    rounds = Rounds(sizes.sparkSession)
    goals = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select(
        "source", F.greatest(F.coalesce("t.target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("t.max_repeats", F.lit(0)), F.lit(0)).alias("cap")
    )
    n_goals = targets.count()  # bounds every table of one row a source; beyond a bound these are shuffled
    per_source = lambda df: sized_broadcast(df, n_goals)
    rows = rounds.cut(
        sizes.select("id", "source", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
        .join(per_source(goals.select("source")), "source").withColumn("hash", F.xxhash64("id", F.lit(17)))
    )
    have = rounds.cut(goals.join(rows.groupBy("source").agg(F.sum("tokens").alias("have")), "source", "left").withColumn("have", F.coalesce("have", F.lit(0))))
    if total is None:
        total = have.where("share > 0 and cap * have > 0").agg(F.min(F.col("cap") * F.col("have") / F.col("share"))).first()[0] or 0.0
    most = F.col("cap").cast("double") * F.col("have")
    budget = F.least(F.floor(F.col("share") * F.lit(float(total)) + 1e-6).cast("double"), most).cast("bigint")
    whole = F.when(F.col("have") > 0, F.expr("budget div have")).otherwise(0)
    # the records below the bound: those whose hash, read by the first level * BITS bits, is below prefix
    state = have.withColumn("budget", budget).withColumn("whole", whole.cast("bigint")).select(
        "source", "whole", (F.col("budget") - F.col("whole") * F.col("have")).alias("room"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).alias("level")
    )
    state = rounds.cut(state.withColumn("fixed", F.col("room") <= 0), fixed=F.expr("count_if(not fixed)"))
    for level in range(1, LEVELS + 1):
        if not state.measured["fixed"]:
            break
        inside = rows.join(per_source(state.where("not fixed").select("source", "prefix", "room")), "source").where(_head(level - 1) == F.col("prefix"))
        sums = inside.groupBy("source", "room", _head(level).alias("bucket")).agg(F.sum("tokens").alias("n"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        # the first bucket that no longer fits, and what the buckets before it take
        over = sums.withColumn("upto", F.sum("n").over(w)).where("upto > room").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
        met, full = F.col("b").isNotNull(), ~F.col("fixed") & F.col("b").isNull()  # full: all of the bucket fits, the bound lies at its end
        state = rounds.cut(
            state.join(over, "source", "left").select(
                "source", "whole", F.when(met, F.col("room") - F.col("b.before")).otherwise(F.col("room")).alias("room"),
                F.when(met, F.col("b.bucket")).when(full, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("prefix"),
                F.when(met, F.lit(level)).otherwise(F.col("level")).alias("level"), (F.col("fixed") | full).alias("fixed"),
            ),
            state, fixed=F.expr("count_if(not fixed)"),
        )
    below = F.when(F.col("level") == 0, F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftrightunsigned(hash, 64 - {BITS} * level)")) < F.col("prefix")
    taken = rows.join(per_source(state.select("source", "whole", "prefix", "level")), "source").withColumn("repeats", (F.col("whole") + below.cast("int")).cast("int"))
    records = taken.where("repeats > 0").select("id", "source", "tokens", "repeats")
    mixed = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_records"), F.max("repeats").alias("most_repeats"))
    whole_mix = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # over one row per target
    shares = have.join(mixed, "source", "left").withColumn("all", whole_mix).select(
        "source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), F.col("have").alias("available_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.col("mixed_tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
    )
    rounds.only(rows, have, state)
    return records, shares


def _head(level: int) -> Column:
    """The first ``level * BITS`` bits of the hash as a number."""
    return F.shiftrightunsigned("hash", 64 - BITS * level) if level else F.lit(0).cast("bigint")
