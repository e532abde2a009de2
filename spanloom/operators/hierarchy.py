"""Parent-child links to full hierarchies: depth, root, path, nested-set ranges, cycles.

Upward, subtree sizes are summed; downward, each family divides its parent's range among its members
by prefix sums of their sizes, and the same pass brings down root and depth. Records whose size never
becomes final are on or below cycles. Both passes work by doubling: in round k each record knows its
ancestor 2^k steps up, so a tree of depth d takes log2(d) rounds of one join, not d. Each round's
state is written to the shared checkpoint folder (:class:`Rounds`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.skew import ONE_TASK_ROWS, hot_split_join
from spanloom.session import Rounds

#: Siblings are in the order of their ids' MD5; so many of its hexadecimal digits part a family, so that no large one is sorted in one task.
SIBLING_DIGITS = 3
OPEN_ROWS = "count_if(not done)"


def parent_links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """``node``, ``parent`` (null for a root), ``looped`` (it is its own parent) for every end of an edge.

    Edges with a null end are no edges; repeated ones count once. A record with several parents
    besides itself hangs below the smallest.
    """
    ends = edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where("p is not null and c is not null")
    sides = ends.select(F.explode(F.array(F.struct(F.col("c").alias("node"), F.col("p").alias("parent")), F.struct(F.col("p").alias("node"), F.lit(None).cast(edges.schema[parent].dataType).alias("parent")))).alias("x"))
    return sides.select("x.*").groupBy("node").agg(
        F.min(F.when(F.col("parent") != F.col("node"), F.col("parent"))).alias("parent"),
        F.coalesce(F.max(F.col("parent") == F.col("node")), F.lit(False)).alias("looped"),
    )


def _jump(state: DataFrame, per_node: DataFrame, rows: int) -> DataFrame:
    """``state`` joined with what ``per_node`` (column ``kids``: rows that point there) says of its ``up``."""
    return hot_split_join(state, per_node.withColumnRenamed("node", "up"), ["up"], "kids", rows)


def several_parents(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """``node``, ``kept``, ``dropped``: one row per link that :func:`hierarchy` leaves out, as a tree has one parent a node.

    Of several parents besides the node itself the smallest is kept; with a self-link none is, and
    ``kept`` is the node. A cycle through a dropped link is none in the hierarchy.
    """
    links = edges.select(F.col(parent).alias("dropped"), F.col(child).alias("node")).where("dropped is not null and node is not null").distinct()
    own = F.max(F.col("dropped") == F.col("node")).alias("own")
    # counts first: nodes with one parent, nearly all, go before any list is made
    kept = links.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("dropped") != F.col("node"), F.col("dropped"))).alias("least"), own).where("n > 1")
    kept = kept.select("node", F.when(F.col("own"), F.col("node")).otherwise(F.col("least")).alias("kept"))
    return links.join(kept, "node").where("dropped <> kept").select("node", "kept", "dropped")


def _climb(links: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(tree, rest): records with ``node, parent, size`` and the unprocessed ones with ``node, parent, up``.

    In round k the open records are those of depth 2^k or more; ``up`` is exactly 2^k above, and
    ``size`` counts the descendants nearer than 2^k, with the record itself. What points at a record
    in any round is its descendants at 2^k to 2^(k+1), so its size is 1 and all that ever pointed at
    it. A record leaves when nothing open is 2^k above it. A round that no record leaves ends the
    climb: what is open then never reaches a root.
    """
    below = rounds.cut(links.where("parent is not null").select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), rows=F.count(F.lit(1)))
    every, left = [below], below.measured["rows"]
    while left:
        met = below.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"), F.count(F.lit(1)).alias("kids"))
        grown = below.join(met, "node", "left").select("node", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        above = below.select("node", F.col("up").alias("up2"))
        above = above.withColumn("kids", F.lit(1)) if left <= ONE_TASK_ROWS else above.join(met.select("node", "kids"), "node")
        moved = rounds.cut(_jump(grown, above, left).select("node", F.col("up2").alias("up"), "size"), rows=F.count(F.lit(1)))
        if moved.measured["rows"] == left:
            rounds.drop(moved)
            break
        below, left = moved, moved.measured["rows"]
        every.append(below)
    pointed = reduce(DataFrame.unionByName, [t.select(F.col("up").alias("node"), "size") for t in every]).groupBy("node").agg(F.sum("size").alias("more"))
    tree = links.join(below.select("node"), "node", "left_anti") if left else links
    tree = rounds.cut(tree.join(pointed, "node", "left").select("node", "parent", (F.lit(1) + F.coalesce("more", F.lit(0))).alias("size")))
    rest = rounds.cut(links.select("node", "parent").join(below.select("node", "up"), "node"), rows=F.count(F.lit(1))) if left else None
    rounds.only(tree, rest)
    return tree, rest


def _descend(tree: DataFrame, paths: bool, rounds: Rounds) -> DataFrame:
    """``tree`` with ``root``, ``depth``, ``pre``, its preorder number within its tree (root 0), and with ``paths`` the ids from the root down.

    A family's members are ordered by the MD5 of their ids. Prefix sums of subtree sizes within its
    parts and over them give each record's distance from its parent; downward these distances are
    summed by doubling. A record that has reached its root is not written again.
    """
    family = tree.where("parent is not null").withColumn("_h", F.md5(F.col("node").cast("string"))).withColumn("_b", F.substring("_h", 1, SIBLING_DIGITS))
    inside = Window.partitionBy("parent", "_b").orderBy("_h", "node").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("parent").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = family.groupBy("parent", "_b").agg(F.sum("size").alias("_s")).select("parent", "_b", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_ahead"))
    local = family.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, ["parent", "_b"])
    local = local.withColumn("_off", 1 + F.col("_in") + F.col("_ahead")).select("node", "parent", "size", "_off")
    roots = tree.where("parent is null").withColumn("_off", F.lit(0).cast("bigint"))
    root = F.col("parent").isNull()
    state = local.unionByName(roots).select(
        "node", "parent", "size", F.coalesce("parent", "node").alias("up"), F.when(root, 0).otherwise(1).alias("depth"), F.col("_off").alias("pre"),
        root.alias("done"), *([F.array("node").alias("path")] if paths else []),
    )
    state = rounds.cut(state, left=F.expr(OPEN_ROWS))
    done, left = [state.where("done")], state.measured["left"]
    while left:
        open_ = state.where("not done")
        every = reduce(DataFrame.unionByName, [*done, open_])
        if left > ONE_TASK_ROWS:
            every = every.join(open_.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("kids")), "node")
        else:  # no key can be hot
            every = every.withColumn("kids", F.lit(1))
        per_node = every.select(
            "node", F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("pre").alias("pre2"), F.col("done").alias("done2"), "kids",
            *([F.col("path").alias("path2")] if paths else []),
        )
        moved = _jump(open_, per_node, left).select(
            "node", "parent", "size", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("pre") + F.col("pre2")).alias("pre"),
            F.col("done2").alias("done"), *([F.concat("path2", "path").alias("path")] if paths else []),
        )
        state = rounds.cut(moved, left=F.expr(OPEN_ROWS))
        done.append(state.where("done"))
        left = state.measured["left"]
    return reduce(DataFrame.unionByName, done).withColumnRenamed("up", "root").drop("done")


def _cycles(rest: DataFrame, rounds: Rounds) -> DataFrame:
    """``node``, ``root`` (smallest id on its cycle), ``depth`` (-1 on a cycle, -2 below one) of the unprocessed records.

    The records that are someone's 2^k-th ancestor become fewer until only cycles are left; the climb
    up has brought ``up`` far already.
    """
    state, rows, image = rest.select("node", "up"), rest.measured["rows"], None
    while True:
        kids = rounds.cut(state.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("kids")), rows=F.count(F.lit(1)))
        if kids.measured["rows"] == image:
            break
        image = kids.measured["rows"]
        per_node = state.join(kids, "node").select("node", F.col("up").alias("up2"), "kids")
        state = rounds.cut(_jump(state, per_node, rows).select("node", F.col("up2").alias("up")), state)
        rounds.drop(kids)
    on = rest.join(state.select(F.col("up").alias("node")).distinct(), "node", "left_semi")
    ring = rounds.cut(on.select("node", F.col("parent").alias("up"), F.col("node").alias("low")))
    fell = True
    while fell:
        ahead = ring.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        moved = ring.join(ahead, "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell"))
        ring = rounds.cut(moved, ring, fell=F.count_if("fell"))
        fell = ring.measured["fell"]
        ring = _bare(ring)
    met = _jump(state, ring.select("node", "low").join(kids, "node"), image or 1)
    mark = ring.select("node", F.lit(-1).alias("depth"))
    return rounds.cut(met.select("node", F.col("low").alias("root")).join(mark, "node", "left").select("node", "root", F.coalesce("depth", F.lit(-2)).alias("depth")))


def _bare(ring: DataFrame) -> DataFrame:
    out = ring.drop("fell")
    out._round_path = ring._round_path
    return out


def hierarchy(edges: DataFrame, parent: str, child: str, paths: bool = False) -> DataFrame:
    """One row per record that is an end of a link: ``node, parent, root, depth, size, pre, last`` and, if asked, ``path``.

    ``size`` is the number of descendants with the record itself. Within a ``root``, ``d`` is a
    descendant of ``a`` exactly if ``a.pre < d.pre <= a.last`` (nested sets), so all descendants
    or ancestors of a record are one range condition away and need not be stored as pairs.

    A record on a cycle (a self-link is one) has depth -1, one below a cycle -2; ``root`` is then
    the smallest id on the cycle (the first met going up), and size, pre, last and path are null.

    Links with a null end do not count, repeated links count once, an empty table gives no rows,
    and other columns are not read. Of several parents the smallest counts; :func:`several_parents`
    reports the links left out.
    """
    links = parent_links(edges, parent, child)
    up, down, rings = (Rounds(edges.sparkSession) for _ in range(3))
    links = up.cut(links.select("node", F.when(F.col("looped"), F.col("node")).otherwise(F.col("parent")).alias("parent")))
    tree, rest = _climb(links, up)
    placed = _descend(tree, paths, down).withColumn("last", F.col("pre") + F.col("size") - 1)
    if rest is not None:
        caught = _cycles(rest, rings)
        rings.only(caught)
        placed = placed.unionByName(caught, allowMissingColumns=True)
    up.only()
    return placed
