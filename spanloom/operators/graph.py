"""Graph operators on edge lists: reachability, paths, components, layers, counts.

Frontiers advance ``HOPS`` edges between two written rounds; a round is written to the shared
checkpoint folder (:class:`spanloom.session.Rounds`), so plans stay small and lost executors cost a
re-read only. Edges are distinct before the first round; the visited set is never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import Rounds

HOPS = 4


def merged_edges(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """Parallel edges as one: ``n_calls``, sorted ``kinds`` and whether the edge is ``recursive``."""
    return edges.groupBy(source, target).agg(F.count(F.lit(1)).alias("n_calls"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds")).withColumn(
        "recursive", F.col(source) == F.col(target)
    )


def roots(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node``: sources that are no target of another node."""
    into = edges.where(F.col(source) != F.col(target)).select(F.col(target).alias("node")).distinct()
    return edges.select(F.col(source).alias("node")).where("node is not null").distinct().join(into, "node", "left_anti")


def leaves(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node``: targets that are no source of another node."""
    return roots(edges, target, source)


def reachable(edges: DataFrame, source: str, target: str, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node``, ``depth``: all nodes within ``max_depth`` edges of ``seeds`` (column node), with their least distance."""
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col(source).alias("node"), F.col(target).alias("to")).where("node is not null and to is not null").distinct())
    front = rounds.cut(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    found, depth = [front], 0
    while max_depth is None or depth < max_depth:
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        known = reduce(DataFrame.unionByName, found).select("node")
        new, step = [], front.select("node", "depth")
        for _ in range(hops):
            step = step.join(e, "node").select(F.col("to").alias("node"), (F.col("depth") + 1).alias("depth")).groupBy("node").agg(F.min("depth").alias("depth")).join(known, "node", "left_anti")
            new.append(step)
        depth += hops
        fresh = rounds.cut(reduce(DataFrame.unionByName, new).groupBy("node").agg(F.min("depth").alias("depth")), rows=F.count(F.lit(1)), last=F.expr(f"count_if(depth = {depth})"))
        if fresh.measured["rows"]:
            found.append(fresh)
        # only nodes first met on the last hop can lead on to others
        front = fresh.where(F.col("depth") == depth)
        if not fresh.measured["last"]:
            break
    rounds.only(*found)
    return reduce(DataFrame.unionByName, found)


def simple_paths(edges: DataFrame, source: str, target: str, starts: DataFrame, ends: DataFrame, max_nodes: int) -> DataFrame:
    """``start``, ``end``, ``path`` (joined by /), ``length``: the paths without repeated nodes from ``starts`` to ``ends`` of ``max_nodes`` nodes at most.

    Paths stop at an end. The number of paths is the result's size; a bound on it is ``max_nodes``.
    """
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col(source).alias("at"), F.col(target).alias("to")).where("at is not null and to is not null").distinct())
    goal = ends.select(F.col("node").alias("to")).distinct().withColumn("goal", F.lit(True))
    e = rounds.cut(e.join(goal, "to", "left").select("at", "to", F.coalesce("goal", F.lit(False)).alias("goal")), e)
    walk = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path")).distinct()
    found = None
    for n in range(2, max_nodes + 1):
        step = walk.join(e, "at").where(~F.array_contains("path", F.col("to"))).select("start", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), "goal")
        step = rounds.cut(step)
        done = step.where("goal").select("start", F.col("at").alias("end"), F.array_join("path", "/").alias("path"), (F.size("path") - 1).alias("length"))
        found = done if found is None else found.unionByName(done)
        walk = step.where("not goal").drop("goal")
        if not walk.limit(1).count():
            break
    return found


def walk_counts(edges: DataFrame, source: str, target: str, starts: DataFrame, max_edges: int) -> DataFrame:
    """``node``, ``n_paths``: the number of walks of 0 to ``max_edges`` edges from ``starts`` to each node, counted level by level, never enumerated."""
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col(source).alias("node"), F.col(target).alias("to")).where("node is not null and to is not null").distinct())
    level = starts.select("node").distinct().withColumn("n", F.lit(1).cast("bigint"))
    total = level
    for _ in range(max_edges):
        level = rounds.cut(level.join(e, "node").groupBy(F.col("to").alias("node")).agg(F.sum("n").alias("n")))
        total = total.unionByName(level)
    return total.groupBy("node").agg(F.sum("n").alias("n_paths"))


def _kept_edges(pairs, entry):
    """The edges (s, t) of one component without those that a depth-first search from ``entry``, targets in order, finds to close a cycle."""
    to: dict = {}
    for s, t in sorted(pairs):
        to.setdefault(s, []).append(t)
    open_, kept, stack = {entry: True}, [], [(entry, iter(to.get(entry, ())))]
    while stack:
        s, rest = stack[-1]
        for t in rest:
            if open_.get(t):
                continue
            kept.append((s, t))
            if t not in open_:
                open_[t] = True
                stack.append((t, iter(to.get(t, ()))))
                break
        else:
            open_[s] = False
            stack.pop()
    return kept


def _without_back_edges(inner):
    """:func:`_kept_edges` of a component's rows, which name its ``entry``."""
    return type(inner)(_kept_edges(zip(inner["s"], inner["t"], strict=True), inner["entry"].iloc[0]), columns=["s", "t"], dtype=object)


def acyclic(edges: DataFrame, source: str, target: str, starts: DataFrame) -> DataFrame:
    """``s``, ``t``: the distinct edges reachable from ``starts`` without cycle edges.

    A cycle edge closes a cycle in a depth-first search, targets in order. Within a component it
    begins at the member nearest to the starts (the least of several), so every reachable node
    stays reachable. One component is one task.
    """
    rounds = Rounds(edges.sparkSession)
    depth = rounds.cut(reachable(edges, source, target, starts))
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    e = rounds.cut(e.join(depth.select(F.col("node").alias("s")), "s", "left_semi"))
    member = rounds.cut(components(e, "s", "t"))
    entry = member.join(depth, "node").groupBy("component").agg(F.min(F.struct("depth", "node"))["node"].alias("entry"))
    both = e.join(member.select(F.col("node").alias("s"), F.col("component").alias("cs")), "s", "left").join(member.select(F.col("node").alias("t"), F.col("component").alias("ct")), "t", "left")
    both = rounds.cut(both.select("s", "t", "cs", F.coalesce(F.col("cs") == F.col("ct"), F.lit(False)).alias("inside")))
    inner = both.where("inside").join(entry.withColumnRenamed("component", "cs"), "cs").groupBy("cs").applyInPandas(_without_back_edges, "s string, t string")
    return both.where("not inside").select("s", "t").unionByName(inner)


def _paths_of(rows):
    """``node``, ``n_paths`` of whole parts (s, t; a row with ``start`` is a node to begin at), by the rules of :func:`acyclic`."""
    to: dict = {}
    starts = []
    for s, t, start in zip(rows["s"], rows["t"], rows["start"], strict=True):
        if start:
            starts.append(s)
        else:
            to.setdefault(s, []).append(t)
    depth, level = dict.fromkeys(starts, 0), starts
    while level:
        new = []
        for s in level:
            for t in to.get(s, ()):
                if t not in depth:
                    depth[t] = depth[s] + 1
                    new.append(t)
        level = new
    pairs = [(s, t) for s in depth for t in to.get(s, ())]
    cycles = next(_cycles_of([type(rows)(pairs, columns=["s", "t"], dtype=object)]))
    member = dict(zip(cycles["node"], cycles["component"], strict=True))
    entry: dict = {}
    for node, c in member.items():
        entry[c] = min(entry.get(c, (depth[node], node)), (depth[node], node))
    inside: dict = {c: [] for c in entry}
    dag: dict = {}
    for s, t in pairs:
        c = member.get(s)
        if c is not None and c == member.get(t):
            inside[c].append((s, t))
        else:
            dag.setdefault(s, []).append(t)
    for c, (_, first) in entry.items():
        for s, t in _kept_edges(inside[c], first):
            dag.setdefault(s, []).append(t)
    waits: dict = {}
    for ts in dag.values():
        for t in ts:
            waits[t] = waits.get(t, 0) + 1
    counts, ready = dict.fromkeys(depth, 0) | dict.fromkeys(starts, 1), [n for n in depth if n not in waits]
    while ready:
        s = ready.pop()
        for t in dag.get(s, ()):
            counts[t] += counts[s]
            waits[t] -= 1
            if not waits[t]:
                ready.append(t)
    if counts and max(counts.values()) >= 2**63:
        raise OverflowError("a number of paths is beyond a bigint")
    return type(rows)(list(counts.items()), columns=["node", "n_paths"], dtype=object)


def path_counts(edges: DataFrame, source: str, target: str, starts: DataFrame) -> DataFrame:
    """``node``, ``n_paths``: the number of paths of any length from ``starts`` to each node, cycle edges ignored (see :func:`acyclic`).

    Never enumerated. Parts that no edge connects are counted apart (see :func:`by_parts`), only those
    too large for one task level by level. A count beyond a bigint is an error, not a wrong number.
    """
    rounds = Rounds(edges.sparkSession)
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    rows, large = by_parts(e, starts.select("node").where("node is not null").distinct(), rounds)
    out = rows.groupBy("bin").applyInPandas(_paths_of, "node string, n_paths bigint")
    if large is None:
        return out
    return out.unionByName(_path_counts_by_level(large.where("not start").select("s", "t"), large.where("start").select(F.col("s").alias("node"))))


def _path_counts_by_level(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """:func:`path_counts` of any number of edges (s, t), until a level is empty; ``2 * HOPS`` levels between two written rounds."""
    rounds = Rounds(edges.sparkSession)
    dag = rounds.cut(acyclic(edges, "s", "t", starts))
    seeds = starts.select("node").where("node is not null").distinct()
    # an edge of a node to itself keeps what was counted, so a level reads the one before it once
    kept = dag.select(F.explode(F.array("s", "t")).alias("node")).distinct().select("node", F.col("node").alias("to"), F.lit(True).alias("keep"))
    e = rounds.cut(dag.select(F.col("s").alias("node"), F.col("t").alias("to"), F.lit(False).alias("keep")).unionByName(kept))
    total = level = rounds.cut(seeds.select("node", F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("counted")))
    while level.where("n > 0").limit(1).count():
        step = level.where("n > 0").select("node", "n", F.lit(0).cast("bigint").alias("counted"))
        for _ in range(2 * HOPS):
            sent = step.join(e, "node").where("not keep and n > 0 or keep and counted > 0").select(F.col("to").alias("node"), F.when(F.col("keep"), 0).otherwise(F.col("n")).alias("n"), F.when(F.col("keep"), F.col("counted")).otherwise(F.col("n")).alias("counted"))
            step = sent.groupBy("node").agg(F.sum("n").alias("n"), F.sum("counted").alias("counted"))
        level = rounds.cut(step)
        total = total.unionByName(level)
    return total.groupBy("node").agg(F.sum("counted").alias("n_paths"))


def condensed(edges: DataFrame, source: str, target: str, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(``node``, ``component`` of every end of an edge, ``s``, ``t`` the distinct edges between components).

    A component is named after its least member; a node on no cycle is one by itself.
    """
    e = rounds.cut(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null and s <> t").distinct())
    nodes = e.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    member = rounds.cut(nodes.join(components(e, "s", "t"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    cyclic = member.where("component <> node").unionByName(member.where("component <> node").select(F.col("component").alias("node"), "component").distinct())
    side = lambda x: cyclic.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    both = e.join(side("s"), "s", "left").join(side("t"), "t", "left").select(F.coalesce("cs", "s").alias("s"), F.coalesce("ct", "t").alias("t"))
    return member, rounds.cut(both.where("s <> t").distinct(), e)


def layers(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node``, ``layer``: 0 for a node none of whose edges leaves its component, else one more than its deepest target outside; all nodes of a component have its layer.

    Level k holds the components from which a path of k edges leads to a leaf; a component's layer is
    the last level it is in. A level is made from the one before alone, ``HOPS`` levels between two
    written rounds, and nothing is rewritten.
    """
    rounds = Rounds(edges.sparkSession)
    member, dag = condensed(edges, source, target, rounds)
    level = member.select(F.col("component").alias("node")).distinct().join(dag.select(F.col("s").alias("node")), "node", "left_anti").withColumn("layer", F.lit(0))
    level = rounds.cut(level)
    found, k = [level], 0
    while True:
        new, step = [], level.where(F.col("layer") == k).select("node")
        for h in range(1, HOPS + 1):
            step = dag.join(step, dag["t"] == step["node"]).select(F.col("s").alias("node")).distinct()
            new.append(step.withColumn("layer", F.lit(k + h)))
        level = rounds.cut(reduce(DataFrame.unionByName, new), rows=F.count(F.lit(1)))
        if not level.measured["rows"]:
            break
        found.append(level)
        k += HOPS
    deepest = reduce(DataFrame.unionByName, found).groupBy(F.col("node").alias("component")).agg(F.max("layer").alias("layer"))
    out = rounds.cut(member.join(deepest, "component").select("node", "component", "layer"))
    rounds.only(out)
    return out


def nearest_ancestor(edges: DataFrame, source: str, target: str, marked: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node``, ``ancestor``, ``depth``: for each node the least ``marked`` one among the nearest above it (itself at 0) within ``max_depth``, if there is such a bound."""
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col(source).alias("node"), F.col(target).alias("to")).where("node is not null and to is not null").distinct())
    done = rounds.cut(marked.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    front, depth = done, 0
    while max_depth is None or depth < max_depth:
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        new, step = None, front
        for _ in range(hops):
            step = step.join(e, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.struct("depth", "ancestor")).alias("x")).select("node", F.col("x.ancestor").alias("ancestor"), (F.col("x.depth") + 1).alias("depth"))
            new = step if new is None else new.unionByName(step)
        best = new.groupBy("node").agg(F.min(F.struct("depth", "ancestor")).alias("x")).select("node", F.col("x.ancestor").alias("ancestor"), F.col("x.depth").alias("depth"))
        fresh = rounds.cut(best.join(done.select("node"), "node", "left_anti"))
        depth += hops
        if not fresh.limit(1).count():
            break
        front = fresh
        done = rounds.cut(done.unionByName(fresh), done)
    return done


def goal_values(edges: DataFrame, goal: str, subgoal: str, facts: DataFrame) -> DataFrame:
    """``goal``, ``value``: the least fixpoint of "a goal has its own facts and all values of its subgoals".

    Semi-naive: a round derives only from what the round before found, and what is known is left
    out by an anti join; cycles end by themselves.
    """
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col(goal).alias("up"), F.col(subgoal).alias("goal")).where("up is not null and goal is not null and up <> goal").distinct())
    delta = rounds.cut(facts.select("goal", "value").where("goal is not null and value is not null").distinct())
    found = [delta]
    while True:
        known, new, step = reduce(DataFrame.unionByName, found), [], delta
        for _ in range(HOPS):
            step = step.join(e, "goal").select(F.col("up").alias("goal"), "value").distinct().join(known, ["goal", "value"], "left_anti")
            new.append(step)
        delta = rounds.cut(reduce(DataFrame.unionByName, new).distinct(), rows=F.count(F.lit(1)))
        if not delta.measured["rows"]:
            break
        found.append(delta)
    rounds.only(*found)
    return reduce(DataFrame.unionByName, found)


#: So many connected edges at most are searched by one task; beyond it all tasks share them.
ONE_TASK_EDGES = 500_000


def _cycles_of(batches):
    """``node``, ``component`` of a whole small graph (s, t): a depth-first search with low marks, without recursion."""
    to: dict = {}
    frame = None
    for b in batches:
        frame = type(b)
        for s, t in zip(b["s"], b["t"], strict=True):
            to.setdefault(s, []).append(t)
    if frame is None:
        return
    number, low, on, stack, rows = {}, {}, set(), [], []
    for start in to:
        if start in number:
            continue
        walk = [(start, iter(to[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on.add(start)
        while walk:
            s, rest = walk[-1]
            for t in rest:
                if t not in number:
                    number[t] = low[t] = len(number)
                    stack.append(t)
                    on.add(t)
                    walk.append((t, iter(to.get(t, ()))))
                    break
                if t in on:
                    low[s] = min(low[s], number[t])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[s])
                if low[s] == number[s]:
                    members = []
                    while not members or members[-1] != s:
                        members.append(stack.pop())
                        on.discard(members[-1])
                    if len(members) > 1:
                        least = min(members)
                        rows += [(m, least) for m in members]
    yield frame(rows, columns=["node", "component"], dtype=object)


def components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node``, ``component`` (its least member): strongly connected components with a cycle, self-edges included.

    First nodes are trimmed that nothing enters or leaves, from both ends, until only cycles and
    what lies between them is left. Then each node takes the least node that reaches it, and the
    component of a colour is what can reach the colour's node within the colour; the rest goes on.
    What is left of ``ONE_TASK_EDGES`` edges or fewer is searched by one task instead.
    """
    rounds = Rounds(edges.sparkSession)
    every = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct()
    found = every.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("component"))
    e = rounds.cut(every.where("s <> t"))
    left = e.count()
    kind = e.schema["s"].dataType.simpleString()
    local = lambda: e.coalesce(1).mapInPandas(_cycles_of, f"node {kind}, component {kind}")
    while left > ONE_TASK_EDGES:
        step = e
        for _ in range(HOPS):
            into, out = step.select(F.col("t").alias("s")).distinct(), step.select(F.col("s").alias("t")).distinct()
            step = step.join(into, "s", "left_semi").join(out, "t", "left_semi").select("s", "t")
        e = rounds.cut(step, e)
        before, left = left, e.count()
        if left == before:
            break
    while left > ONE_TASK_EDGES:
        colour = rounds.cut(e.select(F.explode(F.array("s", "t")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            step = colour
            for _ in range(HOPS):
                sent = e.join(step, e["s"] == step["node"]).select(F.col("t").alias("node"), "c")
                step = sent.unionByName(step).groupBy("node").agg(F.min("c").alias("c"))
            moved = rounds.cut(step.join(colour.withColumnRenamed("c", "old"), "node"))
            colour = moved.drop("old")
            if not moved.where("c <> old").limit(1).count():
                break
        inside = e.join(colour.select(F.col("node").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("node").alias("t"), F.col("c").alias("ct")), "t").where("cs = ct")
        inside = rounds.cut(inside.select("s", "t"))
        seeds = colour.where("node = c").select("node")
        back = reachable(inside, "t", "s", seeds).join(colour, "node")
        group = rounds.cut(back.select("node", F.col("c").alias("component")))
        several = group.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
        found = found.unionByName(group.join(several, "component", "left_semi").select("node", "component"))
        gone = group.select("node")
        e = rounds.cut(e.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "t"), "t", "left_anti").select("s", "t"), e)
        left = e.count()
    if left:
        found = found.unionByName(local())
    return found.groupBy("node").agg(F.min("component").alias("component"))


def _forest_of(batches):
    """``u``, ``m``: each node of a task's edges (s, t), but the least of a part, with the least node that they connect it to."""
    up: dict = {}
    frame = None

    def top(x):
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        frame = type(b)
        for s, t in zip(b["s"], b["t"], strict=True):
            s, t = top(s), top(t)
            if s != t:
                up[max(s, t)] = min(s, t)
    if frame is not None:
        yield frame([(x, top(x)) for x in list(up)], columns=["u", "m"], dtype=object)


def weak_parts(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node``, ``part`` (its least member): the nodes that edges connect, whichever way they lead.

    First each task reduces its own edges to stars. Then larger and smaller neighbours are tied to
    the least one by turns (large and small star) until every node hangs on its part's least member.
    """
    rounds = Rounds(edges.sparkSession)
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null and s <> t")
    e = rounds.cut(e.mapInPandas(_forest_of, "u string, m string").distinct())
    while True:
        both = e.unionByName(e.select(F.col("m").alias("u"), F.col("u").alias("m")))
        least = both.groupBy("u").agg(F.min("m").alias("least")).select("u", F.least("u", "least").alias("least"))
        tied = both.join(least, "u").where("m > u").select(F.col("m").alias("u"), F.col("least").alias("m")).distinct()
        tied = tied.join(tied.groupBy("u").agg(F.min("m").alias("least")), "u")
        e = rounds.cut(tied.select("u", F.col("least").alias("m")).unionByName(tied.where("m <> least").select(F.col("m").alias("u"), F.col("least").alias("m"))).distinct(), e)
        ends = e.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(e.select(F.col("m").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        if not ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").limit(1).count():
            break
    rounds.only(e)
    return e.select(F.col("u").alias("node"), F.col("m").alias("part")).unionByName(e.select(F.col("m").alias("node"), F.col("m").alias("part")).distinct())


def by_parts(edges: DataFrame, nodes: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame | None]:
    """(``s``, ``t``, ``start``, ``bin``; the rows of the rest, None if there are none): the distinct ``edges`` (s, t) and ``nodes`` (node; s = t, with ``start``) so that one bin is one task's work.

    A bin holds whole weakly connected parts. Those of more than ``ONE_TASK_EDGES`` edges are the rest.
    """
    rows = edges.select("s", "t", F.lit(False).alias("start")).unionByName(nodes.select(F.col("node").alias("s"), F.col("node").alias("t"), F.lit(True).alias("start")))
    rows = rounds.cut(rows, edges=F.expr("count_if(not start)"))
    n = rows.measured["edges"]
    if n <= ONE_TASK_EDGES:
        return rows.withColumn("bin", F.lit(0)), None
    parts = weak_parts(rows.where("not start"), "s", "t")
    rows = rounds.cut(rows.join(parts.withColumnRenamed("node", "s"), "s", "left").select("s", "t", "start", F.coalesce("part", "s").alias("part")), rows)
    large = rows.where("not start").groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ONE_TASK_EDGES).select("part")
    large = rounds.cut(large, parts=F.count(F.lit(1)))
    bins = -(-n // max(1, ONE_TASK_EDGES // 5))
    binned = lambda x: x.select("s", "t", "start", F.pmod(F.xxhash64("part"), F.lit(bins)).cast("int").alias("bin"))
    if not large.measured["parts"]:
        return binned(rows), None
    return binned(rows.join(large, "part", "left_anti")), rounds.cut(rows.join(large, "part", "left_semi").select("s", "t", "start"))


def fingerprints(edges: DataFrame, source: str, target: str, own: DataFrame) -> DataFrame:
    """``node``, ``fingerprint``: SHA-256 over the node's ``own`` digest, its targets' fingerprints and its component's other digests, leaves first.

    A change of a digest changes the fingerprints of exactly the node, its component and all that
    depend on it. ``own`` has node and digest (null, and a node without a row, as empty). Targets
    within the component count by their digests. Layer by layer, each written once.
    """
    rounds = Rounds(edges.sparkSession)
    digests = own.groupBy("node").agg(F.max("digest").alias("digest"))
    order = rounds.cut(layers(edges, source, target).join(digests, "node", "left").select("node", "component", "layer", F.coalesce("digest", F.lit("")).alias("digest")), top=F.max("layer"))
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("node")).where("s is not null and node is not null and s <> node").distinct()
    named = order.select(F.col("node").alias("s"), F.col("component").alias("cs"))
    e = rounds.cut(e.join(named, "s").join(order.select("node", "component"), "node").where("cs <> component").select("s", "node"))
    # a component's digests in the order of its members, without the node's own
    group = order.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("all")).where("n > 1").select("component", "all")
    peers = F.array_join(F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<node:string,digest:string>>")), lambda x: x["node"] != F.col("node")), lambda x: x["digest"]), ",")
    info = rounds.cut(order.join(group, "component", "left").select("node", "layer", "digest", peers.alias("peers")), order)
    print_of = lambda under: F.sha2(F.concat_ws("|", "digest", under, "peers"), 256).alias("fingerprint")
    done = [rounds.cut(info.where("layer = 0").select("node", print_of(F.lit(""))))]
    for n in range(1, (order.measured["top"] or 0) + 1):
        level = info.where(F.col("layer") == n)
        known = reduce(DataFrame.unionByName, done)
        under = e.join(level.select(F.col("node").alias("s")), "s", "left_semi").join(known, "node").groupBy(F.col("s").alias("node")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "fingerprint"))), lambda x: x["fingerprint"]), ",").alias("under")
        )
        done.append(rounds.cut(level.join(under, "node", "left").select("node", print_of(F.coalesce("under", F.lit(""))))))
    rounds.only(*done)
    return reduce(DataFrame.unionByName, done)


def carried_search(edges: DataFrame, source: str, target: str, seeds: DataFrame, label: str | None = None) -> DataFrame:
    """``node``, ``depth``, ``path`` (ids from the seed, joined by /), ``label``: for each reachable node its first shortest path from ``seeds`` (node).

    First by the path's text. ``label`` of an edge (null for none) is carried along: a node has that
    of the last labelled edge of its path, empty if there is none. A search in breadth, without a bound.
    """
    rounds = Rounds(edges.sparkSession)
    e = edges.select(F.col(source).alias("node"), F.col(target).alias("to"), (F.col(label) if label else F.lit(None).cast("string")).alias("said"))
    e = rounds.cut(e.where("node is not null and to is not null").groupBy("node", "to").agg(F.min("said").alias("said")))
    front = seeds.select("node").where("node is not null").distinct()
    front = rounds.cut(front.select("node", F.lit(0).alias("depth"), F.col("node").alias("path"), F.lit("").alias("label")))
    found, depth = [front], 0
    while True:
        known, new, step = reduce(DataFrame.unionByName, found).select("node"), [], front
        for _ in range(HOPS):
            way = F.struct(F.concat_ws("/", "path", "to").alias("path"), F.coalesce("said", "label").alias("label"))
            step = step.join(e, "node").groupBy(F.col("to").alias("node"), (F.col("depth") + 1).alias("depth")).agg(F.min(way).alias("w"))
            step = step.join(known, "node", "left_anti").select("node", "depth", "w.path", "w.label")
            new.append(step)
        best = reduce(DataFrame.unionByName, new).groupBy("node").agg(F.min(F.struct("depth", "path", "label")).alias("w")).select("node", "w.depth", "w.path", "w.label")
        depth += HOPS
        fresh = rounds.cut(best, rows=F.count(F.lit(1)), last=F.expr(f"count_if(depth = {depth})"))
        if fresh.measured["rows"]:
            found.append(fresh)
        front = fresh.where(F.col("depth") == depth)
        if not fresh.measured["last"]:
            break
    rounds.only(*found)
    return reduce(DataFrame.unionByName, found)


def paired_reach(edges: DataFrame, source: str, target: str, seeds: DataFrame) -> DataFrame:
    """``seed``, ``node``, ``depth``: what each of ``seeds`` (node) reaches by itself, itself at 0, with the least distance."""
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col(source).alias("node"), F.col(target).alias("to")).where("node is not null and to is not null").distinct())
    front = rounds.cut(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).where("node is not null").distinct())
    found, depth = [front], 0
    while True:
        known, new, step = reduce(DataFrame.unionByName, found).select("seed", "node"), [], front
        for _ in range(HOPS):
            step = step.join(e, "node").groupBy("seed", F.col("to").alias("node")).agg((F.min("depth") + 1).alias("depth")).join(known, ["seed", "node"], "left_anti")
            new.append(step)
        depth += HOPS
        fresh = rounds.cut(reduce(DataFrame.unionByName, new).groupBy("seed", "node").agg(F.min("depth").alias("depth")), rows=F.count(F.lit(1)), last=F.expr(f"count_if(depth = {depth})"))
        if fresh.measured["rows"]:
            found.append(fresh)
        front = fresh.where(F.col("depth") == depth)
        if not fresh.measured["last"]:
            break
    rounds.only(*found)
    return reduce(DataFrame.unionByName, found)


def _states_of(rows, most_states: int, most_depth: int):
    """``seed``, ``states``, ``depth``, ``status`` of :func:`backward_states` for whole parts (s, t; a row with ``start`` is a seed)."""
    up: dict = {}
    seeds, out = [], []
    for s, t, start in zip(rows["s"], rows["t"], rows["start"], strict=True):
        if start:
            seeds.append(s)
        else:
            up.setdefault(t, []).append(s)
    for seed in seeds:
        seen, level, depth, status = {seed}, {seed}, 0, "COMPLETE"
        while level := {s for t in level for s in up.get(t, ())} - seen:
            if len(seen) + len(level) > most_states or depth >= most_depth:
                status = "INCOMPLETE"
                break
            seen |= level
            depth += 1
        out.append((seed, len(seen), depth, status))
    return type(rows)(out, columns=["seed", "states", "depth", "status"], dtype=object)


def backward_states(edges: DataFrame, source: str, target: str, seeds: DataFrame, most_states: int = 5000, most_depth: int = 256) -> DataFrame:
    """``seed``, ``states``, ``depth``, ``status``: how many states a search from each of ``seeds`` (node) up the edges has, itself with them.

    A seed whose next level would pass ``most_states`` or lie beyond ``most_depth`` goes no further
    and has the status INCOMPLETE, so a search that was cut is never taken for a whole one; the
    others are COMPLETE. Parts that no edge connects are searched apart (see :func:`by_parts`), the
    seeds of a bin by several tasks with its edges each; only parts too large for a task level by level.
    """
    rounds = Rounds(edges.sparkSession)
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    rows, large = by_parts(e, seeds.select("node").where("node is not null").distinct(), rounds)
    # seeds of a bin are dealt out by its share of ``ONE_TASK_EDGES``, its edges repeated as often
    sizes = rows.groupBy("bin").agg(F.least(F.ceil(F.count(F.lit(1)) * 8 / ONE_TASK_EDGES), F.lit(8)).cast("int").alias("deals"))
    rows = rows.join(F.broadcast(sizes), "bin")
    deal = F.when(F.col("start"), F.array(F.pmod(F.xxhash64("s"), "deals").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("deals") - 1))
    dealt = rows.select("s", "t", "start", "bin", F.explode(deal).alias("deal"))
    out = dealt.groupBy("bin", "deal").applyInPandas(lambda x: _states_of(x, most_states, most_depth), "seed string, states bigint, depth int, status string")
    if large is None:
        return out
    rest = _states_by_level(large.where("not start").select("s", "t"), large.where("start").select(F.col("s").alias("node")), most_states, most_depth)
    return out.unionByName(rest)


def _states_by_level(edges: DataFrame, seeds: DataFrame, most_states: int, most_depth: int) -> DataFrame:
    """:func:`backward_states` of any number of edges (s, t), level by level for all seeds at once."""
    rounds = Rounds(edges.sparkSession)
    e = rounds.cut(edges.select(F.col("t").alias("node"), F.col("s").alias("to")).where("node is not null and to is not null and node <> to").distinct())
    front = rounds.cut(seeds.select(F.col("node").alias("seed"), "node").where("node is not null").distinct())
    seen, depth = [front], 0
    totals = rounds.cut(front.select("seed", F.lit(1).cast("bigint").alias("states"), F.lit(0).alias("depth"), F.lit("COMPLETE").alias("status")))
    while True:
        known = reduce(DataFrame.unionByName, seen)
        level = rounds.cut(front.join(e, "node").select("seed", F.col("to").alias("node")).distinct().join(known, ["seed", "node"], "left_anti"), rows=F.count(F.lit(1)))
        if not level.measured["rows"]:
            break
        depth += 1
        more = level.groupBy("seed").agg(F.count(F.lit(1)).alias("more"))
        over = (F.col("states") + F.col("more") > most_states) | F.lit(depth > most_depth)
        totals = rounds.cut(
            totals.join(more, "seed", "left").select(
                "seed", F.when(F.col("more").isNull() | over, F.col("states")).otherwise(F.col("states") + F.col("more")).alias("states"),
                F.when(F.col("more").isNull() | over, F.col("depth")).otherwise(F.lit(depth)).alias("depth"), F.when(F.col("more").isNotNull() & over, "INCOMPLETE").otherwise(F.col("status")).alias("status"),
            ),
            totals, cut=F.expr("count_if(status = 'INCOMPLETE')"),
        )
        front = level
        if totals.measured["cut"]:
            front = rounds.cut(level.join(totals.where("status = 'INCOMPLETE'").select("seed"), "seed", "left_anti"), level)
        seen.append(front)
    rounds.only(totals)
    return totals
