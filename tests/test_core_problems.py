"""The general problems on small tables: nulls, ties, repeats, empty tables, foreign columns, brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from spanloom.functions.text import plain_path, plain_value
from spanloom.operators.copies import copy_differences
from spanloom.operators.hierarchy import hierarchy, several_parents
from spanloom.operators.orphans import orphan_references
from spanloom.operators.skew import hot_split_join
from spanloom.operators.snapshots import snapshot_changes

T = [dt.datetime(2031, 1, d) for d in range(1, 29)]
RECORDS = "held_by string, record_id bigint, path string, line int, operation string, value string, loaded_at timestamp, difference string, _row string"


def differences(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], RECORDS)
    fields = {"path": plain_path(F.col("path")), "line": F.col("line"), "operation": F.col("operation"), "value": plain_value(F.col("value"))}
    return {(r[0], r[1]) for r in copy_differences(df, "record_id", "held_by", ("scan", "flow"), "loaded_at", fields).collect()}


def test_copies_latest_delivery_holds_and_spellings_are_equal(spark):
    rows = [
        ("scan", 1, ".\\a\\b.c", 1, "READ", " 5 ", T[1]), ("flow", 1, "a/b.c", 1, "READ", "5", T[0]),
        ("scan", 2, "a", 1, "READ", None, T[1]), ("scan", 2, "a", 1, "READ", "9", T[0]), ("flow", 2, ".//a", 1, "READ", "  ", T[5]),
        ("scan", 3, "a", 1, "READ", "x", T[1]),
        ("flow", 4, None, None, None, None, None), ("flow", 4, None, None, None, None, None),
        ("scan", 5, "a", 1, "READ", "x", T[1]), ("flow", 5, "b", None, "read", "y", None),
        ("other", 6, "a", 1, "READ", "x", T[1]),
        ("scan", None, "a", 1, "READ", "x", T[1]),
    ]
    assert differences(spark, rows) == {(3, "only_scan"), (4, "only_flow"), (5, "path"), (5, "line"), (5, "operation"), (5, "value"), (None, "only_scan")}


def test_copies_hot_key_ties_and_empty(spark):
    rows = [("scan", 1, "a", i % 7, "READ", "x", T[3]) for i in range(500)] + [("flow", 1, "a", 6, "READ", "x", T[3])]
    assert differences(spark, rows) == set()
    assert differences(spark, []) == set()


def brute_hierarchy(edges):
    links = {(p, c) for p, c in edges if p is not None and c is not None}
    nodes = {x for e in links for x in e}
    loops = {p for p, c in links if p == c}
    up = {}
    for p, c in sorted(links, reverse=True):
        if p != c:
            up[c] = p
    for n in loops:
        up[n] = n
    out = {}
    for n in nodes:
        path = [n]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if path[-1] not in up:
            out[n] = (path[-1], len(path) - 1)
        else:
            ring = path[path.index(up[path[-1]]) :]
            out[n] = (min(ring), -1 if n in ring else -2)
    return out


def test_hierarchy_against_walks(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 120) if i not in (40, 41, 42, 90)]
    edges += [("n42", "n40"), ("n40", "n41"), ("n41", "n42"), ("n90", "n90"), ("n3", "n90"), ("a", None), (None, "b"), *edges[:20]]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(40)]
    df = spark.createDataFrame([(p, c, 1, "z") for p, c in edges], "source string, target string, node int, root string")
    got = hierarchy(df, "source", "target", paths=True).collect()
    assert {r["node"]: (r["root"], r["depth"]) for r in got} == brute_hierarchy(edges)
    by = {r["node"]: r for r in got if r["depth"] >= 0}
    for r in by.values():
        assert r["path"][0] == r["root"] and r["path"][-1] == r["node"] and len(r["path"]) == r["depth"] + 1
    for a in by.values():  # nested sets hold exactly the descendants
        inside = {d["node"] for d in by.values() if d["root"] == a["root"] and a["pre"] < d["pre"] <= a["last"]}
        assert inside == {d["node"] for d in by.values() if a["node"] in d["path"][:-1]}


def test_hierarchy_without_links(spark):
    assert hierarchy(spark.createDataFrame([], "p string, c string"), "p", "c").count() == 0


def test_orphans(spark):
    sites = spark.createDataFrame(
        [("a", 1, T[0], None), ("a", 1, T[0], None), ("b", 1, T[10], None), ("c", 1, T[0], T[5]), ("d", 1, None, T[9]), (None, 1, T[0], None), ("e", 1, T[0], T[4]), ("e", 1, T[8], None)],
        "f string, l int, first timestamp, last timestamp",
    )
    facts = [(1, "./a", 1, T[3]), (1, "./a", 1, T[3]), (2, "b", 1, T[3]), (3, "c", 1, T[5]), (4, "c", 1, T[4]), (5, "z", 1, T[0]), (6, None, 1, T[0]), (7, "a", None, T[0]), (8, "z", 9, None), (9, "a", 1, None), (10, "d", 1, T[9]), (11, "e", 1, T[6])]
    df = spark.createDataFrame([(*f, 0) for f in facts], "id int, f string, l int, at timestamp, _kids int").withColumns({"reason": F.lit("x"), "_parent": F.lit(1), "_at": F.lit("y")})

    def reasons(children, parents):
        out = orphan_references(children, parents, {"f": plain_path(F.col("f")), "l": F.col("l")}, {"f": plain_path(F.col("f")), "l": F.col("l")}, "at", "first", "last", "sites")
        return {(r["id"], r["reason"]) for r in out.collect()}

    assert reasons(df, sites) == {(2, "later"), (3, "deleted"), (5, "missing"), (8, "missing"), (10, "deleted")}
    assert {r for r in reasons(df, sites.limit(0))} == {(i, "missing") for i in (1, 2, 3, 4, 5, 8, 9, 10, 11)}
    assert reasons(df.limit(0), sites) == set()


def test_snapshots(spark):
    runs = spark.createDataFrame(
        [("s", "p", "r1", T[0], 2), ("s", "p", "r1", T[0], 2), ("s", "p", "r3", T[2], 5), ("s", "p", "r2", T[3], 2), ("s", None, "x", T[0], 1), ("s", None, "y", T[1], 1), ("s", "q", "r1", T[1], None)],
        "set string, process string, run string, at timestamp, size int",
    )
    rows = [("s", "p", "r1", "f1", "a", 1), ("s", "p", "r1", "f1", "a", 1), ("s", "p", "r1", "f2", "b", None), ("s", "p", "r3", "f9", "z", 1), ("s", "p", "r2", "f2", "b", None), ("s", "p", "r2", "f3", "c", 3), ("s", None, "x", "f1", "a", 1), ("s", None, "y", "f1", "a", 2), ("s", "q", "r1", "f1", "a", 1)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "set string, process string, run string, id string, name string, line int, value string")

    def changes(a, b):
        return {(*r[:5], None if r[5] is None else tuple(r[5])) for r in snapshot_changes(a, b, ["set", "process"], "run", "at", "size", "id", ["name", "line"]).collect()}

    assert changes(runs, df) == {("s", "p", "r2", "f1", "removed", None), ("s", "p", "r2", "f3", "added", None), ("s", None, "y", "f1", "changed", ("line",))}
    assert changes(runs.limit(0), df) == set() and changes(runs, df.limit(0)) == set()


def test_snapshots_of_long_and_null_texts(spark):
    runs = spark.createDataFrame([("r1", T[0], 3), ("r2", T[1], 3)], "run string, at timestamp, size int")
    long = "x" * 100
    rows = [("r1", "a", long), ("r2", "a", long), ("r1", "b", long), ("r2", "b", long + "y"), ("r1", "c", None), ("r2", "c", "")]
    df = spark.createDataFrame(rows, "run string, id string, name string")
    got = snapshot_changes(runs.withColumn("s", F.lit(1)), df.withColumn("s", F.lit(1)), ["s"], "run", "at", "size", "id", ["name"])
    assert {(r["id"], r["change"], tuple(r["fields"])) for r in got.collect()} == {("b", "changed", ("name",)), ("c", "changed", ("name",))}


def test_several_parents(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), ("a", "y"), ("z", "z"), ("a", "z"), (None, "x")], "p string, c string")
    assert {tuple(r) for r in several_parents(df, "p", "c").collect()} == {("x", "a", "b"), ("x", "a", "c"), ("z", "z", "a")}


def test_hierarchy_of_hot_parents(spark, monkeypatch):
    import spanloom.operators.hierarchy as H
    import spanloom.operators.skew as skew

    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 0)
    monkeypatch.setattr(H, "ONE_TASK_ROWS", 0)
    edges = [("root", f"k{i}") for i in range(900)] + [("k7", f"m{i}") for i in range(300)] + [("m3", "end"), ("q", "p"), ("p", "q"), ("q", "r")]
    got = hierarchy(spark.createDataFrame(edges, "p string, c string"), "p", "c").collect()
    assert {r["node"]: (r["root"], r["depth"]) for r in got} == brute_hierarchy(edges)
    by = {r["node"]: r for r in got}
    assert (by["root"]["pre"], by["root"]["last"]) == (0, 1201) and sorted(r["pre"] for r in got if r["root"] == "root") == list(range(1202))
    assert {r["node"] for r in got if r["pre"] and by["k7"]["pre"] < r["pre"] <= by["k7"]["last"]} == {f"m{i}" for i in range(300)} | {"end"}


def test_written_rounds_are_removed(spark):
    import os

    from spanloom.session import Rounds, ensure_checkpoint_dir, release

    release(spark)
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    tables = lambda: {f"{d}/{x}" for d in os.listdir(root) if d.startswith("rounds") for x in os.listdir(f"{root}/{d}")}
    before = tables()
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(40)] + [("a", "b"), ("b", "a")], "p string, c string")
    df = hierarchy(edges, "p", "c")
    assert df.count() == 43 and len(tables() - before) == 8  # seven rounds down, each record in the one it ended in, and the cycles
    rounds = Rounds(spark)
    one = rounds.cut(spark.range(5), n=F.count(F.lit(1)))
    two = rounds.cut(one, one)
    assert one.measured == {"n": 5} and two.count() == 5 and rounds.live == [two._round_path]
    release(spark)
    assert tables() == before


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from spanloom.session import ensure_checkpoint_dir

    undefined = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", getConf=dict, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_hot_split_join_keeps_all_rows(spark, monkeypatch):
    import spanloom.operators.skew as skew

    monkeypatch.setattr(skew, "ONE_TASK_ROWS", 0)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("tag", F.concat(F.lit("t"), F.col("k").cast("string")))
    got = hot_split_join(rows, per, ["k"], "n", 1000, slots=8)
    assert got.count() == 1000 and got.where("tag <> concat('t', cast(k as string))").count() == 0
